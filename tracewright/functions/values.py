"""Scalar functions: typed access to attributes, names in net files, sizes of numbers."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_categorical(value: Column, type_: str) -> Column:
    """Typed access: text and numbers as text, booleans too; dates have no category."""
    return F.lit(None).cast("string") if type_.startswith(("timestamp", "date")) else value.cast("string")


def as_time(value: Column, type_: str) -> Column:
    """Dates as they are, text that reads as one; numbers have no time."""
    if type_.startswith(("timestamp", "date")):
        return value.cast("timestamp")
    return F.try_to_timestamp(value) if type_ == "string" else F.lit(None).cast("timestamp")


def as_numeric(value: Column, type_: str) -> Column:
    """Numbers, and text that reads as a decimal or a fraction such as ``1/5``."""
    if type_ in ("int", "bigint", "smallint", "tinyint", "float", "double") or type_.startswith("decimal"):
        return value.cast("double")
    if type_ != "string":
        return F.lit(None).cast("double")
    parts = F.split(value, "/")
    fraction = F.try_divide(F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double"))
    return F.coalesce(value.try_cast("double"), F.when(F.size(parts) == 2, fraction))


TYPED = {"categorical": as_categorical, "time": as_time, "numeric": as_numeric}


#: fixed codes of characters that names in LoLA files can't hold; the full stop comes first, as it marks the others
LOLA_CODES = ((".", ".p"), (",", ".c"), (";", ".x"), ("(", ".l"), (")", ".q"), ("{", ".u"), ("}", ".d"), ("\t", ".t"), ("\n", ".n"), ("\r", ".r"), (" ", ".s"))


def lola_name(label: str) -> str:
    """A label as a name in a LoLA file."""
    for plain, code in LOLA_CODES:
        label = label.replace(plain, code)
    return label


def lola_label(name: str) -> str:
    """The label of :func:`lola_name`."""
    of = {code[1]: plain for plain, code in LOLA_CODES}
    out, at = [], 0
    while at < len(name):
        coded = name[at] == "." and at + 1 < len(name) and name[at + 1] in of
        out.append(of[name[at + 1]] if coded else name[at])
        at += 2 if coded else 1
    return "".join(out)


def lola_names(labels: Column) -> Column:
    for plain, code in LOLA_CODES:
        labels = F.replace(labels, F.lit(plain), F.lit(code))
    return labels


def significant_bits(number: Fraction) -> int:
    """Bits of the larger of numerator and denominator."""
    return max(abs(number.numerator).bit_length(), number.denominator.bit_length())


def a_kind(name: str) -> str:
    """The name of a kind of object with its article."""
    return f"{'an' if name[:1].lower() in 'aeio' else 'a'} {name}"
