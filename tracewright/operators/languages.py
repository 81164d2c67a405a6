"""Finite languages (distinct traces) and finite stochastic languages (traces with probabilities as num / den)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import EventLog
from .logs import traces, variants


def language(log: EventLog) -> DataFrame:
    """(trace): the distinct traces of a log."""
    return traces(log).select("trace").distinct()


def stochastic_language(log: EventLog) -> DataFrame:
    """(trace, num, den, probability): each variant's share of the traces; an empty log gives an empty language."""
    v = variants(log)
    total = v.agg(F.sum("cnt").alias("den"))
    return v.join(F.broadcast(total)).select("trace", F.col("cnt").alias("num"), "den", (F.col("cnt") / F.col("den")).alias("probability"))


def normalise(slang: DataFrame) -> DataFrame:
    """Probabilities divided by their sum; an empty language stays as it is."""
    total = slang.agg(F.sum("num").alias("den"))
    return slang.select("trace", "num").join(F.broadcast(total)).select("trace", "num", "den", (F.col("num") / F.col("den")).alias("probability"))


def probability_sum(slang: DataFrame) -> DataFrame:
    """n_traces, the mass as num / den, and whether it is at most 1."""
    return slang.agg(F.count("*").alias("n_traces"), F.coalesce(F.sum("num"), F.lit(0)).alias("num"), F.max("den").alias("den")).select("n_traces", "num", "den", F.coalesce(F.col("num") <= F.col("den"), F.lit(True)).alias("at_most_one"))


def push(slang: DataFrame, more: DataFrame) -> DataFrame:
    """Probability mass of both, trace by trace, over a common denominator; mass that isn't positive is an error."""
    wrong = F.raise_error(F.lit("a trace's mass must be positive")).cast("bigint")
    rows = slang.select("trace", "num", "den").unionByName(more.select("trace", F.when(F.col("num") > 0, F.col("num")).otherwise(wrong).alias("num"), "den"))
    # the denominators of two languages are two numbers
    common = rows.agg(F.collect_set("den").alias("dens")).select(F.aggregate("dens", F.lit(1).cast("bigint"), lambda acc, d: _lcm(acc, d)).alias("all"))
    scaled = rows.join(F.broadcast(common)).select("trace", F.expr("num * (all div den)").alias("num"), F.col("all").alias("den"))
    return scaled.groupBy("trace", "den").agg(F.sum("num").alias("num")).select("trace", "num", "den", (F.col("num") / F.col("den")).alias("probability"))


def _lcm(a: Column, b: Column) -> Column:
    """The least common multiple of two positive numbers, by Euclid's steps."""
    start = F.struct(a.alias("x"), b.alias("y"))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, lambda acc, _: F.when(acc["y"] == 0, acc).otherwise(F.struct(acc["y"].alias("x"), (acc["x"] % F.when(acc["y"] == 0, F.lit(1)).otherwise(acc["y"])).alias("y"))), lambda acc: acc["x"])
    return (a / gcd).cast("bigint") * b


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("trace").unionByName(b.select("trace")).distinct()


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Traces whose probabilities differ between two stochastic languages; none: they are equal."""
    x, y = a.select("trace", F.col("num").alias("na"), F.col("den").alias("da")), b.select("trace", F.col("num").alias("nb"), F.col("den").alias("db"))
    return x.join(y, "trace", "full_outer").where("na IS NULL OR nb IS NULL OR na * db <> nb * da")


def lengths(lang: DataFrame) -> DataFrame:
    """n_traces and n_events of the distinct traces."""
    return lang.agg(F.count("*").alias("n_traces"), F.coalesce(F.sum(F.size("trace")), F.lit(0)).alias("n_events"))
