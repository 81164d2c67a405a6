"""Log operators: traces, variants, counts, start and end activities, lengths, filters, attributes, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import TYPED, as_numeric, as_time
from ..sources.tables import EventLog


def _with_cases(log: EventLog, *columns: str) -> DataFrame:
    """The ``columns`` of the order and activity of the events and a row of nulls for each known case, told apart by ``_case``: cases need no join then."""
    events = (log.events if log.flow is None else log.flow).select("case_id", *columns, F.lit(False).alias("_case"))
    return events if log.cases is None else events.unionByName(log.cases.select("case_id", F.lit(True).alias("_case")), allowMissingColumns=True)


def traces(log: EventLog) -> DataFrame:
    """(case_id, trace: array of activities); with ``cases`` also the empty traces, and events of no known case don't count."""
    if log.whole is not None:
        return log.whole.select("case_id", "trace")
    item = F.when(~F.col("_case"), F.struct(*log.order, "activity"))
    trace = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["activity"]).alias("trace")
    out = _with_cases(log, *dict.fromkeys([*log.order, "activity"])).groupBy("case_id").agg(trace, F.max("_case").alias("_known"))
    return (out if log.cases is None else out.where("_known")).select("case_id", "trace")


def traces_of_cases(log: EventLog) -> DataFrame:
    """The :func:`traces` of the known cases with the cases' attributes."""
    return traces(log).join(log.cases, "case_id") if log.whole is None else log.whole.drop("events")


def events_of_cases(log: EventLog) -> DataFrame:
    """The events of the known cases, each with its case's attributes as a column ``case``."""
    case = F.struct(*[c for c in log.cases.columns if c != "case_id"]).alias("case")
    if log.whole is None:
        return log.events.join(log.cases.select("case_id", case), "case_id")
    # an inner explode would have the events made twice, once to see whether there are any
    return log.whole.select("case_id", case, F.explode_outer("events").alias("e")).where("e IS NOT NULL").select("case_id", "case", "e.*")


def variants(log: EventLog) -> DataFrame:
    """(trace, cnt): the distinct traces; most questions about a log are questions about these."""
    return traces(log).groupBy("trace").agg(F.count("*").alias("cnt"))


def counts(log: EventLog) -> DataFrame:
    """n_traces and n_events, with multiplicity; empty traces count where the log knows its cases."""
    events = log.events.agg(F.count("*").alias("n_events"), F.countDistinct("case_id").alias("with_events"))
    if log.cases is None:
        return events.select(F.col("with_events").alias("n_traces"), "n_events")
    return log.cases.agg(F.count("*").alias("n_traces")).join(events.select("n_events"))


def start_activities(log: EventLog) -> DataFrame:
    """(activity, cnt) of first events; aggregated per task before the shuffle."""
    first = log.events.groupBy("case_id").agg(F.min_by("activity", F.struct(*log.order)).alias("activity"))
    return first.groupBy("activity").agg(F.count("*").alias("cnt"))


def end_activities(log: EventLog) -> DataFrame:
    """(activity, cnt) of last events."""
    last = log.events.groupBy("case_id").agg(F.max_by("activity", F.struct(*log.order)).alias("activity"))
    return last.groupBy("activity").agg(F.count("*").alias("cnt"))


def trace_lengths(log: EventLog) -> DataFrame:
    """(case_id, length)."""
    out = _with_cases(log).groupBy("case_id").agg(F.count(F.when(~F.col("_case"), 1)).alias("length"), F.max("_case").alias("_known"))
    return (out if log.cases is None else out.where("_known")).select("case_id", "length")


def trace_length_stats(log: EventLog) -> DataFrame:
    """min, max, and the exact mean as n_events / n_traces."""
    a = trace_lengths(log).agg(F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.sum("length").alias("n_events"), F.count("*").alias("n_traces"))
    return a.select("min_length", "max_length", "n_events", "n_traces", (F.col("n_events") / F.col("n_traces")).alias("avg_length"))


def trace_length_histogram(log: EventLog) -> DataFrame:
    return trace_lengths(log).groupBy("length").agg(F.count("*").alias("cnt"))


def activity_frequency(log: EventLog) -> DataFrame:
    return log.events.groupBy("activity").agg(F.count("*").alias("cnt"))


def top_activities(log: EventLog, n: int = 20) -> DataFrame:
    """The first ``n`` labels in alphabetical order with their frequency, as a profile lists them."""
    return activity_frequency(log).orderBy("activity").limit(n)


def attempt_labels(log: EventLog, labels: DataFrame) -> DataFrame:
    """(case_id, trace): the traces in terms of ``labels`` (activity); null where a label isn't among them."""
    known = log.events.join(labels.select("activity", F.lit(True).alias("_known")).distinct(), "activity", "left")
    bad = known.where("_known IS NULL").select("case_id", F.lit(True).alias("_bad")).distinct()
    return traces(log).join(bad, "case_id", "left").select("case_id", F.when(F.col("_bad").isNull(), F.col("trace")).alias("trace"))


def retain_traces(log: EventLog, condition: Column) -> EventLog:
    """The traces for which ``condition`` over the column ``trace`` (an array) and the case's attributes holds."""
    t = traces(log) if log.cases is None else traces_of_cases(log)
    kept = t.where(condition).select("case_id")
    return EventLog(log.events.join(kept, "case_id", "left_semi"), log.order, None if log.cases is None else log.cases.join(kept, "case_id", "left_semi"))


def _field(name: str):
    return lambda x: x[name]


def retain_traces_by_events(log: EventLog, condition: Column, attributes: tuple[str, ...]) -> EventLog:
    """The traces for which ``condition`` over ``trace``, the case's attributes and the arrays of event ``attributes`` holds."""
    item = F.struct(*log.order, *[F.col(c).alias(f"_{c}") for c in attributes])
    arrays = log.events.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("_e")).select("case_id", *[F.transform("_e", _field(f"_{c}")).alias(c) for c in attributes])
    t = traces(log).join(arrays, "case_id", "left")
    if log.cases is not None:
        t = t.join(log.cases, "case_id")
    kept = t.where(condition).select("case_id")
    return EventLog(log.events.join(kept, "case_id", "left_semi"), log.order, None if log.cases is None else log.cases.join(kept, "case_id", "left_semi"))


def positions(log: EventLog) -> DataFrame:
    """The events with ``pos``, from 0 within each case."""
    by = Window.partitionBy("case_id").orderBy(*log.order)
    return log.events.withColumn("pos", F.row_number().over(by) - 1)


def event_attribute(log: EventLog, name: str, kind: str) -> DataFrame:
    """(case_id, pos, activity, value) of an event attribute read as ``kind``."""
    type_ = dict(log.events.dtypes)[name]
    return positions(log).select("case_id", "pos", "activity", TYPED[kind](F.col(name), type_).alias("value"))


def trace_attribute(log: EventLog, name: str, kind: str) -> DataFrame:
    """(case_id, value) of a trace attribute read as ``kind``."""
    type_ = dict(log.cases.dtypes)[name]
    return log.cases.select("case_id", TYPED[kind](F.col(name), type_).alias("value"))


def attribute_profile(log: EventLog, names: tuple[str, ...]) -> DataFrame:
    """For each attribute: its kind (Categorical, Numerical, Time, Undefined) and the least and greatest value as text.

    The first value decides and the others must agree: all numbers, all times, or a first value that is plain text and
    only texts after it. A first value of null leaves the kind undefined. Attributes come in the order of their names.
    """
    types = dict(log.events.dtypes)
    entry = [F.struct(F.lit(n).alias("attribute"), F.col(n).cast("string").alias("text"), as_numeric(F.col(n), types[n]).alias("num"), as_time(F.col(n), types[n]).alias("time"), F.lit(types[n] == "string").alias("is_text")) for n in names]
    place = F.struct("case_id", *log.order)
    rows = log.events.select(place.alias("place"), F.explode(F.array(*entry)).alias("e")).select("place", "e.*")
    a = rows.groupBy("attribute").agg(F.count("text").alias("n"), F.count("num").alias("n_num"), F.count("time").alias("n_time"), F.min_by(F.struct("text", "num", "time", "is_text"), "place").alias("first"), F.min("num").alias("min_num"), F.max("num").alias("max_num"), F.min("time").alias("min_time"), F.max("time").alias("max_time"))
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    kind = F.when(F.col("first.num").isNotNull() & (F.col("n_num") == F.col("n")), "Numerical").when(F.col("first.time").isNotNull() & (F.col("n_time") == F.col("n")), "Time").when(F.col("first.text").isNotNull() & F.col("first.num").isNull() & F.col("first.time").isNull() & F.col("first.is_text"), "Categorical").otherwise("Undefined")
    a = a.withColumn("kind", kind)
    pick = lambda num, time: F.when(F.col("kind") == "Numerical", F.round(num, 6).cast("string")).when(F.col("kind") == "Time", F.date_format(time, fmt))
    return a.select("attribute", "kind", "n", pick("min_num", "min_time").alias("least"), pick("max_num", "max_time").alias("greatest")).orderBy("attribute")
