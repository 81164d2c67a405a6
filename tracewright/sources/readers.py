"""Readers of event data as DataFrames: CSV, XES, object-centric XML, executions; gzipped files are read as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.objects import ObjectLog, event_resources, flatten
from .tables import EventLog


def _column(columns: list[str], wanted: str, what: str, needed: bool) -> str | None:
    """A column by its name, else by its index."""
    if wanted in columns:
        return wanted
    if wanted.isdigit() and int(wanted) < len(columns):
        return columns[int(wanted)]
    if needed:
        raise ValueError(f"no {what} column {wanted!r} among {columns}")
    return None


def _by_number(file: Column) -> Column:
    """A file's name such that a number at its end counts as a number: the tenth file comes after the ninth."""
    name = F.substring_index(file, "/", -1)  # the number is in here, which is shorter to look through
    padded = F.regexp_replace(name, r"(\d+)((?:\.[^/]*)?)$", "0" * 19 + "$1$2")
    return F.concat(F.substring(file, F.lit(1), F.length(file) - F.length(name)), F.regexp_replace(padded, r"0*(\d{20})((?:\.[^/]*)?)$", "$1$2"))


def read_csv(spark: SparkSession, path: str, case: str = "0", activity: str = "1", resource: str | None = None, time: str | None = None, header: bool = True, separator: str = ",", quote: str = '"', lines: bool = False) -> EventLog:
    """A log in CSV, all cells text. Columns are given by name or index; rows of a case keep their order in the file.

    ``lines`` says that cells may hold line breaks: a file is one task then; without it, large files are read in parts.

    Resource and time default to the columns 2 and 3 if there are such; given explicitly they must exist. Fewer than two
    columns or two rows, and separators or quotes of more than one byte, are errors.
    """
    for what, value in (("separator", separator), ("quote", quote)):
        if len(value.encode()) != 1:
            raise ValueError(f"the {what} must be one byte")
    table = spark.read.csv(path, header=header, sep=separator, quote=quote, escape=quote, multiLine=lines, inferSchema=False, enforceSchema=False)
    if len(table.columns) < 2:
        raise ValueError("a log needs two columns at least")
    if len(table.take(2)) < 2:
        raise ValueError("a log needs two events at least")
    names = {"case_id": _column(table.columns, case, "case", True), "activity": _column(table.columns, activity, "activity", True), "resource": _column(table.columns, resource or "2", "resource", resource is not None), "time": _column(table.columns, time or "3", "time", time is not None)}
    attributes = F.create_map(*[x for c in table.columns for x in (F.lit(c), F.col(f"`{c}`"))])
    # the order within files, whatever parts they're read in; files follow one another by name and number
    place = F.struct(_by_number(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    events = table.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in names.items()], attributes.alias("attributes"), place.alias("place"))
    return EventLog(events, ("place",))


_TYPES = ("string", "date", "int", "float", "boolean", "id")
_ATTRIBUTE = "array<struct<_key:string,_value:string>>"
_PLAIN = ",".join(f"{t}:{_ATTRIBUTE}" for t in _TYPES)
#: lists and containers hold attributes, also below ``values``; two levels of them are read
_INNER = f"array<struct<_key:string,{_PLAIN},values:struct<{_PLAIN}>>>"
_OUTER = f"array<struct<_key:string,{_PLAIN},list:{_INNER},container:{_INNER},values:struct<{_PLAIN},list:{_INNER},container:{_INNER}>>>"
_FIELDS = f"{_PLAIN},list:{_OUTER},container:{_OUTER}"


#: the value of an attribute element of each type; lists and containers as JSON of what they hold
_VALUES: dict[str, Callable[[Column], Column]] = dict.fromkeys(_TYPES, lambda x: x["_value"]) | dict.fromkeys(("list", "container"), lambda x: F.to_json(x.dropFields("_key")))


def _value_of(of: Callable[[str], Column], key: str) -> Column:
    """The value that a ``key`` has in :func:`_attributes`, without the map: the last one of the last type that has it."""

    def last(type_: str) -> Column:
        own = F.filter(of(type_), lambda x: x["_key"] == key)
        return F.try_element_at(F.transform(own, lambda x: F.struct(_VALUES[type_](x).alias("value"))), F.lit(-1))

    return F.coalesce(*[last(t) for t in reversed(_VALUES)])["value"]


def _attributes(of: Callable[[str], Column]) -> Column:
    """A map of key to {type, value} over all attribute elements of a node; lists and containers as JSON of what they hold."""

    def pair(type_: str, value: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["_key"].alias("key"), F.struct(F.lit(type_).alias("type"), value(x).alias("value")).alias("value"))

    parts = [F.coalesce(F.transform(of(t), pair(t, value)), F.lit([]).cast("array<struct<key:string,value:struct<type:string,value:string>>>")) for t, value in _VALUES.items()]
    # of a key that stands twice the last one counts; without such keys the map is made at once
    kind = "map<string,struct<type:string,value:string>>"
    last = lambda e: F.aggregate(e, F.create_map().cast(kind), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: k != x["key"]), F.map_from_entries(F.array(x))).cast(kind))
    once = lambda e: F.size(F.array_distinct(F.transform(e, lambda x: x["key"]))) == F.size(e)
    return F.transform(F.array(F.flatten(F.array(*parts))), lambda e: F.when(once(e), F.map_from_entries(e).cast(kind)).otherwise(last(e)))[0]


def read_xes(spark: SparkSession, path: str, classifier: str | tuple[str, ...] = "concept:name", resource: str = "org:resource", time: str = "time:timestamp") -> EventLog:
    """A log in XES: events with activity, resource, ts and an attribute map; cases with theirs; traces without events stay.

    A classifier of several keys gives activities of the values joined with ``+``. A file without traces must be a log
    nevertheless. A case's number follows from the files and how they're dealt to tasks, whatever is read of them, so it is the same in
    cases and events; who reads cases only has no events made, and ``whole`` gives both in one pass.
    """
    schema = ", ".join(f"`{f.split(':', 1)[0]}` {f.split(':', 1)[1]}" for f in (*(f"{t}:{_ATTRIBUTE}" for t in _TYPES), f"list:{_OUTER}", f"container:{_OUTER}")) + f", event array<struct<{_FIELDS}>>"
    rows = spark.read.format("xml").option("rowTag", "trace").schema(schema).load(path)
    if not spark.read.text(path).where("value LIKE '%<log%'").take(1):
        raise ValueError("no XES log")
    # names need not be unique, so a case is known by its place
    place = F.concat_ws("#", F.regexp_extract(F.input_file_name(), "[^/]*$", 0), F.monotonically_increasing_id().cast("string"))
    events_of = F.transform(F.coalesce("event", F.lit([]).cast(f"array<struct<{_FIELDS}>>")), lambda e: _attributes(lambda t: e[t]))
    trace = rows.select(place.alias("case_id"), _attributes(F.col).alias("attributes"), events_of.alias("event"), F.col("event").alias("raw"))
    keys = (classifier,) if isinstance(classifier, str) else classifier

    def activity_of(value: Callable[[str], Column]) -> Column:
        return value(keys[0]) if len(keys) == 1 else F.concat_ws("+", *[F.coalesce(value(k), F.lit("")) for k in keys])

    def columns(own: Column) -> dict[str, Column]:
        value = lambda k: own[k]["value"]
        return {"activity": activity_of(value), "resource": value(resource), "ts": F.try_to_timestamp(value(time)), "attributes": own}

    c = columns(F.col("attributes"))
    # an inner explode would have the events made twice, once to see whether there are any
    events = trace.select("case_id", F.posexplode_outer("event").alias("pos", "attributes")).where("pos IS NOT NULL").select("case_id", c["activity"].alias("activity"), "pos", c["resource"].alias("resource"), c["ts"].alias("ts"), "attributes")
    activities = F.transform(F.coalesce("raw", F.lit([]).cast(f"array<struct<{_FIELDS}>>")), lambda e: activity_of(lambda k: _value_of(lambda t: e[t], k)))
    rows_of = F.transform("event", lambda own, i: F.struct(i.alias("pos"), *[x.alias(n) for n, x in columns(own).items()]))
    whole = trace.select("case_id", "attributes", activities.alias("trace"), rows_of.alias("events"))
    return EventLog(events, ("pos",), trace.select("case_id", "attributes"), whole=whole)


def read_ocel(spark: SparkSession, path: str) -> ObjectLog:
    """An object-centric log in XML, a file or a folder of files: types, objects, events in stored order, what relates them.

    Files follow one another by name, and by the number at its end: a task of Spark's writers numbers its files without
    leading zeros from the thousandth on.
    """
    relation = "struct<relationship:array<struct<`_object-id`:string,_qualifier:string>>>"
    attribute = "struct<attribute:array<struct<_name:string,_time:string,_VALUE:string>>>"
    source = spark.read.format("xml").option("recursiveFileLookup", "true")
    place = F.struct(_by_number(F.input_file_name()).alias("file"), F.monotonically_increasing_id().alias("row"))
    types = source.option("rowTag", "object-type").schema("_name string").load(path).where("_name IS NOT NULL").withColumn("place", place).collect()  # a handful, so they're sorted here: a sort of Spark's reads the files twice
    objects = source.option("rowTag", "object").schema(f"_id string, _type string, attributes {attribute}").load(path)
    events = source.option("rowTag", "event").schema(f"_id string, _type string, _time string, attributes {attribute}, objects {relation}").load(path).where("_id IS NOT NULL").withColumn("pos", place)
    as_map = F.map_from_entries(F.array_distinct(F.transform(F.coalesce("attributes.attribute", F.lit([]).cast("array<struct<_name:string,_time:string,_VALUE:string>>")), lambda a: F.struct(a["_name"], a["_VALUE"]))))
    e2o = events.select(F.col("_id").alias("event_id"), F.posexplode("objects.relationship").alias("rel_pos", "r")).select("event_id", F.col("r.`_object-id`").alias("object_id"), F.col("r._qualifier").alias("qualifier"), "rel_pos")
    own = (F.col("_id").alias("event_id"), F.col("_type").alias("event_type"), F.try_to_timestamp("_time").alias("ts"), "pos", as_map.alias("attributes"))
    links = F.transform("objects.relationship", lambda r: F.struct(r["_object-id"].alias("object_id"), r["_qualifier"].alias("qualifier")))
    things = objects.where("_id IS NOT NULL").select(F.col("_id").alias("object_id"), F.col("_type").alias("object_type"), as_map.alias("attributes"))
    return ObjectLog(events.select(*own), things, e2o, tuple(dict.fromkeys(r["_name"] for r in sorted(types, key=lambda r: tuple(r["place"])))), events.select(*own, links.alias("links")))


def read_ocel_log(spark: SparkSession, path: str, case_type: str = "0", resource_type: str | None = None, time: str = "time") -> EventLog:
    """The log of one object type of an object-centric file, with resource and time of each event.

    Types are given by name or by their place in the declaration. The case type must exist, and so must the resource type
    where it's given; else the type at place 1 counts, if there is one. ``time`` is the event's own time or an attribute.
    """
    log = read_ocel(spark, path)
    case = log.object_type(case_type)
    resource = log.object_type(resource_type or "1", resource_type is not None)
    flat = flatten(log, case)
    given = log.events.select("event_id", (F.col("ts") if time == "time" else F.try_to_timestamp(F.col("attributes")[time])).alias("ts"))
    events = flat.events.drop("ts").join(given, "event_id", "left")
    none = F.lit(None).cast("string")
    events = events.join(event_resources(log, resource), "event_id", "left") if resource else events.withColumn("resource", none)
    return EventLog(events, flat.order, flat.cases, flow=flat.events)


EXECUTION = "trace long, move_index long, activity string, also_in_log boolean, fired_transition long, other_enabled_transitions array<long>, move_index_of_enablement long, time_of_execution string, resource string, resource_utilisation_fired_transition string, other_enabled_transitions_resource_utilisation array<string>, event_attributes map<string,string>"


def read_executions(spark: SparkSession, path: str) -> DataFrame:
    """Executions in JSON, one row each; times with their offset become instants, whether a ``T`` or a blank stands between
    date and time and however many digits seconds have. Text that is no time is an error."""
    fields = ",".join(f"{n}:{t}" for n, t in (f.strip().split(" ", 1) for f in EXECUTION.replace("map<string,string>", "map<string;string>").split(",")))
    fields = fields.replace("map<string;string>", "map<string,string>")
    rows = spark.read.schema(f"executions array<struct<{fields}>>").json(path, multiLine=True).select(F.inline("executions"))
    time = F.col("time_of_execution")
    read = F.coalesce(F.try_to_timestamp(time, F.lit("yyyy-MM-dd HH:mm:ss XXX")), F.try_to_timestamp(time))
    wrong = F.raise_error(F.concat(F.lit("no time: "), time)).cast("timestamp")
    return rows.withColumn("time_of_execution", F.when(time.isNotNull() & read.isNull(), wrong).otherwise(read))
