"""Object-centric logs: events related to objects of several types, flattened to the cases of one type."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import EventLog


@dataclass(frozen=True)
class ObjectLog:
    """events (event_id, event_type, ts, pos), objects (object_id, object_type, attributes), e2o (event_id, object_id, rel_pos).

    ``e2o`` may also have object_type, and event_type, ts and pos of the event; then no join is needed to know them.
    ``types``: the object types in the order of their declaration, where there is one.
    ``linked``: the events with ``links``, an array of (object_id, qualifier) in order, where the source has them in one row;
    then relations need no join with the events.
    """

    events: DataFrame
    objects: DataFrame
    e2o: DataFrame
    types: tuple[str, ...] = ()
    linked: DataFrame | None = None

    def object_type(self, wanted: str, needed: bool = True) -> str | None:
        """A type by its name, else by its place in the declaration; ValueError, or None if not ``needed``, if there is none."""
        types = self.types or tuple(r[0] for r in self.objects.select("object_type").distinct().orderBy("object_type").collect())  # a handful
        if wanted in types:
            return wanted
        if wanted.isdigit() and int(wanted) < len(types):
            return types[int(wanted)]
        if needed:
            raise ValueError(f"no object type {wanted!r} among {types}")
        return None

    def related(self, object_type: str) -> DataFrame:
        """Relations to the declared objects of a type, with the event's type, time and place."""
        e2o = self.e2o.where(F.col("object_type") == object_type) if "object_type" in self.e2o.columns else self.e2o
        if self.linked is not None and "event_type" not in e2o.columns:
            links = self.linked.select("event_id", "event_type", "pos", "ts", F.posexplode("links").alias("rel_pos", "l"))
            e2o = links.select("event_id", "event_type", "pos", "ts", "rel_pos", "l.object_id", "l.qualifier")
        declared = self.objects.where(F.col("object_type") == object_type).select("object_id")
        out = e2o.join(declared, "object_id", "left_semi")
        return out if "event_type" in out.columns else out.join(self.events.select("event_id", "event_type", "pos", "ts"), "event_id")


def flatten(log: ObjectLog, object_type: str) -> EventLog:
    """The traces of the objects of a type: each event once for each related object, in the stored order of events.

    An event that is related twice to an object stands once in its trace. Objects without events are empty traces;
    objects of other types are none. The events are dealt by object once, for this and for what groups them by case.
    """
    cases = log.objects.where(F.col("object_type") == object_type).withColumnRenamed("object_id", "case_id")
    events = log.related(object_type).select(F.col("object_id").alias("case_id"), F.col("event_type").alias("activity"), "pos", "event_id", "ts")
    return EventLog(events.repartition("case_id").dropDuplicates(["case_id", "event_id"]), ("pos", "event_id"), cases)


def event_resources(log: ObjectLog, object_type: str) -> DataFrame:
    """(event_id, resource): the last related object of a type, by place in the event."""
    return log.related(object_type).groupBy("event_id").agg(F.max_by("object_id", F.struct("rel_pos", "object_id")).alias("resource"))


def trace_lengths(log: ObjectLog, object_type: str) -> DataFrame:
    """(case_id, length) of the objects that have events."""
    flat = flatten(log, object_type)
    return flat.events.groupBy("case_id").agg(F.count("*").alias("length"))


def type_counts(log: ObjectLog) -> DataFrame:
    return log.objects.groupBy("object_type").agg(F.count("*").alias("cnt"))


def trace_attributes(log: ObjectLog, object_type: str) -> DataFrame:
    """(case_id, name, value): the attributes of the objects of a type as text, and their ``object-id``."""
    own = log.objects.where(F.col("object_type") == object_type)
    plain = [c for c in own.columns if c not in ("object_id", "object_type")]
    maps = [c for c, t in own.dtypes if t.startswith("map")]
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in plain if c not in maps]
    rows = F.concat(F.array(F.struct(F.lit("object-id").alias("name"), F.col("object_id").alias("value")), *pairs), *[F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))) for c in maps])
    return own.select(F.col("object_id").alias("case_id"), F.explode(rows).alias("a")).select("case_id", "a.name", "a.value").where("value IS NOT NULL")


def info(log: ObjectLog) -> DataFrame:
    """(metric, value): numbers of events, objects, event types and object types."""
    e = log.events.agg(F.count("*").cast("string").alias("n"), F.countDistinct("event_type").cast("string").alias("k"))
    o = log.objects.agg(F.count("*").cast("string").alias("n"), F.countDistinct("object_type").cast("string").alias("k"))
    tell = lambda d, c, name: d.select(F.lit(name).alias("metric"), F.col(c).alias("value"))
    return tell(e, "n", "events").union(tell(e, "k", "event types")).union(tell(o, "n", "objects")).union(tell(o, "k", "object types"))


def order_objects(spark: SparkSession, sf_dir: str) -> ObjectLog:
    """Order lines as events of orders, parts and suppliers. Relations lie by type, so that of one type only that is read."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.date_format("l_shipdate", "yyyy-MM-dd"))
    pos = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("#"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"))
    event = (key.alias("event_id"), F.concat("l_returnflag", "l_linestatus").alias("event_type"), F.col("l_shipdate").alias("ts"), pos.alias("pos"))
    kinds = [("order", "orders", "o_orderkey", "o_orderpriority", "l_orderkey"), ("part", "part", "p_partkey", "p_brand", "l_partkey"), ("supplier", "supplier", "s_suppkey", "s_name", "l_suppkey")]
    e2o, objects, links = [], [], []
    for i, (kind, table, id_, attribute, line) in enumerate(kinds):
        object_id = F.concat(F.lit(f"{kind}:"), F.col(line).cast("string")).alias("object_id")
        links.append(F.struct(object_id, F.lit(None).cast("string").alias("qualifier")))
        e2o.append(lines.select(*event, object_id, F.lit(kind).alias("object_type"), F.lit(i).alias("rel_pos")))
        objects.append(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.concat(F.lit(f"{kind}:"), F.col(id_).cast("string")).alias("object_id"), F.lit(kind).alias("object_type"), F.col(attribute).cast("string").alias("attribute")))
    return ObjectLog(lines.select(*event), reduce(DataFrame.unionByName, objects), reduce(DataFrame.unionByName, e2o), tuple(k[0] for k in kinds), lines.select(*event, F.array(*links).alias("links")))
