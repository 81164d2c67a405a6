"""Event logs on ordinary tables: which column is the case, which the activity, which columns order a case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventLog:
    """Events with case_id, activity and the columns ``order``, which order each case totally; further columns are attributes.

    ``cases`` (case_id and trace attributes) is there if cases without events count too. ``flow`` is there if attributes cost
    joins: the same events, with case_id, activity and the columns of the order at least. ``whole`` is there if the source has
    each case in one row: the columns of ``cases``, ``trace`` and ``events``, the events in order with all their columns.
    """

    events: DataFrame
    order: tuple[str, ...]
    cases: DataFrame | None = None
    flow: DataFrame | None = None
    whole: DataFrame | None = None

    def select(self, *columns: str) -> EventLog:
        """Control flow and the attributes ``columns`` only."""
        kept = dict.fromkeys(["case_id", "activity", *self.order, *columns])
        return EventLog(self.events.select(*kept), self.order, self.cases and self.cases.select("case_id"))


def log_of(table: DataFrame, case: Column | str, activity: Column | str, order: tuple[str, ...], attributes: tuple[str, ...] = (), cases: DataFrame | None = None) -> EventLog:
    """A log on any table."""
    case, activity = (F.col(c) if isinstance(c, str) else c for c in (case, activity))
    kept = [c for c in dict.fromkeys([*order, *attributes])]
    return EventLog(table.select(case.cast("string").alias("case_id"), activity.cast("string").alias("activity"), *kept), tuple(order), cases)


def log_of_traces(spark: SparkSession, traces: list[list[str]]) -> EventLog:
    """A log of traces given in code, each a case by its number; empty ones stay."""
    rows = [(str(c), i, a) for c, t in enumerate(traces) for i, a in enumerate(t)]
    events = spark.createDataFrame(rows, "case_id string, pos int, activity string")
    return EventLog(events.select("case_id", "activity", "pos"), ("pos",), spark.createDataFrame([(str(c),) for c in range(len(traces))], "case_id string"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_days(spark: SparkSession, sf_dir: str) -> EventLog:
    """Events of a user and day."""
    case = F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return log_of(_read(spark, sf_dir, "events"), case, "event_type", ("ts", "event_id"), ("value", "props"))


def dialogues(spark: SparkSession, sf_dir: str) -> EventLog:
    """Turns of a conversation, the role as activity."""
    return log_of(_read(spark, sf_dir, "conversations"), "conv_id", "role", ("turn",), ("text",))


def customer_orders(spark: SparkSession, sf_dir: str) -> EventLog:
    """Orders of a customer, the priority as activity."""
    return log_of(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ("o_orderdate", "o_orderkey"), ("o_totalprice", "o_orderstatus"))


def order_lines(spark: SparkSession, sf_dir: str) -> EventLog:
    """Lines of an order by ship date; orders without a line are empty traces; order columns are trace attributes."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return log_of(_read(spark, sf_dir, "lineitem"), "l_orderkey", F.concat("l_returnflag", "l_linestatus"), ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"), ("l_quantity", "l_extendedprice"), orders)
