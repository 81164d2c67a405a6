"""Alignments and executions as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import EventLog
from .graphs import prefix_name
from .logs import positions

#: move kinds in the order in which moves are sorted
KINDS = ("log move", "model move", "synchronous move", "silent move")


def moves_against_graph(log: EventLog, dfg: DataFrame) -> DataFrame:
    """(case_id, pos, move_type, activity, transition): synchronous if the graph has the step from the event before, else a log move.

    ``transition`` is the name of the step taken, the name of the array of its source and target; log moves have none.
    """
    by = Window.partitionBy("case_id").orderBy(*log.order)
    steps = log.events.select("case_id", (F.row_number().over(by) - 1).alias("pos"), F.lag("activity").over(by).alias("source"), "activity")
    known = dfg.where("kind IN ('edge', 'start')").select(F.col("source").alias("s"), F.col("target").alias("t"))
    met = steps.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("activity") == F.col("t")), "left")
    return met.select("case_id", "pos", F.when(F.col("t").isNull(), KINDS[0]).otherwise(KINDS[2]).alias("move_type"), "activity", F.when(F.col("t").isNotNull(), prefix_name(F.array("s", "t"))).alias("transition"))


def move_counts(moves: DataFrame) -> DataFrame:
    """(move_type, cnt) in the order of the kinds."""
    return moves.groupBy("move_type").agg(F.count("*").alias("cnt"))


def sort_alignments(moves: DataFrame) -> DataFrame:
    """(case_id, moves): alignments in order, each an array of (kind, activity)."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("move_type"))
    own = moves.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", kind.alias("kind"), "activity"))).alias("m"))
    return own.select("case_id", F.transform("m", lambda x: F.struct(x["kind"], x["activity"])).alias("moves")).orderBy("moves")


def executions(log: EventLog, time: str, resource: str | None = None, dfg: DataFrame | None = None) -> DataFrame:
    """One row per event, with the fields of an execution.

    With a graph, ``fired_transition`` is the step from the event before, ``other_enabled_transitions`` are the other steps
    that the graph has from there, and ``also_in_log`` tells whether the graph has the step; without one the first two are
    empty. An event is enabled by the event before it. Utilisations are the resource's share of the case's events so far.
    """
    by = Window.partitionBy("case_id").orderBy(*log.order)
    e = positions(log).withColumn("source", F.lag("activity").over(by))
    who = F.col(resource).cast("string") if resource else F.lit(None).cast("string")
    e = e.withColumn("resource", who)
    if dfg is None:
        steps = e.withColumns({"known": F.lit(True), "fired_transition": F.lit(None).cast("string"), "other_enabled_transitions": F.array().cast("array<string>")})
    else:
        # the steps of one activity are as many as there are activities at most
        known = dfg.where("kind IN ('edge', 'start') AND weight > 0").groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_set("target")).alias("targets"))
        met = e.join(known, F.col("source").eqNullSafe(F.col("s")), "left")
        name = lambda t: prefix_name(F.array(F.col("source"), t))
        has = F.coalesce(F.array_contains("targets", F.col("activity")), F.lit(False))
        others = F.transform(F.array_remove(F.coalesce("targets", F.array().cast("array<string>")), F.col("activity")), name)
        steps = met.withColumns({"known": has, "fired_transition": F.when(has, name(F.col("activity"))), "other_enabled_transitions": others})
    so_far = Window.partitionBy("case_id", "resource").orderBy("pos")
    share = F.when(F.col("resource").isNotNull(), F.concat(F.row_number().over(so_far).cast("string"), F.lit("/"), (F.col("pos") + 1).cast("string")))
    none = F.transform("other_enabled_transitions", lambda _: F.lit(None).cast("string"))
    return steps.select(F.col("case_id").alias("trace"), F.col("pos").alias("move_index"), "activity", F.col("known").alias("also_in_log"), "fired_transition", "other_enabled_transitions", F.when(F.col("pos") > 0, F.col("pos") - 1).alias("move_index_of_enablement"), F.col(time).alias("time_of_execution"), "resource", share.alias("resource_utilisation_fired_transition"), none.alias("other_enabled_transitions_resource_utilisation"))
