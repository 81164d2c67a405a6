"""Partially ordered runs as tables: one row per node, with the nodes right before it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise


def contract(nodes: list[tuple[int, str | None, list[int]]]) -> list[tuple[str, tuple[int, ...]]]:
    """The events of a run of ``nodes`` (number, activity or None, numbers before it): (activity, places of the events before).

    Nodes take place in rounds by number, each once all before it have. Silent ones go; what comes after them follows the
    nearest events that came before them. A cycle, or a node that isn't there, is an error.
    """
    left = sorted(nodes, key=lambda n: n[0])
    placed: dict[int, frozenset[int]] = {}  # the nearest events that a node stands for: itself, or what is before it
    out: list[tuple[str, tuple[int, ...]]] = []
    while left:
        later = []
        for number, activity, before in left:
            if all(b in placed for b in before):
                events = frozenset().union(*(placed[b] for b in before))
                if activity is None:
                    placed[number] = events
                else:
                    placed[number] = frozenset([len(out)])
                    out.append((activity, tuple(sorted(events))))
            else:
                later.append((number, activity, before))
        if len(later) == len(left):
            raise ValueError("a run with a cycle, or with a node that isn't there")
        left = later
    return out


_EVENTS = "array<struct<activity:string,predecessors:array<int>>>"


def _nodes_of(nodes: DataFrame) -> DataFrame:
    """(run_id, nodes): each run in one row, its nodes by number, so that runs alike have the same array."""
    node = F.struct(F.col("node").cast("int").alias("node"), "activity", F.coalesce("predecessors", F.array()).cast("array<int>").alias("before"))
    return nodes.groupBy("run_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))


#: characters of the kinds of runs that a task remembers; beyond them it starts afresh
_REMEMBERED = 8_000_000


def _contracted(rows: DataFrame) -> DataFrame:
    """``rows`` (key, nodes) as (key, events), in batches; a kind of run is contracted once in a task, as long as it's remembered.

    Runs go to Python as text, which is read for new kinds only.
    """
    schema = pa.schema([("key", pa.string()), ("events", pa.list_(pa.struct([("activity", pa.string()), ("predecessors", pa.list_(pa.int32()))])))])
    most = _REMEMBERED

    def events_of(text: str) -> list[dict]:
        return [{"activity": a, "predecessors": list(before)} for a, before in contract([(n["node"], n.get("activity"), n["before"]) for n in json.loads(text)])]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        found, size = pa.array([], schema.field("events").type), 0
        for batch in batches:
            texts = batch.column("text").dictionary_encode()
            kinds = texts.dictionary.to_pylist()
            new = [t for t in kinds if t not in place]
            if size and size + sum(map(len, new)) > most:
                place, found, size, new = {}, found.slice(0, 0), 0, kinds
            if new:
                place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                found, size = pa.concat_arrays([found, pa.array([events_of(t) for t in new], found.type)]), size + sum(map(len, new))
            at = pa.array([place[t] for t in kinds], pa.int64()).take(texts.indices)
            yield pa.RecordBatch.from_arrays([batch.column("key"), found.take(at)], schema=schema)

    return rows.select(F.col("key").cast("string").alias("key"), F.to_json("nodes").alias("text")).mapInArrow(step, f"key string, events {_EVENTS}")


def contract_runs(nodes: DataFrame) -> DataFrame:
    """(run_id, event, activity, predecessors): the partially ordered traces of ``nodes`` (run_id, node, activity, predecessors).

    Null activities are silent. A run is brought together in one row, as a trace is; batches of runs are contracted.
    """
    whole = _contracted(_nodes_of(nodes).withColumnRenamed("run_id", "key"))
    return whole.select(F.col("key").alias("run_id"), F.posexplode("events").alias("event", "e")).select("run_id", "event", "e.activity", "e.predecessors")


def _with_shares(distinct: DataFrame) -> DataFrame:
    return distinct.join(F.broadcast(distinct.agg(F.sum("cnt").alias("all")))).select("events", "cnt", (F.col("cnt") / F.col("all")).alias("probability"))


def partial_language(traces: DataFrame) -> DataFrame:
    """(events, cnt, probability): the distinct partially ordered traces of ``traces`` with their shares."""
    own = traces.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event", "activity", "predecessors"))), lambda e: F.struct(e["activity"].alias("activity"), e["predecessors"].alias("predecessors"))).alias("events"))
    return _with_shares(own.groupBy("events").agg(F.count("*").alias("cnt")))


def partial_language_of_runs(nodes: DataFrame) -> DataFrame:
    """The :func:`partial_language` of :func:`contract_runs`: runs alike are counted first, and each kind is contracted once.

    Kinds of runs are written once, as what is asked of a language reads it several times.
    """
    kinds = _nodes_of(nodes).groupBy("nodes").agg(F.count("*").alias("key"))
    distinct = _contracted(kinds).where("size(events) > 0").groupBy("events").agg(F.sum(F.col("key").cast("long")).alias("cnt"))
    return _with_shares(materialise(distinct, "runs"))


def partial_language_stats(language: DataFrame) -> DataFrame:
    """n_traces, n_events, n_edges, n_activities and the sum of the probabilities of a :func:`partial_language`."""
    edges = F.aggregate("events", F.lit(0).cast("bigint"), lambda acc, e: acc + F.size(e["predecessors"]))
    sums = language.agg(F.count("*").alias("n_traces"), F.coalesce(F.sum(F.size("events")), F.lit(0)).alias("n_events"), F.coalesce(F.sum(edges), F.lit(0)).alias("n_edges"), F.coalesce(F.sum("probability"), F.lit(0.0)).alias("probability"))
    return sums.join(language.select(F.explode("events.activity").alias("a")).agg(F.countDistinct("a").alias("n_activities")))
