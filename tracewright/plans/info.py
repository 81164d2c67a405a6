"""What there is to tell about a log, a language or a model: rows of metric and value, as text."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..formats.bpmn import Diagram
from ..formats.text import FollowsModel, Move, PartialTrace
from ..functions.values import significant_bits
from ..models.automata import Automaton
from ..models.nets import Net
from ..models.powl import Powl
from ..models.trees import Tree
from ..operators import logs
from ..sources.tables import EventLog

Rows = list[tuple[str, str]]


def tell(model: object) -> Rows:
    """The rows of a model that lies on the driver."""
    labels: set[str] = set()
    if isinstance(model, Automaton):
        labels = {x for _, x, _ in model.arcs if x is not None}
        rows = [("states", model.states), ("transitions", len(model.arcs))]
    elif isinstance(model, Net):
        labels = {t.label for t in model.transitions if t.label is not None}
        rows = [("places", model.places), ("transitions", len(model.transitions)), ("silent transitions", sum(t.label is None for t in model.transitions))]
    elif isinstance(model, FollowsModel):
        labels = set(model.labels)
        weights = [*model.edges.values(), *model.starts.values(), *model.ends.values()]
        total = sum(weights, Fraction(0))
        rows = [("nodes", len(model.labels)), ("edges", len(model.edges)), ("start activities", sum(w > 0 for w in model.starts.values())), ("end activities", sum(w > 0 for w in model.ends.values())), ("sum of weights", total), ("bits of a weight", max(map(significant_bits, weights), default=0))]
    elif isinstance(model, Tree):
        nodes = 0
        todo = [model.root] if model.root else []
        while todo:
            n = todo.pop()
            nodes += 1
            todo += n.children
            labels |= {n.label} - {None}
        rows = [("nodes", nodes)]
    elif isinstance(model, Powl):
        todo, nodes = [model], 0
        while todo:
            p = todo.pop()
            nodes += 1
            todo += p.children
            labels |= {p.label} - {None}
        rows = [("nodes", nodes)]
    elif isinstance(model, Diagram):
        labels = {label for _, _, label in model.elements.values() if label is not None}
        rows = [("processes", len(model.processes)), ("elements", len(model.elements)), ("message flows", len(model.messages))]
    elif isinstance(model, dict):  # a stochastic language
        labels = {a for t in model for a in t}
        rows = [("traces", len(model)), ("events", sum(map(len, model))), ("sum of probabilities", sum(model.values(), Fraction(0)))]
    elif isinstance(model, set):
        labels = {a for t in model for a in t}
        rows = [("traces", len(model)), ("events", sum(map(len, model)))]
    elif isinstance(model, list) and all(isinstance(t, PartialTrace) for t in model):
        labels = {a for t in model for a, _ in t.events}
        rows = [("traces", len(model)), ("events", sum(len(t.events) for t in model)), ("edges", sum(len(b) for t in model for _, b in t.events)), ("sum of probabilities", sum((t.probability for t in model), Fraction(0)))]
    elif isinstance(model, list):  # alignments
        labels = {m.activity for _, moves in model for m in moves if isinstance(m, Move) and m.kind != 3}
        rows = [("alignments", len(model))]
    else:
        raise ValueError(f"nothing to tell about {type(model).__name__}")
    first = sorted(labels)
    listed = [("activity", x) for x in first[:20]] + ([("more activities", len(first) - 20)] if len(first) > 20 else [])
    return [(k, str(v)) for k, v in [*rows, ("activities", len(labels)), *listed]]


def info_graph(dfg: DataFrame) -> DataFrame:
    """(metric, value) of a directly-follows graph or model as a table."""
    number = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).cast("string")
    a = dfg.where("weight > 0").agg(number("edge").alias("edges"), number("start").alias("start activities"), number("end").alias("end activities"), F.coalesce(F.sum(F.when(F.col("kind") != "empty", F.col("weight"))), F.lit(0)).cast("string").alias("sum of weights"))
    nodes = dfg.select(F.explode(F.array("source", "target")).alias("x")).agg(F.countDistinct("x").cast("string").alias("activities"))
    return _rows(a.join(nodes))


def info_automaton(automaton: DataFrame) -> DataFrame:
    states = automaton.select(F.explode(F.array("source", "target")).alias("x")).agg(F.countDistinct("x").cast("string").alias("states"))
    a = automaton.agg(F.count(F.when(F.col("kind") == "transition", 1)).cast("string").alias("transitions"), F.countDistinct("activity").cast("string").alias("activities"))
    return _rows(states.join(a))


def info_net(net: DataFrame) -> DataFrame:
    a = net.agg(F.countDistinct("place").cast("string").alias("places"), F.count(F.when(F.col("kind") == "transition", 1)).cast("string").alias("transitions"), F.countDistinct("label").cast("string").alias("activities"), F.count(F.when((F.col("kind") == "transition") & F.col("label").isNull(), 1)).cast("string").alias("silent transitions"))
    return _rows(a)


def info_log(log: EventLog, attributes: tuple[str, ...] = ()) -> DataFrame:
    """(metric, value): traces, events, activities, lengths, the first start and end activities, and the attributes' kinds."""
    stats = logs.trace_length_stats(log).select(*[F.col(c).cast("string").alias(n) for c, n in (("n_traces", "traces"), ("n_events", "events"), ("min_length", "shortest trace"), ("max_length", "longest trace"))])
    out = _rows(stats.join(logs.activity_frequency(log).agg(F.count("*").cast("string").alias("activities"))))
    for name, rows in (("start activity", logs.start_activities(log)), ("end activity", logs.end_activities(log)), ("activity", logs.activity_frequency(log))):
        out = out.unionByName(rows.orderBy("activity").limit(20).select(F.lit(name).alias("metric"), F.col("activity").alias("value")))
    if attributes:
        out = out.unionByName(logs.attribute_profile(log, attributes).select(F.lit("attribute").alias("metric"), F.concat_ws(" ", "attribute", "kind").alias("value")))
    return out


def info_executions(executions: DataFrame) -> DataFrame:
    return _rows(executions.agg(F.count("*").cast("string").alias("executions")))


def info_moves(moves: DataFrame) -> DataFrame:
    return _rows(moves.agg(F.countDistinct("case_id").cast("string").alias("alignments"), F.count("*").cast("string").alias("moves"), F.countDistinct("activity").cast("string").alias("activities")))


def _rows(one: DataFrame) -> DataFrame:
    """The columns of the one row as rows."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in one.columns])).alias("r")).select("r.metric", "r.value")
