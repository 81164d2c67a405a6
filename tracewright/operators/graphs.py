"""Directly-follows graphs and models, automata and nets as tables.

A directly-follows graph is one table (kind, source, target, weight): kind ``edge``, ``start`` (target only), ``end``
(source only) or ``empty``. Automata are (kind, source, activity, target, weight): kind ``transition`` or ``final``; a state
that stands for an activity bears its name, with one more ``@`` in front of names that begin with one, as ``@initial`` and
``@final`` are states of their own; a state that stands for a prefix bears :func:`prefix_name`.
Nets are (kind, transition, label, place, weight): kind ``transition``, ``input``, ``output`` or ``marking``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise, numbered
from ..sources.tables import EventLog
from .logs import variants

INITIAL = "@initial"


def prefix_name(labels: Column) -> Column:
    """A name for an array of labels that no other array has: the length, a colon and the text of each; ``-`` for null."""
    return F.array_join(F.transform(labels, lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))), "")


def state_name(activity: Column) -> Column:
    """The state of an activity."""
    return F.when(activity.startswith("@"), F.concat(F.lit("@"), activity)).otherwise(activity)


def directly_follows_graph(log: EventLog) -> DataFrame:
    """Count consecutive pairs, first and last activities and empty traces. One window per case, then partial sums."""
    by = Window.partitionBy("case_id").orderBy(*log.order)
    e = log.events.select("activity", F.lag("activity").over(by).alias("before"), F.lead("activity").over(by).alias("after"))
    none = F.lit(None).cast("string")
    row = lambda kind, s, t: F.struct(F.lit(kind).alias("kind"), s.alias("source"), t.alias("target"))
    a = F.col("activity")
    marks = F.filter(F.array(F.when(F.col("before").isNull(), row("start", none, a)), F.when(F.col("after").isNull(), row("end", a, none)), F.when(F.col("after").isNotNull(), row("edge", a, F.col("after")))), lambda x: x.isNotNull())
    out = e.select(F.explode(marks).alias("m")).groupBy("m.kind", "m.source", "m.target").agg(F.count("*").alias("weight")).select("kind", "source", "target", "weight")
    if log.cases is not None:
        empty = log.cases.join(log.events.select("case_id"), "case_id", "left_anti").agg(F.count("*").alias("weight"))
        out = out.unionByName(empty.select(F.lit("empty").alias("kind"), none.alias("source"), none.alias("target"), "weight").where("weight > 0"))
    return out


def remove_edges(dfg: DataFrame, below: int) -> DataFrame:
    """Edges lighter than ``below`` taken out."""
    return dfg.where((F.col("kind") != "edge") | (F.col("weight") >= below))


def remove_ends(dfg: DataFrame, kind: str, activities: tuple[str, ...]) -> DataFrame:
    """``activities`` no longer start (``start``) or end (``end``) traces."""
    at = F.col("target" if kind == "start" else "source")
    return dfg.where((F.col("kind") != kind) | ~at.isin(*activities))


def describe_activities(dfg: DataFrame) -> DataFrame:
    """(activity, is_start, is_end, has_loop) by the weights of a graph or model."""
    side = F.when(F.col("kind") == "start", F.array("target")).when(F.col("kind") == "end", F.array("source")).otherwise(F.array("source", "target"))
    rows = dfg.where("weight > 0 AND kind <> 'empty'").select(F.explode(side).alias("activity"), "kind", (F.col("source") == F.col("target")).alias("own"))
    return rows.groupBy("activity").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in (("is_start", F.col("kind") == "start"), ("is_end", F.col("kind") == "end"), ("has_loop", (F.col("kind") == "edge") & F.col("own")))])


def activity_cardinality(dfg: DataFrame) -> DataFrame:
    """(activity, cnt): weight that leaves an activity, by an edge or by ending there."""
    return dfg.where("kind IN ('edge', 'end') AND weight > 0").groupBy(F.col("source").alias("activity")).agg(F.sum("weight").alias("cnt"))


def model_of(dfg: DataFrame) -> DataFrame:
    """Directly-follows model: the kinds and places of positive weight, unweighted."""
    return dfg.where("weight > 0").select("kind", "source", "target")


def stochastic_model_of(dfg: DataFrame) -> DataFrame:
    """Stochastic model: start and end weights of every activity, zero where there are none."""
    none = F.lit(None).cast("string")
    row = lambda kind, s, t, weight: F.struct(kind.alias("kind"), s.alias("source"), t.alias("target"), weight.alias("weight"))
    zero = F.lit(0).cast(dict(dfg.dtypes)["weight"])
    # each row brings rows of no weight for its activities, so the graph is gone through once
    sides = [F.when(F.col(c).isNotNull(), row(F.lit(k), *((none, F.col(c)) if k == "start" else (F.col(c), none)), zero)) for c in ("source", "target") for k in ("start", "end")]
    rows = F.filter(F.array(row(F.col("kind"), F.col("source"), F.col("target"), F.col("weight")), *sides), lambda x: x.isNotNull())
    return dfg.select(F.explode(rows).alias("r")).groupBy("r.kind", "r.source", "r.target").agg(F.sum("r.weight").alias("weight")).select("kind", "source", "target", "weight")


def automaton_of(dfg: DataFrame) -> DataFrame:
    """Weighted automaton of a graph or model: states are activities and ``@initial``; an arc bears its target's label.

    The weight of a final row is the weight of ending there, that of ``@initial`` the weight of the empty trace.
    """
    source = F.when(F.col("kind").isin("start", "empty"), INITIAL).otherwise(state_name(F.col("source")))
    final = F.col("kind").isin("end", "empty")
    return dfg.where("weight > 0").select(F.when(final, "final").otherwise("transition").alias("kind"), source.alias("source"), F.when(~final, F.col("target")).alias("activity"), F.when(~final, state_name(F.col("target"))).alias("target"), "weight")


def probabilities(automaton: DataFrame) -> DataFrame:
    """Weights divided by what leaves the state, arcs and ending alike: a stochastic automaton."""
    total = F.sum("weight").over(Window.partitionBy("source"))
    return automaton.select("kind", "source", "activity", "target", (F.col("weight") / total).alias("weight"))


def without_weights(automaton: DataFrame) -> DataFrame:
    """The deterministic automaton: final where the weight of ending is positive."""
    return automaton.where("kind = 'transition' OR weight > 0").select("kind", "source", "activity", "target")


def prefix_automaton(log: EventLog) -> DataFrame:
    """Counting prefix tree: a state is a prefix of traces; its arcs and its ending bear the number of traces.

    Traces are counted first and only variants are taken apart, so the work follows the variants.
    """
    v = variants(log)
    n = F.size("trace")
    none = F.lit(None).cast("string")
    step = lambda i: F.struct(prefix_name(F.slice("trace", F.lit(1), i - 1)).alias("source"), F.element_at("trace", i).alias("activity"), prefix_name(F.slice("trace", F.lit(1), i)).alias("target"))
    arcs = v.where(n > 0).select("cnt", F.explode(F.transform(F.sequence(F.lit(1), n), step)).alias("s")).groupBy("s.source", "s.activity", "s.target").agg(F.sum("cnt").alias("weight"))
    ends = v.select(F.lit("final").alias("kind"), prefix_name(F.col("trace")).alias("source"), none.alias("activity"), none.alias("target"), F.col("cnt").alias("weight"))
    return arcs.select(F.lit("transition").alias("kind"), "source", "activity", "target", "weight").unionByName(ends)


def inconsistent_states(automaton: DataFrame) -> DataFrame:
    """States whose arcs' and ending's weights don't sum up to 1."""
    return automaton.groupBy("source").agg(F.sum("weight").alias("total")).where(F.abs(F.col("total") - 1) > 1e-9)


def transitions(automaton: DataFrame) -> DataFrame:
    """All transitions in order, ending as a silent one to ``@final``: (idx, source, activity, target, weight)."""
    rows = automaton.select("source", "activity", F.coalesce("target", F.lit("@final")).alias("target"), "weight")
    return numbered(rows, "idx", "source", F.col("activity").asc_nulls_last(), "target").withColumn("idx", F.col("idx").cast("int"))


def outgoing_weight(automaton: DataFrame) -> DataFrame:
    return automaton.groupBy("source").agg(F.sum("weight").alias("weight"))


def reachable(edges: DataFrame) -> DataFrame:
    """Pairs (source, target) joined by a path of one or more ``edges`` (source, target), by doubling path lengths.

    The result may hold the square of the nodes, which is what is asked for; :func:`strong_components` doesn't need it.
    """
    paths, n = materialise(edges.select("source", "target").distinct(), "paths"), -1
    while (now := paths.count()) != n:
        n, spent = now, paths
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.target") == F.col("y.source")).select(F.col("x.source").alias("source"), F.col("y.target").alias("target"))
        paths = materialise(paths.union(longer).distinct(), "paths")
        discard(spent)
    return paths


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each strongly connected component, by colouring.

    Each node takes the smallest node that reaches it as its colour. The nodes that reach their colour's node within the
    colour are its component and leave; the others go round again. No more than nodes and edges are ever kept.
    """
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    left = materialise(edges.where("source <> target").select("source", "target").distinct(), "edges")
    done: DataFrame | None = None
    while not left.isEmpty():
        colour = _spread(left, left.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("colour", F.col("node")))
        by = left.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("a")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("b")), "target")
        within = materialise(by.where("a = b").select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("a").alias("colour")), "within")
        # backwards from the colours' own nodes
        reach = materialise(colour.where("node = colour"), "reach")
        front = reach
        while not front.isEmpty():
            more = front.select(F.col("node").alias("source")).join(within, "source").select(F.col("target").alias("node"), "colour").distinct()
            front = materialise(more.join(reach, "node", "left_anti"), "front")
            reach = materialise(reach.union(front), "reach")
        found = reach.select("node", F.col("colour").alias("component"))
        done = found if done is None else materialise(done.union(found), "components")
        gone = reach.select("node")
        rest = left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
        spent, left = left, materialise(rest.select("source", "target"), "edges")
        discard(spent, within)
    if done is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """``colour`` (node, colour) after each node has taken the least colour of the nodes that reach it."""
    colour = materialise(colour, "colours")
    while True:
        sent = edges.join(colour.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("sent"))
        both = colour.join(sent, "node", "left").select("node", F.least("colour", F.coalesce("sent", "colour")).alias("colour"), (F.col("sent") < F.col("colour")).alias("_changed"))
        now = materialise(both, "colours")
        discard(colour)
        if now.where("_changed").isEmpty():
            return now.drop("_changed")
        colour = now.drop("_changed")
        colour.scratch_path = now.scratch_path


def net_of(automaton: DataFrame) -> DataFrame:
    """Net of an automaton: a place per state, a labelled transition per arc, a silent one per ending, a token at the start.

    The start is ``@initial`` or the empty prefix, whichever the automaton has. A transition bears the name of the array of
    its source, label and target.
    """
    name = prefix_name(F.array("source", "activity", "target"))
    arcs = automaton.withColumn("t", name)
    none, one = F.lit(None).cast("string"), F.lit(1).cast("double")
    shape = lambda kind, label, place, weight: (F.lit(kind).alias("kind"), F.col("t").alias("transition"), label.alias("label"), place.alias("place"), weight.cast("double").alias("weight"))
    out = arcs.select(*shape("transition", F.col("activity"), none, F.col("weight")))
    out = out.unionByName(arcs.select(*shape("input", none, F.col("source"), one))).unionByName(arcs.where("target IS NOT NULL").select(*shape("output", none, F.col("target"), one)))
    start = arcs.agg(F.max(F.col("source") == INITIAL).alias("has")).select(F.when(F.col("has"), INITIAL).otherwise("").alias("t"))
    return out.unionByName(start.select(F.lit("marking").alias("kind"), none.alias("transition"), none.alias("label"), F.col("t").alias("place"), one.alias("weight")))


def incidence(net: DataFrame) -> DataFrame:
    """(transition, place, change): tokens produced less tokens consumed."""
    arcs = net.where("kind IN ('input', 'output')")
    return arcs.groupBy("transition", "place").agg(F.sum(F.when(F.col("kind") == "output", F.col("weight")).otherwise(-F.col("weight"))).cast("long").alias("change"))


def largest_input(net: DataFrame) -> DataFrame:
    """The greatest number of tokens that any transition takes from a place; 0 without transitions."""
    arcs = net.where("kind = 'input'").groupBy("transition", "place").agg(F.sum("weight").alias("n"))
    return arcs.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest"))


def trace_probability(variants_: DataFrame, automaton: DataFrame) -> DataFrame:
    """(trace, probability) of each trace of ``variants_`` in a stochastic prefix automaton: its arcs' product in order."""
    arcs_of = F.transform("trace", lambda a, i: F.struct(prefix_name(F.slice("trace", F.lit(1), i)).alias("source"), F.struct(a.alias("activity")).alias("step")))
    end = F.array(F.struct(prefix_name(F.col("trace")).alias("source"), F.lit(None).cast("struct<activity:string>").alias("step")))
    steps = variants_.select("trace", F.posexplode(F.concat(arcs_of, end)).alias("pos", "s")).select("trace", "pos", "s.source", F.col("s.step.activity").alias("activity"), F.col("s.step").isNull().alias("ends"))
    arcs = automaton.select(F.col("source").alias("s2"), F.col("activity").alias("a2"), (F.col("kind") == "final").alias("e2"), "weight")
    met = steps.join(arcs, (F.col("source") == F.col("s2")) & F.col("activity").eqNullSafe(F.col("a2")) & (F.col("ends") == F.col("e2")), "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("weight", F.lit(0.0)).alias("weight"))))
    return met.groupBy("trace").agg(ordered.alias("w")).select("trace", F.aggregate("w", F.lit(1.0), lambda acc, x: acc * x["weight"]).alias("probability"))


# ---- states and transitions by number ------------------------------------------------------------------------------------


def _indexed(dfg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The activities of a graph with their numbers (node, idx), and its rows with numbers for source and target."""
    nodes = dfg.select(F.explode(F.array("source", "target")).alias("node")).where("node IS NOT NULL").distinct()
    nodes = numbered(nodes, "idx", "node").withColumn("idx", F.col("idx").cast("int"))
    rows = dfg.join(nodes.select(F.col("node").alias("source"), F.col("idx").alias("s")), "source", "left").join(nodes.select(F.col("node").alias("target"), F.col("idx").alias("t")), "target", "left")
    return nodes, rows


def graph_semantics(dfg: DataFrame) -> DataFrame:
    """The automaton of a directly-follows graph or model by number: (transition, source, target, activity, weight).

    With n activities and m edges: activities are states 0..n-1 in alphabetical order, the initial state is n, the final
    one n + 1. Edges are transitions 0..m-1 by source and target, ending is m, starting with activity i is m + 1 + i, and
    the empty trace, from n to n + 1, ends too. Rows without weight aren't transitions.
    """
    nodes, rows = _indexed(materialise(dfg.where("weight > 0"), "graph"))
    edges = numbered(rows.where("kind = 'edge'"), "e", "s", "t")
    size = nodes.agg(F.count("*").cast("int").alias("n")).join(edges.agg(F.count("*").cast("int").alias("m")))
    n, m = F.col("n"), F.col("m")
    ends = rows.where("kind <> 'edge'").withColumn("e", F.lit(0).cast("long"))
    all_ = edges.unionByName(ends).join(F.broadcast(size))
    kind = F.col("kind")
    transition = F.when(kind == "edge", F.col("e").cast("int")).when(kind == "start", m + 1 + F.col("t")).otherwise(m)
    source = F.when(kind.isin("start", "empty"), n).otherwise(F.col("s"))
    target = F.when(kind.isin("end", "empty"), n + 1).otherwise(F.col("t"))
    return all_.select(transition.alias("transition"), source.alias("source"), target.alias("target"), F.when(kind.isin("edge", "start"), F.col("target")).alias("activity"), "weight")


def automaton_semantics(automaton: DataFrame) -> DataFrame:
    """An automaton by number: (transition, source, target, activity, weight).

    With n states and m arcs: states are 0..n-1 by name, arcs 0..m-1 by source, label and target; ending leads to the
    virtual state n by the transition m, from any state that may end.
    """
    automaton = materialise(automaton, "automaton")
    names = numbered(automaton.select(F.explode(F.array("source", "target")).alias("state")).where("state IS NOT NULL").distinct(), "idx", "state").withColumn("idx", F.col("idx").cast("int"))
    rows = automaton.where("weight > 0").join(names.select(F.col("state").alias("source"), F.col("idx").alias("s")), "source").join(names.select(F.col("state").alias("target"), F.col("idx").alias("t")), "target", "left")
    arcs = numbered(rows.where("kind = 'transition'"), "e", "s", F.col("activity").asc_nulls_last(), "t")
    size = names.agg(F.count("*").cast("int").alias("n")).join(arcs.agg(F.count("*").cast("int").alias("m")))
    ends = rows.where("kind = 'final'").withColumn("e", F.lit(None).cast("long"))
    all_ = arcs.unionByName(ends).join(F.broadcast(size))
    return all_.select(F.coalesce(F.col("e").cast("int"), F.col("m")).alias("transition"), F.col("s").alias("source"), F.coalesce("t", "n").alias("target"), "activity", "weight")


def enabled(semantics: DataFrame, state: int) -> DataFrame:
    """The transitions that leave a state: (transition, activity, target, weight)."""
    return semantics.where(F.col("source") == state).select("transition", "activity", "target", "weight")


def places_around(net: DataFrame) -> DataFrame:
    """(transition, before, after): the places that each transition takes from and gives to, as sorted arrays."""
    own = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("place"))))
    return net.where("kind IN ('input', 'output')").groupBy("transition").agg(own("input").alias("before"), own("output").alias("after"))


def transitions_around(net: DataFrame) -> DataFrame:
    """(place, before, after): the transitions that give to and take from each place, as sorted arrays."""
    own = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("transition"))))
    return net.where("kind IN ('input', 'output')").groupBy("place").agg(own("output").alias("before"), own("input").alias("after"))
