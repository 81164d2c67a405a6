"""Registered queries on models that are made from the tables, each with the DuckDB SQL that works the result out.

Models are small: their size follows the number of activities, so they're brought to the driver, where their algorithms
are exact.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..formats import bpmn
from ..formats import text as T
from ..models.automata import Automaton
from ..models.nets import Net, net_of_automaton, net_of_tree
from ..models.powl import net_of_powl, powl_of_tree
from ..models.trees import Node, Tree, activity, operator, tau
from ..operators import graphs, languages, logs, moves, runs
from ..sources import tables
from .queries import _AUT, _FMT, _POS, _PREFIX, _PROB, _dfg, _t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


# ---- from tables to models on the driver and back ---------------------------------------------------------------------


def activities(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The activities of the user days in order, with their frequencies."""
    return [(r.activity, r.cnt) for r in logs.activity_frequency(tables.user_days(spark, sf_dir)).orderBy("activity").collect()]


def optional_steps(spark: SparkSession, sf_dir: str) -> Tree:
    """Each activity in order, by its frequency, or nothing, by its rank."""
    return Tree(operator("sequence", *[operator("xor", activity(a, n), tau(i)) for i, (a, n) in enumerate(activities(spark, sf_dir), 1)]))


def follows_model(spark: SparkSession, sf_dir: str, log: tables.EventLog | None = None) -> T.FollowsModel:
    """The directly-follows graph of a log, the user days unless another one is given."""
    rows = graphs.directly_follows_graph(log or tables.user_days(spark, sf_dir)).collect()
    m = T.FollowsModel(sorted({x for r in rows for x in (r.source, r.target) if x is not None}))
    of = {a: i for i, a in enumerate(m.labels)}
    for r in rows:
        w = Fraction(r.weight)
        if r.kind == "edge":
            m.edges[of[r.source], of[r.target]] = w
        elif r.kind == "empty":
            m.empty = w
        else:
            (m.starts if r.kind == "start" else m.ends)[of[r.target if r.kind == "start" else r.source]] = w
    return m


def language_of(spark: SparkSession, sf_dir: str, least: int = 3) -> dict[tuple[str, ...], Fraction]:
    """The variants of the user days that stand ``least`` times at least, with their shares of all traces."""
    return {tuple(r.trace): Fraction(r.num, r.den) for r in languages.stochastic_language(tables.user_days(spark, sf_dir)).where(f"num >= {least}").collect()}


def follows_rows(spark: SparkSession, m: T.FollowsModel) -> DataFrame:
    rows = [("edge", m.labels[s], m.labels[t], int(w)) for (s, t), w in m.edges.items()] + [("start", None, m.labels[t], int(w)) for t, w in m.starts.items()] + [("end", m.labels[s], None, int(w)) for s, w in m.ends.items()]
    return spark.createDataFrame(rows + ([("empty", None, None, int(m.empty))] if m.empty else []), "kind string, source string, target string, weight long")


def automaton_rows(spark: SparkSession, a: Automaton, weights: bool = True) -> DataFrame:
    rows = [("transition", s, x, t, float(p)) for (s, x, t), p in a.arcs.items()] + [("final", s, None, None, float(p)) for s, p in a.final.items()]
    df = spark.createDataFrame(rows, "kind string, source int, activity string, target int, weight double")
    return df if weights else df.drop("weight")


def named_rows(spark: SparkSession, a: Automaton, weights: bool = True) -> DataFrame:
    """The rows of a prefix automaton, a state by the way that leads to it."""
    name, todo = {a.initial: ()}, [a.initial]
    out: dict[int, list[tuple[str, int]]] = {}
    for s, x, t in a.arcs:
        out.setdefault(s, []).append((x, t))
    while todo:
        for x, t in out.get(s := todo.pop(), ()):
            name[t] = (*name[s], x)
            todo.append(t)
    text = {s: "".join(f"{len(x)}:{x}" for x in way) for s, way in name.items()}
    rows = [("transition", text[s], x, text[t], float(p)) for (s, x, t), p in a.arcs.items()] + [("final", text[s], None, None, float(p)) for s, p in a.final.items() if p > 0]
    df = spark.createDataFrame(rows, "kind string, source string, activity string, target string, weight double")
    return df if weights else df.drop("weight")


def net_rows(spark: SparkSession, net: Net, weights: bool = True) -> DataFrame:
    rows: list[tuple] = [("marking", None, None, p, float(k)) for p, k in enumerate(net.marking or []) if k]
    for i, t in enumerate(net.transitions):
        rows.append(("transition", i, t.label, None, float(t.weight) if weights else None))
        rows += [(kind, i, None, p, float(k)) for kind, side in (("input", t.inputs), ("output", t.outputs)) for p, k in side.items()]
    return spark.createDataFrame(rows, "kind string, transition int, label string, place int, weight double")


def words_of(a: Automaton, longest: int) -> list[tuple[str, ...]]:
    """The words of an automaton of at most ``longest`` labels."""
    d = a.determinise()
    out, now = [], [((), d.initial)] if d.initial is not None else []
    for _ in range(longest + 1):
        out += [w for w, s in now if d.final.get(s, 0) > 0]
        now = [((*w, x), t) for w, s in now if len(w) < longest for x, t, _ in d.outgoing(s)]
    return out


# ---- a tree of optional steps ---------------------------------------------------------------------------------------------

_ACT = "a AS (SELECT event_type AS activity, count(*) AS cnt, CAST(row_number() OVER (ORDER BY event_type) AS INTEGER) AS r FROM events GROUP BY 1), k AS (SELECT CAST(max(r) AS INTEGER) AS k FROM a)"
_STATE = "CASE WHEN {0} = 0 THEN 0 WHEN {0} = k THEN 1 ELSE {0} + 1 END"
_add("sptree_to_snfa", lambda s, d: automaton_rows(s, optional_steps(s, d).automaton()), f"WITH {_ACT} SELECT 'transition' AS kind, r - 1 AS source, activity, r AS target, cnt / (cnt + r) AS weight FROM a UNION ALL SELECT 'transition', r - 1, NULL, r, r / (cnt + r) FROM a UNION ALL SELECT 'final', k, NULL, NULL, 1.0 FROM k")
_add("tree_to_dfa", lambda s, d: automaton_rows(s, optional_steps(s, d).automaton().determinise(), False), f"WITH {_ACT}, st AS (SELECT 0 AS r UNION ALL SELECT r FROM a) SELECT 'transition' AS kind, CAST(st.r AS INTEGER) AS source, activity, a.r AS target FROM st JOIN a ON a.r > st.r UNION ALL SELECT 'final', CAST(r AS INTEGER), NULL, NULL FROM st")
_LPN = f"WITH {_ACT}, t AS (SELECT 2 * r - 2 AS t, activity AS label, r, CAST(cnt AS DOUBLE) AS w FROM a UNION ALL SELECT 2 * r - 1, NULL, r, CAST(r AS DOUBLE) FROM a) SELECT 'transition' AS kind, t AS transition, label, NULL AS place, w AS weight FROM t UNION ALL SELECT 'input', t, NULL, {_STATE.format('r - 1')}, 1.0 FROM t, k UNION ALL SELECT 'output', t, NULL, {_STATE.format('r')}, 1.0 FROM t, k UNION ALL SELECT 'marking', NULL, NULL, 0, 1.0"
_add("tree_to_lpn", lambda s, d: net_rows(s, net_of_tree(optional_steps(s, d))), _LPN)


def _steps_and_rest(spark: SparkSession, sf_dir: str) -> Tree:
    """All activities side by side."""
    return Tree(operator("concurrent", *[a for a, _ in activities(spark, sf_dir)]))


def _size(spark: SparkSession, a: Automaton) -> DataFrame:
    return spark.createDataFrame([(a.states, len(a.arcs), len(a.final))], "states int, arcs int, finals int")


_SPACE = f"WITH {_ACT} SELECT CAST(1 << k AS INTEGER) AS states, CAST(k * (1 << (k - 1)) AS INTEGER) AS arcs, 1 AS finals FROM k"
_add("tree_state_space", lambda s, d: _size(s, _steps_and_rest(s, d).automaton()), _SPACE)
_add("lpn_state_space", lambda s, d: _size(s, net_of_tree(_steps_and_rest(s, d)).automaton().determinise()), _SPACE)

# ---- all operators, by their words ----------------------------------------------------------------------------------------


def _operators(spark: SparkSession, sf_dir: str) -> dict[str, Node]:
    a, b, c = (x for x, _ in activities(spark, sf_dir)[:3])
    plain = {k: operator(k, a, b, c) for k in ("xor", "sequence", "concurrent", "or", "loop")}
    return plain | {"interleaved": operator("interleaved", operator("sequence", a, b), c)}


def _words(of: Callable[[Tree], Automaton], without: tuple[str, ...] = ()) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(kind, ">".join(w)) for kind, n in _operators(spark, sf_dir).items() if kind not in without for w in words_of(of(Tree(n)), 5)]
        return spark.createDataFrame(rows, "operator string, word string")

    return query


_WORDS = """WITH x AS (SELECT event_type AS a, row_number() OVER (ORDER BY event_type) AS r FROM (SELECT DISTINCT event_type FROM events) ORDER BY 1 LIMIT 3), one AS (SELECT a FROM x WHERE r = 1), two AS (SELECT a FROM x WHERE r = 2), three AS (SELECT a FROM x WHERE r = 3), redo AS (SELECT a FROM x WHERE r > 1),
w AS (SELECT 'xor' AS operator, a AS word FROM x UNION ALL SELECT 'sequence', string_agg(a, '>' ORDER BY r) FROM x
 UNION ALL SELECT 'concurrent', concat_ws('>', p.a, q.a, s.a) FROM x p, x q, x s WHERE p.r <> q.r AND q.r <> s.r AND p.r <> s.r
 UNION ALL SELECT 'interleaved', concat_ws('>', one.a, two.a, three.a) FROM one, two, three UNION ALL SELECT 'interleaved', concat_ws('>', three.a, one.a, two.a) FROM one, two, three
 UNION ALL SELECT 'or', a FROM x UNION ALL SELECT 'or', concat_ws('>', p.a, q.a) FROM x p, x q WHERE p.r <> q.r UNION ALL SELECT 'or', concat_ws('>', p.a, q.a, s.a) FROM x p, x q, x s WHERE p.r <> q.r AND q.r <> s.r AND p.r <> s.r
 UNION ALL SELECT 'loop', a FROM one UNION ALL SELECT 'loop', concat_ws('>', one.a, redo.a, one.a) FROM one, redo UNION ALL SELECT 'loop', concat_ws('>', one.a, p.a, one.a, q.a, one.a) FROM one, redo p, redo q)
SELECT * FROM w"""
_add("tree_words", _words(Tree.automaton), _WORDS)
_add("tree_to_lpn_words", _words(lambda t: net_of_tree(t).automaton()), _WORDS)
_add("powl_to_lpn", _words(lambda t: net_of_powl(powl_of_tree(t)).automaton()), _WORDS)

# ---- nondeterminism -------------------------------------------------------------------------------------------------------


def _third_from_the_end(spark: SparkSession, sf_dir: str) -> Automaton:
    """Words over the activities whose third label from the end is the first activity: a guess, and silent ends."""
    labels = [a for a, _ in activities(spark, sf_dir)]
    a = Automaton(5, 0)
    for x in labels:
        a.add(0, x, 0, Fraction(1, 2 * len(labels)))
        a.add(1, x, 2, Fraction(1, len(labels)))
        a.add(2, x, 3, Fraction(1, len(labels)))
    a.add(0, labels[0], 1, Fraction(1, 2))
    a.add(3, None, 4, Fraction(1))
    a.final[4] = Fraction(1)
    return a


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _third_from_the_end(spark, sf_dir).determinise()
    labels = [x for x, _ in activities(spark, sf_dir)]
    words = [w for n in range(1, 5) for w in itertools.product(labels, repeat=n) if a.trace_probability(w) > 0]
    return spark.createDataFrame([(">".join(w), a.states) for w in words], "word string, states int")


_add("snfa_to_dfa", _accepted, f"WITH {_ACT}, first AS (SELECT activity AS x FROM a WHERE r = 1) SELECT concat_ws('>', x, p.activity, q.activity) AS word, 8 AS states FROM first, a p, a q UNION ALL SELECT concat_ws('>', o.activity, x, p.activity, q.activity), 8 FROM first, a o, a p, a q")


def _follows_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = follows_model(spark, sf_dir).automaton()
    a.arcs = dict(sorted(a.arcs.items(), key=lambda x: (x[0][0], x[0][1])))
    return net_rows(spark, net_of_automaton(a))


#: states by number: activities in order, the initial one behind them
_NUMBERED = """, names AS (SELECT x, CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT unnest([source, target]) AS x FROM g) WHERE x IS NOT NULL),
st AS (SELECT x, i FROM names UNION ALL SELECT '@initial', CAST(count(*) AS INTEGER) FROM names),
m AS (SELECT p.kind, p.activity, p.weight, s.i AS s, e.i AS e, CAST(row_number() OVER (ORDER BY p.kind = 'final', s.i, p.activity) - 1 AS INTEGER) AS t FROM p JOIN st s ON s.x = p.source LEFT JOIN st e ON e.x = p.target)"""
_add("snfa_to_slpn", _follows_net, f"WITH {_dfg('user_days')}{_AUT}{_PROB}{_NUMBERED} SELECT 'transition' AS kind, t AS transition, activity AS label, NULL AS place, weight FROM m UNION ALL SELECT 'input', t, NULL, s, 1.0 FROM m UNION ALL SELECT 'output', t, NULL, e, 1.0 FROM m WHERE e IS NOT NULL UNION ALL SELECT 'marking', NULL, NULL, i, 1.0 FROM st WHERE x = '@initial'")

# ---- diagrams -------------------------------------------------------------------------------------------------------------


def _diagram(of: Callable[[Tree], bpmn.Diagram]) -> Query:
    """How many elements of each kind a diagram has, and flows, read back from its text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = bpmn.read_bpmn(bpmn.write_bpmn(of(optional_steps(spark, sf_dir))))
        count = Counter(kind for _, kind, _ in d.elements.values())
        rows = [(k, n) for k, n in count.items()] + [("flow", len(d.flows))] + [(f"task {label}", 1) for _, kind, label in d.elements.values() if kind == "task"]
        return spark.createDataFrame(rows, "element string, n long")

    return query


_COUNTED = "SELECT * FROM (VALUES ('start', CAST(1 AS BIGINT)), ('end', 1)) v(element, n) UNION ALL SELECT 'task ' || activity, 1 FROM a UNION ALL SELECT 'task', CAST(k AS BIGINT) FROM k UNION ALL "
_add("tree_to_bpmn", _diagram(bpmn.diagram_of_tree), f"WITH {_ACT} {_COUNTED} SELECT 'exclusive', CAST(3 * k AS BIGINT) FROM k UNION ALL SELECT 'flow', CAST(4 * k + k - 1 + 2 AS BIGINT) FROM k")
_add("lpn_to_bpmn", _diagram(lambda t: bpmn.diagram_of_net(net_of_tree(t))), f"WITH {_ACT} {_COUNTED} SELECT 'exclusive', CAST(k AS BIGINT) FROM k UNION ALL SELECT 'parallel', CAST(k AS BIGINT) FROM k UNION ALL SELECT 'flow', CAST(4 * k + 1 AS BIGINT) FROM k")
_add("powl_to_bpmn", _diagram(lambda t: bpmn.diagram_of_powl(powl_of_tree(t))), f"WITH {_ACT} {_COUNTED} SELECT 'parallel', CAST(2 * k + 2 AS BIGINT) FROM k UNION ALL SELECT 'exclusive', CAST(7 * k AS BIGINT) FROM k UNION ALL SELECT 'flow', CAST(2 + (k - 1) + 2 + 2 * k + 8 * k AS BIGINT) FROM k")

# ---- alignments, executions, runs -----------------------------------------------------------------------------------------


def _moves(spark: SparkSession, d: str) -> DataFrame:
    log = tables.order_lines(spark, d)
    return moves.moves_against_graph(log, graphs.remove_edges(graphs.directly_follows_graph(log), 100))


_NAMED = "coalesce(length(h.source) || ':' || h.source, '-') || length(h.target) || ':' || h.target"
_MOVES = f"WITH {_dfg('order_lines')}, k AS (SELECT case_id, CAST({_POS} AS INTEGER) AS pos, lag(activity) OVER (PARTITION BY case_id ORDER BY o) AS s, activity FROM log), m AS (SELECT case_id, pos, CASE WHEN target IS NULL THEN 'log move' ELSE 'synchronous move' END AS move_type, activity, CASE WHEN target IS NOT NULL THEN {_NAMED} END AS transition FROM k LEFT JOIN (SELECT * FROM g WHERE kind = 'start' OR kind = 'edge' AND weight >= 100) h ON s IS NOT DISTINCT FROM h.source AND activity = h.target) "
_add("alignment_moves", _moves, _MOVES + "SELECT * FROM m")
_add("alignment_counts", lambda s, d: moves.move_counts(_moves(s, d)), _MOVES + "SELECT move_type, count(*) AS cnt FROM m GROUP BY 1")
_add("alignments_sorted", lambda s, d: moves.sort_alignments(_moves(s, d)).select("case_id", F.array_join(F.transform("moves", lambda x: F.concat_ws(":", x["kind"].cast("string"), x["activity"])), ">").alias("moves")), _MOVES + "SELECT case_id, string_agg(CASE move_type WHEN 'log move' THEN '1' ELSE '3' END || ':' || activity, '>' ORDER BY pos) AS moves FROM m GROUP BY 1")


def executions_of(spark: SparkSession, d: str) -> DataFrame:
    """The user days against their directly-follows graph without its lightest edges; the user is the resource."""
    log = tables.user_days(spark, d)
    log = tables.EventLog(log.events.withColumn("user", F.regexp_extract("case_id", "^[^_]*", 0)), log.order)
    return moves.executions(log, "ts", "user", graphs.remove_edges(graphs.directly_follows_graph(log), 20))


_EXECUTIONS = f"""WITH {_dfg('user_days')}, h AS (SELECT source, target, {_NAMED.replace('h.', '')} AS t FROM g WHERE kind = 'start' OR kind = 'edge' AND weight >= 20),
e AS (SELECT case_id, CAST({_POS} AS INTEGER) AS pos, activity, lag(activity) OVER (PARTITION BY case_id ORDER BY o) AS source, ts FROM log),
x AS (SELECT e.*, h.t AS fired, (SELECT coalesce(string_agg(t, ',' ORDER BY target), '') FROM h WHERE h.source IS NOT DISTINCT FROM e.source AND target <> e.activity) AS others FROM e LEFT JOIN h ON h.source IS NOT DISTINCT FROM e.source AND h.target = e.activity)
SELECT case_id AS trace, pos AS move_index, activity, fired IS NOT NULL AS also_in_log, fired AS fired_transition, others AS other_enabled_transitions, CASE WHEN pos > 0 THEN pos - 1 END AS move_index_of_enablement, strftime(ts, {{time}}) AS time_of_execution, split_part(case_id, '_', 1) AS resource, (pos + 1) || '/' || (pos + 1) AS resource_utilisation_fired_transition FROM x"""


def executions_shown(rows: DataFrame, time: str) -> DataFrame:
    return rows.withColumns({"time_of_execution": F.date_format("time_of_execution", time), "other_enabled_transitions": F.array_join("other_enabled_transitions", ",")}).drop("other_enabled_transitions_resource_utilisation")


EXECUTIONS_SQL = _EXECUTIONS
_add("executions_flatten", lambda s, d: executions_shown(executions_of(s, d), "yyyy-MM-dd HH:mm:ss.SSSSSS"), _EXECUTIONS.format(time=_FMT))


def line_runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs: a line comes after those of the ship date before its own; returned lines (flag R) are silent."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("run_id", F.col("l_orderkey").cast("string"))
    by = Window.partitionBy("run_id")  # all that a run needs goes by this one key, so it is dealt once, and by one order, so it is sorted once
    order = by.orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    e = lines.select("run_id", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", (F.row_number().over(order) - 1).alias("node"), F.when(F.col("l_returnflag") != "R", F.concat("l_returnflag", "l_linestatus")).alias("activity"))
    e = e.withColumn("first", F.rank().over(by.orderBy("l_shipdate")) - 1)  # of the own day, whose nodes stand side by side
    e = e.withColumn("before", F.when(F.col("node") == F.col("first"), F.lag("first").over(order)))
    e = e.withColumn("before", F.last("before", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.when(F.col("before").isNull(), F.array().cast("array<int>")).otherwise(F.sequence("before", F.col("first") - 1))
    return e.select("run_id", "node", "activity", F.when(F.col("run_id").isNotNull(), before).alias("predecessors"))


_RUNS = """WITH RECURSIVE e AS (SELECT l_orderkey AS run, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS day, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS node, CASE WHEN l_returnflag <> 'R' THEN l_returnflag || l_linestatus END AS activity FROM lineitem),
walk(run, node, day, met, act) AS (SELECT a.run, a.node, b.day, b.node, b.activity FROM e a JOIN e b ON a.run = b.run AND b.day = a.day - 1 WHERE a.activity IS NOT NULL
 UNION SELECT w.run, w.node, b.day, b.node, b.activity FROM walk w JOIN e b ON w.run = b.run AND b.day = w.day - 1 WHERE w.act IS NULL),
n AS (SELECT run, node, activity, row_number() OVER (PARTITION BY run ORDER BY node) - 1 AS event FROM e WHERE activity IS NOT NULL),
c AS (SELECT n.run, n.event, n.activity, count(p.event) AS edges, coalesce(string_agg(p.event, ',' ORDER BY p.event), '') AS predecessors FROM n LEFT JOIN (SELECT DISTINCT run, node, met FROM walk WHERE act IS NOT NULL) w ON w.run = n.run AND w.node = n.node LEFT JOIN n p ON p.run = w.run AND p.node = w.met GROUP BY ALL)
"""
_add("po_trace_contract", lambda s, d: runs.contract_runs(line_runs(s, d)).withColumn("predecessors", F.array_join("predecessors", ",")), _RUNS + "SELECT CAST(run AS VARCHAR) AS run_id, CAST(event AS INTEGER) AS event, activity, predecessors FROM c")
_add("spolang_stats", lambda s, d: runs.partial_language_stats(runs.partial_language_of_runs(line_runs(s, d))).withColumn("probability", F.round("probability", 9)), _RUNS + ", t AS (SELECT run, string_agg(activity || '(' || predecessors || ')', ';' ORDER BY event) AS shape, count(*) AS n, sum(edges) AS edges FROM c GROUP BY run), v AS (SELECT shape, any_value(n) AS n, any_value(edges) AS edges FROM t GROUP BY shape) SELECT count(*) AS n_traces, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(edges) AS BIGINT) AS n_edges, CAST(1 AS DOUBLE) AS probability, (SELECT count(DISTINCT activity) FROM c) AS n_activities FROM v")
_add("info_slang", lambda s, d: (x := languages.stochastic_language(tables.user_days(s, d))) and languages.lengths(x).join(languages.probability_sum(x).select("num", "den")), f"WITH {_t('user_days')}, v AS (SELECT trace, any_value(n) AS n, count(*) AS c FROM t GROUP BY trace) SELECT count(*) AS n_traces, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(c) AS BIGINT) AS num, CAST(sum(c) AS BIGINT) AS den FROM v")
