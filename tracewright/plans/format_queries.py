"""Registered queries that write the tables' logs and models in each format and read them back, with DuckDB SQL for what must come out."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formats import files, markup
from ..formats import text as T
from ..models.automata import Automaton
from ..models.nets import Net, net_of_tree
from ..models.powl import powl_of_tree, read_powl, write_powl
from ..models.trees import Tree
from ..operators import graphs, logs, objects, runs
from ..sources import readers, tables, writers
from ..sources.scratch import numbered, scratch
from . import info
from .model_queries import _ACT, _LPN, _RUNS, EXECUTIONS_SQL, _moves, _operators, executions_of, executions_shown, follows_model, follows_rows, language_of, line_runs, named_rows, net_rows, optional_steps
from .queries import _AUT, _FMT, _OC, _POS, _PREFIX, _PROB, _dfg, _net_sql, _t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("trace", F.array_join("trace", ">"))


# ---- logs -----------------------------------------------------------------------------------------------------------------


def _written(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    path = scratch(spark, name)
    write(path)
    return path


def _csv(spark: SparkSession, d: str) -> tables.EventLog:
    log = tables.user_days(spark, d)
    path = _written(spark, "csv", lambda p: writers.write_csv(tables.EventLog(log.events.select("case_id", "activity", "value", "ts", "props", "event_id"), log.order), p))
    return readers.read_csv(spark, path, case="case_id", activity="activity", resource="props", time="ts")


_U = f"WITH {_t('user_days')} "
_PLACED = _U + f"SELECT case_id, CAST({_POS} AS INTEGER) AS pos, activity"
_at = lambda k: F.col("attributes")[k]["value"]
_add("csv_roundtrip", lambda s, d: logs.positions(_csv(s, d)).select("case_id", "pos", "activity", F.col("attributes")["value"].cast("double").alias("value"), F.date_format(F.col("time").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.nullif("resource", F.lit("")).alias("props")), f"{_PLACED}, value, strftime(ts, {_FMT}) AS ts, props FROM log")


def _xes(spark: SparkSession, log: tables.EventLog, **how: bool) -> tables.EventLog:
    return readers.read_xes(spark, _written(spark, "xes", lambda p: writers.write_xes(log, p, **how)))


def _named(log: tables.EventLog) -> DataFrame:
    """Cases by the name that was written, with their traces."""
    return _joined(logs.traces_of_cases(log).select(_at("concept:name").alias("case_id"), "trace"))


_L = f"WITH {_t('order_lines')} SELECT case_id, trace FROM t"
for _name, _how in (("xes_roundtrip", {}), ("xes_gz_roundtrip", {"compress": True})):
    _add(_name, lambda s, d, h=_how: _named(_xes(s, tables.order_lines(s, d).select(), **h)), _L)


def _xes_events(spark: SparkSession, d: str) -> DataFrame:
    log = tables.user_days(spark, d)
    e = logs.events_of_cases(_xes(spark, log, event_attributes=True))
    return e.select(F.col("case.attributes")["concept:name"]["value"].alias("case_id"), "pos", "activity", _at("value").cast("double").alias("value"), _at("event_id").cast("long").alias("event_id"), _at("props").alias("props"), F.col("attributes")["value"]["type"].alias("value_type"), F.date_format(_at("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"))


_add("xes_event_attributes_roundtrip", _xes_events, f"{_PLACED}, value, event_id, props, CASE WHEN value IS NOT NULL THEN 'float' END AS value_type, strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') AS ts FROM log")
_add("xes_trace_attributes_roundtrip", lambda s, d: (x := _xes(s, tables.order_lines(s, d), trace_attributes=True)) and x.cases.select(_at("concept:name").alias("case_id"), _at("o_totalprice").cast("double").alias("price"), _at("o_orderpriority").alias("priority"), F.date_format(_at("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("day"), F.col("attributes")["o_orderdate"]["type"].alias("day_type")), "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_totalprice AS price, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderdate IS NOT NULL THEN 'date' END AS day_type FROM orders")


def _csv_to_xes(spark: SparkSession, d: str) -> DataFrame:
    log = _csv(spark, d)
    cells = F.map_from_entries(F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"], F.struct(F.lit("string").alias("type"), e["value"].alias("value")))))
    events = log.events.select("case_id", "activity", "place", cells.alias("attributes"))
    e = logs.events_of_cases(_xes(spark, tables.EventLog(events, log.order), event_attributes=True))
    return e.select(F.col("case.attributes")["concept:name"]["value"].alias("case_id"), "pos", "activity", _at("value").cast("double").alias("value"), F.col("attributes")["value"]["type"].alias("value_type"))


_add("csv_to_xes", _csv_to_xes, f"{_PLACED}, value, 'string' AS value_type FROM log")


def _ocel(spark: SparkSession, d: str) -> str:
    return _written(spark, "ocel", lambda p: writers.write_ocel(objects.order_objects(spark, d), p, compress=True))


_add("ocel_roundtrip", lambda s, d: _joined(logs.traces(readers.read_ocel_log(s, _ocel(s, d), "1", "supplier"))), f"WITH {_OC} SELECT o.case_id, coalesce(string_agg(activity, '>' ORDER BY pos, event_id), '') AS trace FROM (SELECT 'part:' || p_partkey AS case_id FROM part) o LEFT JOIN ev ON ev.prt = o.case_id GROUP BY 1")
_add("ocel_roundtrip_attributes", lambda s, d: objects.trace_attributes(readers.read_ocel(s, _ocel(s, d)), "supplier"), "SELECT 'supplier:' || s_suppkey AS case_id, 'attribute' AS name, s_name AS value FROM supplier UNION ALL SELECT 'supplier:' || s_suppkey, 'object-id', 'supplier:' || s_suppkey FROM supplier")
_add("executions_roundtrip", lambda s, d: executions_shown(_read_executions(s, d), "yyyy-MM-dd HH:mm:ss"), EXECUTIONS_SQL.format(time="'%Y-%m-%d %H:%M:%S'"))


def _read_executions(spark: SparkSession, d: str) -> DataFrame:
    """Transitions are numbers in the file: the step's rank among all steps; they come back as names."""
    rows = executions_of(spark, d)
    steps = rows.select(F.explode(F.concat("other_enabled_transitions", F.array("fired_transition"))).alias("t")).where("t IS NOT NULL").distinct()
    number = {r.t: i for i, r in enumerate(steps.orderBy("t").collect())}  # the square of the activities at most
    of = F.create_map(*[x for t, i in number.items() for x in (F.lit(t), F.lit(i).cast("long"))])
    back = F.create_map(*[x for t, i in number.items() for x in (F.lit(i).cast("long"), F.lit(t))])
    coded = rows.withColumns({"fired_transition": of[F.col("fired_transition")], "other_enabled_transitions": F.transform("other_enabled_transitions", lambda t: of[t])})
    cases = rows.select("trace").distinct()


    ids = numbered(cases, "id", "trace")
    path = _written(spark, "executions", lambda p: writers.write_executions(coded.join(ids, "trace").drop("trace").withColumnRenamed("id", "trace"), p))
    got = readers.read_executions(spark, path).withColumn("move_index_of_enablement", F.col("move_index_of_enablement").cast("int")).withColumn("move_index", F.col("move_index").cast("int"))
    got = got.join(ids.select(F.col("id").alias("trace"), F.col("trace").alias("name")), "trace").withColumn("trace", F.col("name")).drop("name", "event_attributes")
    return got.withColumns({"fired_transition": back[F.col("fired_transition")], "other_enabled_transitions": F.transform("other_enabled_transitions", lambda t: back[t])})


# ---- models ---------------------------------------------------------------------------------------------------------------


def _through(spark: SparkSession, text: str) -> str:
    """The text after it has been in a file."""
    path = scratch(spark, "model")
    files.write_model(spark, text, path)
    return files.read_model(spark, path)


def _slang(spark: SparkSession, d: str) -> dict[tuple[str, ...], Fraction]:
    return T.read_stochastic_language(_through(spark, T.write_stochastic_language(language_of(spark, d))))


_V = _U + ", v AS (SELECT trace, n, count(*) AS c FROM t GROUP BY ALL HAVING count(*) >= 3)"
_add("slang_file", lambda s, d: s.createDataFrame([(">".join(t), float(p)) for t, p in _slang(s, d).items()], "trace string, probability double"), _V + " SELECT trace, c / (SELECT count(*) FROM t) AS probability FROM v")
_add("lang_file", lambda s, d: s.createDataFrame([(">".join(t),) for t in T.read_language(_through(s, T.write_language(set(language_of(s, d)))))], "trace string"), _V + " SELECT trace FROM v")
#: prefix automata of the variants that stand three times at least; what is missing to 1 is spread by normalising
_PRE = _PREFIX.replace("v AS (SELECT CASE WHEN n = 0 THEN [] ELSE string_split(trace, '>') END AS l, n, count(*) AS c FROM t GROUP BY ALL)", "v AS (SELECT CASE WHEN n = 0 THEN [] ELSE string_split(trace, '>') END AS l, n, count(*) AS c FROM t GROUP BY ALL HAVING count(*) >= 3)")
_PAUT = _U.rstrip() + _PRE.replace("SELECT 'final', ", "SELECT 'final', ", 1) + _PROB


def _prefix(spark: SparkSession, d: str, kind: str) -> DataFrame:
    a = Automaton.of_language(_slang(spark, d))
    if kind == "dfa":
        a = a.determinise()
    return named_rows(spark, T.read_automaton(_through(spark, T.write_automaton(a, kind))), kind != "dfa")


_add("slang_file_to_sdfa", lambda s, d: named_rows(s, Automaton.of_language(_slang(s, d))), _PAUT + " SELECT kind, source, activity, target, weight FROM p")
_add("sdfa_file", lambda s, d: _prefix(s, d, "sdfa"), _PAUT + " SELECT kind, source, activity, target, weight FROM p")
_add("snfa_file", lambda s, d: _prefix(s, d, "snfa"), _PAUT + " SELECT kind, source, activity, target, weight FROM p")
_add("dfa_file", lambda s, d: _prefix(s, d, "dfa"), _PAUT + " SELECT kind, source, activity, target FROM p")
_G = f"WITH {_dfg('order_lines')} "
_add("dfg_file", lambda s, d: follows_rows(s, T.read_follows_graph(_through(s, T.write_follows_graph(follows_model(s, d, tables.order_lines(s, d)))))), _G + "SELECT * FROM g")
_add("sdfm_file", lambda s, d: follows_rows(s, T.read_follows_model(_through(s, T.write_follows_model(follows_model(s, d, tables.order_lines(s, d)))))), _G + "SELECT * FROM g")
_add("dfm_file", lambda s, d: follows_rows(s, T.read_follows_model(_through(s, T.write_follows_model(follows_model(s, d, tables.order_lines(s, d)), False)))).drop("weight"), _G + "SELECT kind, source, target FROM g")


def _net_file(write: Callable[[Net], str], read: Callable[[str], Net], weights: bool) -> Query:
    return lambda s, d: net_rows(s, read(_through(s, write(net_of_tree(optional_steps(s, d))))), weights)


_BARE = _LPN.replace("label, NULL AS place, w AS weight", "label, NULL AS place, CAST(NULL AS DOUBLE) AS weight")
_add("slpn_file", _net_file(lambda n: T.write_net(n, True), T.read_net, True), _LPN)
_add("lpn_file", _net_file(T.write_net, T.read_net, False), _BARE)
_add("lola_file", _net_file(T.write_lola, T.read_lola, False), _BARE)
_add("pnml_file", _net_file(markup.write_pnml, markup.read_pnml, False), _BARE)


def _leaves(spark: SparkSession, tree: Tree, weights: bool) -> DataFrame:
    rows = [(tree.root.kind, i, c.kind, j, x.label, float(x.weight) if weights else None) for i, c in enumerate(tree.root.children, 1) for j, x in enumerate(c.children)]
    return spark.createDataFrame(rows, "root string, child int, operator string, rank int, label string, weight double")


_LEAVES = f"WITH {_ACT} SELECT 'sequence' AS root, r AS child, 'xor' AS operator, 0 AS rank, activity AS label, {{0}} AS weight FROM a UNION ALL SELECT 'sequence', r, 'xor', 1, NULL, {{1}} FROM a"
_add("sptree_file", lambda s, d: _leaves(s, T.read_tree(_through(s, T.write_tree(optional_steps(s, d), True))), True), _LEAVES.format("CAST(cnt AS DOUBLE)", "CAST(r AS DOUBLE)"))
_add("ptree_file", lambda s, d: _leaves(s, T.read_tree(_through(s, T.write_tree(optional_steps(s, d)))), False), _LEAVES.format("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"))
_add("ptml_file", lambda s, d: _leaves(s, markup.read_ptml(_through(s, markup.write_ptml(optional_steps(s, d)))), False), _LEAVES.format("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"))


def _powl(spark: SparkSession, d: str) -> DataFrame:
    """Children and edges of the partial order of the first three activities in a row."""
    p = read_powl(_through(spark, write_powl(powl_of_tree(Tree(_operators(spark, d)["sequence"])))))
    rows = [("node", c.label, None) for c in p.children] + [("edge", p.children[s].label, p.children[t].label) for s, t in p.edges]
    return spark.createDataFrame(rows, "part string, source string, target string")


_add("powl_file", _powl, f"WITH {_ACT} SELECT 'node' AS part, activity AS source, NULL AS target FROM a WHERE r <= 3 UNION ALL SELECT 'edge', x.activity, y.activity FROM a x JOIN a y ON y.r = x.r + 1 WHERE y.r <= 3")


def _tree_to_powl(spark: SparkSession, d: str) -> DataFrame:
    """For each operator over the first activities the kinds of its partially ordered model, from the root down."""
    rows = []
    for kind, n in _operators(spark, d).items():
        todo = [(powl_of_tree(Tree(n)), 0)]
        while todo:
            p, depth = todo.pop()
            rows.append((kind, depth, p.kind, p.skippable))
            todo += [(c, depth + 1) for c in p.children]
    return spark.createDataFrame(rows, "operator string, depth int, kind string, skippable boolean").groupBy("operator", "depth", "kind", "skippable").agg(F.count("*").alias("n"))


_add("tree_to_powl", _tree_to_powl, "SELECT operator, CAST(depth AS INTEGER) AS depth, kind, skippable, CAST(n AS BIGINT) AS n FROM (VALUES ('xor', 0, 'choice_graph', false, 1), ('xor', 1, 'activity', false, 3), ('sequence', 0, 'partial_order', false, 1), ('sequence', 1, 'activity', false, 3), ('concurrent', 0, 'partial_order', false, 1), ('concurrent', 1, 'activity', false, 3), ('or', 0, 'choice_graph', false, 1), ('or', 1, 'partial_order', false, 3), ('or', 2, 'activity', false, 3), ('or', 2, 'activity', true, 6), ('loop', 0, 'choice_graph', false, 1), ('loop', 1, 'activity', false, 3), ('interleaved', 0, 'choice_graph', false, 1), ('interleaved', 1, 'partial_order', false, 2), ('interleaved', 2, 'partial_order', false, 2), ('interleaved', 2, 'activity', false, 2), ('interleaved', 3, 'activity', false, 4)) v(operator, depth, kind, skippable, n)")


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    """The distinct alignments of the orders, each with its share, as written and read; steps have numbers."""
    own = _moves(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "move_type", "activity"))).alias("m"))
    distinct = own.groupBy(F.transform("m", lambda x: F.struct(x["move_type"], x["activity"])).alias("m")).agg(F.count("*").alias("n")).where("n >= 20").collect()  # at most a twentieth of the cases
    total = sum(r.n for r in distinct)
    rows = [(Fraction(r.n, total), [T.Move(T.MOVES.index(x.move_type), x.activity, 0 if x.move_type == T.MOVES[2] else -1) for x in r.m]) for r in distinct]
    got = T.read_alignments(_through(spark, T.write_alignments(rows, True)))
    return spark.createDataFrame([(">".join(f"{m.kind + 1}:{m.activity}" for m in moves), float(p)) for p, moves in got], "moves string, probability double")


_add("sali_file", _alignments, f"WITH {_dfg('order_lines')}, k AS (SELECT case_id, o, lag(activity) OVER (PARTITION BY case_id ORDER BY o) AS s, activity FROM log), m AS (SELECT case_id, string_agg(CASE WHEN target IS NULL THEN '1:' ELSE '3:' END || activity, '>' ORDER BY o) AS moves FROM k LEFT JOIN (SELECT * FROM g WHERE kind = 'start' OR kind = 'edge' AND weight >= 100) h ON s IS NOT DISTINCT FROM h.source AND activity = h.target GROUP BY 1), v AS (SELECT moves, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 20) SELECT moves, n / (SELECT sum(n) FROM v) AS probability FROM v")


def _spolang(spark: SparkSession, d: str) -> DataFrame:


    rows = runs.partial_language_of_runs(line_runs(spark, d)).where("cnt >= 5").collect()  # a fifth of the runs at most
    total = sum(r.cnt for r in rows)
    got = T.read_partial_language(_through(spark, T.write_partial_language([T.PartialTrace(Fraction(r.cnt, total), tuple((e.activity, tuple(e.predecessors)) for e in r.events)) for r in rows])))
    return spark.createDataFrame([(";".join(f"{a}({','.join(map(str, b))})" for a, b in t.events), float(t.probability)) for t in got], "shape string, probability double")


_add("spolang_file", _spolang, _RUNS + ", t AS (SELECT run, string_agg(activity || '(' || predecessors || ')', ';' ORDER BY event) AS shape FROM c GROUP BY run), v AS (SELECT shape, count(*) AS n FROM t GROUP BY shape HAVING count(*) >= 5) SELECT shape, n / (SELECT sum(n) FROM v) AS probability FROM v")

# ---- what there is to tell ----------------------------------------------------------------------------------------------


def _tell(of: Callable[[SparkSession, str], object]) -> Query:
    return lambda s, d: s.createDataFrame(info.tell(of(s, d)), "metric string, value string")


_LISTED = "SELECT 'activity', activity FROM a"
_K = f"WITH {_ACT} "
_add("info_ptree", _tell(optional_steps), _K + f"SELECT 'nodes' AS metric, CAST(3 * k + 1 AS VARCHAR) AS value FROM k UNION ALL SELECT 'activities', CAST(k AS VARCHAR) FROM k UNION ALL {_LISTED}")
_add("info_lpn", _tell(lambda s, d: net_of_tree(optional_steps(s, d))), _K + f"SELECT 'places' AS metric, CAST(k + 1 AS VARCHAR) AS value FROM k UNION ALL SELECT 'transitions', CAST(2 * k AS VARCHAR) FROM k UNION ALL SELECT 'silent transitions', CAST(k AS VARCHAR) FROM k UNION ALL SELECT 'activities', CAST(k AS VARCHAR) FROM k UNION ALL {_LISTED}")
_add("info_powl", _tell(lambda s, d: powl_of_tree(Tree(_operators(s, d)["sequence"]))), _K + "SELECT 'nodes' AS metric, '4' AS value UNION ALL SELECT 'activities', '3' UNION ALL SELECT 'activity', activity FROM a WHERE r <= 3")
_add("info_sdfm", _tell(lambda s, d: follows_model(s, d)), f"WITH {_dfg('user_days')}, {_ACT} SELECT 'nodes' AS metric, CAST(k AS VARCHAR) AS value FROM k UNION ALL SELECT 'activities', CAST(k AS VARCHAR) FROM k UNION ALL SELECT CASE kind WHEN 'edge' THEN 'edges' ELSE kind || ' activities' END, CAST(count(*) AS VARCHAR) FROM g GROUP BY kind UNION ALL SELECT 'sum of weights', CAST(CAST(sum(weight) AS BIGINT) AS VARCHAR) FROM g UNION ALL SELECT 'bits of a weight', CAST(length(ltrim(bin(max(weight)), '0')) AS VARCHAR) FROM g UNION ALL {_LISTED}")
_add("info_dfg", lambda s, d: info.info_graph(graphs.directly_follows_graph(tables.order_lines(s, d))), _G + "SELECT 'edges' AS metric, CAST(count(*) FILTER (kind = 'edge') AS VARCHAR) AS value FROM g UNION ALL SELECT 'start activities', CAST(count(*) FILTER (kind = 'start') AS VARCHAR) FROM g UNION ALL SELECT 'end activities', CAST(count(*) FILTER (kind = 'end') AS VARCHAR) FROM g UNION ALL SELECT 'sum of weights', CAST(CAST(sum(weight) FILTER (kind <> 'empty') AS BIGINT) AS VARCHAR) FROM g UNION ALL SELECT 'activities', CAST(count(DISTINCT activity) AS VARCHAR) FROM log")
_A = f"WITH {_t('user_days')}{_PREFIX} "
_add("info_sdfa", lambda s, d: info.info_automaton(graphs.prefix_automaton(tables.user_days(s, d))), _A + "SELECT 'states' AS metric, CAST(count(DISTINCT x) AS VARCHAR) AS value FROM (SELECT unnest([source, target]) AS x FROM a) UNION ALL SELECT 'transitions', CAST(count(*) AS VARCHAR) FROM a WHERE kind = 'transition' UNION ALL SELECT 'activities', CAST(count(DISTINCT activity) AS VARCHAR) FROM a")
_add("info_slpn", lambda s, d: info.info_net(graphs.net_of(graphs.automaton_of(graphs.directly_follows_graph(tables.user_days(s, d))))), f"WITH {_dfg('user_days')}{_AUT}{_net_sql('a', chr(39) + '@initial' + chr(39))} SELECT 'places' AS metric, CAST(count(DISTINCT place) AS VARCHAR) AS value FROM net UNION ALL SELECT 'transitions', CAST(count(*) AS VARCHAR) FROM net WHERE kind = 'transition' UNION ALL SELECT 'activities', CAST(count(DISTINCT label) AS VARCHAR) FROM net UNION ALL SELECT 'silent transitions', CAST(count(*) AS VARCHAR) FROM net WHERE kind = 'transition' AND label IS NULL")
_add("info_event_attributes", lambda s, d: info.info_log(tables.user_days(s, d), ("value", "ts", "props")), f"WITH {_dfg('user_days')} SELECT 'traces' AS metric, CAST(count(*) AS VARCHAR) AS value FROM t UNION ALL SELECT 'events', CAST(count(*) AS VARCHAR) FROM log UNION ALL SELECT 'shortest trace', CAST(min(n) AS VARCHAR) FROM t UNION ALL SELECT 'longest trace', CAST(max(n) AS VARCHAR) FROM t UNION ALL SELECT 'activities', CAST(count(DISTINCT activity) AS VARCHAR) FROM log UNION ALL SELECT 'start activity', target FROM g WHERE kind = 'start' UNION ALL SELECT 'end activity', source FROM g WHERE kind = 'end' UNION ALL SELECT DISTINCT 'activity', activity FROM log UNION ALL SELECT 'attribute', x FROM (VALUES ('value Numerical'), ('ts Time'), ('props Categorical')) v(x)")
_add("info_executions", lambda s, d: info.info_executions(executions_of(s, d)), "SELECT 'executions' AS metric, CAST(count(*) AS VARCHAR) AS value FROM events")
_add("info_alignments", lambda s, d: info.info_moves(_moves(s, d)), "SELECT 'alignments' AS metric, CAST(count(DISTINCT l_orderkey) AS VARCHAR) AS value FROM lineitem UNION ALL SELECT 'moves', CAST(count(*) AS VARCHAR) FROM lineitem UNION ALL SELECT 'activities', CAST(count(DISTINCT l_returnflag || l_linestatus) AS VARCHAR) FROM lineitem")
