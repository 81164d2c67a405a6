"""The registered queries of the library on the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, languages, logs, objects
from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_ORDERED = "row_number() OVER (ORDER BY {}) AS o"
#: the logs in SQL: log (case_id, activity, o) and, where empty traces count, cases (case_id)
_SQL = {
    "user_days": f"log AS (SELECT concat_ws('_', user_id, strftime(ts, '%Y-%m-%d')) AS case_id, event_type AS activity, {_ORDERED.format('ts, event_id')}, event_id, ts, value, props FROM events)",
    "dialogues": "log AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, role AS activity, turn AS o FROM conversations)",
    "customer_orders": f"log AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, o_orderpriority AS activity, {_ORDERED.format('o_orderdate, o_orderkey')} FROM orders)",
    "order_lines": f"log AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || l_linestatus AS activity, {_ORDERED.format('l_shipdate, l_linenumber, l_partkey, l_suppkey')} FROM lineitem), cases AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_totalprice, o_orderdate, o_orderpriority FROM orders)",
}
_LOGS = {"user_days": tables.user_days, "dialogues": tables.dialogues, "customer_orders": tables.customer_orders, "order_lines": tables.order_lines}


def _t(log: str) -> str:
    """CTEs log and t (case_id, trace, n)."""
    if log == "order_lines":
        return _SQL[log] + ", t AS (SELECT c.case_id, coalesce(string_agg(activity, '>' ORDER BY o), '') AS trace, count(activity) AS n FROM cases c LEFT JOIN log USING (case_id) GROUP BY c.case_id)"
    return _SQL[log] + ", t AS (SELECT case_id, string_agg(activity, '>' ORDER BY o) AS trace, count(*) AS n FROM log GROUP BY case_id)"


def _dfg(log: str) -> str:
    """CTEs log, t and g (kind, source, target, weight)."""
    empty = " UNION ALL SELECT 'empty', NULL, NULL, count(*) FROM t WHERE n = 0 HAVING count(*) > 0" if log == "order_lines" else ""
    return _t(log) + f""", w AS (SELECT activity, lag(activity) OVER p AS b, lead(activity) OVER p AS f FROM log WINDOW p AS (PARTITION BY case_id ORDER BY o)),
g AS (SELECT 'edge' AS kind, activity AS source, f AS target, count(*) AS weight FROM w WHERE f IS NOT NULL GROUP BY 2, 3
 UNION ALL SELECT 'start', NULL, activity, count(*) FROM w WHERE b IS NULL GROUP BY 3 UNION ALL SELECT 'end', activity, NULL, count(*) FROM w WHERE f IS NULL GROUP BY 2{empty})"""


_AUT = """, a AS (SELECT CASE WHEN kind IN ('end', 'empty') THEN 'final' ELSE 'transition' END AS kind, CASE WHEN kind IN ('start', 'empty') THEN '@initial' ELSE source END AS source,
 CASE WHEN kind IN ('edge', 'start') THEN target END AS activity, CASE WHEN kind IN ('edge', 'start') THEN target END AS target, weight FROM g WHERE weight > 0)"""


def _state_sql(labels: str) -> str:
    """The name of a list of labels."""
    return f"array_to_string(list_transform({labels}, lambda x: coalesce(length(x) || ':' || x, '-')), '')"


_PROB = ", p AS (SELECT kind, source, activity, target, weight / sum(weight) OVER (PARTITION BY source) AS weight FROM a)"
_PREFIX = f""", v AS (SELECT CASE WHEN n = 0 THEN [] ELSE string_split(trace, '>') END AS l, n, count(*) AS c FROM t GROUP BY ALL),
a AS (SELECT 'transition' AS kind, {_state_sql('l[1:i - 1]')} AS source, l[i] AS activity, {_state_sql('l[1:i]')} AS target, CAST(sum(c) AS BIGINT) AS weight FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM v) GROUP BY 2, 3, 4
 UNION ALL SELECT 'final', {_state_sql('l')}, NULL, NULL, c FROM v)"""
def _net_sql(src: str, start: str) -> str:
    """CTEs m and net of the automaton in ``src``, with the token on ``start``."""
    return f""", m AS (SELECT *, {_state_sql('[source, activity, target]')} AS t FROM {src}),
net AS (SELECT 'transition' AS kind, t AS transition, activity AS label, NULL AS place, CAST(weight AS DOUBLE) AS weight FROM m UNION ALL SELECT 'input', t, NULL, source, 1.0 FROM m
 UNION ALL SELECT 'output', t, NULL, target, 1.0 FROM m WHERE target IS NOT NULL UNION ALL SELECT 'marking', NULL, NULL, {start}, 1.0)"""


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("trace", F.array_join("trace", ">"))


def _on(log: str, op: Callable[[tables.EventLog], DataFrame]) -> Query:
    return lambda spark, d: op(_LOGS[log](spark, d))


def _dfg_of(log: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: op(graphs.directly_follows_graph(_LOGS[log](spark, d)))


def _short(name: str, log: str) -> str:
    return name if log == "user_days" else f"{name}_{log}"


# ---- traces, languages, counts -----------------------------------------------------------------------------------

for _log in _LOGS:
    _w, _t_ = f"WITH {_t(_log)} ", _t(_log)
    _add(_short("log_trace_view", _log), _on(_log, lambda x: _joined(logs.traces(x))), _w + "SELECT case_id, trace FROM t")
    _add(_short("log_to_slang", _log), _on(_log, lambda x: _joined(languages.stochastic_language(x))), _w + "SELECT trace, count(*) AS num, (SELECT count(*) FROM t) AS den, count(*) / (SELECT count(*) FROM t) AS probability FROM t GROUP BY trace")
    _add(_short("log_counts", _log), _on(_log, logs.counts), _w + "SELECT count(*) AS n_traces, CAST(sum(n) AS BIGINT) AS n_events FROM t")
    _add(_short("start_activities", _log), _on(_log, logs.start_activities), f"WITH {_dfg(_log)} SELECT target AS activity, weight AS cnt FROM g WHERE kind = 'start'")
    _add(_short("end_activities", _log), _on(_log, logs.end_activities), f"WITH {_dfg(_log)} SELECT source AS activity, weight AS cnt FROM g WHERE kind = 'end'")
    _add(_short("trace_length_stats", _log), _on(_log, logs.trace_length_stats), _w + "SELECT min(n) AS min_length, max(n) AS max_length, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_traces, CAST(sum(n) AS BIGINT) / count(*) AS avg_length FROM t")
    _add(_short("dfg", _log), _dfg_of(_log, lambda g: g), f"WITH {_dfg(_log)} SELECT * FROM g")
    _add(_short("log_to_sdfa", _log), _on(_log, lambda x: graphs.probabilities(graphs.prefix_automaton(x))), f"WITH {_t_}{_PREFIX}{_PROB} SELECT * FROM p")

_U = f"WITH {_t('user_days')} "
_add("log_to_language", _on("user_days", lambda x: _joined(languages.language(x))), _U + "SELECT DISTINCT trace FROM t")
_add("lang_counts", _on("user_days", lambda x: languages.lengths(languages.language(x))), _U + "SELECT count(*) AS n_traces, CAST(sum(n) AS BIGINT) AS n_events FROM (SELECT DISTINCT trace, n FROM t)")
_add("slang_normalise", _on("user_days", lambda x: _joined(languages.normalise(languages.stochastic_language(x).where("num >= 2")))), _U + ", v AS (SELECT trace, count(*) AS num FROM t GROUP BY trace HAVING count(*) >= 2) SELECT trace, num, (SELECT CAST(sum(num) AS BIGINT) FROM v) AS den, num / (SELECT CAST(sum(num) AS BIGINT) FROM v) AS probability FROM v")
_add("slang_partial_sum", _on("user_days", lambda x: languages.probability_sum(languages.stochastic_language(x).where("num >= 2"))), _U + ", v AS (SELECT trace, count(*) AS num FROM t GROUP BY trace HAVING count(*) >= 2) SELECT count(*) AS n_traces, CAST(sum(num) AS BIGINT) AS num, (SELECT count(*) FROM t) AS den, sum(num) <= (SELECT count(*) FROM t) AS at_most_one FROM v")
_add("slang_equality", _on("user_days", lambda x: _joined(languages.differences(languages.stochastic_language(x), languages.stochastic_language(logs.retain_traces(x, F.expr("size(trace) <> 2")))))), _U + ", v AS (SELECT trace, any_value(n) AS n, count(*) AS c FROM t GROUP BY trace), w AS (SELECT trace, c FROM v WHERE n <> 2) SELECT trace, v.c AS na, CAST((SELECT sum(c) FROM v) AS BIGINT) AS da, w.c AS nb, CASE WHEN w.c IS NOT NULL THEN CAST((SELECT sum(c) FROM w) AS BIGINT) END AS db FROM v LEFT JOIN w USING (trace) WHERE w.c IS NULL OR v.c * (SELECT sum(c) FROM w) <> w.c * (SELECT sum(c) FROM v)")
_add("slang_push", lambda s, d: _joined(languages.push(languages.stochastic_language(tables.user_days(s, d)).where("num >= 3"), languages.stochastic_language(tables.dialogues(s, d)))), f"WITH u AS (WITH {_t('user_days')} SELECT trace, count(*) AS num, sum(count(*)) OVER () AS den FROM t GROUP BY trace), d AS (WITH {_t('dialogues')} SELECT trace, count(*) AS num, sum(count(*)) OVER () AS den FROM t GROUP BY trace), x AS (SELECT * FROM u WHERE num >= 3 UNION ALL SELECT * FROM d), m AS (SELECT CAST(lcm(CAST(min(den) AS BIGINT), CAST(max(den) AS BIGINT)) AS BIGINT) AS den FROM x) SELECT trace, CAST(sum(num * (m.den // CAST(x.den AS BIGINT))) AS BIGINT) AS num, any_value(m.den) AS den, sum(num * (m.den // CAST(x.den AS BIGINT))) / any_value(m.den) AS probability FROM x, m GROUP BY trace")
_add("attempt_labels", lambda s, d: _joined(logs.attempt_labels(tables.user_days(s, d), s.createDataFrame([("click",), ("view",), ("signup",)], "activity string"))), _U + "SELECT case_id, CASE WHEN bool_and(activity IN ('click', 'view', 'signup')) THEN any_value(trace) END AS trace FROM log JOIN t USING (case_id) GROUP BY case_id")
_add("lang_union", lambda s, d: _joined(languages.union(languages.language(tables.user_days(s, d)), languages.language(tables.dialogues(s, d)))), f"SELECT trace FROM (WITH {_t('user_days')} SELECT trace FROM t) UNION SELECT trace FROM (WITH {_t('dialogues')} SELECT trace FROM t)")
_add("trace_length_hist", _on("user_days", logs.trace_length_histogram), _U + "SELECT n AS length, count(*) AS cnt FROM t GROUP BY n")
_add("activity_frequency", _on("user_days", logs.activity_frequency), _U + "SELECT activity, count(*) AS cnt FROM log GROUP BY 1")
_add("top20_activities", lambda s, d: logs.top_activities(tables.log_of(s.read.parquet(f"{d}/part.parquet"), "p_size", "p_brand", ("p_partkey",))), "SELECT p_brand AS activity, count(*) AS cnt FROM part GROUP BY 1 ORDER BY 1 LIMIT 20")

# ---- filters ------------------------------------------------------------------------------------------------------

for _name, _cond, _where in (
    ("retain_traces_containing", "array_contains(trace, 'purchase')", "list_contains(string_split(trace, '>'), 'purchase')"),
    ("retain_traces_min_length", "size(trace) >= 4", "n >= 4"),
    ("retain_traces_starting", "trace[0] = 'signup'", "trace LIKE 'signup%'"),
    ("retain_traces_all_of", "forall(trace, a -> a IN ('click', 'view'))", "regexp_full_match(trace, '((click|view)(>|$))*')"),
):
    _add(_name, lambda s, d, c=_cond: _joined(logs.traces(logs.retain_traces(tables.user_days(s, d), F.expr(c)))), _U + f"SELECT case_id, trace FROM t WHERE {_where}")
_add("retain_traces_by_attribute", lambda s, d: _joined(logs.traces(logs.retain_traces(tables.order_lines(s, d), (F.col("o_totalprice") > 200000) & (F.size("trace") < 4)))), f"WITH {_t('order_lines')} SELECT case_id, trace FROM t JOIN cases USING (case_id) WHERE o_totalprice > 200000 AND n < 4")

# ---- attributes ---------------------------------------------------------------------------------------------------

_POS = "row_number() OVER (PARTITION BY case_id ORDER BY o) - 1"
_FMT = "'%Y-%m-%d %H:%M:%S.%f'"
_add("event_attr_numeric", _on("user_days", lambda x: logs.event_attribute(x, "value", "numeric")), _U + f"SELECT case_id, CAST({_POS} AS INTEGER) AS pos, activity, value FROM log")
_add("event_attr_categorical", _on("user_days", lambda x: logs.event_attribute(x, "props", "categorical")), _U + f"SELECT case_id, CAST({_POS} AS INTEGER) AS pos, activity, props AS value FROM log")
_add("event_attr_time", _on("user_days", lambda x: logs.event_attribute(x, "ts", "time").withColumn("value", F.date_format("value", "yyyy-MM-dd HH:mm:ss.SSSSSS"))), _U + f"SELECT case_id, CAST({_POS} AS INTEGER) AS pos, activity, strftime(ts, {_FMT}) AS value FROM log")
_add("event_attr_json", _on("user_days", lambda x: logs.positions(x).select("case_id", "pos", F.get_json_object("props", "$.k").alias("value"))), _U + f"SELECT case_id, CAST({_POS} AS INTEGER) AS pos, props->>'$.k' AS value FROM log")
_O = f"WITH {_t('order_lines')} "
_add("trace_attr_numeric", _on("order_lines", lambda x: logs.trace_attribute(x, "o_totalprice", "numeric")), _O + "SELECT case_id, o_totalprice AS value FROM cases")
_add("trace_attr_categorical", _on("order_lines", lambda x: logs.trace_attribute(x, "o_orderpriority", "categorical")), _O + "SELECT case_id, o_orderpriority AS value FROM cases")
_add("trace_attr_time", _on("order_lines", lambda x: logs.trace_attribute(x, "o_orderdate", "time").withColumn("value", F.date_format("value", "yyyy-MM-dd"))), _O + "SELECT case_id, strftime(o_orderdate, '%Y-%m-%d') AS value FROM cases")
_add("trace_attr_with_trace", _on("order_lines", lambda x: _joined(logs.traces(x)).join(logs.trace_attribute(x, "o_totalprice", "numeric"), "case_id")), _O + "SELECT case_id, trace, o_totalprice AS value FROM t JOIN cases USING (case_id)")
_add("event_point_lookup", _on("user_days", lambda x: logs.event_attribute(x, "value", "numeric").where("pos = 2")), _U + f"SELECT * FROM (SELECT case_id, CAST({_POS} AS INTEGER) AS pos, activity, value FROM log) WHERE pos = 2")
_add("attribute_profile", _on("user_days", lambda x: logs.attribute_profile(x, ("value", "ts", "props")).select("attribute", "kind", "n", F.when(F.col("kind") == "Time", F.col("least")).alias("least"))), "SELECT 'value' AS attribute, 'Numerical' AS kind, count(value) AS n, NULL AS least FROM events UNION ALL SELECT 'props', 'Categorical', count(props), NULL FROM events UNION ALL SELECT 'ts', 'Time', count(ts), strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') FROM events")
_add("info_log", _on("user_days", lambda x: logs.counts(x).selectExpr("stack(2, 'traces', cast(n_traces as string), 'events', cast(n_events as string)) AS (metric, value)").union(logs.activity_frequency(x).agg(F.lit("activities").alias("metric"), F.count("*").cast("string").alias("value")))), _U + "SELECT 'traces' AS metric, CAST(count(*) AS VARCHAR) AS value FROM t UNION ALL SELECT 'events', CAST(count(*) AS VARCHAR) FROM log UNION ALL SELECT 'activities', CAST(count(DISTINCT activity) AS VARCHAR) FROM log")

# ---- directly-follows graphs and models -----------------------------------------------------------------------------

_G = f"WITH {_dfg('user_days')} "
_GL = f"WITH {_dfg('order_lines')} "
_add("activity_cardinality", _dfg_of("user_days", graphs.activity_cardinality), _G + "SELECT source AS activity, CAST(sum(weight) AS BIGINT) AS cnt FROM g WHERE kind IN ('edge', 'end') GROUP BY 1")
_add("dfg_outgoing", _dfg_of("user_days", lambda g: g.where("kind = 'edge' AND source = 'click'").select("target", "weight")), _G + "SELECT target, weight FROM g WHERE kind = 'edge' AND source = 'click'")
_add("dfg_incoming", _dfg_of("user_days", lambda g: g.where("kind = 'edge' AND target = 'click'").select("source", "weight")), _G + "SELECT source, weight FROM g WHERE kind = 'edge' AND target = 'click'")
_add("dfg_weight_sum", _dfg_of("user_days", lambda g: g.groupBy("kind").agg(F.sum("weight").alias("weight"))), _G + "SELECT kind, CAST(sum(weight) AS BIGINT) AS weight FROM g GROUP BY 1")
_add("dfg_remove_edges", _dfg_of("order_lines", lambda g: graphs.remove_edges(g, 100)), _GL + "SELECT * FROM g WHERE kind <> 'edge' OR weight >= 100")
_add("dfg_to_dfm", _dfg_of("order_lines", graphs.model_of), _GL + "SELECT kind, source, target FROM g WHERE weight > 0")
_SDFM = ", nodes AS (SELECT DISTINCT unnest([source, target]) AS x FROM g), s AS (SELECT kind, source, target, weight FROM g WHERE kind IN ('edge', 'empty') UNION ALL SELECT 'start', NULL, x, coalesce(weight, 0) FROM nodes LEFT JOIN (SELECT * FROM g WHERE kind = 'start') k ON k.target = x WHERE x IS NOT NULL UNION ALL SELECT 'end', x, NULL, coalesce(weight, 0) FROM nodes LEFT JOIN (SELECT * FROM g WHERE kind = 'end') k ON k.source = x WHERE x IS NOT NULL) "
_add("dfg_to_sdfm", _dfg_of("order_lines", graphs.stochastic_model_of), _GL.rstrip() + _SDFM + "SELECT * FROM s")
_add("sdfm_to_dfm", _dfg_of("order_lines", lambda g: graphs.model_of(graphs.stochastic_model_of(g))), _GL.rstrip() + _SDFM + "SELECT kind, source, target FROM s WHERE weight > 0")
for _log in ("user_days", "order_lines"):
    _g = f"WITH {_dfg(_log)}{_AUT}{_PROB} "
    for _name in ("dfg_to_sdfa", "sdfm_to_snfa"):
        _add(_short(_name, _log), _dfg_of(_log, lambda g, n=_name: graphs.probabilities(graphs.automaton_of(graphs.stochastic_model_of(g) if n == "sdfm_to_snfa" else g))), _g + "SELECT * FROM p")
_add("dfm_to_dfa", _dfg_of("order_lines", lambda g: graphs.without_weights(graphs.automaton_of(g))), f"WITH {_dfg('order_lines')}{_AUT} SELECT kind, source, activity, target FROM a")
_add("sdfa_to_dfa", _on("user_days", lambda x: graphs.without_weights(graphs.probabilities(graphs.prefix_automaton(x)))), f"WITH {_t('user_days')}{_PREFIX} SELECT kind, source, activity, target FROM a")
_add("lang_to_dfa", _on("order_lines", lambda x: graphs.without_weights(graphs.prefix_automaton(x))), f"WITH {_t('order_lines')}{_PREFIX} SELECT kind, source, activity, target FROM a")
_add("sdfa_state_consistency", _on("user_days", lambda x: graphs.inconsistent_states(graphs.probabilities(graphs.prefix_automaton(x)).where("activity IS NULL OR activity <> 'purchase'")).select("source", F.round("total", 9).alias("total"))), f"WITH {_t('user_days')}{_PREFIX}{_PROB} SELECT source, round(sum(weight), 9) AS total FROM p WHERE activity IS NULL OR activity <> 'purchase' GROUP BY 1 HAVING abs(sum(weight) - 1) > 1e-9")
_add("sdfa_trace_probability", _on("user_days", lambda x: _joined(graphs.trace_probability(logs.variants(x), graphs.probabilities(graphs.prefix_automaton(x)))).withColumn("probability", F.round("probability", 9))), _U + "SELECT trace, round(count(*) / (SELECT count(*) FROM t), 9) AS probability FROM t GROUP BY trace")
_add("automaton_outgoing_weight", _dfg_of("order_lines", lambda g: graphs.outgoing_weight(graphs.automaton_of(g))), f"WITH {_dfg('order_lines')}{_AUT} SELECT source, CAST(sum(weight) AS BIGINT) AS weight FROM a GROUP BY 1")
_add("automaton_transitions", _dfg_of("order_lines", lambda g: graphs.transitions(graphs.automaton_of(g))), f"WITH {_dfg('order_lines')}{_AUT} SELECT source, activity, coalesce(target, '@final') AS target, weight, CAST(row_number() OVER (ORDER BY source, activity NULLS LAST, target) - 1 AS INTEGER) AS idx FROM a")
_edges = lambda g: g.where("kind = 'edge'").select("source", "target")
_REACH = ", r AS (WITH RECURSIVE p(x, y) AS (SELECT source, target FROM g WHERE kind = 'edge' UNION SELECT p.x, g.target FROM p JOIN g ON g.kind = 'edge' AND g.source = p.y) SELECT * FROM p) "
_add("automaton_reachability", _dfg_of("order_lines", lambda g: graphs.reachable(_edges(g))), _GL.rstrip() + _REACH + "SELECT x AS source, y AS target FROM r")
_add("dfg_scc", _dfg_of("order_lines", lambda g: graphs.strong_components(_edges(g))), _GL.rstrip() + _REACH + ", nodes AS (SELECT DISTINCT unnest([source, target]) AS node FROM g WHERE kind = 'edge') SELECT node, least(node, coalesce((SELECT min(a.y) FROM r a JOIN r b ON a.x = b.y AND a.y = b.x WHERE a.x = node), node)) AS component FROM nodes")

# ---- nets -----------------------------------------------------------------------------------------------------------

for _name, _src, _weights in (("sdfm_to_slpn", "a", True), ("dfm_to_lpn", "a", False)):
    _add(_name, _dfg_of("user_days", lambda g, w=_weights: graphs.net_of(graphs.automaton_of(g)) if w else graphs.net_of(graphs.automaton_of(g)).drop("weight")), f"WITH {_dfg('user_days')}{_AUT}{_net_sql('a', chr(39) + '@initial' + chr(39))} SELECT {'*' if _weights else 'kind, transition, label, place'} FROM net")
_PNET = f"WITH {_t('user_days')}{_PREFIX}{_PROB}{_net_sql('p', chr(39) * 2)} "
_sdfa_net = lambda x: graphs.net_of(graphs.probabilities(graphs.prefix_automaton(x)))
_add("sdfa_to_slpn", _on("user_days", _sdfa_net), _PNET + "SELECT * FROM net")
_add("dfa_to_lpn", _on("user_days", lambda x: _sdfa_net(x).drop("weight")), _PNET + "SELECT kind, transition, label, place FROM net")
_add("slpn_incidence", _on("user_days", lambda x: graphs.incidence(_sdfa_net(x))), _PNET + "SELECT transition, place, CAST(sum(CASE kind WHEN 'output' THEN weight ELSE -weight END) AS BIGINT) AS change FROM net WHERE kind IN ('input', 'output') GROUP BY 1, 2")


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """A net of deliveries: a transition for each supplier takes a token from the part's place for each line."""
    none = F.lit(None).cast("string")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("transition"), F.concat(F.lit("brand "), F.col("l_partkey") % 50).alias("place"))
    rows = lambda kind, place: lines.select(F.lit(kind).alias("kind"), "transition", none.alias("label"), place.alias("place"), F.lit(1.0).alias("weight"))
    return rows("input", F.col("place")).unionByName(rows("output", F.lit("delivered")))


_DELIVERIES = "WITH net AS (SELECT CAST(l_suppkey AS VARCHAR) AS transition, 'brand ' || (l_partkey % 50) AS place FROM lineitem) "
_add("slpn_max_arc", lambda s, d: graphs.largest_input(_deliveries(s, d)), _DELIVERIES + "SELECT max(n) AS largest FROM (SELECT count(*) AS n FROM net GROUP BY transition, place)")
_add("net_places_around", lambda s, d: graphs.places_around(_deliveries(s, d)).select("transition", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after")), _DELIVERIES + "SELECT transition, string_agg(DISTINCT place, ',' ORDER BY place) AS before, 'delivered' AS after FROM net GROUP BY 1")
_add("net_transitions_around", lambda s, d: graphs.transitions_around(_deliveries(s, d)).select("place", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after")), _DELIVERIES + "SELECT place, '' AS before, string_agg(DISTINCT transition, ',' ORDER BY transition) AS after FROM net GROUP BY 1 UNION ALL SELECT 'delivered', string_agg(DISTINCT transition, ',' ORDER BY transition), '' FROM net")

# ---- states and transitions by number -----------------------------------------------------------------------------------

_SEMANTICS = """, names AS (SELECT x, CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT unnest([source, target]) AS x FROM g WHERE weight > 0) WHERE x IS NOT NULL),
z AS (SELECT CAST((SELECT count(*) FROM names) AS INTEGER) AS n, CAST((SELECT count(*) FROM g WHERE kind = 'edge' AND weight > 0) AS INTEGER) AS m),
i AS (SELECT g.*, s.i AS s, t.i AS t FROM g LEFT JOIN names s ON s.x = g.source LEFT JOIN names t ON t.x = g.target WHERE weight > 0),
sem AS (SELECT CAST(row_number() OVER (ORDER BY s, t) - 1 AS INTEGER) AS transition, s AS source, t AS target, target AS activity, weight FROM i WHERE kind = 'edge'
 UNION ALL SELECT m + 1 + t, n, t, target, weight FROM i, z WHERE kind = 'start' UNION ALL SELECT m, s, n + 1, NULL, weight FROM i, z WHERE kind = 'end' UNION ALL SELECT m, n, n + 1, NULL, weight FROM i, z WHERE kind = 'empty') """
for _log in ("user_days", "order_lines"):
    _add(_short("dfg_semantics", _log), _dfg_of(_log, graphs.graph_semantics), f"WITH {_dfg(_log)}{_SEMANTICS} SELECT * FROM sem")
_add("sdfm_semantics", _dfg_of("order_lines", lambda g: graphs.graph_semantics(graphs.stochastic_model_of(g))), f"WITH {_dfg('order_lines')}{_SEMANTICS} SELECT * FROM sem")
_add("dfm_semantics", _dfg_of("order_lines", lambda g: graphs.graph_semantics(graphs.model_of(g).withColumn("weight", F.lit(1))).drop("weight")), f"WITH {_dfg('order_lines')}{_SEMANTICS} SELECT transition, source, target, activity FROM sem")
_add("dfg_enabled", _dfg_of("user_days", lambda g: graphs.enabled(graphs.graph_semantics(g), 0)), f"WITH {_dfg('user_days')}{_SEMANTICS} SELECT transition, activity, target, weight FROM sem WHERE source = 0")
_AUTSEM = """, names AS (SELECT x, CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT unnest([source, target]) AS x FROM {src}) WHERE x IS NOT NULL),
j AS (SELECT p.*, s.i AS s, t.i AS t FROM {src} p JOIN names s ON s.x = p.source LEFT JOIN names t ON t.x = p.target WHERE weight > 0)
SELECT CAST(row_number() OVER (ORDER BY s, activity, t) - 1 AS INTEGER) AS transition, s AS source, t AS target, activity, weight FROM j WHERE kind = 'transition'
UNION ALL SELECT CAST((SELECT count(*) FROM j WHERE kind = 'transition') AS INTEGER), s, CAST((SELECT count(*) FROM names) AS INTEGER), NULL, weight FROM j WHERE kind = 'final'"""
_add("sdfa_semantics", _on("user_days", lambda x: graphs.automaton_semantics(graphs.probabilities(graphs.prefix_automaton(x)))), f"WITH {_t('user_days')}{_PREFIX}{_PROB}{_AUTSEM.format(src='p')}")
_add("snfa_semantics", _dfg_of("order_lines", lambda g: graphs.automaton_semantics(graphs.probabilities(graphs.automaton_of(g)))), f"WITH {_dfg('order_lines')}{_AUT}{_PROB}{_AUTSEM.format(src='p')}")
_add("dfa_semantics", _dfg_of("order_lines", lambda g: graphs.automaton_semantics(graphs.automaton_of(g).withColumn("weight", F.lit(1))).drop("weight")), f"WITH {_dfg('order_lines')}{_AUT}{_AUTSEM.format(src='a').replace('activity, weight FROM', 'activity FROM').replace('NULL, weight FROM', 'NULL FROM')}")
_add("dfg_activities", _dfg_of("order_lines", graphs.describe_activities), f"WITH {_dfg('order_lines')}, n AS (SELECT DISTINCT unnest([source, target]) AS activity FROM g) SELECT activity, activity IN (SELECT target FROM g WHERE kind = 'start') AS is_start, activity IN (SELECT source FROM g WHERE kind = 'end') AS is_end, EXISTS (SELECT 1 FROM g WHERE kind = 'edge' AND source = activity AND target = activity) AS has_loop FROM n WHERE activity IS NOT NULL")
_add("dfg_remove_starts", _dfg_of("order_lines", lambda g: graphs.remove_ends(graphs.remove_ends(g, "start", ("RF",)), "end", ("NO",))), _GL + "SELECT * FROM g WHERE NOT (kind = 'start' AND target = 'RF') AND NOT (kind = 'end' AND source = 'NO')")
_add("retain_traces_by_event_attribute", lambda s, d: _joined(logs.traces(logs.retain_traces_by_events(tables.user_days(s, d), F.expr("exists(value, v -> v > 90) AND trace[0] <> 'view'"), ("value",)))), _U + "SELECT case_id, any_value(trace) AS trace FROM log JOIN t USING (case_id) GROUP BY case_id HAVING max(value) > 90 AND NOT starts_with(any_value(trace), 'view')")
_add("event_attr_resource", _on("user_days", lambda x: logs.event_attribute(tables.EventLog(x.events.withColumn("resource", F.regexp_extract("case_id", "^[^_]*", 0)), x.order), "resource", "categorical")), _U + f"SELECT case_id, CAST({_POS} AS INTEGER) AS pos, activity, split_part(case_id, '_', 1) AS value FROM log")
_add("ocel_trace_attribute_values", lambda s, d: objects.trace_attributes(objects.order_objects(s, d), "part"), "SELECT 'part:' || p_partkey AS case_id, 'attribute' AS name, p_brand AS value FROM part UNION ALL SELECT 'part:' || p_partkey, 'object-id', 'part:' || p_partkey FROM part")
_add("ocel_end_activities", lambda s, d: logs.end_activities(objects.flatten(objects.order_objects(s, d), "part")), None)

# ---- object-centric logs -----------------------------------------------------------------------------------------------

_OC = """ev AS (SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS event_id, l_returnflag || l_linestatus AS activity,
 strftime(l_shipdate, '%Y-%m-%d') || '#' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS pos, 'order:' || l_orderkey AS ord, 'part:' || l_partkey AS prt, 'supplier:' || l_suppkey AS sup FROM lineitem)"""
for _kind, _col, _table, _id in (("order", "ord", "orders", "o_orderkey"), ("part", "prt", "part", "p_partkey"), ("supplier", "sup", "supplier", "s_suppkey")):
    _add(f"ocel_flatten_{_kind}", lambda s, d, k=_kind: _joined(logs.traces(objects.flatten(objects.order_objects(s, d), k))), f"WITH {_OC} SELECT o.case_id, coalesce(string_agg(activity, '>' ORDER BY pos, event_id), '') AS trace FROM (SELECT '{_kind}:' || {_id} AS case_id FROM {_table}) o LEFT JOIN ev ON ev.{_col} = o.case_id GROUP BY 1")
    _add(f"ocel_trace_lengths_{_kind}", lambda s, d, k=_kind: objects.trace_lengths(objects.order_objects(s, d), k), f"WITH {_OC} SELECT o.case_id, count(*) AS length FROM (SELECT '{_kind}:' || {_id} AS case_id FROM {_table}) o JOIN ev ON ev.{_col} = o.case_id GROUP BY 1")
_add("ocel_start_activities", lambda s, d: logs.start_activities(objects.flatten(objects.order_objects(s, d), "part")), f"WITH {_OC} SELECT activity, count(*) AS cnt FROM (SELECT arg_min(activity, pos || '~' || event_id) AS activity FROM ev JOIN part ON prt = 'part:' || p_partkey GROUP BY prt) GROUP BY 1")
_add("ocel_type_counts", lambda s, d: objects.type_counts(objects.order_objects(s, d)), "SELECT 'order' AS object_type, count(*) AS cnt FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
_add("info_ocel", lambda s, d: objects.info(objects.order_objects(s, d)), "SELECT 'events' AS metric, CAST(count(*) AS VARCHAR) AS value FROM lineitem UNION ALL SELECT 'event types', CAST(count(DISTINCT l_returnflag || l_linestatus) AS VARCHAR) FROM lineitem UNION ALL SELECT 'objects', CAST((SELECT count(*) FROM orders) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS VARCHAR) UNION ALL SELECT 'object types', '3'")
_add("ocel_trace_attributes", lambda s, d: (x := objects.flatten(objects.order_objects(s, d), "part")) and x.cases.select("case_id", "attribute"), "SELECT 'part:' || p_partkey AS case_id, p_brand AS attribute FROM part")
_add("ocel_event_attributes", lambda s, d: (o := objects.order_objects(s, d)) and objects.flatten(o, "part").events.join(objects.event_resources(o, "supplier"), "event_id", "left").select("case_id", "event_id", "activity", "resource"), f"WITH {_OC} SELECT prt AS case_id, event_id, activity, CASE WHEN s_suppkey IS NOT NULL THEN sup END AS resource FROM ev JOIN part ON prt = 'part:' || p_partkey LEFT JOIN supplier ON sup = 'supplier:' || s_suppkey")
ORACLE_SQL["ocel_end_activities"] = f"WITH {_OC} SELECT activity, count(*) AS cnt FROM (SELECT arg_max(activity, pos || '~' || event_id) AS activity FROM ev JOIN part ON prt = 'part:' || p_partkey GROUP BY prt) GROUP BY 1"
