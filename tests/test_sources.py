import gzip
import json
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tracewright.formats import text as T
from tracewright.operators import graphs, languages, logs, objects
from tracewright.plans.convert import convert, path
from tracewright.sources import readers, tables, writers
from tracewright.streaming.follows import follows_counts, follows_stream

XES = """<?xml version="1.0"?><log xes.version="1.0">
<trace><string key="concept:name" value="ward 4"/><int key="beds" value="12"/><list key="tags"><values><string key="tag" value="acute"/></values></list>
<event><string key="concept:name" value="admit"/><string key="lifecycle:transition" value="start"/><string key="org:resource" value="nurse"/><date key="time:timestamp" value="2021-03-04T08:15:30.250+02:00"/><float key="temp" value="38.5"/></event>
<event><string key="concept:name" value="triage &lt;red&gt;"/><boolean key="urgent" value="true"/></event></trace>
<trace><string key="concept:name" value="ward 4"/><event><string key="concept:name" value="admit"/></event></trace>
<trace><string key="concept:name" value="nobody"/></trace></log>"""

OCEL = """<log><object-types><object-type name="Truck"><attributes/></object-type><object-type name="Parcel"><attributes/></object-type><object-type name="Driver"><attributes/></object-type></object-types>
<objects><object id="T7" type="Truck"><attributes><attribute name="plate" time="1970-01-01T00:00:00Z">K-7</attribute></attributes></object><object id="T8" type="Truck"><attributes/></object><object id="X1" type="Parcel"><attributes/></object><object id="X2" type="Parcel"><attributes/></object><object id="D1" type="Driver"><attributes/></object></objects>
<events><event id="load-1" type="load" time="2023-05-02T06:00:00Z"><attributes><attribute name="checked">2023-05-02T07:30:00Z</attribute></attributes><objects><relationship object-id="T7" qualifier="into"/><relationship object-id="X1" qualifier="what"/><relationship object-id="X2" qualifier="what"/><relationship object-id="X2" qualifier="heaviest"/></objects></event>
<event id="drive-1" type="drive" time="2023-05-02T09:45:00Z"><attributes/><objects><relationship object-id="T7" qualifier="with"/><relationship object-id="D1" qualifier="by"/></objects></event>
<event id="unload-1" type="unload" time="2023-05-02T17:05:00Z"><attributes/><objects><relationship object-id="X2" qualifier="what"/><relationship object-id="T7" qualifier="from"/></objects></event></events></log>"""


def got(log):
    return sorted(">".join(r.trace) for r in logs.traces(log).collect())


def test_csv(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("case_id,activity\n1,a\n2,a\n1,b\n")
    assert got(readers.read_csv(spark, str(p))) == ["a", "a>b"]
    assert got(readers.read_csv(spark, str(p), case="activity", activity="case_id")) == ["1", "1>2"]
    for bad in ({"separator": "::"}, {"time": "none"}, {"case": "x"}):
        with pytest.raises(ValueError):
            readers.read_csv(spark, str(p), **bad)
    (tmp_path / "one.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "one.csv"))
    writers.write_csv(readers.read_csv(spark, str(p)), str(tmp_path / "out"))
    assert got(readers.read_csv(spark, str(tmp_path / "out"))) == ["a", "a>b"]


def test_csv_with_line_breaks_and_in_parts(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text('case,step,note\n' + "".join(f'{i // 3},s{i % 3},"x"\n' for i in range(3000)))
    assert set(got(readers.read_csv(spark, str(p)))) == {"s0>s1>s2"}
    (tmp_path / "lines.csv").write_text('case,step\n1,"two\nlines"\n1,b\n')
    assert got(readers.read_csv(spark, str(tmp_path / "lines.csv"), lines=True)) == ["two\nlines>b"]


@pytest.mark.parametrize("zipped", [False, True])
def test_xes(spark, tmp_path, zipped):
    p = tmp_path / ("log.xes.gz" if zipped else "log.xes")
    p.write_bytes(gzip.compress(XES.encode()) if zipped else XES.encode())
    log = readers.read_xes(spark, str(p))
    assert got(log) == ["", "admit", "admit>triage <red>"]
    first = log.events.where("resource = 'nurse'").first()
    assert first.activity == "admit" and first.ts.isoformat() == "2021-03-04T06:15:30.250000" and first.pos == 0
    assert first.attributes["temp"]["type"] == "float" and first.attributes["temp"]["value"] == "38.5"
    ward = next(r.attributes for r in log.cases.collect() if "beds" in r.attributes)
    assert ward["beds"]["type"] == "int" and ward["tags"]["type"] == "list" and '"acute"' in ward["tags"]["value"]
    assert got(readers.read_xes(spark, str(p), ("concept:name", "lifecycle:transition")))[1:] == ["admit+", "admit+start>triage <red>+"]
    writers.write_xes(log, str(tmp_path / "out"), zipped)
    assert got(readers.read_xes(spark, str(tmp_path / "out"))) == ["", "admit", "admit>triage <red>"]
    assert logs.counts(log).first().n_traces == 3
    with pytest.raises(ValueError):
        (tmp_path / "no.csv").write_text("a,b\n")
        readers.read_xes(spark, str(tmp_path / "no.csv"))


def test_xes_keeps_typed_attributes(spark, tmp_path):
    (tmp_path / "log.xes").write_text(XES)
    log = readers.read_xes(spark, str(tmp_path / "log.xes"))
    writers.write_xes(log, str(tmp_path / "events"), event_attributes=True)
    again = readers.read_xes(spark, str(tmp_path / "events"))
    told = lambda x: sorted((r.activity, r.pos, sorted((k, v.type, v.value) for k, v in r.attributes.items())) for r in x.events.collect())
    assert told(again) == told(log)
    with pytest.raises(Exception, match="lists and containers"):
        writers.write_xes(log, str(tmp_path / "all"), trace_attributes=True)
    plain = log.cases.where("NOT map_contains_key(attributes, 'tags')")
    writers.write_xes(tables.EventLog(log.events.join(plain, "case_id", "left_semi"), log.order, plain), str(tmp_path / "cases"), trace_attributes=True)
    assert sorted(r.attributes["concept:name"]["value"] for r in readers.read_xes(spark, str(tmp_path / "cases")).cases.collect()) == ["nobody", "ward 4"]
    writers.write_xes(tables.EventLog(log.events.limit(0), log.order), str(tmp_path / "none"))
    assert readers.read_xes(spark, str(tmp_path / "none")).events.count() == 0


def test_read_cases_are_not_taken_apart(spark, tmp_path):
    """Traces and events of a XES file come with their case's attributes without a shuffle, and are those of the joins."""
    (tmp_path / "log.xes").write_text(XES.replace('<float key="temp" value="38.5"/>', '<float key="temp" value="38.5"/><string key="temp" value="warm"/><string key="k" value="1"/><string key="k" value="2"/>'))
    log = readers.read_xes(spark, str(tmp_path / "log.xes"))
    apart = tables.EventLog(log.events, log.order, log.cases)
    for of in (logs.traces, logs.traces_of_cases, logs.events_of_cases):
        whole, joined = of(log), of(apart)
        assert sorted(whole.columns) == sorted(joined.columns)
        assert sorted(repr(r) for r in whole.select(*joined.columns).collect()) == sorted(repr(r) for r in joined.collect())
        assert "Exchange" not in of(log)._jdf.queryExecution().executedPlan().toString()
    first = logs.events_of_cases(log).where("resource = 'nurse'").first()
    assert first.case.attributes["beds"]["value"] == "12" and first.ts.isoformat() == "2021-03-04T06:15:30.250000"
    assert first.attributes["temp"] == ("float", "38.5") and first.attributes["k"] == ("string", "2")  # of a key that stands twice the last one counts
    kept = logs.retain_traces(log, F.expr("size(trace) = 1 AND attributes['concept:name']['value'] = 'ward 4'"))
    assert got(kept) == ["admit"]


def test_files_are_written_by_one_shuffle(spark, tmp_path):
    """A log's events are dealt once on their way into CSV or XES, and not again to see whether there are any."""
    read = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    events = spark.createDataFrame([("1", 1, "b"), ("1", 0, "a"), ("2", 0, "b")], "case_id string, pos int, activity string").coalesce(1)
    log = tables.EventLog(events.mapInArrow(pass_on, events.schema), ("pos",))
    writers.write_xes(log, str(tmp_path / "xes"))
    assert read.value == 3 and got(readers.read_xes(spark, str(tmp_path / "xes"))) == ["a>b", "b"]
    writers.write_csv(log, str(tmp_path / "csv"))
    assert read.value == 6 and got(readers.read_csv(spark, str(tmp_path / "csv"), "case_id", "activity")) == ["a>b", "b"]
    for zipped in (False, True):
        writers.write_xes(tables.EventLog(events.limit(0), ("pos",)), str(tmp_path / f"none{zipped}"), zipped)
        assert readers.read_xes(spark, str(tmp_path / f"none{zipped}")).cases.count() == 0


def test_cases_are_read_without_their_events(spark, tmp_path):
    """Who asks for cases has no events made, nor anything written, and cases bear the numbers that events have."""
    (tmp_path / "log").mkdir()
    for i in range(5):
        (tmp_path / "log" / f"{i}.xes").write_text(XES.replace("ward 4", f"ward {i}") + " " * 100 * i)
    log = readers.read_xes(spark, str(tmp_path / "log"))
    plan = log.cases._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "event:" not in plan.split("ReadSchema")[1] and "/xes-" not in plan
    names = {r.case_id: r.attributes["concept:name"]["value"] for r in log.cases.collect()}
    assert len(names) == 15 and {r.case_id for r in log.whole.collect()} == set(names)
    assert {(r.case_id, r.case.attributes["concept:name"]["value"]) for r in logs.events_of_cases(log).collect()} == {(r.case_id, names[r.case_id]) for r in log.events.collect()}


def test_ocel(spark, tmp_path):
    p = tmp_path / "log.ocel"
    p.write_text(OCEL)
    log = readers.read_ocel(spark, str(p))
    assert log.types == ("Truck", "Parcel", "Driver")
    assert got(objects.flatten(log, "Truck")) == ["", "load>drive>unload"]
    assert got(objects.flatten(log, "Parcel")) == ["load", "load>unload"]
    assert {(r.event_id, r.resource) for r in objects.event_resources(log, "Parcel").collect()} == {("load-1", "X2"), ("unload-1", "X2")}
    assert {tuple(r) for r in objects.trace_attributes(log, "Truck").collect()} == {("T7", "object-id", "T7"), ("T8", "object-id", "T8"), ("T7", "plate", "K-7")}
    by_place = readers.read_ocel_log(spark, str(p), "1", "Driver", "checked")
    assert got(by_place) == ["load", "load>unload"]
    assert {r.ts.hour for r in by_place.events.where("event_id = 'load-1'").collect()} == {7}
    assert {r.resource for r in readers.read_ocel_log(spark, str(p), "Truck").events.collect()} == {"X2", None}
    for bad in ({"case_type": "Ship"}, {"case_type": "3"}, {"resource_type": "Pilot"}):
        with pytest.raises(ValueError):
            readers.read_ocel_log(spark, str(p), **bad)
    writers.write_ocel(log, str(tmp_path / "out"))
    again = readers.read_ocel(spark, str(tmp_path / "out"))
    assert again.types == log.types and got(objects.flatten(again, "Parcel")) == ["load", "load>unload"]
    assert sorted(map(tuple, again.e2o.collect())) == sorted(map(tuple, log.e2o.collect()))
    assert {r.attributes.get("checked") for r in again.events.collect()} == {"2023-05-02T07:30:00Z", None}


def test_ocel_files_in_the_order_of_their_numbers(spark, tmp_path):
    """A task's thousandth file follows the one before it, whatever the names' letters say."""
    event = '<log><event id="{0}" type="{0}" time="2023-05-02T06:00:00Z"><attributes/><objects><relationship object-id="P" qualifier=""/></objects></event></log>'
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "kinds.xml").write_text('<log><object-type name="Parcel"><attributes/></object-type><object id="P" type="Parcel"><attributes/></object></log>')
    for name in ("part-00000-1f-c101.txt", "part-00000-1f-c999.txt", "part-00000-1f-c1000.txt.gz", "part-00001-1f-c000.txt"):
        text = event.format(name[5:].split(".")[0]).encode()
        (tmp_path / "log" / name).write_bytes(gzip.compress(text) if name.endswith("gz") else text)
    assert got(readers.read_ocel_log(spark, str(tmp_path / "log"), "Parcel")) == ["00000-1f-c101>00000-1f-c999>00000-1f-c1000>00001-1f-c000"]


def test_files_of_many_elements(spark, tmp_path, monkeypatch):
    """Every file is a log of its own with its share of the elements, whole and in order; nothing is dealt by key for it."""
    monkeypatch.setattr(writers, "_PER_FILE", 3, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for n, files in ((0, []), (1, [1]), (2, [2]), (3, [3]), (4, [3, 1]), (7, [3, 3, 1]), (9, [3, 3, 3])):
            writers._write_files(spark.range(n).coalesce(1).select(F.concat(F.lit("<x>"), "id", F.lit("</x>"))), "<log>", str(tmp_path / str(n)))
            texts = [p.read_text() for p in sorted((tmp_path / str(n)).glob("part-*")) if p.stat().st_size]
            assert [t.count("<x>") for t in texts] == files and all(t.startswith("<log>\n<x>") and t.endswith("</x>\n</log>\n") for t in texts)
            assert [int(x) for t in texts for x in re.findall("<x>(.)", t)] == list(range(n))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ocel_writes_links_that_lie_with_their_events(spark, tmp_path):
    """Events that bring their relations along are written with one shuffle, for their order, and gzipped if wanted."""
    (tmp_path / "log.ocel").write_text(OCEL)
    log = readers.read_ocel(spark, str(tmp_path / "log.ocel"))
    assert log.linked is not None
    writers.write_ocel(log, str(tmp_path / "zipped"), compress=True)
    assert all(p.name.endswith(".gz") for p in (tmp_path / "zipped").rglob("part-*"))
    again = readers.read_ocel(spark, str(tmp_path / "zipped"))
    told = lambda x: sorted((r.event_id, r.event_type, r.ts, [(k.object_id, k.qualifier) for k in r.links]) for r in x.linked.collect())
    assert told(again) == told(log) and len(told(log)) == 3
    assert "Exchange" not in objects.order_objects(spark, "/root/testdata/sf0.001").linked._jdf.queryExecution().executedPlan().toString()


def test_elements_are_made_once(spark, tmp_path, monkeypatch):
    """No filter on the texts stands in the plan of a file: Spark would make each text for it too, and for each pass of a sort."""
    written, frame = [], type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, pass_on=frame.mapInArrow, **k: (written.append(self), pass_on(self, *a, **k))[1])
    (tmp_path / "log.ocel").write_text(OCEL)
    log = readers.read_ocel(spark, str(tmp_path / "log.ocel"))
    writers.write_ocel(log, str(tmp_path / "again"))
    writers.write_xes(tables.log_of_traces(spark, [["a", "b"], []]), str(tmp_path / "xes"))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in written]
    assert len(plans) >= 4 and not any("isnotnull(value" in p or "isnotnull(concat" in p or "isnotnull(xml" in p for p in plans)
    whole = readers.read_xes(spark, str(tmp_path / "xes"))
    assert got(whole) == ["", "a>b"] and "size(" not in logs.events_of_cases(whole)._jdf.queryExecution().optimizedPlan().toString().split("Filter", 1)[-1].split("\n")[0]
    odd = spark.createDataFrame([(None,), ("<x>1</x>",), (None,), ("<x>2</x>",)], "value string").coalesce(1)
    writers._write_files(odd, "<log>", str(tmp_path / "odd"))
    assert "".join(p.read_text() for p in (tmp_path / "odd").glob("part-*")) == "<log>\n<x>1</x>\n<x>2</x>\n</log>\n"


def test_executions(spark, tmp_path):
    move = {"trace": 3, "move_index": 1, "activity": "weigh", "also_in_log": False, "fired_transition": 6, "other_enabled_transitions": [2, 9], "move_index_of_enablement": 0, "resource": "scale 2", "resource_utilisation_fired_transition": "3/4", "other_enabled_transitions_resource_utilisation": ["1/2", None], "event_attributes": {"kg": "7"}}
    times = ["2019-11-30 23:10:05 +02:00", "2019-11-30T21:10:05Z", None]
    (tmp_path / "x.exs").write_text(json.dumps({"executions": [move | {"move_index": i, "time_of_execution": t} for i, t in enumerate(times)]}))
    rows = sorted(readers.read_executions(spark, str(tmp_path / "x.exs")).collect(), key=lambda r: r.move_index)
    assert [r.time_of_execution and r.time_of_execution.isoformat() for r in rows] == ["2019-11-30T21:10:05"] * 2 + [None]
    assert rows[0].other_enabled_transitions == [2, 9] and rows[0].event_attributes == {"kg": "7"} and rows[0].other_enabled_transitions_resource_utilisation == ["1/2", None]
    writers.write_executions(readers.read_executions(spark, str(tmp_path / "x.exs")), str(tmp_path / "out"))
    assert sorted(readers.read_executions(spark, str(tmp_path / "out")).collect(), key=lambda r: r.move_index) == rows
    (tmp_path / "bad.exs").write_text(json.dumps({"executions": [move | {"time_of_execution": "soon"}]}))
    with pytest.raises(Exception, match="no time"):
        readers.read_executions(spark, str(tmp_path / "bad.exs")).collect()


def test_labels_that_look_like_names(spark):
    """Labels with separators, nothing in them, or none at all make states and transitions of their own."""
    from tracewright.sources.tables import log_of

    traces = [["a>b"], ["a", "b"], ["a|b", "@initial"], [""], [], [None, "a"], ["1:a"], ["@final"]]
    rows = [(c, i, a) for c, t in enumerate(traces) for i, a in enumerate(t)]
    cases = spark.range(len(traces)).select(F.col("id").cast("string").alias("case_id"))
    log = log_of(spark.createDataFrame(rows, "c long, i int, a string"), "c", "a", ("i",), (), cases)
    a = graphs.probabilities(graphs.prefix_automaton(log))
    assert a.where("kind = 'final'").count() == len(traces)
    told = graphs.trace_probability(logs.variants(log), a).collect()
    assert len(told) == len(traces) and all(r.probability == pytest.approx(1 / len(traces)) for r in told)
    net = graphs.net_of(a)
    assert net.where("kind = 'transition'").count() == net.where("kind = 'transition'").select("transition").distinct().count() == a.count()
    follows = graphs.automaton_of(graphs.directly_follows_graph(log_of(spark.createDataFrame([r for r in rows if r[2] is not None], "c long, i int, a string"), "c", "a", ("i",), (), cases)))
    assert {r.target for r in follows.where("activity = '@initial'").collect()} == {"@@initial"}


def test_strong_components_and_numbers(spark):
    import random

    from tracewright.models.automata import strong_components

    rng = random.Random(3)
    for n, m in ((40, 60), (30, 90), (25, 20)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        nodes = {x for e in edges for x in e}
        want = {v: min(c) for c in strong_components(n, edges) for v in c if v in nodes}
        got_ = {r.node: r.component for r in graphs.strong_components(spark.createDataFrame(edges, "source long, target long")).collect()}
        assert got_ == want
    many = spark.range(1000).withColumn("k", F.expr("(id * 7919) % 1000")).repartition(5)
    from tracewright.sources.scratch import numbered

    assert all(r.k == r.i for r in numbered(many, "i", "k").collect())


def test_runs():
    from tracewright.operators.runs import contract

    assert contract([]) == [] and contract([(0, None, [])]) == []
    assert contract([(2, "c", [1]), (0, "a", []), (1, None, [0])]) == [("a", ()), ("c", (0,))]
    # d waits for two branches, one of them silent all the way
    assert contract([(0, "a", []), (1, None, [0]), (2, "b", [0]), (3, None, [1, 2]), (4, "d", [3, 1])]) == [("a", ()), ("b", (0,)), ("d", (0, 1))]
    for bad in ([(0, "a", [1]), (1, "b", [0])], [(0, "a", [5])]):
        with pytest.raises(ValueError):
            contract(bad)


def test_languages_of_runs(spark):
    """Runs alike are contracted once, whatever order their rows come in; the language is that of the runs one by one."""
    from tracewright.operators import runs

    kinds = [[(0, "a", []), (1, None, [0]), (2, "b", [1])], [(0, None, [])], [(0, "b", []), (1, "a", [])], [(0, "a", []), (1, "b", [0])]]
    rows = [(str(r), *n) for r in range(40) for n in reversed(kinds[r % 4])]
    nodes = spark.createDataFrame(rows, "run_id string, node int, activity string, predecessors array<int>").repartition(7)
    told = lambda x: sorted(([(e.activity, tuple(e.predecessors)) for e in r.events], r.cnt, r.probability) for r in x.collect())
    by_run = told(runs.partial_language(runs.contract_runs(nodes)))
    assert told(runs.partial_language_of_runs(nodes)) == by_run == [([("a", ()), ("b", (0,))], 20, 2 / 3), ([("b", ()), ("a", ())], 10, 1 / 3)]
    with pytest.raises(Exception, match="a cycle"):
        runs.partial_language_of_runs(spark.createDataFrame([("x", 0, "a", [1]), ("x", 1, "b", [0])], nodes.schema)).collect()


def test_runs_alike_are_contracted_once_in_a_task(spark, monkeypatch):
    """Whatever batches they come in; and when too many kinds are known, a task starts afresh."""
    from tracewright.operators import runs

    done = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(runs, "contract", lambda nodes, own=runs.contract: (done.add(1), own(nodes))[1])
    kinds = [[(0, 'a "1"', []), (1, None, [0]), (2, "b", [1])], [(0, "b", []), (1, "a", [])]]
    nodes = spark.createDataFrame([(str(r), *n) for r in range(60) for n in kinds[r % 2]], "run_id string, node int, activity string, predecessors array<int>").coalesce(1)
    want = sorted([(str(r), 0, 'a "1"', []) if r % 2 == 0 else (str(r), 0, "b", []) for r in range(60)] + [(str(r), 1, "b", [0]) if r % 2 == 0 else (str(r), 1, "a", []) for r in range(60)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for most, least, at_most in ((10_000, 2, 2), (1, 12, 60)):
            monkeypatch.setattr(runs, "_REMEMBERED", most, raising=False)
            before = done.value
            assert sorted(map(tuple, runs.contract_runs(nodes).collect())) == want
            assert least <= done.value - before <= at_most
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_runs_of_lines_are_dealt_once(spark, tmp_path):
    """All windows over an order's lines and its run go by one key, so lines are shuffled once."""
    from tracewright.operators import runs
    from tracewright.plans.model_queries import line_runs

    day = lambda d: f"2020-01-0{d} 00:00:00"
    lines = [(1, 1, 1, 1, "A", "F", day(1)), (1, 2, 1, 1, "R", "F", day(2)), (1, 3, 1, 1, "N", "O", day(2)), (1, 4, 1, 1, "A", "F", day(4)), (2, 1, 1, 1, "R", "F", day(1))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate string").withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    nodes = line_runs(spark, str(tmp_path))
    assert sorted((r.run_id, r.node, r.activity, r.predecessors) for r in nodes.collect()) == [("1", 0, "AF", []), ("1", 1, None, [0]), ("1", 2, "NO", [0]), ("1", 3, "AF", [1, 2]), ("2", 0, None, [])]
    found = runs.contract_runs(nodes)
    assert sorted(map(tuple, found.collect())) == [("1", 0, "AF", []), ("1", 1, "NO", [0]), ("1", 2, "AF", [0, 1])]
    plan = runs.contract_runs(line_runs(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert line_runs(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1  # and sorted once


def test_semantics_read_the_log_once(spark):
    """A graph's states are numbered on a table of the graph, so its log isn't read again for each step."""
    read = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    events = spark.createDataFrame([("1", 0, "a"), ("1", 1, "b"), ("2", 0, "b")], "case_id string, pos int, activity string").coalesce(1)
    g = graphs.directly_follows_graph(tables.EventLog(events.mapInArrow(pass_on, events.schema), ("pos",)))
    told = sorted(map(tuple, graphs.graph_semantics(graphs.stochastic_model_of(g)).collect()))
    assert told == [(0, 0, 1, "b", 1), (1, 1, 3, None, 2), (2, 2, 0, "a", 1), (3, 2, 1, "b", 1)]
    assert read.value == 3
    model = {(r.kind, r.source, r.target, r.weight) for r in graphs.stochastic_model_of(g).collect()}
    assert model == {("edge", "a", "b", 1), ("start", None, "a", 1), ("start", None, "b", 1), ("end", "a", None, 0), ("end", "b", None, 2)}
    read.value = 0
    assert graphs.automaton_semantics(graphs.probabilities(graphs.automaton_of(g))).count() == 4 and read.value == 3


def test_table_and_model_agree(spark):
    """The prefix automaton made by Spark is that of the language read on the driver."""
    from tracewright.models.automata import Automaton

    log = tables.log_of_traces(spark, [["x"], ["x", "y"], ["x", "y"], ["y", "y", "x"], []])
    slang = {tuple(r.trace): Fraction(r.num, r.den) for r in languages.stochastic_language(log).collect()}
    assert slang == {("x",): Fraction(1, 5), ("x", "y"): Fraction(2, 5), ("y", "y", "x"): Fraction(1, 5), (): Fraction(1, 5)}
    a = Automaton.of_language(slang)
    weights = sorted(r.weight for r in graphs.probabilities(graphs.prefix_automaton(log)).collect())
    assert weights == pytest.approx(sorted(map(float, [*a.arcs.values(), *a.final.values()])))
    dfg = {(r.kind, r.source, r.target): r.weight for r in graphs.directly_follows_graph(log).collect()}
    assert dfg == {("edge", "x", "y"): 2, ("edge", "y", "y"): 1, ("edge", "y", "x"): 1, ("start", None, "x"): 3, ("start", None, "y"): 1, ("end", "x", None): 2, ("end", "y", None): 2, ("empty", None, None): 1}


def test_logs_given_in_code(spark):
    log = tables.log_of_traces(spark, [["b", "a"], [], ["a"]])
    assert got(log) == ["", "a", "b>a"] and logs.trace_length_stats(log).first().min_length == 0
    told = {r.case_id: r.trace for r in logs.attempt_labels(log, spark.createDataFrame([("a",)], "activity string")).collect()}
    assert told == {"0": None, "1": [], "2": ["a"]}


def test_conversions():
    assert path("slang", "snfa") == ["slang", "sdfa", "snfa"] and path("dfg", "sbpmn")[-1] == "sbpmn" and path("ptml", "powl")
    language = {("x", "x"): Fraction(1, 4), ("y",): Fraction(1, 4), (): Fraction(1, 2)}
    net = convert(language, "slang", "slpn")
    assert len(net.transitions) == 6  # three arcs, three endings
    with pytest.raises(ValueError):
        path("lola", "ptree")
    tree = T.read_tree("stochastic process tree\nloop\n2\nactivity work\n3\nxor\n2\nactivity pause\n1\ntau\n2\n5\n")
    assert len(convert(tree, "sptree", "dfa").arcs) == 4
    assert "sequenceFlow" in convert(tree, "sptree", "bpmn") and convert(convert(tree, "sptree", "ptml"), "ptml", "dfa").arcs


def test_stream(spark, tmp_path):
    """Events come late and out of order; cases end when the watermark has left them behind."""
    import os

    (tmp_path / "in").mkdir()
    batches = [
        [("c", "load", "2020-01-01 00:00:00"), ("c", "unload", "2020-01-01 00:20:00")],
        [("c", "drive", "2020-01-01 00:10:00"), ("d", "load", "2020-01-01 00:05:00")],  # before what has come
        [("e", "load", "2020-01-01 09:00:00")],
        [("e", "drive", "2020-01-01 12:00:00"), ("c", "too late", "2020-01-01 00:15:00")],
        [("f", "load", "2020-01-01 20:00:00")],
    ]
    for i, rows in enumerate(batches):
        out = str(tmp_path / f"b{i}")
        spark.createDataFrame(rows, "c string, a string, t string").select("c", "a", F.to_timestamp("t").alias("t")).coalesce(1).write.parquet(out)
        (name,) = [n for n in os.listdir(out) if n.endswith(".parquet")]
        os.rename(f"{out}/{name}", tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_600_000_000 + i, 1_600_000_000 + i))
    stream = spark.readStream.schema("c string, a string, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = follows_stream(stream, "c", "a", "t").writeStream.format("memory").queryName("follows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    steps = [tuple(r) for r in spark.table("follows").collect()]
    assert sorted(steps, key=str) == sorted([("start", None, "load"), ("edge", "load", "drive"), ("edge", "drive", "unload"), ("end", "unload", None), ("start", None, "load"), ("end", "load", None), ("start", None, "load"), ("edge", "load", "drive"), ("end", "drive", None)], key=str)
    assert {(r.kind, r.target): r.weight for r in follows_counts(spark.table("follows")).where("kind = 'start'").collect()} == {("start", "load"): 3}
