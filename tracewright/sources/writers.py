"""Writers of event data: CSV, XES, object-centric XML and executions. Models are written by ``tracewright.formats``."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.logs import traces
from ..operators.objects import ObjectLog
from .tables import EventLog

#: XES types of the tables' types; text for all others
_XES_TYPES = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "boolean": "boolean", "timestamp": "date", "timestamp_ntz": "date", "date": "date"}
_VALUE = "struct<type:string,value:string>"


def as_text(value: Column, type_: str) -> Column:
    """An attribute as text; times with milliseconds and an offset, structures not at all."""
    if type_.startswith(("timestamp", "date")):
        return F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return F.lit(None).cast("string") if type_.startswith(("struct", "map", "array")) else value.cast("string")


def write_csv(log: EventLog, path: str) -> None:
    """case, activity and plain attributes in the order of each case; a log with empty traces is an error."""
    if log.cases is not None and not traces(log).where("size(trace) = 0").isEmpty():
        raise ValueError("CSV can't hold empty traces")
    plain = [c for c, t in log.events.dtypes if c not in ("case_id", "activity") and not t.startswith(("struct", "map", "array"))]
    rows = log.events.repartition("case_id").sortWithinPartitions("case_id", *log.order)
    rows.select("case_id", "activity", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in plain]).write.csv(path, header=True, quoteAll=True, escape='"')


def _escape(c: Column) -> Column:
    out = c
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return F.when(c.rlike('[&<>"\\n\\r\\t]'), out).otherwise(c)  # one look at most texts instead of seven


def _element(type_: Column, key: Column, value: Column) -> Column:
    return F.concat(F.lit("<"), type_, F.lit(' key="'), _escape(key), F.lit('" value="'), _escape(value), F.lit('"/>'))


def _elements(df: DataFrame, own: tuple[str, ...], except_: tuple[str, ...], of: dict[str, Column]) -> Column:
    """The XES elements of the plain columns of ``df`` and of a column ``attributes``, an XES map, but for keys in ``except_``;
    ``of`` tells where the columns are.

    Lists and containers of an XES map can't be written so: they're an error when a row has one.
    """
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c in own:
            continue
        if types[c] == f"map<string,{_VALUE}>":
            bad = F.raise_error(F.lit("lists and containers can't be written"))
            keep = F.filter(F.map_entries(of[c]), lambda e: ~e["key"].isin(*except_) & e["value"]["value"].isNotNull())
            out.append(F.transform(keep, lambda e: F.when(e["value"]["type"].isin("list", "container"), bad.cast("string")).otherwise(_element(e["value"]["type"], e["key"], e["value"]["value"]))))
        elif not types[c].startswith(("struct", "map", "array")) and c not in except_:
            out.append(_element(F.lit(_XES_TYPES.get(types[c].split("(")[0], "string")), F.lit(c), as_text(of[c], types[c])))
    return F.concat_ws("", *out)  # passes over null


def _xes_parts(log: EventLog, event_attributes: bool, trace_attributes: bool) -> DataFrame:
    """(case_id, event, text): what a case's XES element holds, the case's own elements first, then its events in order.

    Rows are dealt by case once, as they are; their texts are made after that.
    """
    name = lambda c: _element(F.lit("string"), F.lit("concept:name"), c)

    def renamed(df: DataFrame, letter: str) -> tuple[list[Column], dict[str, Column]]:
        at = {c: f"_{letter}{i}" for i, c in enumerate(df.columns) if c != "case_id"}
        return [F.col(c).alias(n) for c, n in at.items()], {c: F.col(n) for c, n in at.items()} | {"case_id": F.col("case_id")}

    e = log.events
    columns, of = renamed(e, "e")
    from_map = dict(e.dtypes).get("attributes") == f"map<string,{_VALUE}>"
    own = ("case_id", "activity", "pos", *(("resource", "ts") if from_map else ()))
    more = _elements(e, own, ("concept:name",), of) if event_attributes else F.lit("")
    text = F.concat(F.lit("<event>"), F.coalesce(name(of["activity"]), F.lit("")), more, F.lit("</event>"))
    rows = e.select(F.col("case_id").cast("string").alias("case_id"), F.lit(True).alias("event"), *columns)
    if log.cases is not None:
        c = log.cases
        own_columns, its = renamed(c, "c")
        rows = rows.unionByName(c.select(F.col("case_id").cast("string").alias("case_id"), F.lit(False).alias("event"), *own_columns), allowMissingColumns=True)
        named = F.coalesce(its["attributes"]["concept:name"]["value"], F.col("case_id")) if dict(c.dtypes).get("attributes") == f"map<string,{_VALUE}>" else F.col("case_id")
        text = F.when(F.col("event"), text).otherwise(F.concat(name(named), _elements(c, ("case_id",), ("concept:name",), its) if trace_attributes else F.lit("")))
    return rows.repartition("case_id").sortWithinPartitions("case_id", "event", *[of[c] for c in log.order]).select("case_id", "event", text.alias("text"))


def _traces_of(known: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes (case_id, xml), the ``trace`` elements, of rows of :func:`_xes_parts`; ``known``: of cases that have a row of their own only."""
    codes = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\n": "&#10;", "\r": "&#13;", "\t": "&#9;"})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, heads, events = None, [], []  # a case named twice is two traces of the same events
        ids, out = [], []

        def end() -> None:
            body = "".join(events)
            ids.extend([case] * len(heads))
            out.extend([None if h is None else f"<trace>{h}{body}</trace>" for h in heads])

        for batch in batches:
            for c, event, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != case:
                    end()
                    case, heads, events = c, [] if known else [f'<string key="concept:name" value="{c.translate(codes)}"/>'], []
                if not event:
                    heads.append(text)
                elif c is not None:  # an event of no case is in no trace
                    events.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], ["case_id", "xml"])
            ids, out = [], []
        end()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], ["case_id", "xml"])

    return gather


def xes_traces(log: EventLog, event_attributes: bool = False, trace_attributes: bool = False) -> DataFrame:
    """One row per case with its XES ``trace`` element as text; names are escaped, empty traces stay.

    With ``event_attributes`` and ``trace_attributes`` the typed attributes go along. A log read from XES keeps its own
    attributes and case names.
    """
    return _xes_parts(log, event_attributes, trace_attributes).mapInArrow(_traces_of(log.cases is not None), "case_id string, xml string")


def write_xes(log: EventLog, path: str, compress: bool = False, event_attributes: bool = False, trace_attributes: bool = False) -> None:
    """A folder of XES files, each a log of traces of one partition; an empty log is one file without traces."""
    rows = _xes_parts(log, event_attributes, trace_attributes)
    head = '<log xes.version="1849-2016">'
    _write_files(rows, head, path, compress, gather=_traces_of(log.cases is not None))
    spark = rows.sparkSession
    if spark.read.text(path).isEmpty():
        _write_files(spark.createDataFrame([("",)], "xml string"), head, path, compress, "overwrite")


#: elements of a file; they pass one by one, so the memory of a task doesn't depend on it
_PER_FILE = 10_000


def _write_files(elements: DataFrame, head: str, path: str, compress: bool = False, mode: str = "error", gather: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> None:
    """The one column of ``elements`` as text files below ``path``, each a ``log`` of up to 10,000 elements, in their order.

    The first element of a file bears its head, the last one its end; so elements are neither dealt anew nor gathered. Null
    elements go here: a filter of the plan would make each text once more, and also before a sort. ``gather`` makes batches
    of elements of batches of other rows.
    """
    per = _PER_FILE

    def enclose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, []  # rows given on, and the one after them, which may be the last
        for batch in itertools.chain(batches if gather is None else gather(batches), [None]):
            rows = held + ([x for x in batch.column(batch.num_columns - 1).to_pylist() if x is not None] if batch is not None else [])
            held = [rows.pop()] if batch is not None and rows else []
            for i in range(-n % per, len(rows), per):
                rows[i] = f"{head}\n{rows[i]}"
            for i in range(-(n + 1) % per, len(rows), per):
                rows[i] += "\n</log>"
            n += len(rows)
            if batch is None and n % per:
                rows[-1] += "\n</log>"
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    text = elements.mapInArrow(enclose, "value string")
    text.write.option("maxRecordsPerFile", per).mode(mode).text(path, compression="gzip" if compress else "none")


def write_ocel(log: ObjectLog, path: str, compress: bool = False) -> None:
    """A folder of object-centric XML files: the types, the objects and the events with what they're related to.

    The files are one log, which :func:`tracewright.sources.readers.read_ocel` reads as a folder; each file is a ``log``
    element of its own. Attributes are a column ``attributes`` (a map) or plain columns; their types are text.
    """
    q = lambda c: F.concat(F.lit('"'), _escape(c), F.lit('"'))

    def attributes(df: DataFrame, own: tuple[str, ...]) -> Column:
        types = dict(df.dtypes)
        tag = lambda k, v: F.concat(F.lit("<attribute name="), q(k), F.lit(' time="1970-01-01T00:00:00Z">'), _escape(v), F.lit("</attribute>"))
        out = [F.transform(F.map_entries(c), lambda e: tag(e["key"], e["value"])) if types[c] == "map<string,string>" else tag(F.lit(c), as_text(F.col(c), types[c])) for c in df.columns if c not in own and not types[c].startswith(("struct", "array"))]
        return F.concat(F.lit("<attributes>"), F.concat_ws("", *out), F.lit("</attributes>"))

    objects = log.objects.select(F.concat(F.lit("<object id="), q(F.col("object_id")), F.lit(" type="), q(F.col("object_type")), F.lit(">"), attributes(log.objects, ("object_id", "object_type")), F.lit("</object>")).alias("value"))
    qualifier = F.coalesce("qualifier", F.lit("")) if "qualifier" in log.e2o.columns else F.lit("")
    link = F.concat(F.lit("<relationship object-id="), q(F.col("object_id")), F.lit(" qualifier="), q(qualifier), F.lit("/>"))
    of = None if log.linked is not None else log.e2o.groupBy(F.col("event_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel_pos", link.alias("x")))), lambda x: x["x"]), "").alias("links"))
    time = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if log.linked is None:
        rows, links = log.events.join(of, "event_id", "left"), F.col("links")
    else:
        of_link = lambda x: F.concat(F.lit("<relationship object-id="), q(x["object_id"]), F.lit(" qualifier="), q(F.coalesce(x["qualifier"], F.lit(""))), F.lit("/>"))
        rows, links = log.linked, F.array_join(F.transform("links", of_link), "")
    events = rows.orderBy("pos", "event_id")
    events = events.select(F.concat(F.lit("<event id="), q(F.col("event_id")), F.lit(" type="), q(F.col("event_type")), F.lit(' time="'), F.coalesce(time, F.lit("")), F.lit('">'), attributes(log.events, ("event_id", "event_type", "ts", "pos")), F.lit("<objects>"), F.coalesce(links, F.lit("")), F.lit("</objects></event>")).alias("value"))
    types = log.types or tuple(r[0] for r in log.objects.select("object_type").distinct().orderBy("object_type").collect())  # a handful
    spark = log.events.sparkSession
    names = spark.createDataFrame([(t,) for t in types], "t string").coalesce(1).select(F.concat(F.lit("<object-type name="), q(F.col("t")), F.lit("><attributes/></object-type>")).alias("value"))
    for part, rows in (("object-types", names), ("objects", objects), ("events", events)):
        _write_files(rows, "<log>", f"{path}/{part}", compress)


def write_executions(executions: DataFrame, path: str) -> None:
    """Executions as JSON files of the shape ``{"executions": [..]}``, up to 1,000 each, sorted by trace and move within a file."""
    time = F.date_format("time_of_execution", "yyyy-MM-dd HH:mm:ss XXX") if dict(executions.dtypes).get("time_of_execution", "").startswith("timestamp") else F.lit(None).cast("string")
    rows = executions.withColumn("time_of_execution", time) if "time_of_execution" in executions.columns else executions
    rows = rows.repartition("trace").sortWithinPartitions("trace", "move_index")
    whole = rows.select(F.struct(*rows.columns).alias("x"), F.spark_partition_id().alias("part"), F.floor(F.monotonically_increasing_id() / 1_000).alias("chunk"))
    whole = whole.groupBy("part", "chunk").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when((a["trace"] < b["trace"]) | ((a["trace"] == b["trace"]) & (a["move_index"] < b["move_index"])), -1).when((a["trace"] == b["trace"]) & (a["move_index"] == b["move_index"]), 0).otherwise(1)).alias("executions"))
    whole.select(F.to_json(F.struct("executions"), {"ignoreNullFields": "false"}).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
