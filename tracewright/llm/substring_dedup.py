"""Substring deduplication: of equal lines or paragraphs the earliest stays, the others are removed; so do long passages.

Units are whole lines (or paragraphs), normalised: A-Z lower-cased, runs of white space as one blank. Their digests are
grouped over all documents, the earliest occurrence by (doc_id, number of its first word) stays, and every other goes,
however short it is. Passages within longer lines, or broken into lines in another way, come on top: in the stretches of
text between removed units, a word goes if it lies in a run of ``run_words`` words that stands at an earlier place of such
a stretch too. Removed spans keep their original offsets.

Runs aren't all hashed at once. Of the word groups of SEED words those are chosen whose hash is the least of the groups
within some run; a run chooses the same ones wherever it stands, so runs that are equal have a chosen group in common.
Only the runs around chosen groups that occur twice are hashed, to 96 bits, and grouped over all documents. Nothing is
lost by that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, discard, free_names, materialise, pa_fields, returning, slices, texts_of, word_hashes
from .minhash import _mix

#: words of a group that tells where runs may be equal
SEED = 8
RUN_WORDS = 25

_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` or more."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        row = np.full(max(2 * n, 4096), base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        row[0] = 1
        _POWERS[base] = np.multiply.accumulate(row)
    return _POWERS[base]


def _spans_digest(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray | int, k: int = 0) -> np.ndarray:
    """A digest for each span of words, a polynomial over its words' hashes; ``k`` (0 or 1) picks one of two."""
    n, base = len(hashes), _BASES[k]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(hashes ^ np.uint64(base)) * _powers(base, n)[:n], out=sums[1:])
    return _mix((sums[starts + counts] - sums[starts]) * _powers(pow(base, -1, 1 << 64), n)[starts])


def _sliding(op: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over each window of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _seeds(hashes: np.ndarray, run_words: int) -> np.ndarray:
    """Places of the groups whose hash is the least of the groups in some run of ``run_words`` words."""
    size = min(SEED, run_words)
    width, n = run_words - size + 1, len(hashes) - size + 1
    if n < width:
        return np.zeros(0, np.int64)
    group = _spans_digest(hashes, np.arange(n), size)
    least = np.zeros(n + width - 1, np.uint64)  # of each window, with none before the first and behind the last
    least[width - 1 : n] = _sliding(np.minimum, group, width)
    return np.flatnonzero(_sliding(np.maximum, least, width) == group)


def words_of(text: str, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of ``text`` and the numbers of words of its units; ASCII rules, white space x09-x0D and x20."""
    lines = [line.split() for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]
    counts = np.array([len(line) for line in lines], np.int64)
    if unit == "paragraph":  # lines without a blank one between them
        block = np.cumsum(counts == 0)
        counts = np.bincount(block, counts).astype(np.int64) if len(counts) else counts
    return word_hashes([w for line in lines for w in line]), counts[counts > 0]


def marks_of(text: str, unit: str, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, numbers of words (0: a chosen group) and digests (n x 2) of the units and chosen groups of ``text``."""
    h, counts = words_of(text, unit)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    starts = np.cumsum(counts) - counts
    whole = np.stack([_mix(_spans_digest(h, starts, counts, k) + counts.astype(np.uint64)) for k in range(2)], 1)
    seeds = _seeds(h, run_words) if run_words else np.zeros(0, np.int64)
    groups = np.zeros((len(seeds), 2), np.uint64)
    if len(seeds):
        groups[:, 0] = _spans_digest(h, seeds, min(SEED, run_words))
    return np.concatenate([seeds, starts]), np.concatenate([np.zeros(len(seeds), np.int64), counts]), np.concatenate([groups, whole]).view(np.int64)


def runs_of(text: str, at: np.ndarray, words: np.ndarray, unit: str, run_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and digests (n x 2) of the runs of ``text`` around chosen groups and clear of removed units.

    ``at`` and ``words``: the groups (0 words) and removed units.
    """
    h, _ = words_of(text, unit)
    n, size = len(h) - run_words + 1, min(SEED, run_words)
    good = at + np.where(words > 0, words, size) <= len(h)  # else of another row of the same doc_id, with a longer text
    seeds, at, words = at[good & (words == 0)], at[good & (words > 0)], words[good & (words > 0)]
    if n < 1 or not len(seeds):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    gone = np.concatenate([[0], np.cumsum(_covered(len(h), at, words))])  # removed words before each place
    seeds = seeds[gone[seeds + size] == gone[seeds]]
    near = _covered(len(h), np.maximum(seeds - (run_words - size), 0), seeds + 1 - np.maximum(seeds - (run_words - size), 0))[:n]
    clear = gone[run_words : n + run_words] == gone[:n]
    at = np.flatnonzero(near & clear)
    return at, np.stack([_spans_digest(h, at, run_words, k) for k in range(2)], 1).view(np.int64)


def _covered(n: int, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each of ``n`` places whether one of the stretches covers it."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + counts, -1)
    return np.cumsum(edge[:-1]) > 0


def places_of(text: str) -> np.ndarray:
    """Start and end (code points) of each word (n x 2)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
    edge = np.diff(inside)
    return np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)], 1)


def spans_of(text: str, at: np.ndarray, words: np.ndarray) -> list[dict]:
    """The spans that the stretches of words cover: start, end (code points) and words of each."""
    places = places_of(text)
    good = at + words <= len(places)  # else of another row of the same doc_id
    edge = np.diff(np.concatenate([[0], _covered(len(places), at[good], words[good]).astype(np.int8), [0]]))
    return [{"start": int(places[a, 0]), "end": int(places[b - 1, 1]), "words": int(b - a)} for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)]


def _marks(docs: DataFrame, unit: str, run_words: int) -> DataFrame:
    """One row for each unit and chosen group (words 0) of ``docs``: doc_id, at, words and its digest d0, d1."""
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("words", pa.int32()), ("d0", pa.int64()), ("d1", pa.int32())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for a, b in slices(texts, 1_000_000):
                at, words, digest = zip(*[marks_of(t, unit, run_words) for t in texts[a:b]], strict=True)
                doc = np.repeat(np.array(ids[a:b], np.int64), [len(x) for x in at])
                digest = np.concatenate(digest)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(words).astype(np.int32)), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(digest[:, 1].astype(np.int32))], schema=schema)

    # rows without an id can't be ranked and are kept as they are
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(returning(mark), "doc_id long, at int, words int, d0 long, d1 int")


def _runs(docs: DataFrame, again: DataFrame, unit: str, run_words: int) -> DataFrame:
    """One row for each run of ``docs`` around a chosen group in ``again``: doc_id, at, d0, d1."""
    own = again.groupBy("doc_id").agg(F.collect_list(F.struct("at", "words")).alias("marks")).where("exists(marks, m -> m.words = 0)")
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("d0", pa.int64()), ("d1", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, marks = batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("marks")
            for a, b in slices(texts, 1_000_000):
                found = [runs_of(texts[i], *_numbers(marks[i]), unit, run_words) for i in range(a, b)]
                doc = np.repeat(np.array(ids[a:b], np.int64), [len(x) for x, _ in found])
                digest = np.concatenate([d for _, d in found])
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.concatenate([x for x, _ in found]).astype(np.int32)), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(digest[:, 1].astype(np.int32))], schema=schema)

    return docs.select("doc_id", "text").join(own, "doc_id").mapInArrow(returning(emit), "doc_id long, at int, d0 long, d1 int")


def _numbers(marks: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return tuple(marks.values.field(k).to_numpy().astype(np.int64) for k in range(2))


def repeats(docs: DataFrame, unit: str = "line", run_words: int = RUN_WORDS) -> DataFrame:
    """For each document of ``docs`` (doc_id, text) with repeats: doc_id, _units (at, words), the stretches of words to remove.

    Occurrences are grouped by digest with the least place per task before any shuffle, and only digests met more than
    once are joined back. They're written before that, so that the join has nothing but shuffles below it and Spark can
    split it where one line stands in a third of all rows.
    """
    bound_batches(docs.sparkSession)
    marks = materialise(_marks(docs, unit, run_words), "marks")
    place, least = F.struct("doc_id", "at"), F.min(F.struct("doc_id", "at")).alias("f")
    first = materialise(marks.groupBy("d0", "d1").agg(least, F.count("*").alias("n")).where("n > 1").select("d0", "d1", "f"), "first")
    again = materialise(marks.join(first, ["d0", "d1"]).where((F.col("words") == 0) | (place > F.col("f"))).select("doc_id", "at", "words"), "again")
    discard(marks, first)
    units = again.where("words > 0")
    runs = None
    if run_words:
        runs = materialise(_runs(docs, again, unit, run_words), "runs")
        first = materialise(runs.groupBy("d0", "d1").agg(least, F.count("*").alias("n")).where("n > 1").select("d0", "d1", "f"), "first")
        # a run that overlaps its own first occurrence would take words from that
        later = runs.join(first, ["d0", "d1"]).where(F.expr(f"doc_id > f.doc_id OR at >= f.at + {run_words}"))
        units = units.union(later.select("doc_id", "at", F.lit(run_words).alias("words")))
    out = materialise(units.groupBy("doc_id").agg(F.collect_list(F.struct("at", "words")).alias("_units")), "repeats")
    discard(again, runs, first)
    return out


REMOVED = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "words")]))


def remove_repeats(docs: DataFrame, unit: str = "line", run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with repeated text cut from ``text`` and a column ``removed`` of the spans (offsets in the old text).

    ``unit`` is line or paragraph; ``run_words`` 0 leaves passages alone. All rows and columns stay, but a column named
    ``removed`` is replaced; null and empty texts have no units; rows without a doc_id are kept as they are; an empty table
    gives an empty table. Rows that share a doc_id share its units: of equal units at the same place each stays.
    """
    if unit not in ("line", "paragraph"):
        raise ValueError(f"unit {unit!r}")
    kept = docs.select(*[n for n in docs.columns if n != "removed"])
    (units,) = free_names(kept.columns, "_units")
    fields = pa_fields(kept)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
    schema = pa.schema([*fields, ("removed", spans_type)])
    both = kept.join(repeats(docs, unit, run_words).withColumnRenamed("_units", units), "doc_id", "left").select(*kept.columns, units)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column("text").to_pylist(), []
            for i, numbers in enumerate(batch.column(units)):
                spans = spans_of(texts[i], *_numbers(numbers)) if numbers.is_valid and texts[i] else []
                if spans:
                    edges = [0, *[x for s in spans for x in (s["start"], s["end"])], len(texts[i])]
                    texts[i] = "".join(texts[i][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                removed.append(spans)
            yield pa.RecordBatch.from_arrays([*[pa.array(texts, f.type) if f.name == "text" else batch.column(f.name).cast(f.type) for f in fields], pa.array(removed, spans_type)], schema=schema)

    return both.mapInArrow(returning(cut), T.StructType([*kept.schema.fields, T.StructField("removed", REMOVED)]))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the spans removed (all, and those of RUN_WORDS words or more), their words, and a digest of what stays.

    Null and empty texts have no spans and the digest of nothing.
    """
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["words"])
    passages = F.size(F.filter("removed", lambda s: s["words"] >= RUN_WORDS)).cast("long")
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), passages.alias("n_passages"), words.alias("removed_words"), spans.alias("removed_spans"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+') AS toks FROM documents),
t AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS k FROM s),
u AS (SELECT *, regexp_matches(tok, '^[\x20\x09-\x0D]') AS blank, sum(length(tok)) OVER w - length(tok) AS start, sum(length(tok) - length(replace(tok, chr(10), ''))) OVER w AS line
      FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
w AS (SELECT doc_id, k, start, start + length(tok) AS stop, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos,
      translate(tok, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM u WHERE NOT blank),
l AS (SELECT doc_id, line, min(pos) AS pos, string_agg(word, ' ' ORDER BY pos) AS body FROM w GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) > 1 AS gone FROM l),
seg AS (SELECT *, sum(CASE WHEN gone THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS part FROM g),
kept AS (SELECT w.doc_id, part, list(word ORDER BY w.pos) AS words, min(w.pos) AS pos FROM w JOIN seg ON seg.doc_id = w.doc_id AND seg.line = w.line WHERE NOT gone GROUP BY ALL),
run AS (SELECT doc_id, pos + i - 1 AS pos, array_to_string(words[i : i + 24], ' ') AS body FROM (SELECT *, unnest(range(1, len(words) - 23)) AS i FROM kept)),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER v AS f_doc, first_value(pos) OVER v AS f_at FROM run WINDOW v AS (PARTITION BY body ORDER BY doc_id, pos)),
cut AS (SELECT doc_id, unnest(range(pos, pos + 25)) AS pos FROM f WHERE doc_id > f_doc OR pos >= f_at + 25 UNION SELECT w.doc_id, w.pos FROM w JOIN g ON g.doc_id = w.doc_id AND g.line = w.line AND gone),
span AS (SELECT doc_id, min(start) AS a, max(stop) AS b, count(*) AS n FROM (SELECT w.*, w.pos - row_number() OVER (PARTITION BY doc_id ORDER BY w.pos) AS grp FROM w JOIN cut USING (doc_id, pos)) GROUP BY doc_id, grp),
told AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (n >= 25) AS n_passages, sum(n) AS removed_words, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_spans FROM span GROUP BY doc_id),
rest AS (SELECT u.doc_id, sum(length(tok)) AS kept_chars, string_agg(tok, '' ORDER BY k) AS body FROM u WHERE NOT EXISTS (SELECT 1 FROM span WHERE span.doc_id = u.doc_id AND u.start >= a AND u.start < b) GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_passages, 0) AS n_passages, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words, coalesce(removed_spans, '') AS removed_spans,
  CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars, sha256(coalesce(body, '')) AS kept_sha256 FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
