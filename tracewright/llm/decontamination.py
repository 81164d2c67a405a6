"""Benchmark decontamination with DataFrame functions only.

Words are runs of letters and digits (and any character beyond ASCII) after A-Z are lower-cased. Each benchmark item
yields windows of ten consecutive words, or one window of all its words if it has fewer. The hashes of the windows go to
the executors as a bit set within the plan, three bits for each window; each document's windows are hashed and looked up
in place, and only those whose bits are set are joined, as strings, with the benchmark's windows. The bit set has
``MAX_BITS`` at most, whatever the benchmark's size: beyond about a million windows more hits are false and go by the
join, and nothing else changes.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_names, materialise

WINDOW = 10
#: bits for each window of the benchmark, and most bits of all (4 MB)
BITS_EACH = 32
MAX_BITS = 1 << 25
#: most contaminated texts (an id, a digest and a few places each) that are broadcast
BROADCAST_ROWS = 50_000
#: a word, once A-Z are lower-cased
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NONE = "CAST(array() AS array<struct<at:int,size:int,window:string>>)"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, size, window) of ``benchmark`` (item_id, text); an item without words has none."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("_row"))
    size = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words") - size + 1))
    at = words.select("item_id", "words", size.alias("size"), F.explode(starts).alias("at"))
    return at.select("item_id", "size", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("window")).distinct()


def _places(h: str, bits: int) -> list[tuple[str, str]]:
    """SQL for the three bits of the hash ``h``: which long (from 0) and which bit of it. ``bits`` is a power of two."""
    return [(f"CAST(shiftrightunsigned({h}, {k + 6}) & {bits // 64 - 1}L AS int)", f"CAST(shiftrightunsigned({h}, {k}) & 63L AS int)") for k in (0, 32, 17)]


def bit_set(windows: DataFrame, max_bits: int = MAX_BITS) -> tuple[str, int]:
    """SQL for the bit set of ``windows`` (window), as an array of longs, and how many bits it has.

    At most ``max_bits`` / 64 numbers come to the driver. As a constant of the plan it's read once, where it's needed.
    """
    hashes = windows.select(F.xxhash64(F.split("window", " ")).alias("h"))
    bits = min(1 << 12, max_bits)
    while bits < min(max_bits, BITS_EACH * windows.count()):
        bits *= 2
    at = hashes.select(F.expr("inline(array(" + ", ".join(f"named_struct('i', {i}, 'bit', {b})" for i, b in _places("h", bits)) + "))"))
    words = at.groupBy("i").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("w"))
    full = ["0"] * (bits // 64)
    for r in words.collect():
        full[r.i] = str(r.w)
    return f"CAST(split('{','.join(full)}', ',') AS array<bigint>)", bits


def _windows(size: int, set_: tuple[str, int]) -> str:
    """SQL for the windows of ``size`` words whose bits are set: array of (at, size, window); at counts from 1."""
    words, bits = set_
    test = " AND ".join(f"getbit(element_at({words}, {i} + 1), {b}) = 1" for i, b in _places("h", bits))
    hashes = f"transform(sequence(1, size(words) - {size - 1}), i -> xxhash64(slice(words, i, {size})))"
    at = f"filter(transform({hashes}, (h, k) -> CASE WHEN {test} THEN k + 1 END), x -> x IS NOT NULL)"
    return f"CASE WHEN size(words) >= {size} THEN transform({at}, i -> named_struct('at', i, 'size', {size}, 'window', array_join(slice(words, i, {size}), ' '))) ELSE {_NONE} END"


def _candidates(docs: DataFrame, windows: DataFrame, keep: list[str], max_bits: int) -> DataFrame:
    """``keep`` of ``docs`` with _row, n_words and ``found``, the windows that may be the benchmark's."""
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # ten numbers at most
    found = f"concat({', '.join(_windows(k, bit_set(windows.where(F.col('size') == k).select('window').distinct(), max_bits)) for k in sizes)})" if sizes else _NONE
    # the row number keeps repeated rows apart and keeps Spark from computing the words once more in a later filter
    words = docs.select(*keep, words_of(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("_row"))
    return words.select(*keep, "_row", F.expr("CASE WHEN words IS NULL THEN 0L ELSE CAST(size(words) AS long) END").alias("n_words"), F.coalesce(F.expr(found), F.expr(_NONE)).alias("found"))


def _hit_count(places: Column) -> Column:
    """Words inside any of the windows (at, size)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, x: Column) -> Column:
        end = x["at"] + x["size"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["at"])).cast("long")).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(places), zero, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; repeated rows each get their row; repeated or null items change nothing; an empty
    benchmark hits nothing; other columns are ignored. One shuffle carries the counts and the verified windows.
    """
    windows = materialise(benchmark_windows(benchmark), "windows")
    rows = _candidates(docs, windows, ["doc_id"], max_bits)
    exploded = rows.select("doc_id", "_row", "n_words", F.explode_outer("found").alias("c")).select("doc_id", "_row", "n_words", "c.at", "c.size", "c.window")
    side = windows.select("item_id", "window").withColumn("item_id", F.col("item_id").cast("string"))
    hits = exploded.join(side, "window", "left")
    place = F.when(F.col("item_id").isNotNull(), F.struct("at", "size"))
    grouped = hits.groupBy("doc_id", "_row").agg(F.max("n_words").alias("n_words"), F.collect_set(place).alias("places"), F.collect_set("item_id").alias("items"))
    n_hit = _hit_count(F.col("places"))
    return grouped.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("places") > 0).alias("contaminated"))


def _verified(docs: DataFrame, benchmark: DataFrame, max_bits: int) -> DataFrame:
    """The texts of ``docs`` with benchmark windows: _doc (doc_id), _digest (of the text) and _places (at, size).

    What a text holds depends on the text alone, so rows of one doc_id with different texts are told apart by its digest.
    """
    windows = materialise(benchmark_windows(benchmark), "windows")
    rows = _candidates(docs.select("doc_id", "text", F.sha2("text", 256).alias("_digest")), windows, ["doc_id", "_digest"], max_bits)
    # the row number in the condition keeps the words from being computed anew for each window
    found = rows.where("size(found) > 0 AND _row >= 0").select("doc_id", "_digest", F.explode("found").alias("c")).select("doc_id", "_digest", "c.at", "c.size", "c.window")
    hits = found.join(windows.select("window").distinct(), "window", "left_semi")
    out = materialise(hits.groupBy(F.col("doc_id").alias("_doc"), "_digest").agg(F.collect_set(F.struct("at", "size")).alias("_places")), "contaminated")
    discard(windows)
    return out


def _sized(hits: DataFrame) -> DataFrame:
    """``hits`` for a join: broadcast if they're at most BROADCAST_ROWS, which is counted, else merged."""
    return F.broadcast(hits) if hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else hits.hint("merge")


def _of(docs: DataFrame, hits: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(hits["_doc"]) & (F.sha2(docs["text"], 256) == hits["_digest"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns kept; no shuffle while few texts have any."""
    hits = _verified(docs, benchmark, max_bits)
    return docs.join(_sized(hits), _of(docs, hits), "left_anti")


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with every word that lies in a benchmark window cut from ``text``, and what follows it up to the next word."""
    names = docs.columns
    hits = _verified(docs, benchmark, max_bits)
    letters = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"{letters}[^0-9A-Za-z\\x80-\\x{{10FFFF}}]*|^[^0-9A-Za-z\\x80-\\x{{10FFFF}}]+"), F.lit(0))
    where, of, skip = free_names(names, "_places", "_pieces", "_skip")
    cut = F.expr(f"array_join(filter({of}, (p, i) -> NOT exists({where}, h -> i + 1 - {skip} >= h.at AND i + 1 - {skip} < h.at + h.size)), '')")
    rows = docs.join(_sized(hits), _of(docs, hits), "left").select(*[docs[n] for n in names], hits["_places"].alias(where))
    rows = rows.withColumn(of, pieces).withColumn(skip, F.when(F.col("text").rlike(f"^{letters}"), 0).otherwise(1))
    return rows.select(*[F.when(F.col(where).isNotNull(), cut).otherwise(F.col("text")).alias("text") if n == "text" else F.col(n) for n in names])


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the benchmark's windows hit in all documents; null texts have no words."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS k, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM b WHERE len(words) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(words[i : i + k - 1], ' ') AS win
       FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, ks WHERE len(words) >= k)),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
