"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

A document's set holds the 64-bit hashes of its distinct word shingles. Two permutations of the 32-bit ring make all
signature coordinates: the first scatters the shingles, the second is applied after a circular shift by k for the k-th
coordinate, which is the least value over the set. ``bands`` bands of ``rows`` coordinates are hashed into bucket keys.

Documents with equal sets become one class first; only class representatives go on. Within a bucket every representative
is paired with the smallest one, so a bucket yields as many pairs as members, and the pairs that pass on full sets are
united. Buckets whose members are still in different components are then compared on full sets within tasks, in chunks of
bounded size, component against component, and within a chunk only sets that share one of their rarest elements; a task
gives only the links that join components. So no pair that shares a
bucket goes unchecked unless it is in one component already, and no pairs are listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialise, returning, slices, texts_of, word_hashes
from .graph import components

SHINGLE = 5
ROWS = 4
BANDS = 32
THRESHOLD = 75  # percent
#: shingles of a bucket that are compared in one piece
CHUNK = 2_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # ASCII rules: A-Z, and white space x09-x0D and x20


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words than a shingle count as one; no words: empty."""
    words = [words_of(t) for t in texts]
    hashed = word_hashes([w for own in words for w in own])
    out, at = [], 0
    for own in words:
        n = len(own)
        h = hashed[at : at + n]
        at += n
        width = min(n, size)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        acc = np.full(n - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            acc = _mix(acc * _A + h[k : k + len(acc)])
        out.append(np.unique(acc))
    return out


def signature(shingles: np.ndarray, coordinates: int = ROWS * BANDS) -> np.ndarray:
    """The circulant MinHash of a set that isn't empty."""
    place = ((shingles * _A) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    shift = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(place), 1024):
        x = place[None, a : a + 1024] + shift  # round the ring
        x *= np.uint32(0x9E3779B1)  # the second permutation
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(1), out=least)
    return least


def band_keys(signature_: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket key for each band, the band's number mixed in."""
    bands = signature_.reshape(-1, rows).astype(np.uint64)
    acc = np.arange(1, len(bands) + 1, dtype=np.uint64) * _C
    for k in range(rows):
        acc = _mix(acc * _A + bands[:, k])
    return acc.view(np.int64)


def signatures(docs: DataFrame, size: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, digest (of the set), keys (empty for an empty set)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], size)
                keys = [band_keys(signature(s, rows * bands), rows) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(sets)).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(returning(sign), "doc_id long, n_shingles long, digest binary, keys array<long>")


def verified(pairs: DataFrame, docs: DataFrame, size: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """Those of ``pairs`` (a, b: doc_ids) whose full sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = texts_of(batch, "text_a"), texts_of(batch, "text_b")
            keep = []
            seen: dict[str, np.ndarray] = {}
            for a in range(0, len(left), 128):
                if len(seen) > 512:
                    seen = {}
                new = list(dict.fromkeys(t for t in [*left[a : a + 128], *right[a : a + 128]] if t not in seen))
                seen.update(zip(new, shingle_sets(new, size), strict=True))
                for x, y in zip(left[a : a + 128], right[a : a + 128], strict=True):
                    s, t = seen[x], seen[y]
                    common = 0 if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)) else len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * common >= percent * (len(s) + len(t) - common) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=arrow).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(returning(verify), "a long, b long")


def _prefix_index(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray]]:
    """The elements of all sets as numbers in a row, where each set begins, and the sets that may be near a given one.

    Elements are numbered from rare to common, and each set is sorted so. Two sets near enough have more than so many
    elements in common, so one at least among the first few of each: only sets that share such an element come up, which
    keeps sets of a few elements from being compared all with all.
    """
    n = np.array([len(s) for s in sets])
    starts = np.cumsum(n) - n
    _, flat, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(counts), np.int64)
    rarity[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((rarity[flat], owner))
    flat = rarity[flat][order]
    first = np.flatnonzero(np.arange(len(flat)) - starts[owner] < (n - (n * percent + 99) // 100 + 1)[owner])
    first = first[np.argsort(flat[first], kind="stable")]
    elements, places = flat[first], owner[first]

    def near(i: int) -> np.ndarray:
        own = flat[starts[i] : starts[i] + n[i] - (n[i] * percent + 99) // 100 + 1]
        a, b = np.searchsorted(elements, own, "left"), np.searchsorted(elements, own, "right")
        return np.unique(np.concatenate([places[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]))

    return flat, starts, near


def _links_between(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join different roots within a bucket; ``members``: key, rep, root, chunks.

    A bucket of several chunks is compared chunk against chunk, each pair of chunks in a task of its own.
    """
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", "rep", "root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    rows = dealt.join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        rep, root = table.column("rep").to_numpy(), table.column("root").to_numpy()
        names, counts = np.unique(root, return_counts=True)
        out: list[tuple[int, int]] = []
        if len(names) > 1:
            texts = ["" if t is None else t for t in table.column("text").to_pylist()]
            sets = [s for a in range(0, len(texts), 128) for s in shingle_sets(texts[a : a + 128], size)]
            n = np.array([len(s) for s in sets])
            if not n.all():  # another row of the same doc_id, without words
                some = n > 0
                rep, root, n, sets = rep[some], root[some], n[some], [s for s in sets if len(s)]
            flat, starts, near = _prefix_index(sets, percent)
            marks = np.zeros(int(flat.max()) + 1, np.int32)
            parent = {r: r for r in names.tolist()}

            def find(r: int) -> int:
                while parent[r] != r:
                    parent[r] = r = parent[parent[r]]
                return r

            # every pair across components has one side outside the largest
            for i in np.flatnonzero(root != names[counts.argmax()]).tolist():
                own = find(int(root[i]))
                # sets of other components that may be near enough, by size too
                j = near(i)
                j = j[(root[j] != root[i]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))]
                j = j[[find(r) != own for r in root[j].tolist()]] if len(j) else j
                if not len(j):
                    continue
                mine = flat[starts[i] : starts[i] + n[i]]
                marks[mine] = 1
                ends = np.cumsum(n[j])
                common = np.add.reduceat(marks[flat[np.repeat(starts[j] - (ends - n[j]), n[j]) + np.arange(ends[-1])]], ends - n[j])
                marks[mine] = 0
                for k in j[100 * common >= percent * (n[i] + n[j] - common)].tolist():
                    x, y = find(int(root[i])), find(int(root[k]))
                    if x != y:
                        parent[x] = y
                        out.append((int(min(rep[i], rep[k])), int(max(rep[i], rep[k]))))
        return pa.Table.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], schema=schema)

    return rows.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, percent: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    What grows with the documents is joined by merging, never broadcast, so the plan is the same at every size.

    Null and empty texts have no shingles and link with nothing. Rows that share a doc_id are one document: the one with
    the most shingles (then the greater digest) stands for it. Other columns are ignored. Nothing is collected; every
    stage but the last is written to the shared scratch folder.
    """
    bound_batches(docs.sparkSession)
    signed = materialise(signatures(docs, size, rows, bands), "signatures")
    one = signed.select("doc_id", F.struct("n_shingles", "digest").alias("s")).groupBy("doc_id").agg(F.max("s").alias("s")).select("doc_id", "s.n_shingles", "s.digest")
    # written, so that the join has nothing but shuffles below it and Spark can split it where one text has many copies
    classes = materialise(one.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep"), "classes")
    rep = F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id"))
    member = materialise(one.join(classes.hint("merge"), "digest", "left").select("doc_id", "n_shingles", rep.alias("rep")), "members")
    reps = member.where("doc_id = rep").select("doc_id", "n_shingles")
    keyed = signed.join(reps.hint("merge"), ["doc_id", "n_shingles"], "left_semi").select(F.explode("keys").alias("key"), F.col("doc_id").alias("rep"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("key", "first")
    bucket = materialise(keyed.join(shared.hint("merge"), "key"), "buckets")
    discard(signed, classes)
    texts = docs.select("doc_id", "text").join(member.where("doc_id = rep").select("doc_id").hint("merge"), "doc_id", "left_semi")
    stars = materialise(bucket.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = materialise(verified(stars, texts, size, percent), "links")
    discard(stars)
    united = components(links)
    placed = bucket.select("key", "rep").distinct().join(united.select(F.col("v").alias("rep"), "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    sized = placed.join(reps.select(F.col("doc_id").alias("rep"), "n_shingles"), "rep")
    mixed = sized.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum("n_shingles").alias("n")).where("r0 < r1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    open_ = materialise(placed.join(mixed.select("key", chunks.alias("chunks")), "key"), "open")
    more = materialise(_links_between(open_, texts, size, percent), "links")
    discard(bucket, open_)
    if not more.isEmpty():
        united = components(links.union(more))
    discard(links, more)
    root = F.coalesce("root", "rep", "doc_id")
    return member.join(united.select(F.col("v").alias("rep"), "root"), "rep", "left").select("doc_id", "n_shingles", root.alias("component_id"), (F.col("doc_id") == root).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the smallest doc_id; all columns stay.

    Rows that share a doc_id are one document and stay or go together; documents without words always stay.
    """
    dropped = near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents; those without words link with nothing."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + least(len(words), 5) - 1], ' ') AS sh
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - least(len(words), 5) + 2)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE g(v, u) AS (SELECT doc_id, doc_id FROM w UNION SELECT g.v, e.b FROM g JOIN e ON g.u = e.a) SELECT v, min(u) AS root FROM g GROUP BY v)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, root AS component_id, w.doc_id = root AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.v = w.doc_id
"""
