"""Near-duplicate vectors by passes of random projections.

Each pass gives every vector a key, the signs of ``bits`` random projections, and all vectors with equal keys make a
bucket. All pairs of a bucket are compared by cosine in double precision, in chunks of bounded size, each pair of chunks
in a group of its own. Pairs at the threshold or above are links; a pair that shared a bucket in an earlier pass isn't
counted again, which both vectors' keys tell. A group gives no pairs but, for each of its vectors, the number of new links
and the smallest vector that it hangs together with. Equal vectors are one class from the start, with a weight.

A pair at the threshold meets in at least one pass with probability ``recall`` whatever the other vectors are, as no
bucket is left in part; ``passes_for`` gives the passes that a number of bits needs. The sizes of the buckets at each
number of bits are measured, and the bits with the least work are taken: none at all, so that every pair is compared, where
there are few vectors or where most of them lie so close together that bits don't part them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, discard, materialise, pa_fields, returning
from .graph import components

#: most signs of a key
BITS = 30
#: vectors of a chunk; a row that is dealt to a bucket costs about as much as so many comparisons
BLOCK = 2048
#: most chunks of a bucket, as long as none of them has more than LARGE vectors
CHUNKS, LARGE = 16, 32_768
THRESHOLD = 0.9
RECALL = 0.995


def passes_for(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes needed so that a pair at the threshold has equal keys of ``bits`` signs in at least one."""
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log1p(-meet))


def _keys(x: np.ndarray, passes: int, bits: int, seed: int) -> np.ndarray:
    """For each row of ``x`` and each pass the signs of ``bits`` projections as one number."""
    out = np.zeros((len(x), passes), np.int64)
    for p in range(passes if bits else 0):
        planes = np.random.default_rng([seed, x.shape[1], p]).standard_normal((x.shape[1], bits))
        out[:, p] = (x @ planes > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
    return out


def _projected(reps: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """rep, dim and keys (one for each pass) of ``reps`` (rep, embedding)."""
    keyed = pa.schema([("rep", pa.int64()), ("dim", pa.int32()), ("keys", pa.list_(pa.int32()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                keys = _keys(_matrix(part.column("embedding"), dim), passes, bits, seed)
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([dim] * len(keys), pa.int32()), pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32()))], schema=keyed)

    return reps.select("rep", "embedding").mapInArrow(returning(project), "rep long, dim int, keys array<int>")


def _bits(reps: DataFrame, block: int, threshold: float, passes: int | None, seed: int) -> int:
    """The number of bits with the least work, from the measured sizes of a pass's buckets at each number of bits.

    ``passes``, if given, bounds the passes. The choice changes the time alone: every number of bits comes with the passes it needs.
    """
    able = [b for b in range(BITS + 1) if passes is None or passes_for(b, threshold) <= passes]
    finest = _projected(reps, 1, BITS, seed).select("dim", F.col("keys")[0].alias("key")).groupBy("dim", "key").agg(F.count("*").alias("n"))
    each = finest.select("dim", "key", "n", F.explode(F.array(*map(F.lit, able))).alias("bits"))
    sizes = each.groupBy("bits", "dim", F.expr(f"shiftright(key, {BITS} - bits)").alias("key")).agg(F.sum("n").cast("double").alias("n"))
    # one row for each number of bits
    work = {r["bits"]: r["w"] * passes_for(r["bits"], threshold) for r in sizes.groupBy("bits").agg(F.sum(F.col("n") * (F.col("n") + block)).alias("w")).collect()}
    return min(sorted(work), key=work.get, default=0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column, all of length ``dim`` and fit to be linked, at length 1 in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _classes(vectors: DataFrame) -> DataFrame:
    """One row for each vec_id: vec_id, embedding as it is given (float or double), digest (null where it links with nothing)."""
    one = vectors.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    kept, *_ = pa_fields(one.select("embedding"))
    arrow = pa.schema([("vec_id", pa.int64()), kept, ("digest", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("embedding")
            lengths = given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = given.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null is NaN, zero has no sign
            starts, digests = np.cumsum(lengths) - lengths, [None] * len(lengths)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == dim)
                x = values[starts[rows][:, None] + np.arange(dim)]
                for r, v in zip(rows[np.isfinite(x).all(1) & x.any(1)].tolist(), x[np.isfinite(x).all(1) & x.any(1)], strict=True):
                    digests[r] = xxhash.xxh3_128_digest(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), given.cast(kept.type), pa.array(digests, pa.binary())], schema=arrow)

    return one.mapInArrow(returning(sign), T.StructType([T.StructField("vec_id", T.LongType()), one.schema["embedding"], T.StructField("digest", T.BinaryType())]))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, passes: int | None = None, seed: int = 17) -> DataFrame:
    """Per vector of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of unequal
    length. Rows that share a vec_id are one vector (the greatest embedding in array order). Other columns are ignored.
    ``passes`` bounds the passes; with fewer of them buckets are larger, and a pair is found as surely.
    """
    bound_batches(vectors.sparkSession)
    # vectors travel as they are given, at half the size if they're floats
    embedding = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    signed = materialise(_classes(vectors.select("vec_id", embedding.alias("embedding"))), "vectors")
    classes = materialise(signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = materialise(signed.join(classes.select(F.col("rep").alias("vec_id"), "copies"), "vec_id").select(F.col("vec_id").alias("rep"), "copies", "embedding"), "representatives")
    bits = _bits(reps, block, threshold, passes, seed)
    keyed = materialise(_projected(reps, passes_for(bits, threshold), bits, seed), "keys")
    own = keyed.select("rep", "dim", F.posexplode("keys").alias("pass", "key"))
    # buckets larger than a chunk are few: none holds less than a block
    chunks = F.greatest(F.least(F.ceil(F.col("n") / block), F.lit(CHUNKS)), F.ceil(F.col("n") / LARGE)).cast("int")
    large = materialise(own.groupBy("pass", "dim", "key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("pass", "dim", "key", chunks.alias("chunks")), "large")
    wide = reps.join(keyed, "rep").select("rep", "copies", "embedding", "dim", "keys", F.posexplode("keys").alias("pass", "key"))
    placed = wide.join(large, ["pass", "dim", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("rep", "copies", "embedding", "dim", "keys", "pass", "key", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    out_schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        while True:
            before = label.copy()
            low = np.minimum(label[i], label[j])
            for at in (i, j, before[i], before[j]):
                np.minimum.at(label, at, low)
            label = label[label]
            if (label == before).all():
                return label

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
        p, dim, x, y = (table.column(c)[0].as_py() for c in ("pass", "dim", "x", "y"))
        side, keys = table.column("own").to_numpy(), table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        v = _matrix(table.column("embedding"), dim)
        links, label = np.zeros(len(rep)), np.arange(len(rep))
        here, there = np.flatnonzero(side == x), np.flatnonzero(side == y)
        w = v[there]
        step = max(1, 2**21 // max(1, len(there)))
        for a in range(0, len(here), step):
            i = here[a : a + step]
            hit = v[i] @ w.T >= threshold
            if x == y:
                hit &= i[:, None] < there[None, :]  # each pair once
            rows, columns = hit.any(1), hit.any(0)
            i, j, hit = i[rows], there[columns], hit[np.ix_(rows, columns)]
            for q in range(p if len(i) else 0):
                hit &= keys[i, q][:, None] != keys[j, q][None, :]
            if not hit.any():
                continue
            some = hit.astype(np.float64)
            links[i] += some @ copies[j]
            links[j] += copies[i] @ some
            while True:  # one partner of each row and column at a time, until all that hang together have one label
                apart = hit & (label[i][:, None] != label[j][None, :])
                r, c = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
                if not len(r):
                    break
                label = unite(label, np.concatenate([i[r], i[apart[:, c].argmax(0)]]), np.concatenate([j[apart[r].argmax(1)], j[c]]))
        at = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(rep[at]), pa.array(links[at].astype(np.int64)), pa.array(rep[label[at]])], schema=out_schema)

    found = materialise(dealt.groupBy("pass", "dim", "key", "x", "y").applyInArrow(compare, "rep long, links long, root long"), "links")
    discard(keyed, large, reps)
    united = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = classes.join(linked, "rep", "left").join(united.select(F.col("v").alias("rep"), "root"), "rep", "left")
    per_class = per_class.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = signed.select("vec_id", "digest").join(per_class, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors; those that can't link are components of their own."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
