import random

import numpy as np
import pytest

from tracewright.llm import minhash, vector_passes
from tracewright.llm.graph import components


def brute(rows):
    sets = {}
    for i, text in rows:
        words = minhash.words_of(text or "")
        k = min(5, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = [(900, None), (901, ""), (902, "one two"), (903, "One TWO"), (904, "  \n\t ")]
    n = 0
    for size, edits in ((60, 6), (8, 2), (5, 0), (30, 9)):
        base = [word() for _ in range(150)]
        for _ in range(size):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n + i, " ".join(word() for _ in range(40))) for i in range(30)]
    rows.append((n + 40, " ".join([word() for _ in range(30_000)])))
    return rows


@pytest.mark.parametrize("chunk", [2_000_000, 1500])
def test_minhash_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_shingles string, rep int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in minhash.drop_near_duplicates(docs).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_prefix_index_misses_no_near_pair():
    rng = np.random.default_rng(4)
    base = [rng.choice(60, rng.integers(1, 30), replace=False) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.1], rng.choice(60, 2)])).astype(np.uint64) for b in base for _ in range(12)]
    flat, starts, near = minhash._prefix_index(sets, 75)
    for i, s in enumerate(sets):
        assert len(np.unique(flat[starts[i] : starts[i] + len(s)])) == len(s)
        want = {j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))}
        assert want <= set(near(i).tolist())


def test_minhash_of_many_short_texts(spark):
    """Thousands of texts of five or six words in one bucket, all different: next to nothing to compare."""
    import time

    rows = [(i, f"the same five words here {'x' * (i % 3)}{i}") for i in range(6000)] + [(9000, "the same five words here"), (9001, "The same  five words HERE")]
    began = time.perf_counter()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert all(got[i] == i for i in range(6000)) and got[9001] == 9000 and time.perf_counter() - began < 60


def test_minhash_of_an_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.range(1000, 1003).selectExpr("id AS a", "1000L AS b"))
    got = {r.v: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1003)}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:10] + 0.1 * rng.standard_normal((10, 16)), np.repeat(base[:1], 5, 0), base[1:2] * 1e-30, base[5] + 0.25 * rng.standard_normal((60, 16))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [1.0, 2.0]), (1006, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + [(i, v, 1) for i, v in odd] + rows[:3], "vec_id long, embedding array<double>, copies int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_passes.near_duplicate_vectors(df, block=16, passes=40).collect()}
    assert all(got[i] == (0, i, True) for i, _ in odd) and len(got) == len(rows) + len(odd)
    assert all(got[i][0] <= int(links[i].sum()) for i in range(len(x)))
    assert sum(got[i][0] for i in range(len(x))) >= 0.95 * links.sum()
    assert vector_passes.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("block", [None, 64])
def test_vectors_of_dense_groups(spark, block):
    import pyarrow as pa

    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    n, m = (20_000, 12_000) if block is None else (700, 2_000)  # several blocks each
    near = np.r_[rng.standard_normal(64), 0] + np.c_[0.02 * rng.standard_normal((n, 64)), np.zeros(n)]
    # all at a cosine of about 0.8 to each other, without links but for 300 planted pairs
    dense = np.c_[unit(rng.standard_normal((m, 64))), np.full(m, 2.0)]
    dense[:300, :64] = unit(dense[300:600, :64] + 0.02 * rng.standard_normal((300, 64)))
    x = unit(np.concatenate([near, dense]))
    count, partner = np.full(len(x), n - 1), np.arange(len(x))
    partner[:n] = 0
    y = x[n:]
    for a in range(0, m, 1000):
        hit = y[a : a + 1000] @ y.T >= 0.9
        count[n + a : n + a + 1000] = hit.sum(1) - 1
    assert not (x[:n:50] @ y.T >= 0.9).any() and (x[:n] @ x[0] >= 0.99).all()
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))})).repartition(4)
    out = vector_passes.near_duplicate_vectors(df, **({} if block is None else {"block": block})).toPandas().sort_values("vec_id")
    got = out.n_links.to_numpy()
    assert (got <= count).all() and got[:n].sum() >= 0.999 * count[:n].sum() and got[n:].sum() >= 0.98 * count[n:].sum()
    if block is None:
        assert (got[:n] == n - 1).all()
    assert (out.component_id.to_numpy()[:n] == 0).all()
    assert (out.component_id.to_numpy()[n : n + 300] == out.component_id.to_numpy()[n + 300 : n + 600]).mean() >= 0.98
