import functools
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import hilbert_ann

SCHEMA = "vec_id long, embedding array<float>, rank string"


def run(spark, rows, k=10):
    return hilbert_ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, k).collect()


def brute(rows, k=10):
    """Neighbours of each query row as (vec_id, [(distance, id)]); repeated rows count each."""
    usable = [(i, tuple(np.float32(v).tolist())) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return sorted((i, sorted((math.dist(v, w), j) for m, (j, w) in enumerate(usable) if m != n and len(w) == len(v))[:k]) for n, (i, v) in enumerate(usable) if i % 100 == 0)


def test_neighbouring_keys_are_neighbouring_cells():
    for m, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=m)))
        keys = hilbert_ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_small_table_is_exact_and_bad_vectors_take_no_part(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), "x") for i in range(0, 300, 20)]
    rows += [(400, None, "x"), (500, [0.0] * 8, "x"), (600, [float("nan")] + [1.0] * 7, "x"), (700, [None] + [1.0] * 7, "x"), (800, [float("inf")] + [1.0] * 7, "x"), (None, [1.0] * 8, "x"), (900, [1.0, 2.0], "x")]
    rows += [(1000, [3.0, 1.0], "x"), (40, rows[2][1], "x"), (100, rows[5][1], "x"), (200, rng.normal(size=8).tolist(), "x")]  # another length, repeated ids
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in run(spark, rows))
    want = sorted((q, n + 1, j, d) for q, near in brute(rows) for n, (d, j) in enumerate(near))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_many_equal_vectors_tie_by_id(spark):
    rng = np.random.default_rng(2)
    common = rng.normal(size=8).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=8).tolist(), "x") for i in range(1200)]
    got = run(spark, rows)
    for q in (0, 300, 600, 900):
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert mine == [j for j in range(0, 36, 3) if j != q][:10]
    assert all(r.score == 0 for r in got if r.query_id % 3 == 0)


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(j in found[q] for q, near in want for _, j in near) / sum(len(near) for _, near in want)


@pytest.mark.parametrize(("block", "span"), [(hilbert_ann.BLOCK, hilbert_ann.SPAN), (50, 200)])
def test_recall_against_brute_force(spark, block, span, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "nearest_codes", functools.partial(hilbert_ann.nearest_codes, block=block, span=span))
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + rng.normal(size=16)).tolist(), "x") for i in range(3000)]
    got, want = run(spark, rows), brute(rows)
    assert recall(got, want) >= 0.9 and len(got) == 300


def test_clustered_vectors_need_few_candidates(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 16)) * 10
    x = centres[rng.integers(300, size=6000)] + rng.normal(size=(6000, 16)) * 0.1
    used, share = hilbert_ann.fit_window(x, hilbert_ann.Curves.fit(x, hilbert_ann.CURVES[-1]), 10)
    assert used * 2 * share < 0.1


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/embeddings.parquet"), reason="no test data here")
def test_recall_on_the_test_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding, None) for r in vectors.collect()]
    found = recall(hilbert_ann.search(vectors, F.col("vec_id") % 100 == 0).collect(), brute(rows))
    print("recall", found)
    assert found >= 0.9


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0, 2.0], "x")]) == []
    twice = run(spark, [(100, [1.0, 2.0], "x"), (100, [1.0, 2.0], "x"), (7, [2.0, 2.0], "x")])
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in twice) == [(100, 1, 100, 0.0), (100, 1, 100, 0.0), (100, 2, 7, 1.0), (100, 2, 7, 1.0)]
