import hashlib
import random

import numpy as np
import pytest

from loomline.llm import suffix_dedup
from loomline.llm.suffix_groups import suffix_array, suffix_arrays

SCHEMA = "doc_id long, text string, starts string"


def naive(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


def texts_for_arrays(n=400):
    rng = random.Random(4)
    return [[rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))] + [0] for _ in range(n)]


def test_serial_arrays():
    for t in texts_for_arrays():
        assert suffix_array(t) == naive(t)


def test_lockstep_arrays():
    texts = texts_for_arrays()
    lengths = np.array([len(t) for t in texts])
    matrix = np.zeros((len(texts), lengths.max()), np.int32)
    for i, t in enumerate(texts):
        matrix[i, : len(t)] = t
    found = suffix_arrays(matrix, lengths)
    assert all(found[i, : len(t)].tolist() == naive(t) for i, t in enumerate(texts))


def brute(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - 49) if i is not None else ():
            if first[t[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        spans = sum(1 for j, x in enumerate(gone) if x and (not j or not gone[j - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def edge_rows():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 400)))) for i in range(40)]
    rows += [(100, "a" * 500), (101, "a" * 300), (102, "ab" * 200), (103, None), (None, "a" * 200), (100, "a" * 500), (104, ""), (105, "x" * 49), (106, "x" * 49)]
    rows += [(200, rows[5][1] * 3), (201, "é" * 60), (202, "ü" + "é" * 40), (203, rows[7][1])]
    passage = "".join(rng.choice("cdefgh ") for _ in range(120))
    return rows + [(300 + i, "".join(rng.choice("ijkl") for _ in range(80)) + passage[i % 5 :] + "".join(rng.choice("mnop") for _ in range(30))) for i in range(20)]


@pytest.mark.parametrize("bounds", [{}, {"pack_bytes": 300, "bucket_owners": 20, "bucket_parts": 10}, {"hot_packs": 0}, {"pack_bytes": 300, "hot_packs": 1}, {"hot_runs": 2}])
def test_against_brute_force(spark, bounds):
    rows = edge_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    found = suffix_dedup.remove_repeats(docs, **bounds).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), len(r.starts), r.kept_sha256) for r in found), key=str) == brute([(i, (t or "").encode()) for i, t in rows])


def test_owner_search_over_segments(monkeypatch):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 101, 5000, dtype=np.uint8))
    whole = suffix_dedup.owners(text)
    owner = {w: (p, h) for s, e, p, h in zip(*(x.tolist() for x in whole), strict=True) for w in range(s, e)}
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    cut = suffix_dedup.owners(text)
    assert {w: (p, h) for s, e, p, h in zip(*(x.tolist() for x in cut), strict=True) for w in range(s, e)} == owner
    assert sorted(owner) == list(range(len(text) - 49)) and all(w <= p <= w + 26 for w, (p, _) in owner.items())


def test_empty_table(spark):
    assert suffix_dedup.digest(spark.createDataFrame([], SCHEMA)).count() == 0
