import numpy as np
import pytest

from loomline.llm import line_dedup

SCHEMA = "doc_id long, text string, n int, h1 string"
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    keys = {}
    split = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    for i, lines in split:
        for line in lines:
            k = line.strip(SPACE).translate(LOWER)
            if len(k) >= 20:
                keys.setdefault(k, set()).add(i)
    out = []
    for i, lines in split:
        kept = []
        for line in lines:
            ids = keys.get(line.strip(SPACE).translate(LOWER), set())
            if len(ids) < 3 or (i is not None and i == max(x for x in ids if x is not None)):
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


ROWS = [
    (1, "A Line That Is Long Enough\nshort\n\n  a line that is long enough\t", 0, "x"),
    (2, "a line that is long enough\nnineteen chars here", 0, "x"),
    (3, "x\na LINE that is long enough  \nnineteen chars here", 0, None),
    (4, "nineteen chars here\nÄÖ twenty code points", 0, "x"),
    (5, "ÄÖ twenty code points\näö twenty code points", 0, "x"),
    (6, "ÄÖ twenty code points", 0, "x"),
    (6, "ÄÖ twenty code points", 0, "x"),
    (7, None, 0, "x"), (8, "", 0, "x"), (9, "\n\n", 0, "x"),
    (None, "a line that is long enough", 0, "x"),
]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_against_brute_force(spark, broadcast):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = line_dedup.dedup_lines(docs, broadcast_bytes=broadcast)
    assert kept.columns[:4] == docs.columns
    assert sorted(((r.doc_id, r.text, r["__ll_lines"], r["__ll_dropped"]) for r in kept.collect()), key=str) == brute(ROWS)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_many_shards_and_salts(spark, broadcast, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 7)
    monkeypatch.setattr(line_dedup, "SALT_ROWS", 20)
    rows = [(i, "\n".join(f"line number {j} of the repeated ones" for j in range(i % 60)) + "\na line that all the documents have", 0, "x") for i in range(120)]
    kept = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), broadcast_bytes=broadcast)
    assert sorted(((r.doc_id, r.text, r["__ll_lines"], r["__ll_dropped"]) for r in kept.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal_and_travels(n):
    keys = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    keys = np.unique(keys)
    made = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(keys).to_bytes())
    assert sorted(made(keys).tolist()) == list(range(len(keys)))
    others = np.random.default_rng(n + 1).integers(0, 2**64, 100, dtype=np.uint64)
    assert all(-1 <= p < max(len(keys), 1) for p in made(others).tolist())
