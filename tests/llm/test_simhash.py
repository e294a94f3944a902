import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomline.llm import simhash

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    first = {}
    for (i, _), lab in zip(fps, label, strict=True):
        if i is not None:
            first[lab] = min(i, first.get(lab, i))
    return sorted(((i, f, first.get(lab)) for (i, f), lab in zip(fps, label, strict=True)), key=str)


def run(spark, rows, **bounds):
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), **bounds).collect()
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=str)


def near_copies(n, seed=1):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(300)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(300)] = "edit" + str(rng.randrange(1000))
        out.append(" ".join(words))
    return out


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            flipped = (1 << i) | (1 << j)
            assert any(not m & flipped for m in masks)


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(near_copies(40) + near_copies(30, 2))]
    rows += [(100, None), (101, ""), (102, "  \n"), (103, "one"), (104, "ONE"), (105, "one two"), (3, rows[3][1]), (None, rows[0][1]), (None, "alone here now ok")]
    assert run(spark, rows) == brute_components(rows)


def test_large_buckets_give_the_same_components(spark):
    rows = [(i, t) for i, t in enumerate(near_copies(60, 5))]
    assert run(spark, rows, bucket=2) == brute_components(rows)


def test_non_ascii_capitals_stay(spark):
    assert simhash.fingerprint("É a b".encode()) != simhash.fingerprint("é a b".encode())
    assert simhash.fingerprint(b"A B C") == simhash.fingerprint(b"a\tb\x0bc")


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_keeps_clashing_columns(spark):
    rows = [(2, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "y"), (5, "quite another text here", "z"), (None, "a b c d e", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.fp) for r in kept.collect()) == [(-1, "n"), (1, "y"), (5, "z")]


def test_very_long_text(spark):
    text = " ".join(str(i) for i in range(120_000))
    rows = [(1, text), (2, text + " end")]
    assert {r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {1}


def test_components_of_long_chains(spark):
    from loomline.llm.common import components

    edges = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    found = {r.v: r.l for r in components(edges).collect()}
    assert {found[v] for v in range(201)} == {0} and found[1001] == 1000


def test_blocks_cover_all_bits_and_keys_are_short():
    bounds = simhash.block_bounds(simhash.WIDE + 3)
    assert [b for first, width in bounds for b in range(first, first + width)] == list(range(64))
    assert 3 * max(width for _, width in bounds) <= 16


def test_majority_of_hashes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 70_000):
        hashes = rng.integers(1 << 63, size=n).astype(np.uint64) * np.uint64(2)
        every = hashes.tolist()
        assert simhash.majority(hashes) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in every) > n)


@pytest.mark.parametrize("bucket, part", [(simhash.BUCKET, simhash.PART), (1, 40)])
def test_together_against_brute_force(spark, monkeypatch, bucket, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(6)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):
        x = rng.getrandbits(64)
        for flips in (0, 4, simhash.WIDE, simhash.WIDE, simhash.WIDE, simhash.WIDE + 1, simhash.WIDE + 1, 15, 30):
            x ^= sum(1 << i for i in rng.sample(range(64), flips))
            fps.append(x)
    rows = [(1000 - i, simhash.signed(x)) for i, x in enumerate(fps + fps[:20])]
    label = {v: v for v, _ in rows}
    for v, x in rows:
        for w, y in rows:
            if ((x ^ y) % 2**64).bit_count() <= simhash.WIDE and label[v] != label[w]:
                old, new = max(label[v], label[w]), min(label[v], label[w])
                label = {k: new if lab == old else lab for k, lab in label.items()}
    got = {v: v for v, _ in rows}
    for a, b in simhash.together(spark.createDataFrame(rows, "v long, fp long"), bucket=bucket).collect():
        old, new = max(got[a], got[b]), min(got[a], got[b])
        got = {k: new if lab == old else lab for k, lab in got.items()}
    assert got == label


def test_buckets_of_all_sizes_span_the_same_components():
    rng = np.random.default_rng(4)
    sizes = (1, 2, 60, 65, 300, 1)
    centres = np.repeat(rng.integers(1 << 62, size=8).astype(np.uint64), 60)[: sum(sizes)]
    x = np.unique(rng.permutation(centres) ^ np.array([sum(1 << int(b) for b in rng.choice(64, 8)) & (1 << 64) - 1 for _ in centres], np.uint64))
    key = np.repeat(np.arange(len(sizes)), sizes)[: len(x)]

    def parts(edges):
        label = {int(v): int(v) for v in x.view(np.int64)}
        for a, b in edges:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {v: new if lab == old else lab for v, lab in label.items()}
        return label

    brute = [(int(a), int(b)) for k in set(key.tolist()) for i, a in enumerate(x[key == k].view(np.int64)) for b in x[key == k].view(np.int64)[:i] if ((int(a) ^ int(b)) % 2**64).bit_count() <= simhash.WIDE]
    found, many = simhash._bucket_edges(x, key, simhash.WIDE, simhash.BUCKET)
    assert brute and parts(found) == parts(brute) and not many
    found, many = simhash._bucket_edges(x, key, simhash.WIDE, 50)
    dealt = [e for values in many for e in simhash._wide_stars(values.view(np.uint64), simhash.WIDE)]
    assert max(map(len, many)) <= 100 and parts(found + dealt) == parts(brute)
