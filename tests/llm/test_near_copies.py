import random

import numpy as np
import pytest

from loomline.llm import near_copies, simhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            met, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * met >= 4 * every and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    first = {}
    for (i, _), lab in zip(rows, label, strict=True):
        if i is not None:
            first[lab] = min(i, first.get(lab, i))
    return sorted(((i, first.get(lab)) for (i, _), lab in zip(rows, label, strict=True)), key=str)


def texts():
    rng = random.Random(4)
    out = []
    for length in (1, 5, 6, 9, 30, 80, 300):
        base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(length)]
        for edits in range(12):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(length)] = "edit" + str(rng.randrange(1000))
            out.append(" ".join(words[: length - edits % 3 * (length // 12)]))
    return out


@pytest.fixture(params=[10_000, 7])
def batch_rows(request, spark):
    """Groups that span Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("bucket", [near_copies.BUCKET, 2])
def test_groups_against_brute_force(spark, bucket, batch_rows):
    found = texts() + [f"{t} and a tail" for t in texts()[:40]] * 20
    rows = list(enumerate(found)) + [(200, None), (201, ""), (202, " \n"), (203, found[3].upper()), (3, found[3]), (None, found[9]), (None, "all alone here")]
    got = near_copies.groups(spark.createDataFrame(rows, SCHEMA), bucket).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute(rows)


def test_sketches_rule_out_no_linked_pair():
    rng = np.random.default_rng(1)
    for n in (1, 9, 60, 65, 500, 3000):
        base = rng.integers(1 << 63, size=n).astype(np.uint64)
        sets = [np.unique(base)]
        for _ in range(60):
            keep = base[rng.random(n) > rng.random() * 0.3]
            sets.append(np.unique(np.concatenate([keep, rng.integers(1 << 63, size=rng.integers(0, n // 8 + 1)).astype(np.uint64)])))
        sets = [s for s in sets if len(s)]
        sets.sort(key=len)
        size, sketches = np.array([len(s) for s in sets]), [near_copies._sketch(s) for s in sets]
        few = list(near_copies._partners(size[:40], sketches[:40]))
        many = list(near_copies._partners(size, sketches))
        assert [x.tolist() for x in few] == [x.tolist() for x in many[:40]]
        for i, near in enumerate(many):
            for j in range(i):
                met = near_copies._met(sets[i], sets[j])
                if 5 * met >= 4 * (size[i] + size[j] - met):
                    assert j in near


def test_prefixes_of_linked_sets_meet_in_any_order():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 300):
        base = np.unique(rng.integers(1 << 63, size=n).astype(np.uint64))
        common = np.sort(rng.choice(base, size=n // 2, replace=False))
        table = np.stack([common, rng.permutation(len(common)).astype(np.uint64) + np.uint64(1)])
        for _ in range(50):
            other = np.unique(np.concatenate([rng.choice(base, size=-(-9 * n // 10), replace=False), rng.integers(1 << 63, size=n // 12).astype(np.uint64)]))
            met = near_copies._met(base, other)
            if 5 * met >= 4 * (len(base) + len(other) - met):
                assert any(np.intersect1d(a, b).size for a, b in zip(near_copies.prefix(base, table), near_copies.prefix(other, table), strict=True))


def test_of_repeated_ids_the_same_row_stays(spark):
    rows = [(5, f"text number {i} of many more words {i}") for i in range(6)] + [(6, "alone"), (None, "a"), (None, "a")]
    kept = [sorted(map(str, simhash.keep_one(spark.createDataFrame(random.Random(s).sample(rows, 9), SCHEMA)).collect())) for s in range(3)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 4


def test_the_stage_drops_copies_whose_fingerprints_are_far_apart(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    other = list(words)
    for at in (30, 90, 150):
        other[at] = "edited"
    rows = [(1, " ".join(words)), (2, " ".join(other))]
    assert (simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).bit_count() > 2
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()] == [1]


def test_fingerprints_bring_texts_together_and_the_join_the_rest(spark, monkeypatch):
    rng = random.Random(0)
    words = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    rows = [(1, words), (2, [*words[:-1], "edited"]), (3, ["edited" if i % 50 == 25 else w for i, w in enumerate(words)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)
    first, near, far = (simhash.majority(near_copies.shingle_set(" ".join(w).encode())) for _, w in rows)
    assert (first ^ near).bit_count() <= simhash.WIDE < min((first ^ far).bit_count(), (near ^ far).bit_count())
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [1]
    rare = near_copies._rare
    monkeypatch.setattr(near_copies, "_rare", lambda keyed, bucket: rare(keyed.limit(0), bucket))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]


def test_texts_of_near_fingerprints_are_compared_exactly(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(60)) for _ in range(2)]
    monkeypatch.setattr(simhash, "together", lambda nodes, bucket: nodes.selectExpr("min(v) as a", "max(v) as b"))
    assert near_copies.keep_one(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).count() == 2
