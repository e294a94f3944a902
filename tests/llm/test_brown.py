import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomline.llm import brown

SCHEMA = "doc_id long, text string, n long"


def words(t):
    return (t or "").encode().lower().split()


def corpus(n=200):
    rng = random.Random(2)
    tongues = [[f"{p}{i}" for i in range(40)] for p in "ab"]
    rows = []
    for i in range(n):
        own = tongues[i % 2]
        rows.append((i, " ".join(rng.choice(own[: 5 + rng.randrange(36)]) for _ in range(rng.randint(0, 60))) + (f" Rare{i}" if i % 3 else ""), 1))
    return rows + [(500, None, 1), (501, "", 1), (502, " \n", 1), (None, "a1 b2", 1), (7, rows[7][1], 1)]


def check_base(rows, got):
    c = Counter()
    for i, t, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(words(t))
            c[None] += 1
    total, distinct = sum(c.values()), len(c)
    want = sorted((str(i), i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in [*words(t), None]), 6)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}


BOUNDS = [{}, {"head": 30, "clustered": 10, "classes": 4}, {"head": 5, "clustered": 5, "classes": 2}, {"head": 0}]


@pytest.mark.parametrize("bounds", BOUNDS)
def test_base_scores_and_gain(spark, bounds):
    rows = corpus()
    got = brown.score_held_out(spark.createDataFrame(rows, SCHEMA), **bounds).collect()
    check_base(rows, got)
    if not bounds:  # enough classes to tell the two tongues apart
        held = [r for r in got if r.held_out and r.n_tokens > 20]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("bounds", BOUNDS)
def test_scores_against_a_plain_model(spark, bounds):
    """Classes are the operator's; everything that follows from them is computed anew, token by token."""
    texts = [t for i, t, _ in corpus() if i is not None and i % 3]
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in corpus()] + [(900, "never seen these words a1 b2 neither", 0)], SCHEMA)
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = brown.cut(brown.word_counts(training))
    own = dict(bounds)
    common = brown._common(counts, own.pop("head", brown.HEAD))
    flagged = training.selectExpr("0L as doc_id", "text", "true as learn", "true as ask")
    model = brown.fit(brown.cut(brown.numbered(flagged, [w for w, _ in common])), counts, common, len(texts), **own)
    cls = {w: int(model.label[i]) for i, w in enumerate(model.words)}
    assert (len(cls) == 0) == (bounds.get("head") == 0)
    cls |= {bytes(r.word): r.cls for r in model.tail.collect()}
    c = Counter(w for t in texts for w in words(t))
    assert set(cls) == set(c) and {bytes(r.word): r.c for r in model.tail.collect()} == {w: c[w] for w in c if w not in model.words}
    k, sizes, table = model.classes, Counter(), np.zeros((model.classes + 2,) * 2)
    for w, n in c.items():
        sizes[cls[w]] += n
    for t in texts:
        seq = [None, *words(t), None]
        number = [k + 1 if w is None else k if c[w] == 1 else cls[w] for w in seq]
        for i in range(len(seq) - 1):
            table[number[i], number[i + 1]] += 1
    share = (table.sum(0) + 1) / (table.sum() + k + 2)
    p = (table + brown.MIX * share) / (table.sum(1, keepdims=True) + brown.MIX)
    assert np.allclose(p.sum(1), 1)
    once = sum(n == 1 for n in c.values())

    def plain(text):
        out, last = 0.0, k + 1
        for w in [*words(text), None]:
            now = k + 1 if w is None else cls.get(w, k)
            out += math.log10(p[last, now]) + (0 if w is None else math.log10(c[w] / sizes[now]) if w in c else -math.log10(once + 1))
            last = now
        return out

    got = brown.score(docs, training, **bounds).collect()
    want = sorted((str(r.doc_id), round(plain(r.text), 6)) for r in docs.collect())
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want


def test_words_of_two_tongues_are_classed_apart_inside_and_outside_the_head(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{'ab'[i % 2]}{min(int(rng.expovariate(0.05)), 150)}" for _ in range(40)) for i in range(400)]
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = brown.cut(brown.word_counts(training))
    common = brown._common(counts, 120)
    lines = brown.cut(brown.numbered(training.selectExpr("0L as doc_id", "text", "true as learn", "true as ask"), [w for w, _ in common]))
    model = brown.fit(lines, counts, common, len(texts), clustered=30, classes=2)
    tongue = model.label[model.words.index(b"a0")], model.label[model.words.index(b"b0")]
    assert tongue[0] != tongue[1]
    every = [(w, model.label[i]) for i, w in enumerate(model.words)] + [(bytes(r.word), r.cls) for r in model.tail.collect()]
    assert len(every) > len(model.words) > 30
    assert sum(x == tongue[w[:1] == b"b"] for w, x in every) > 0.95 * len(every)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    side = np.arange(20) % 2
    counts = rng.poisson(np.where(side[:, None] == side, 20, 1)).astype(float)
    shuffled = rng.permutation(20)
    label = brown.exchange(counts[np.ix_(shuffled, shuffled)], 20, 2)
    groups = {frozenset(int(shuffled[i]) % 2 for i in np.nonzero(label == g)[0]) for g in (0, 1)}
    assert groups == {frozenset({0}), frozenset({1})}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert brown.score(none, none).count() == 0
    row = brown.score(spark.createDataFrame([(1, "a b", 0)], SCHEMA), none).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
