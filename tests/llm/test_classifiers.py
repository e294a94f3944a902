import random
import zlib

import numpy as np
import zstandard

from loomline.llm import langid, quality


def crc(i):
    return zlib.crc32(str(i).encode())


def quality_rows(n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        words = ["".join(rng.choice(["an", "er", "the", "ion", "st"]) for _ in range(3)) for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(words) if good else "!! ".join(w.upper() for w in words), "x"))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows()
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "the and", "x"), (1002, "a" * 400_000, "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (1, None), (2, 1), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(crc(r.doc_id) % 5 == 0 for r in held) and len(held) > 30
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    prior = {r.score for r in got if r.doc_id in (1000, 1001)}
    assert len(prior) == 1


def test_quality_does_not_read_held_out_labels(spark):
    rows, labels = quality_rows(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    flipped = [(i, 1 - q if crc(i) % 5 == 0 else q) for i, q in labels]
    a, b = ({r.doc_id: r.score for r in quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, flipped))
    assert a == b


def test_quality_scores_against_a_plain_version(spark):
    rows, labels = quality_rows(300)
    got = {r.doc_id: r.score for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    text = {i: t.encode() for i, t, _ in rows}
    taught = sorted((i, q) for i, q in labels if crc(i) % 5)
    build, rest = taught[::2], taught[1::2]
    kept = []
    for k in (0, 1):
        pieces = [text[i][a : a + 4096] for i, q in build if q == k for a in range(0, len(text[i]), 4096)]
        try:
            kept.append(zstandard.train_dictionary(64 << 10, pieces).as_bytes())
        except zstandard.ZstdError:
            kept.append(b"".join(pieces)[-(64 << 10) :])
    press = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_dict_id=False) for x in kept]

    def features(t):
        sizes = [sum(len(p.compress(t[a : a + 4096])) for a in range(0, len(t), 4096)) for p in press]
        d = 10 * (sizes[0] - sizes[1]) / len(t)
        return np.array([1, d, d * np.log1p(len(t)) / 10, np.clip(d, -1, 1) ** 2])

    x, y = np.array([features(text[i]) for i, _ in rest]), np.array([q for _, q in rest])
    w = np.zeros(4)
    for _ in range(200):  # Newton steps for the logistic likelihood with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(4), x.T @ (y - p) - 1e-2 * w)
    share = sum(q for _, q in taught) / len(taught)
    w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    assert all(abs(got[i] - 1 / (1 + np.exp(-np.clip(features(t) @ w, -30, 30)))) < 1e-6 for i, t in text.items())


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, none).first().score == 0.5
    assert quality.classify(docs.limit(0), none).count() == 0


TONGUES = {"aa": ["ka", "ri", "to"], "bb": ["sch", "un", "eit"], "cc": ["eau", "oui", "re"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def lang_rows(n=240):
    rng = random.Random(3)
    return [(i, speak(rng, lang, rng.randint(3, 80)), lang, "x") for i in range(n) for lang in [sorted(TONGUES)[i % 3]]]


LANG = "doc_id long, text string, lang string, __ll_words string"


def test_languages_on_held_out_rows(spark):
    rows = lang_rows()
    rows += [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, "12 34 ²", "bb", "x"), (None, speak(random.Random(9), "bb", 30), None, "x"), (4, rows[4][1], rows[4][2], "x")]
    got = langid.identify(spark.createDataFrame(rows, LANG)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" for i in (900, 901, 902)) and by_id[None].lang_pred == "bb"
    held = [(r, rows[r.doc_id][2]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(held) > 20 and sum(r.lang_pred == want for r, want in held) > 0.97 * len(held)


def test_code_switched_words_are_labelled():
    rng = random.Random(4)
    model = langid.train([(lang, speak(rng, lang, 400).split()) for lang in TONGUES for _ in range(5)])
    text = speak(rng, "aa", 30) + " " + speak(rng, "bb", 60)
    names, scores = langid.label_texts([text], model)
    assert names == ["bb"] and 0.55 < scores[0] < 0.8


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 4])
    emit, transitions = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got, at = langid.mean_posteriors(emit, lengths, transitions), 0
    for row, n in zip(got, lengths.tolist(), strict=True):
        total = np.zeros((n, 2))
        for path in np.ndindex(*[2] * n):
            w = np.exp(sum(emit[at + t, k] for t, k in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, k in enumerate(path):
                total[t, k] += w
        assert np.allclose(row, (total / total.sum(1, keepdims=True)).mean(0))
        at += n


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "ka ri", None, "x")], LANG)
    assert langid.identify(docs).first().lang_pred == "und"
    assert langid.identify(docs.limit(0)).count() == 0
