import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomline.llm import mixing

DOCS, LABELS = "doc_id long, text string, mix_rate string", "doc_id long, domain string"


def cases(n=300):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        kind = ("clean", "poor", "toxic")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]
        words = [rng.choice(["the", "an", "of", "ionic", "stand"]) for _ in range(rng.randint(5, 60))]
        if kind == "poor":
            words = [w.upper() + "!!" for w in words]
        if kind == "toxic":
            words[:2] = ["awful", "worthless"]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, kind))
    return docs, labels


TARGETS = {"clean": 0.5, "poor": 0.3, "toxic": 0.2}


def test_totals_meet_their_targets(spark):
    docs, labels = cases()
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "the of an", "x"), (5, docs[5][1], "x")]
    got = mixing.rates(spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (None, "clean"), (7, None)], LABELS), TARGETS).collect()
    assert len(got) == len(docs)
    whole = sum(r.n_tokens for r in got)
    for name, share in TARGETS.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in got) / whole - share) < 1e-4
    assert all(r.rate >= 0 and abs(sum(r[f"p_{d}"] for d in TARGETS) - 1) < 1e-9 for r in got)
    assert all(r.rate == 1 and r.n_tokens == 0 for r in got if r.doc_id in (1000, 1001))
    truth = dict(labels)
    assert sum(max(TARGETS, key=lambda d: r[f"p_{d}"]) == truth.get(r.doc_id) for r in got) > 0.95 * len(labels)


def test_rates_against_a_plain_solver(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 50), p, 1 - p) for i in range(200) for p in [rng.random()]]
    table = spark.createDataFrame(rows, "doc_id long, __ll_tokens long, __ll_p0 double, __ll_p1 double")
    steps, reached, missed = mixing.fit_rates(table, [0.75, 0.25])
    assert missed <= mixing.TOLERANCE
    whole = sum(r[1] for r in rows)
    assert abs(reached[0] - 0.75 * whole) < 1e-3 * whole and abs(reached[1] - 0.25 * whole) < 1e-3 * whole
    got = {r.doc_id: r.r for r in table.select("doc_id", mixing._rate(steps).alias("r")).collect()}
    for i, t, p, q in rows:
        r = 1.0
        for g in steps:
            r = max(0.0, r - t * (p * g[0] + q * g[1]))
        assert abs(got[i] - r) < 1e-9
    assert abs(sum(got[i] * t * p for i, t, p, _ in rows) - reached[0]) < 1e-6 * whole


def test_unreachable_targets_stay_nonnegative(spark):
    rows = [(i, 10, 0.6, 0.4) for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, __ll_tokens long, __ll_p0 double, __ll_p1 double")
    steps, reached, missed = mixing.fit_rates(table, [0.0, 1.0])
    assert missed > 0.1  # and says so
    assert all(r[0] >= 0 for r in table.select(mixing._rate(steps)).collect()) and min(reached) >= 0


def test_posteriors_against_a_plain_classifier(spark):
    """Naive Bayes computed anew, from counts of the labelled rows, for the words and bins that the model holds."""
    docs, labels = cases(200)
    model = mixing.fit_domains(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    truth, names = dict(labels), sorted(TARGETS)
    per = {d: [t for i, t, _ in docs if truth[i] == d] for d in names}
    rate = lambda w, d: (sum(w in t.lower().split() for t in per[d]) + 0.5) / (len(per[d]) + 1)
    shape = lambda t, p: min(mixing.BINS - 1, int(math.sqrt(len(re.findall(p, t)) / max(1, len(t))) * 16))
    got = {r.doc_id: r for r in mixing.rates(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), TARGETS).collect()}
    for i, text, _ in docs[::7]:
        score = {}
        for d in names:
            score[d] = math.log(len(per[d]) / len(docs))
            for pattern in (mixing.SYMBOLS, mixing.CAPITALS):
                same = sum(shape(t, pattern) == shape(text, pattern) for t in per[d])
                score[d] += math.log((same + 0.5) / (len(per[d]) + 0.5 * mixing.BINS))
            for w in set(text.lower().split()) & set(model.words):
                score[d] += math.log(rate(w, d) / (sum(rate(w, x) for x in names) / len(names)))
        whole = sum(math.exp(s) for s in score.values())
        assert all(abs(got[i][f"p_{d}"] - math.exp(s) / whole) < 1e-9 for d, s in score.items())


def test_stage_keeps_rows_and_columns(spark):
    docs, labels = cases(60)
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    out = mixing.with_rates(d, lab, TARGETS)
    assert out.columns == d.columns and out.count() == 60
    rates = {r.doc_id: r.rate for r in mixing.rates(d, lab, TARGETS).collect()}
    assert all(abs(rates[r.doc_id] - r.mix_rate) < 1e-9 for r in out.collect())


def test_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b", "x")], DOCS), spark.createDataFrame([], LABELS)
    assert [r.rate for r in mixing.rates(docs, none, TARGETS).collect()] == [1.0]
    assert mixing.rates(docs.limit(0), none, TARGETS).count() == 0


def test_main_path_has_no_python(spark):
    docs, labels = cases(40)
    plan = mixing.with_rates(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), TARGETS)
    assert not re.search("Python|Pandas|InArrow", plan._jdf.queryExecution().toString())


@pytest.mark.parametrize(("quality", "toxic", "domain"), [(1, 1, "toxic"), (1, 0, "clean"), (0, 0, "poor"), (0, None, "poor")])
def test_label_domains(spark, quality, toxic, domain):
    row = mixing.label_domains(spark.createDataFrame([(1, quality, toxic)], "doc_id long, quality int, toxic int")).first()
    assert row.domain == domain and F is not None
