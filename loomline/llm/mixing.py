"""Mixing to target weights by soft membership, in DataFrame expressions only.

A naive Bayes classifier fitted on a labelled table predicts each document's domain posteriors from the
presence of telling words and from binned shares of symbols and capitals.  Nonnegative document rates are then
fitted by projected gradient descent on the weighted squares of (expected domain tokens - target), where a
document of t tokens, posterior p and rate r brings r*t*p_k to domain k.  Documents stay where they are: an
iteration is one aggregation of as many sums as there are domains, and a rate is an expression of the gradients
so far.  Nothing is joined or grouped by source or domain, so a hot source can't skew it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded_sample, cut

#: Labelled rows of each domain that fit the classifier, about; telling words kept; bins of a share; words that
#: can be telling appear in at least so many sampled documents.
FIT_ROWS, LEXICON, BINS, LEAST_DOCS = 1500, 300, 12, 5
#: Most iterations, and the error of the totals, relative to all tokens, at which they end.
ROUNDS, TOLERANCE = 40, 1e-6
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS, CAPITALS = r"[!#$%&*|<>{}=]", r"[A-Z]"


@dataclass
class Domains:
    """names; log priors; for each binned share, log probabilities by domain and bin; word log ratios."""

    names: list[str]
    prior: list[float]
    bins: dict[str, list[list[float]]]
    words: dict[str, list[float]]


def _share_bin(text: Column, pattern: str) -> Column:
    share = F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))
    return F.least(F.lit(BINS - 1), F.floor(F.sqrt(share) * 16)).cast("int")


def _features(docs: DataFrame) -> DataFrame:
    """``docs`` with the features of ``text`` in internal columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    return docs.withColumns({"__ll_words": words, "__ll_symbols": _share_bin(text, SYMBOLS), "__ll_capitals": _share_bin(text, CAPITALS)})


def fit_domains(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Domains:
    """A classifier from ``docs`` (doc_id, text) and ``labelled`` (doc_id, domain).

    Null domains and ids teach nothing; of several domains of one doc_id the smallest name counts.  Priors come
    from all labelled rows, the rest from a bounded sample of them.
    """
    known = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}
    names = sorted(counts)
    if not names:
        return Domains(["all"], [0.0], {}, {})
    chosen = F.broadcast(bounded_sample(known, "domain", "doc_id", fit_rows))  # ids only, a bounded number
    sample = _features(docs.select("doc_id", "text").join(chosen, "doc_id"))
    sample = cut(sample.select("domain", "__ll_symbols", "__ll_capitals", F.array_distinct("__ll_words").alias("__ll_words")))
    size = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}
    bins = {}
    for column in ("__ll_symbols", "__ll_capitals"):
        seen = {(r[0], r[1]): r[2] for r in sample.groupBy("domain", column).count().collect()}
        bins[column] = [[math.log((seen.get((d, b), 0) + 0.5) / (size.get(d, 0) + 0.5 * BINS)) for b in range(BINS)] for d in names]
    per_domain = [F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(names)]
    table = sample.select("domain", F.explode("__ll_words").alias("word")).filter(F.length("word") <= 40).groupBy("word").agg(*per_domain, F.count(F.lit(1)).alias("n"))
    rates = [(F.col(f"n{i}") + 0.5) / (size.get(d, 0) + 1.0) for i, d in enumerate(names)]
    mean = sum(rates[1:], rates[0]) / len(names)
    logs = [F.log(r / mean) for r in rates]
    telling = sum((r * F.abs(x) for r, x in zip(rates, logs, strict=True)), F.lit(0.0))
    picked = table.filter(F.col("n") >= LEAST_DOCS).select("word", telling.alias("telling"), *[x.alias(f"w{i}") for i, x in enumerate(logs)])
    rows = picked.orderBy(F.desc("telling"), "word").limit(LEXICON).collect() if len(names) > 1 else []
    whole = sum(counts.values())
    return Domains(names, [math.log(counts[d] / whole) for d in names], bins, {r.word: [float(r[f"w{i}"]) for i in range(len(names))] for r in rows})


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _posteriors(docs: DataFrame, model: Domains) -> DataFrame:
    """``docs`` with ``__ll_tokens`` and the posteriors ``__ll_p0``, ``__ll_p1``... of the domains."""
    docs = _features(docs).withColumn("__ll_tokens", F.size("__ll_words").cast("long"))
    found = F.array_intersect(F.array(*map(F.lit, model.words)), "__ll_words") if model.words else F.expr("cast(array() as array<string>)")
    docs = docs.withColumn("__ll_found", found)
    places = F.create_map(*[F.lit(x) for i, w in enumerate(model.words) for x in (w, i + 1)]) if model.words else None
    scores = {}
    for k in range(len(model.names)):
        score = F.lit(model.prior[k])
        for column, table in model.bins.items():
            score = score + F.element_at(_doubles(table[k]), F.col(column) + 1)
        if places is not None:
            weights = _doubles([w[k] for w in model.words.values()])
            score = score + F.aggregate("__ll_found", F.lit(0.0), _adder(weights, places))
        scores[f"__ll_s{k}"] = score
    docs = docs.withColumns(scores).drop("__ll_words", "__ll_symbols", "__ll_capitals", "__ll_found")
    top = F.greatest(*scores) if len(scores) > 1 else F.col("__ll_s0")
    docs = docs.withColumn("__ll_top", top)
    docs = docs.withColumns({f"__ll_e{k}": F.exp(F.col(s) - F.col("__ll_top")) for k, s in enumerate(scores)}).drop(*scores, "__ll_top")
    total = sum((F.col(f"__ll_e{k}") for k in range(1, len(scores))), F.col("__ll_e0"))
    docs = docs.withColumn("__ll_total", total)
    return docs.withColumns({f"__ll_p{k}": F.col(f"__ll_e{k}") / F.col("__ll_total") for k in range(len(scores))}).drop("__ll_total", *[f"__ll_e{k}" for k in range(len(scores))])


def _adder(weights: Column, places: Column):
    return lambda acc, w: acc + F.element_at(weights, F.element_at(places, w))


def _inverse(matrix: list[list[float]]) -> list[list[float]]:
    """Inverse of a small symmetric positive definite matrix, by elimination with a small ridge."""
    n = len(matrix)
    ridge = 1e-9 * max(sum(matrix[i][i] for i in range(n)) / n, 1e-300)
    rows = [[matrix[i][j] + ridge * (i == j) for j in range(n)] + [float(i == j) for j in range(n)] for i in range(n)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[p] = rows[p], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [r[n:] for r in rows]


def _rate(steps: list[list[float]]) -> Column:
    """The rate after the given gradient steps, from 1, kept nonnegative."""
    r = F.lit(1.0)
    for g in steps:
        move = sum((F.col(f"__ll_p{k}") * F.lit(x) for k, x in enumerate(g)), F.lit(0.0))
        r = F.greatest(F.lit(0.0), r - F.col("__ll_tokens") * move)
    return r


def fit_rates(table: DataFrame, shares: list[float], tokens: float | None = None) -> tuple[list[list[float]], list[float], float]:
    """Gradient steps for ``table`` (``__ll_tokens``, ``__ll_p*``), the domain totals that they reach, and the largest
    distance of one from its target, as a share of all tokens.

    Minimises (A(r) - b)' W (A(r) - b) over r >= 0, where A(r) are the expected domain totals and b = shares *
    tokens (the table's own by default).  W is the inverse of sum t^2 p p' over the documents whose rate is
    positive; in that metric a step of one lands on the target unless further bounds become active.  A step
    that doesn't lower the error is taken back and halved.
    """
    k = len(shares)
    a = [F.col("__ll_tokens") * F.col(f"__ll_p{i}") for i in range(k)]
    total = tokens
    steps: list[list[float]] = []
    best: tuple[float, list[list[float]], list[float]] | None = None
    for _ in range(ROUNDS):
        rated = table.select(_rate(steps).alias("r"), "__ll_tokens", *[x.alias(f"a{i}") for i, x in enumerate(a)])
        sums = [F.sum(F.col("r") * F.col(f"a{i}")) for i in range(k)]
        gram = [F.sum(F.when(F.col("r") > 0, F.col(f"a{i}") * F.col(f"a{j}"))) for i in range(k) for j in range(k)]
        row = [float(x or 0) for x in rated.agg(*sums, *gram, F.sum("__ll_tokens")).first()]
        if not row[-1]:
            return [], [0.0] * k, 0.0
        total = row[-1] if total is None else total
        off = [x - s * total for x, s in zip(row[:k], shares, strict=True)]
        error = max(map(abs, off))
        if best is None or error < best[0]:
            best = (error, steps, row[:k])
            weight = _inverse([row[k + i * k : k + i * k + k] for i in range(k)])
            step = [float(f"{sum(weight[i][j] * off[j] for j in range(k)):.12e}") for i in range(k)]
        else:
            step = [x / 2 for x in step]
        if best[0] <= TOLERANCE * total:
            break
        steps = [*best[1], step]
    return best[1], best[2], best[0] / total


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], fit_rows: int = FIT_ROWS) -> tuple[DataFrame, Domains, list[list[float]], float]:
    """(table of doc_id, ``__ll_tokens`` and ``__ll_p*``; the classifier; the gradient steps; how far they miss)."""
    model = fit_domains(docs, labelled, fit_rows)
    table = cut(_posteriors(docs.select("doc_id", "text"), model).drop("text"))
    whole = sum(targets.get(d, 0.0) for d in model.names)
    shares = [targets.get(d, 0.0) / whole if whole else 1.0 / len(model.names) for d in model.names]
    steps, _, missed = fit_rates(table, shares)
    return table, model, steps, missed


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, target_miss) of every row: how often it is to be drawn.

    target_miss, the same in each row, says how far the expected total of a domain stays from its target at most, as a
    share of all tokens: above ``TOLERANCE`` where the targets can't be met or ``ROUNDS`` steps weren't enough.
    Texts of any length are read whole; columns other than ``doc_id`` and ``text`` are not read.  Null and empty texts have no tokens and rate 1.  Rows that repeat get equal rates.  Domains that no label
    names have no share; the other shares are scaled to one.  Without labels all rates are 1.
    """
    table, model, steps, missed = mix(docs, labelled, targets, fit_rows)
    return table.select("doc_id", F.col("__ll_tokens").alias("n_tokens"), *[F.col(f"__ll_p{k}").alias(f"p_{d}") for k, d in enumerate(model.names)], F.round(_rate(steps), 9).alias("rate"), F.lit(missed).alias("target_miss"))


def with_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with a column ``mix_rate`` (which replaces one of that name); no join, as rates are expressions.

    All rows stay, with the rates of ``rates``: 1 for null and empty texts, equal ones for repeated rows.
    """
    _, model, steps, _ = mix(docs, labelled, targets, fit_rows)
    rated = _posteriors(docs, model).withColumn("mix_rate", F.round(_rate(steps), 9))
    return rated.drop("__ll_tokens", *[f"__ll_p{k}" for k in range(len(model.names))])


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table (doc_id, quality, toxic): toxic, clean or poor; null quality: no domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")
