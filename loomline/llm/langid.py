"""Language identification with a linear-chain conditional random field over words.

Each word of a text carries a label; emissions are linear in hashed affix, character n-gram and lexicon
features of the word, and label transitions are learned.  Training texts are cut into runs of words, and these
are shuffled and strung together, so that transitions are learned for code-switched text; every word is in one run.  Forward-backward
gives each word's label posteriors; a text's language is the label with the largest mean posterior, and that
mean is its score.  The model (a fixed number of weights) is broadcast; texts are labelled row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import arrow_schema, bounded_sample, crc_bucket, slices

UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")
#: Number of hashed features, labelled rows of each language that fit the model (about; their texts are read whole), and
#: words of a training sequence.
FEATURES, FIT_ROWS, SEQUENCE = 1 << 16, 200, 48
#: A word this common in the sample is a lexicon entry.
LEXICON_COUNT = 5


@dataclass
class CrfModel:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: frozenset[str]


class _Ids(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """Feature ids of tuples of code points; a part that is absent is 0."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % FEATURES


class _Rows:
    """Sparse word-by-feature matrix: affixes of 1 to 3 letters, character n-grams of 2 and 3 over the word
    with its ends marked (together weighing 3 a word), and a lexicon entry for common words."""

    def __init__(self, words: list[str], lexicon: frozenset[str]):
        self.n = len(words)
        chars = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, self.n) + 2
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(self.n), size)
        ids, values, rows = [], [], []
        weight = 3.0 / (2 * size - 3)
        for n in (2, 3):
            at = np.nonzero(row[: len(row) - n + 1] == row[n - 1 :])[0] if len(row) >= n else np.zeros(0, np.int64)
            ids.append(_mixed(n, *[chars[at + j] for j in range(n)]))
            rows.append(row[at])
            values.append(weight[row[at]])
        for n in (1, 2, 3):
            for salt, index in ((10 + n, lambda j: first + 1 + j), (20 + n, lambda j: first + size - 2 - j)):
                letters = [np.where(size - 2 > j, chars[np.minimum(np.maximum(index(j), 0), len(chars) - 1)], 0) for j in range(n)] if self.n else []
                ids.append(_mixed(salt, *letters) if self.n else np.zeros(0, np.int64))
                rows.append(np.arange(self.n))
                values.append(np.full(self.n, 0.5))
        known = np.array([i for i, w in enumerate(words) if w in lexicon], np.int64)
        ids.append(np.array([xxhash.xxh32_intdigest(words[i]) % FEATURES for i in known.tolist()], np.int64))
        rows.append(known)
        values.append(np.ones(len(known)))
        self.ids, self.values, self.rows = np.concatenate(ids), np.concatenate(values), np.concatenate(rows)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.rows, self.values * weights[self.ids, k], self.n) for k in range(weights.shape[1])], axis=1)

    def back(self, grad: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.ids, self.values * grad[self.rows, k], FEATURES) for k in range(grad.shape[1])], axis=1)


def train(samples: list[tuple[str, list[str]]], rounds: int = 40, seed: int = 7) -> CrfModel:
    """A model from (label, words) samples, by full-batch AdaGrad on the conditional log-likelihood."""
    samples = sorted((lab, words) for lab, words in samples if words)
    labels = sorted({lab for lab, _ in samples})
    counts: dict[str, int] = {}
    for _, words in samples:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    lexicon = frozenset(w for w, n in counts.items() if n >= LEXICON_COUNT)
    k = len(labels)
    if k < 2:
        return CrfModel(labels, np.zeros((FEATURES, k)), np.zeros((k, k)), lexicon)
    vocabulary = {w: i for i, w in enumerate(counts)}
    rng = np.random.default_rng(seed)
    runs: list[tuple[int, list[int]]] = []
    for lab, words in samples:
        at, own = 0, [vocabulary[w] for w in words]
        while at < len(own):
            size = int(rng.integers(4, 40))
            runs.append((labels.index(lab), own[at : at + size]))
            at += size
    order = rng.permutation(len(runs)).tolist()
    flat = np.array([w for i in order for w in runs[i][1]])
    y = np.repeat([runs[i][0] for i in order], [len(runs[i][1]) for i in order])
    whole = -(-len(flat) // SEQUENCE) * SEQUENCE
    flat, y = np.resize(flat, whole), np.resize(y, whole)  # the last sequence is filled up from the first words
    n, x, y = whole // SEQUENCE, flat.reshape(-1, SEQUENCE), y.reshape(-1, SEQUENCE)
    rows = _Rows(list(vocabulary), lexicon)
    weights, transitions = np.zeros((FEATURES, k)), np.zeros((k, k))
    squares, squares_t = np.full_like(weights, 1e-2), np.full_like(transitions, 1e-2)
    gold_t = np.zeros((k, k))
    np.add.at(gold_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    for _ in range(rounds):
        emit = rows.dot(weights)[x]
        gamma, pair = _posteriors(emit, transitions)
        grad = -gamma.reshape(-1, k)
        grad[np.arange(len(flat)), y.ravel()] += 1
        by_word = np.stack([np.bincount(flat, grad[:, j], rows.n) for j in range(k)], axis=1)
        g = rows.back(by_word) / n - 1e-4 * weights
        gt = (gold_t - pair) / n - 1e-4 * transitions
        squares += g * g
        squares_t += gt * gt
        weights += 0.5 * g / np.sqrt(squares)
        transitions += 0.5 * gt / np.sqrt(squares_t)
    return CrfModel(labels, weights, transitions, lexicon)


def _posteriors(emit: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors and summed transition posteriors of equally long sequences (n, t, k)."""
    n, t, k = emit.shape
    e, a = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(transitions)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        v = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] = v / v.sum(1, keepdims=True)
    pair = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        later = e[:, i + 1] * beta[:, i + 1]
        v = later @ a.T
        joint = alpha[:, i, :, None] * a * later[:, None, :]
        pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta[:, i] = v / v.sum(1, keepdims=True)
    gamma = alpha * beta
    return gamma / gamma.sum(2, keepdims=True), pair


def mean_posteriors(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Mean label posteriors of sequences that lie one after another in ``emit``; all lengths are positive.

    All sequences step together, the longest first, so that the running ones are always a prefix.
    """
    k = emit.shape[1]
    a = np.exp(transitions - transitions.max())
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    alpha = np.empty_like(e)
    v = None
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        v = e[at] if t == 0 else (v[:n] @ a) * e[at]
        v /= v.sum(1, keepdims=True)
        alpha[at] = v
    total, later = np.zeros((len(size), k)), np.ones((len(size), k))
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(active[t])
        at = starts[:n] + t
        g = alpha[at] * later[:n]
        total[:n] += g / g.sum(1, keepdims=True)
        w = (e[at] * later[:n]) @ a.T
        later[:n] = w / w.sum(1, keepdims=True)
    out = np.empty_like(total)
    out[order] = total / size[:, None]
    return out


def label_texts(texts: list[str | None], model: CrfModel) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    ids = _Ids()
    per_text = [np.array([ids[w] for w in WORDS.findall((text or "").lower())], np.int64) for text in texts]
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.labels or not ids:
        return names, scores
    lettered = np.fromiter((any(map(str.isalpha, w)) for w in ids), bool, len(ids))
    per_text = [x[lettered[x]] for x in per_text]
    full = [i for i, x in enumerate(per_text) if len(x)]
    if not full:
        return names, scores
    words = list(ids)
    emit = np.concatenate([_Rows(words[i : i + 50_000], model.lexicon).dot(model.weights) for i in range(0, len(words), 50_000)])
    emit = emit.astype(np.float32)[np.concatenate([per_text[i] for i in full])]
    mean = mean_posteriors(emit, np.array([len(per_text[i]) for i in full]), model.transitions.astype(np.float32))
    for i, row in zip(full, mean, strict=True):
        best = int(row.argmax())
        names[i], scores[i] = model.labels[best], float(min(1.0, max(0.0, row[best])))
    return names, scores


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> CrfModel:
    """A model from ``docs`` (doc_id, text, lang): all words of about ``fit_rows`` rows of each language.  Null text or
    lang teaches nothing; rows that repeat a doc_id are in the sample together or not at all."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null")
    sample = bounded_sample(known.select("doc_id", "text", "lang"), "lang", "doc_id", fit_rows)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [" ".join(w for w in WORDS.findall(text.lower()) if any(map(str.isalpha, w))) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["lang", "words"])

    rows = sample.select("lang", "text").mapInArrow(words, "lang string, words string").collect()
    return train([(r.lang, r.words.split(" ")) for r in rows if r.words])


def predict(docs: DataFrame, model: CrfModel) -> DataFrame:
    """``docs`` with columns ``__ll_lang`` and ``__ll_score`` added; other columns pass through.

    Null text and text without a letter get ``und`` and score 0.  Texts of any length are labelled whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*docs.schema.fields, T.StructField("__ll_lang", T.StringType()), T.StructField("__ll_score", T.DoubleType())])
    arrow, at = arrow_schema(out), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 12 << 20):
            names, scores = label_texts(batch.column(at).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=arrow)

    return docs.mapInArrow(run, out)


def taught(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The rows that may teach: those outside the held-out fold."""
    return docs.filter(crc_bucket(F.col("doc_id"), folds) != held_out)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; without labelled rows all are ``und``.  Rows that repeat come
    back each; null ids are in no fold, teach nothing and are not held out; other columns are not read."""
    found = predict(docs.select("doc_id", "text"), fit(taught(docs, folds, held_out)))
    held = F.coalesce(crc_bucket(F.col("doc_id"), folds) == held_out, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("__ll_lang").alias("lang_pred"), F.col("__ll_score").alias("score"))
