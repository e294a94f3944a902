"""Quality classifier by compression: zstandard dictionaries of good and bad text.

One dictionary is built from labelled good text and one from bad.  A text is cut into pieces and each piece
is compressed against both; d = (bytes with the bad dictionary - bytes with the good one) / raw bytes.  A
logistic curve fitted on labelled texts that built no dictionary turns d into a probability.  Texts are
scored whole, by rows, with no shuffle; only the two dictionaries and the curve's numbers are broadcast, and
their size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded_sample, crc_bucket, slices, text_bytes

PIECE, DICTIONARY, LEVEL = 4096, 64 << 10, 3
#: Labelled rows of each class that fit the model, about; their texts are read whole.
FIT_ROWS = 1500
THRESHOLD = 0.3


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [_compressor(x) for x in (self.good, self.bad)]


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves as the dictionary
        return b"".join(pieces)[-DICTIONARY:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if kept:
        kept.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_dict_id=False)


def pieces_of(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def difference(text: bytes, compressors) -> float:
    """Normalised compressed-size difference of one text; positive: closer to good text."""
    good, bad = compressors
    parts = pieces_of(text)
    return (sum(len(bad.compress(p)) for p in parts) - sum(len(good.compress(p)) for p in parts)) / max(1, len(text))


def _design(d: np.ndarray, length: np.ndarray) -> np.ndarray:
    size = np.log1p(length) / 10
    return np.stack([np.ones_like(d), d * 10, d * 10 * size, np.clip(d * 10, -1, 1) ** 2], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> CompressionModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0/1), on a bounded sample of rows.

    Null labels are left out; of several labels of a doc_id the largest counts.  With one class or none
    the score of every text is the share of label 1 (0.5 without labels).
    """
    known = labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.5
    chosen = F.broadcast(bounded_sample(known, "label", "doc_id", fit_rows))  # at most 8 * fit_rows ids
    texts = docs.filter("text is not null").join(chosen, "doc_id").select("doc_id", "label", "text")
    rows = sorted((r.doc_id, int(r.label), r.text.encode()) for r in texts.limit(8 * fit_rows).toLocalIterator() if r.text)
    build, rest = rows[::2], rows[1::2]
    if len({r[1] for r in build}) < 2 or len({r[1] for r in rest}) < 2:
        return CompressionModel(b"", b"", (), prior)
    bad, good = (_dictionary([p for r in build if r[1] == k for p in pieces_of(r[2])]) for k in (0, 1))
    model = CompressionModel(good, bad, (), prior)
    compressors = model.compressors()
    d, y = np.array([difference(r[2], compressors) for r in rest]), np.array([r[1] for r in rest], float)
    w = _logistic(_design(d, np.array([len(r[2]) for r in rest], float)), y)
    w[0] += np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(y.mean() / (1 - y.mean()))  # the sample is balanced
    return CompressionModel(good, bad, tuple(w.tolist()), prior)


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """(doc_id, score) of every row.  Null and empty texts score the prior; texts of any length are scored whole; rows
    that repeat each come back; columns other than ``doc_id`` and ``text`` are not read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        compressors = own.compressors()
        for batch in slices(batches, 1, 16 << 20):
            texts = text_bytes(batch.column(1))
            out = np.full(len(texts), own.prior)
            full = np.array([bool(x) for x in texts])
            if own.weights and full.any():
                d = np.array([difference(x, compressors) for x in texts if x])
                length = np.array([len(x) for x in texts if x], float)
                out[full] = 1 / (1 + np.exp(-np.clip(_design(d, length) @ np.array(own.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels of the fold with remainder 0 are not read."""
    taught = labels.select("doc_id", F.col("quality").alias("label")).filter(crc_bucket(F.col("doc_id"), folds) != 0)
    scored = score(docs, fit(docs.select("doc_id", "text"), taught))
    held = F.coalesce(crc_bucket(F.col("doc_id"), folds) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
