"""Language-model scores from a Brown class-based bigram model.

Counts of all tokens of all training texts are exact and distributed.  Every training word gets a class.  The
commonest words (``CLUSTERED``) are clustered by exchange on a matrix of their bigram counts; all other words of
the head (``HEAD``, a size-bounded table that workers look words up in) join the class that their neighbours fit
best and are then exchanged in parallel, each against the class bigrams of the round before; words outside the
head are dealt by a shuffle, and join the class that fits their neighbours best.  Text ends have a class of their
own, and so have words that training texts don't have; words seen once stand for them where class
transitions are counted.  A text's score is the log10 of the product of smoothed class transitions and word emissions.  Texts are
numbered once; all further passes read numbers.  No table that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import crc_bucket, cut, slices, text_bytes, whole_groups

#: Bounds of the tables that are broadcast or sent to the driver: words looked up in workers, words clustered on one
#: matrix, and the longest word (bytes) that they hold.  Words beyond them are dealt by a shuffle instead.
HEAD, CLUSTERED, WORD_BYTES = 200_000, 1000, 64
#: Least and most classes; in between their number is this power of the vocabulary's size.
CLASSES, POWER = (8, 128), 0.35
#: Distinct words that one task counts before it passes them on, and parts that the head's context counts are dealt in.
FLUSH, PARTS = 300_000, 64
#: Weight of the class unigram in smoothed transitions, in tokens.
MIX = 20.0


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all words of ``texts``; partial counts are made before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return batch

        for batch in slices(batches, 0, 8 << 20):
            for text in text_bytes(batch.column(0)):
                counts.update(_words(text))
                if len(counts) > FLUSH:
                    yield out()
        if counts:
            yield out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _common(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` of the commonest words with their counts, by count and then word: all words of a count
    or none, found from a histogram of logarithms of counts."""
    short = counts.filter(F.octet_length("word") <= WORD_BYTES)
    level = F.floor(F.log2(F.col("c")) * 16).cast("int")
    levels = sorted(((r[0], r[1]) for r in short.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for value, n in levels:
        if total + n > most:
            break
        total, least = total + n, value
    if least is None:
        return []
    rows = short.filter(level >= least).collect()
    return sorted(((bytes(r.word), int(r.c)) for r in rows), key=lambda x: (-x[1], x[0]))


def numbered(rows: DataFrame, words: list[bytes]) -> DataFrame:
    """(row, doc_id, learn, ask, ids, others): the tokens of ``rows`` (doc_id, text, learn, ask) as 32-bit numbers.

    ``words`` are numbered from 0, other words (listed in ``others``) are ``len(words)`` and ends ``len(words) + 1``.
    """
    held = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, other = held.value.get, len(held.value)
        for batch in slices(batches, 4, 8 << 20):
            ids, others = [], []
            for text in text_bytes(batch.column(4)):
                found = _words(text)
                x = [get(w, other) for w in found]
                others.append([w for w, i in zip(found, x, strict=True) if i == other])
                x.append(other + 1)
                ids.append(np.array(x, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary()), pa.array(others, pa.list_(pa.binary()))], ["row", "doc_id", "learn", "ask", "ids", "others"])

    every = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "learn", "ask", "text")
    return every.mapInArrow(run, "row long, doc_id long, learn boolean, ask boolean, ids binary, others array<binary>")


def _sequence(column: pa.Array, end: int) -> np.ndarray:
    """The numbers of all rows of a column of ``ids``, one after another, after an end."""
    blobs = column.to_pylist()
    return np.concatenate([np.array([end], np.int32), np.frombuffer(b"".join(blobs), np.int32)])


def _summed(lines: DataFrame, codes_of, size: int, *columns: str) -> np.ndarray:
    """Sums of the codes (below ``size``, which is bounded) that ``codes_of`` finds in each batch of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                n = np.bincount(codes_of(batch), minlength=size)
                total = n if total is None else total + n
        if total is not None:
            codes = np.nonzero(total)[0]
            for at in range(0, len(codes), 100_000):
                part = codes[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], ["code", "n"])

    out = np.zeros(size)
    found = lines.select(*columns).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out


def _bigrams(lines: DataFrame, label: np.ndarray, size: int) -> np.ndarray:
    """Bigram counts of labels (by number; negative: none) of neighbouring tokens."""
    held, end = lines.sparkSession.sparkContext.broadcast(label), len(label) - 1

    def codes_of(batch: pa.RecordBatch) -> np.ndarray:
        c = held.value[_sequence(batch.column(0), end)].astype(np.int64)
        left, right = c[:-1], c[1:]
        return (left * size + right)[(left >= 0) & (right >= 0)]

    return _summed(lines, codes_of, size * size, "ids").reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, words: int, classes: int, rounds: int = 6) -> np.ndarray:
    """Classes of the first ``words`` rows of a square matrix of bigram counts.

    The remaining rows are words that stay in classes of their own.  Starting from classes dealt by rank, each
    word in turn moves to the class that most raises the likelihood of the class bigrams, until no word moves.
    """
    fixed = len(bigrams) - words
    size = classes + fixed
    label = np.concatenate([np.arange(words) % classes, classes + np.arange(fixed)]).astype(np.int64)
    member = np.eye(size)[label]
    succ, pred = bigrams @ member, bigrams.T @ member  # by word and class
    table = member.T @ succ
    n_left, n_right = bigrams.sum(1), bigrams.sum(0)
    m_left, m_right = table.sum(1), table.sum(0)
    inner = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            a, own = label[w], bigrams[w, w]
            r, c = succ[w].copy(), pred[w].copy()
            r[a] -= own
            c[a] -= own
            table[a, :] -= r
            table[:, a] -= c
            table[a, a] -= own
            m_left[a] -= n_left[w]
            m_right[a] -= n_right[w]
            rows, columns = table[:classes], table[:, :classes].T
            gain_rows = _xlogx(rows + r) - _xlogx(rows)
            gain_columns = _xlogx(columns + c) - _xlogx(columns)
            diagonal = table[inner, inner]
            gain = gain_rows.sum(1) - gain_rows[inner, inner] + gain_columns.sum(1) - gain_columns[inner, inner]
            gain += _xlogx(diagonal + r[inner] + c[inner] + own) - _xlogx(diagonal)
            gain -= _xlogx(m_left[inner] + n_left[w]) - _xlogx(m_left[inner]) + _xlogx(m_right[inner] + n_right[w]) - _xlogx(m_right[inner])
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b, :] += r
            table[:, b] += c
            table[b, b] += own
            m_left[b] += n_left[w]
            m_right[b] += n_right[w]
            if b != a:
                moved += 1
                label[w] = b
                succ[:, a] -= bigrams[:, w]
                succ[:, b] += bigrams[:, w]
                pred[:, a] -= bigrams[w, :]
                pred[:, b] += bigrams[w, :]
        if not moved:
            break
    return label[:words]


def place(succ: np.ndarray, pred: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """The class (of the first ``classes``) whose transitions give each word's neighbours the largest likelihood.

    succ and pred count each word's followers and predecessors by class; table holds class bigrams.
    """
    smooth = table + 0.5
    after = np.log(smooth / smooth.sum(1, keepdims=True))[:classes]
    before = np.log(smooth / smooth.sum(0, keepdims=True))[:, :classes]
    return np.argmax(succ @ after.T + pred @ before, axis=1)


def _dense(codes: list[np.ndarray], counts: list[np.ndarray] | None, rows: int, width: int) -> np.ndarray:
    weights = None if counts is None else np.concatenate(counts)
    return np.bincount(np.concatenate(codes), weights, rows * width).reshape(rows, width).astype(np.float64)


def placed(lines: DataFrame, label: np.ndarray, first: int, last: int, table: np.ndarray, classes: int) -> np.ndarray:
    """The best classes of the words numbered ``first`` to ``last``, by ``place``, from the labels of all their neighbours.

    Each task sums the contexts of its words and sends them in ``PARTS`` parts; a part's words are decided where it is
    summed, in a matrix of bounded size.
    """
    size, width, count = classes + 2, 2 * (classes + 2), last - first
    held, end = lines.sparkSession.sparkContext.broadcast(label), len(label) - 1
    rows = -(-count // PARTS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, found, waiting = zstandard.ZstdCompressor(level=1), [], 0

        def out() -> pa.RecordBatch:
            codes, n = (np.concatenate([x[i] for x in found]) for i in (0, 1))
            codes, at = np.unique(codes, return_inverse=True)
            n = np.bincount(at, n).astype(np.int32)
            part = codes // width % PARTS
            order = np.argsort(part, kind="stable")
            ends = np.cumsum(np.bincount(part, minlength=PARTS)).tolist()
            blobs = []
            for a, b in zip([0, *ends], ends, strict=False):
                mine = order[a:b]
                blobs.append(press.compress(np.diff(codes[mine], prepend=0).astype(np.int32).tobytes() + n[mine].tobytes()))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], ["part", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _sequence(batch.column(0), end).astype(np.int64)
            c, mine = held.value[x].astype(np.int64), (x >= first) & (x < last)
            after, before = mine[:-1] & (c[1:] >= 0), mine[1:] & (c[:-1] >= 0)
            codes = np.concatenate([(x[:-1][after] - first) * width + c[1:][after], (x[1:][before] - first) * width + size + c[:-1][before]])
            found.append(np.unique(codes, return_counts=True))
            waiting += len(found[-1][0])
            if waiting > 4_000_000:
                yield out()
                waiting = 0
        if found:
            yield out()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, matrix, open_ = -1, np.zeros((rows, width)), zstandard.ZstdDecompressor()

        def out() -> pa.RecordBatch:
            words = first + at + PARTS * np.arange(rows)
            best = place(matrix[:, :size], matrix[:, size:], table, classes)
            matrix[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(best.astype(np.int32))], ["word", "cls"])

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != at >= 0:
                    yield out()
                at = part
                codes, n = np.frombuffer(open_.decompress(data), np.int32).reshape(2, -1)
                codes = np.cumsum(codes, dtype=np.int64)
                matrix[codes // width // PARTS, codes % width] += n
        if at >= 0:
            yield out()

    sent = lines.select("ids").mapInArrow(send, "part int, data binary").repartition("part").sortWithinPartitions("part")
    found = sent.mapInArrow(decide, "word int, cls int").filter(F.col("word") < last).toArrow()
    out = np.zeros(count, np.int64)
    out[found["word"].to_numpy() - first] = found["cls"].to_numpy()
    return out


def tail(lines: DataFrame, label: np.ndarray, table: np.ndarray, classes: int) -> DataFrame:
    """(word, c, cls) of the words outside the head: their counts, and their classes by ``place``."""
    size, width = classes + 2, 2 * (classes + 2)
    held, end = lines.sparkSession.sparkContext.broadcast(label), len(label) - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(contexts), pa.binary()), pa.array([np.array(x, np.uint32).tobytes() for x in contexts.values()], pa.binary())], ["word", "codes"])
            contexts.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _sequence(batch.column(0), end)
            c, at = held.value[x].astype(np.int64) + 1, np.nonzero(x == end - 1)[0]
            for word, code in zip(batch.column(1).flatten().to_pylist(), (c[at - 1] << 10 | c[at + 1]).tolist(), strict=True):
                contexts.setdefault(word, []).append(code)
            if len(contexts) > FLUSH:
                yield out()
        if contexts:
            yield out()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in range(0, batch.num_rows, 4096):
                some = batch.slice(lot, 4096)
                blobs = [b"".join(x) for x in some.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in blobs], np.int64)
                codes, row = np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64), np.repeat(np.arange(len(n)), n)
                left, right = (codes >> 10) - 1, (codes & 1023) - 1
                pairs = [(row * width + right)[right >= 0], (row * width + size + left)[left >= 0]]
                matrix = _dense(pairs, None, len(n), width)
                best = place(matrix[:, :size], matrix[:, size:], table, classes)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), pa.array(best.astype(np.int32))], ["word", "c", "cls"])

    sent = lines.filter(F.size("others") > 0).select("ids", "others").mapInArrow(send, "word binary, codes binary")
    return sent.groupBy("word").agg(F.collect_list("codes").alias("codes")).mapInArrow(decide, "word binary, c long, cls int")


@dataclass
class BrownModel:
    """Head words are numbered; other words have the number ``len(words)`` and text ends the one after."""

    words: list[bytes]
    known: np.ndarray  # by number: the count, for head words
    label: np.ndarray  # by number: the class; -1 for other words
    tail: DataFrame  # (word, c, cls) of the training words outside the head
    classes: int  # word classes; the next class is that of unknown words, the last that of text ends
    sizes: np.ndarray  # tokens of each word class
    once: int  # words seen once: as many unknown words share the unknown class
    total: int
    distinct: int

    @property
    def rare(self) -> np.ndarray:
        """By number: is it a head word seen once?"""
        return np.concatenate([self.known == 1, [False, False]])

    @property
    def emissions(self) -> np.ndarray:
        """By number, for head words the log10 probability in their class; 0 for others."""
        n, c = self.known, self.label[: len(self.known)]
        return np.concatenate([np.log10(n / self.sizes[c]) if len(n) else n, [0.0, 0.0]])

    @property
    def unknown(self) -> float:
        return -math.log10(self.once + 1)


def fit(lines: DataFrame, counts: DataFrame, common: list[tuple[bytes, int]], ends: int, clustered: int = CLUSTERED, classes: int | None = None) -> BrownModel:
    """A model from the training ``lines`` (of ``numbered``) and the exact ``counts`` of their words."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1))).first()
    total, distinct = int(sums[0]) + ends, int(sums[1]) + (ends > 0)
    words, n = [w for w, _ in common], np.array([c for _, c in common], np.float64)
    p, k = len(words), min(clustered, len(words))
    classes = max(1, min(classes or min(max(CLASSES[0], int(distinct**POWER)), CLASSES[1]), k))
    label = np.full(p + 2, -1, np.int64)
    label[-1] = classes + 1
    own = np.concatenate([np.arange(k), np.full(p + 1 - k, k), [k + 1]])  # the commonest words, all others, ends
    pairs = _bigrams(lines, own, k + 2)
    label[:k] = exchange(pairs, k, classes)
    if p > k:
        for _ in range(2):  # from the neighbours that have a class, then exchanged against the classes of all
            table = _bigrams(lines, label, classes + 2)
            label[k:p] = placed(lines, label, k, p, table, classes)
    rest = cut(tail(lines, label, _bigrams(lines, label, classes + 2), classes))
    sizes = np.bincount(label[:p], n, classes) if p else np.zeros(classes)
    for c, s in rest.groupBy("cls").agg(F.sum("c")).collect():
        sizes[c] += s
    return BrownModel(words, n, label, rest, classes, sizes, int(sums[2]), total, distinct)


def _listed(codes: np.ndarray, group: np.ndarray, groups: int) -> pa.Array:
    """A binary value for each group: its 16-bit codes."""
    data = codes[np.argsort(group, kind="stable")].astype(np.uint16).tobytes()
    offsets = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=groups))]) * 2
    return pa.Array.from_buffers(pa.binary(), groups, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _outside(lines: DataFrame, model: BrownModel) -> DataFrame:
    """(key, also, logs, emit, codes, taught) of the rows that have words outside the head; key is 2 * row + learn.

    ``codes`` are the class transitions that touch such a word, ``taught`` the same with words seen once taken as
    unknown; also, logs and emit sum what they add to n_known and to the scores.
    """
    size, unknown = model.classes + 2, model.classes
    held, end = lines.sparkSession.sparkContext.broadcast((model.label + 1) | model.rare.astype(np.int64) << 10), len(model.label) - 1
    sizes, new = np.log10(np.maximum(model.sizes, 1)), model.unknown

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _sequence(batch.column(1), end)
            c, at = held.value[x], np.nonzero(x == end - 1)[0]
            ends = np.nonzero(x == end)[0]
            row = np.searchsorted(ends, at) - 1
            place = (at - ends[row]) << 22 | c[at - 1] << 11 | c[at + 1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(place), batch.column(2).flatten()], ["key", "place", "word"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_groups(batches):
            place, cls = rows["place"].to_numpy(), rows["cls"].to_numpy()
            n = rows["c"].to_numpy().astype(np.float64)
            starts = np.array([0, *ends])
            starts = starts[starts < rows.num_rows]
            group = np.repeat(np.arange(len(starts)), np.diff([*starts.tolist(), rows.num_rows]))
            position, left, right = place >> 22, place >> 11 & 2047, place & 2047
            next_ = (group[1:] == group[:-1]) & (position[1:] == position[:-1] + 1)
            last = right > 0  # the next word is in the head, or the text ends
            cls = np.where(n > 0, cls, unknown).astype(np.int64)
            steps = []
            for own, label in ((cls, lambda x: (x & 1023) - 1), (np.where(n == 1, unknown, cls), lambda x: np.where(x >> 10, unknown, (x & 1023) - 1))):
                before = label(left)
                before[1:][next_] = own[:-1][next_]
                steps.append(np.concatenate([before * size + own, (own * size + label(right))[last]]))
            steps = [_listed(codes, np.concatenate([group, group[last]]), len(starts)) for codes in steps]
            emit = np.where(n > 0, np.log10(np.maximum(n, 1)) - sizes[np.minimum(cls, unknown - 1)], new)
            sums = [np.add.reduceat(v, starts) for v in ((n > 0).astype(np.int64), np.log10(n + 1), emit)]
            keys = rows.column(0).combine_chunks().take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, sums), *steps], ["key", "also", "logs", "emit", "codes", "taught"])

    some = lines.filter(F.size("others") > 0).select(_key(), "ids", "others").mapInArrow(items, "key long, place long, word binary")
    met = some.join(model.tail, "word", "left").select("key", "place", F.coalesce("cls", F.lit(0)).alias("cls"), F.coalesce("c", F.lit(0)).alias("c"))
    return met.repartition("key").sortWithinPartitions("key", "place").mapInArrow(fold, "key long, also long, logs double, emit double, codes binary, taught binary")


def _key() -> Column:
    return (F.col("row") * 2 + F.col("learn").cast("long")).alias("key")


def transitions(lines: DataFrame, outside: DataFrame, model: BrownModel) -> np.ndarray:
    """log10 probabilities of class transitions, from the training ``lines`` and the ``outside`` of all rows.

    Words seen once stand for unknown words here: their own contexts chose their classes, and would flatter them.
    """
    size = model.classes + 2

    def codes_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).astype(np.int64)

    table = _bigrams(lines, np.where(model.rare, model.classes, model.label), size)
    table += _summed(outside.filter("key % 2 = 1"), codes_of, size * size, "taught").reshape(size, size)
    share = (table.sum(0) + 1) / (table.sum() + size)
    return np.log10((table + MIX * share) / (table.sum(1, keepdims=True) + MIX))


def _scored(rows: DataFrame, head: int = HEAD, **bounds: int) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) of the rows (doc_id, text, learn, ask) marked ``ask``."""
    counts = cut(word_counts(rows.filter("learn").select("text")))
    common = _common(counts, head)
    lines = cut(numbered(rows, [w for w, _ in common]))
    training = lines.filter("learn")
    ends = training.count()
    model = fit(training, counts, common, ends, **bounds)
    outside = cut(_outside(lines, model))
    log = transitions(training, outside, model)
    number = len(model.words)
    logs = np.concatenate([np.log10(model.known + 1), [0.0, math.log10(ends + 1)]])
    held = lines.sparkSession.sparkContext.broadcast((model.label, logs, model.emissions, log))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, base, emissions, table = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _sequence(batch.column(1), number + 1)
            c = label[x]
            left, right = c[:-1], c[1:]
            steps = np.where((left >= 0) & (right >= 0), table[left, right], 0.0) + emissions[x[1:]]
            ends_at = np.nonzero(x == number + 1)[0]
            starts = ends_at[:-1]
            tokens = np.diff(ends_at)
            known = np.add.reduceat((x[1:] != number).astype(np.int64), starts) - (not ends)
            columns = [tokens, known, np.add.reduceat(base[x[1:]], starts), np.add.reduceat(steps, starts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), *batch.columns[2:4]], ["key", "n_tokens", "n_known", "base", "score", "doc_id", "learn"])

    asked = lines.filter("ask").select(_key(), "ids", "doc_id", "learn").mapInArrow(run, "key long, n_tokens long, n_known long, base double, score double, doc_id long, learn boolean")

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(4).to_pylist()
            codes = np.frombuffer(b"".join(blobs), np.uint16)
            sums = np.bincount(np.repeat(np.arange(len(blobs)), [len(b) // 2 for b in blobs]), log.ravel()[codes], len(blobs))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(batch.column(3).to_numpy() + sums)], ["key", "also", "logs", "more"])

    rest = outside.select("key", "also", "logs", "emit", "codes").mapInArrow(more, "key long, also long, logs double, more double")
    both = asked.join(rest, "key", "left")
    base = F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(model.total + model.distinct + 1)
    score = F.col("score") + F.coalesce("more", F.lit(0.0)) if ends else base
    known = F.col("n_known") + F.coalesce("also", F.lit(0))
    return both.select("doc_id", "learn", "n_tokens", known.alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def score(docs: DataFrame, training: DataFrame, **bounds: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Tokens are the words, A-Z lower-cased, and one end.  Null and empty texts have the end alone; texts of any
    length are read whole.  Without training rows all counts are zero and both scores are the base's.  Rows that
    repeat come back each; other columns are not read.
    """
    both = docs.select("doc_id", "text", F.lit(False).alias("learn"), F.lit(True).alias("ask"))
    both = both.union(training.select(F.lit(None).cast("long"), "text", F.lit(True), F.lit(False)))
    return _scored(both, **bounds).drop("learn")


def score_held_out(docs: DataFrame, folds: int = 7, held_out: int = 2, **bounds: int) -> DataFrame:
    """The scores of all rows, from a model of the rows outside the held-out fold.

    Rows with a null doc_id have no fold: they teach nothing and are not held out.
    """
    bucket = crc_bucket(F.col("doc_id"), folds)
    found = _scored(docs.select("doc_id", "text", F.coalesce(bucket != held_out, F.lit(False)).alias("learn"), F.lit(True).alias("ask")), **bounds)
    return found.select("doc_id", F.coalesce(bucket == held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
