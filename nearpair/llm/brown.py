"""Scores texts by a Brown class-based bigram model trained on the corpus itself.

Words are counted over all training texts. Every word with LEAST or more occurrences is put into
a class by exchange clustering: in each round every word moves to the class under which the
bigrams it takes part in are most likely, given the classes of all others, and the class
statistics are counted anew. Rarer words share classes by their shape (length, bytes beyond
ASCII); the end of a text is a class of its own and the context of a text's first word.

    P(w after v) = P(class(w) | class(v)) * P(w | class(w))

Transitions are smoothed towards class frequencies; a word of a shape class has one count added,
so unseen words keep some mass.

Bigrams are shuffled once: each word's neighbours on either side are written as packed lists, in
segments if the word is frequent. A round is then a pass over that table with the classes of the
HEAD most frequent words, of fixed size, in every task; only counts of frequent words are summed
over segments. Neighbours beyond the head are rows, joined with their classes. Rounds end when the
likelihood of the classes no longer rises. Only class matrices and what is known of the head go
through the driver; counts and classes of other words reach the texts by a join.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpair.llm.memory import released
from nearpair.llm.tables import drop_written, written
from nearpair.llm.words import Words, chunks, mix

HEAD = 1 << 20  # most frequent words (of LEAST or more occurrences) whose counts every task holds
LEAST = 5  # occurrences from which a word gets a class by exchange
CLASSES = 64
ROUNDS = 8
PULL = 50.0  # weight of the class frequencies in a transition
_SHAPES = 16
_PAIR = 0x9E3779B97F4A7C15
_END = np.uint64(0x5EED0FE2D0FAD0C5)  # stands for the end of a text
_FLUSH = 1 << 21  # tokens counted before they are handed on
_DEAL = 1 << 20  # bigrams dealt into buckets at once
_BUCKET = 1 << 19  # neighbours in a bucket, about
_SEGMENT = 1 << 18  # occurrences of a word whose neighbours stay together
_SPECIAL = 1 << 20  # symbol of the first shape; those of head words, their ranks, are below
_LATE = 1 << 21  # set in the symbols of words beyond the head, otherwise their hashes
_BLOCK = 1 << 12  # words moved at once, about
_WORDS = 1 << 13  # words of a bucket whose counts by class are held at once
_LOG = logging.getLogger(__name__)


def _shape(words: Words) -> np.ndarray:
    return np.minimum(words.size // 3, 7) + 8 * words.wide


class Lookup:
    """Positions of hashes in a set of hashes, -1 if absent."""

    def __init__(self, hashes: np.ndarray, bits: int = 22) -> None:
        self.shift = np.uint64(64 - bits)
        self.order = np.argsort(hashes)
        self.sorted, self.hashes = hashes[self.order], hashes
        self.slots = np.full(1 << bits, -1, np.int32)
        slot = (hashes >> self.shift).astype(np.int64)
        self.slots[slot] = np.arange(len(hashes))
        taken = np.bincount(slot, minlength=1 << bits)
        self.slots[taken > 1] = -2

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = self.slots[(h >> self.shift).astype(np.int64)].astype(np.int64)
        many = np.flatnonzero(at == -2)
        if len(many):
            where = np.minimum(np.searchsorted(self.sorted, h[many]), len(self.sorted) - 1)
            at[many] = self.order[where]
        return np.where(self.hashes[np.maximum(at, 0)] == h, at, -1) if len(at) else at


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    h = np.concatenate([x for x, _ in parts])
    shape = np.concatenate([x for _, x in parts])
    order = np.argsort(h, kind="stable")
    h, shape = h[order], shape[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(h)))
    return pa.RecordBatch.from_arrays(
        [pa.array(h[at].view(np.int64)), pa.array(shape[at].astype(np.int32)), pa.array(count.astype(np.int64))],
        ["word", "shape", "n"],
    )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size, texts = [], 0, 0
    for rows, words in chunks(batches):
        parts.append((words.hashes, _shape(words)))
        size, texts = size + len(words.hashes), texts + rows.num_rows
        if size >= _FLUSH:
            yield _counted(parts)
            parts, size = [], 0
    parts.append((np.full(texts, _END), np.full(texts, -1)))
    yield _counted(parts)


def vocabulary(texts: DataFrame) -> DataFrame:
    """`word` (hash), `shape`, `n` over all `text`; one row is the end of a text, with shape -1."""
    rows = texts.select("text").mapInArrow(_count_words, "word bigint, shape int, n bigint")
    return rows.groupBy("word", "shape").agg(F.sum("n").alias("n"))


def _ordered(words: Words, texts: int, own: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """`own` of each token, ends included, and that before it."""
    symbols = np.full(len(own) + texts, end, own.dtype)
    symbols[np.arange(len(own)) + words.doc] = own
    return symbols, np.concatenate([np.full(1, end, own.dtype), symbols[:-1]])


def _bigrams(heads, classed: np.ndarray, late: bool, beyond: bool = False):
    """Counts of symbol pairs. Words beyond the head (`heads`, of which those in `classed` get
    classes) have symbols of their own if any of them may get a class (`late`), else that of their
    shape. Pairs with such a symbol are given if `beyond`, those without if not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(heads.value)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found))
            key = mix(a.view(np.uint64) * np.uint64(_PAIR) + b.view(np.uint64))
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            first, count = order[at], np.diff(np.append(at, len(key)))
            return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(count.astype(np.int64))], ["a", "b", "n"])

        for rows, words in chunks(batches):
            at = lookup(words.hashes)
            own = _SPECIAL + _shape(words)
            if len(classed):
                own = np.where((at >= 0) & classed[np.maximum(at, 0)], at, own)
            if late:
                own = np.where(at < 0, words.hashes.view(np.int64) | _LATE, own)
            symbols, before = _ordered(words, rows.num_rows, own.astype(np.int64), _SPECIAL + _SHAPES)
            if late:
                keep = (((before | symbols) & _LATE) != 0) == beyond
                before, symbols = before[keep], symbols[keep]
            found.append((before, symbols))
            size += len(symbols)
            if size >= _FLUSH:
                yield out()
                found, size = [], 0
        if found:
            yield out()

    return run


def _told(bigrams: DataFrame, late: DataFrame) -> DataFrame:
    """Bigrams in which words of `late` (`symbol, final`) have their final symbols."""
    for side in "ab":
        open_ = F.col(side).bitwiseAND(F.lit(_LATE)) != 0
        named = bigrams.filter(open_).join(late.withColumnRenamed("symbol", side), side).withColumn(side, F.col("final")).select("a", "b", "n")
        bigrams = bigrams.filter(~open_).unionByName(named)
    return bigrams


def _pack(values: np.ndarray) -> bytes:
    """The numbers as differences, byte by byte of their place, compressed."""
    steps = np.diff(values, prepend=0).astype(np.int64)
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


_LISTS = [f"{side}_{x}" for side in ("before", "after") for x in ("w", "near", "n")]
_NEAR = "bucket bigint, " + ", ".join(f"{x} binary" for x in _LISTS)


def _segments(w: np.ndarray, known: np.ndarray, late: int) -> np.ndarray:
    """Segments of the words' neighbours; `late`: those of a word beyond the head."""
    own = (w & _LATE) == 0
    return np.where(own, known[np.where(own, w, 0)], late)


def _dealt(segments, late: int, buckets: int):
    """Packed neighbours of the bigrams `a, b, n`, by bucket of word and segment.

    before: for each symbol those in front of it, with counts; after: those that follow, for words
    that may move. Neighbours beyond the head are left out.
    """

    def lists(w: np.ndarray, near: np.ndarray, n: np.ndarray) -> dict[int, list[bytes]]:
        seg = mix(near.astype(np.uint64)) % _segments(w, segments.value, late).astype(np.uint64)
        bucket = mix(w.view(np.uint64) * np.uint64(_PAIR) + seg) % np.uint64(buckets)
        # the order within a bucket only helps to compress
        order = np.argsort((bucket << np.uint64(38)) | ((w.view(np.uint64) & np.uint64((1 << 17) - 1)) << np.uint64(21)) | near.view(np.uint64))
        bucket, w, near, n = bucket[order].astype(np.int64), w[order], near[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(bucket))
        return {int(bucket[i]): [_pack(x[i:j]) for x in (w, near, n)] for i, j in zip(at, ends)}

    def out(found: list[list[np.ndarray]]) -> pa.RecordBatch:
        a, b, n = (np.concatenate(x) for x in zip(*found))
        known = (a & _LATE) == 0
        before = lists(b[known], a[known], n[known])
        known = ((b & _LATE) == 0) & ((a < _SPECIAL) | ((a & _LATE) != 0))
        after = lists(a[known], b[known], n[known])
        both = sorted(before.keys() | after.keys())
        empty = [None] * 3
        columns = zip(*[before.get(x, empty) + after.get(x, empty) for x in both])
        return pa.RecordBatch.from_arrays([pa.array(both, pa.int64()), *[pa.array(x, pa.binary()) for x in columns]], ["bucket", *_LISTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, _DEAL):
                part = batch.slice(i, _DEAL)
                found.append([part.column(x).to_numpy() for x in range(3)])
                size += part.num_rows
                if size >= _DEAL:
                    yield out(found)
                    found, size = [], 0
        if size:
            yield out(found)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """The lists of one bucket as one: words in order, each neighbour once."""
    columns = []
    for side in ("before", "after"):
        parts = [[_unpack(x) for x in table.column(f"{side}_{y}").drop_null().to_pylist()] for y in ("w", "near", "n")]
        w, near, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)
        order = np.lexsort((near, w))
        w, near, n = w[order], near[order], n[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (near[1:] != near[:-1])
        at = np.flatnonzero(new)
        columns += [w[at], near[at], np.add.reduceat(n, at) if len(at) else n]
    return pa.table([table.column("bucket").slice(0, 1), *[pa.array([_pack(x)], pa.binary()) for x in columns]], ["bucket", *_LISTS])


class Near(NamedTuple):
    """Neighbours of words."""

    packed: DataFrame  # those of the head, shapes and ends, as lists
    late: DataFrame | None  # those beyond the head: `w, side, near, n`
    segments: object  # broadcast: segments of each symbol of the head, shapes and the end


class Classes(NamedTuple):
    """The class of every symbol."""

    front: np.ndarray  # of the head, shapes and the end
    late: DataFrame | None  # of words beyond the head: `symbol, c`
    pair: np.ndarray  # [c, c2]: how often a symbol of class c precedes one of c2


def _sparse(table: np.ndarray, first: np.ndarray, names: list[str]) -> pa.RecordBatch:
    i, j = np.nonzero(table)
    return pa.RecordBatch.from_arrays([pa.array(first[i]), pa.array(j.astype(np.int32)), pa.array(table[i, j].astype(np.int64))], names)


def _blobs(batches: Iterator[pa.RecordBatch], side: str) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for row in zip(*[batch.column(f"{side}_{x}").to_pylist() for x in ("w", "near", "n")]):
            yield [_unpack(x) for x in row]


def _count_pairs(front, span: int):
    """`ca, cb, n` of packed lists whose words are all in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = front.value
        pair = np.zeros(span * span)
        for w, near, n in _blobs(batches, "before"):
            pair += np.bincount(of[near] * span + of[w], n, minlength=span * span)
        yield _sparse(pair.reshape(span, span), np.arange(span), ["ca", "cb", "n"])

    return run


def _profiles(row: list[np.ndarray], of: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of both lists, some at a time, and how often they follow and precede each class."""
    w, near, n, w2, near2, n2 = row
    words = np.union1d(w, w2)
    for i in range(0, len(words), _WORDS):
        some = words[i : i + _WORDS]
        x, y = (slice(np.searchsorted(v, some[0]), np.searchsorted(v, some[-1], "right")) for v in (w, w2))
        at = np.searchsorted(some, np.concatenate([w[x], w2[y]]))
        c = np.concatenate([of[near[x]], of[near2[y]] + span])
        counts = np.bincount(at * (2 * span) + c, np.concatenate([n[x], n2[y]]), minlength=len(some) * 2 * span)
        yield some, counts.reshape(len(some), 2 * span)


def _rows(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    for row in zip(*[batch.column(x).to_pylist() for x in _LISTS]):
        yield [_unpack(x) for x in row]


def _near_classes(front, span: int):
    """`w, c, n`: how often words follow (c) and precede (span + c) classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                for words, near in _profiles(row, front.value, span):
                    yield _sparse(near, words, ["w", "c", "n"])

    return run


def _move(near: np.ndarray, of: np.ndarray, log_next: np.ndarray, total: np.ndarray, classes: int) -> np.ndarray:
    """New classes of words, from how often they follow and precede each class."""
    span = len(log_next)
    after, ahead = near[:, :span], near[:, span:]
    count = after.sum(axis=1)
    score = after @ log_next[:, :classes] + ahead @ log_next[:classes].T
    inside = of[:, None] == np.arange(classes)
    score -= count[:, None] * np.log(np.maximum(total[:classes] + np.where(inside, 0, count[:, None]), 1))
    return score.argmax(axis=1).astype(np.int32)


def _move_whole(front, segments, log_next: np.ndarray, total: np.ndarray, classes: int):
    """`w, c, n`: new classes (n null) of words of one segment, counts as in `_near_classes` of others."""
    span = len(log_next)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts = front.value, segments.value
        for batch in batches:
            for row in _rows(batch):
                for words, near in _profiles(row, of, span):
                    move = of[words] < classes
                    words, near = words[move], near[move]
                    whole = parts[words] == 1
                    yield _sparse(near[~whole], words[~whole], ["w", "c", "n"])
                    words = words[whole]
                    c = _move(near[whole], of[words], log_next, total, classes)
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(c), pa.nulls(len(c), pa.int64())], ["w", "c", "n"])

    return run


def _moved(log_next: np.ndarray, total: np.ndarray, classes: int):
    """`symbol, c` of a block of words from their rows `w, own, c, n`."""
    span = len(log_next)

    def run(table: pa.Table) -> pa.Table:
        symbol, own, c, n = (table.column(x).to_numpy() for x in ("w", "own", "c", "n"))
        words, at = np.unique(symbol, return_inverse=True)
        near = np.bincount(at * (2 * span) + c, n, minlength=len(words) * 2 * span).reshape(len(words), 2 * span)
        of = np.zeros(len(words), np.int64)
        of[at] = own
        return pa.table({"symbol": words, "c": _move(near, of, log_next, total, classes)})

    return run


def _matrix(rows: DataFrame, span: int) -> np.ndarray:
    rows = rows.groupBy("ca", "cb").agg(F.sum("n").alias("n")).toArrow()
    pair = np.zeros((span, span))
    pair[rows["ca"].to_numpy(), rows["cb"].to_numpy()] = rows["n"].to_numpy()
    return pair


def _likelihood(pair: np.ndarray) -> float:
    """What the classes add to the log likelihood of the bigrams."""

    def entropy(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1))).sum())

    return entropy(pair) - entropy(pair.sum(axis=0)) - entropy(pair.sum(axis=1))


def _counted_near(near: Near, front: np.ndarray, late: DataFrame, span: int) -> DataFrame:
    """`w, own, c, n` of all words where some are beyond the head; written."""
    spark = near.packed.sparkSession
    counts = near.packed.mapInArrow(_near_classes(spark.sparkContext.broadcast(front), span), "w bigint, c int, n bigint")
    named = late.select(F.col("symbol").alias("near"), F.col("c"))
    others = near.late.join(named, "near").select("w", (F.col("c") + F.col("side") * span).cast("int").alias("c"), "n")
    counts = counts.unionByName(others).groupBy("w", "c").agg(F.sum("n").alias("n"))
    used = np.flatnonzero(front >= 0)
    own = spark.createDataFrame(pa.table({"symbol": used, "c": front[used].astype(np.int32)})).unionByName(late)
    return written(counts.join(own.toDF("w", "own"), "w").select("w", "own", "c", "n"), "counts")


def exchange_classes(near: Near, front: np.ndarray, late: DataFrame | None, words: int, classes: int, rounds: int) -> Classes:
    """The classes after the rounds, of as many `words`, from those of the head, shapes and the end
    (`front`, by symbol) and of the words beyond the head (`late`: `symbol, c`, or None).

    Shapes and the end have classes of their own and stay. All words move at once, given the classes
    of the round before; the first round that does not raise the likelihood is undone and ends it.
    """
    spark, span = near.packed.sparkSession, classes + _SHAPES + 1
    blocks = max(256, words // _BLOCK)
    block = F.pmod(F.xxhash64("w"), F.lit(blocks)).alias("block")

    def measure(front: np.ndarray, late: DataFrame | None) -> tuple[np.ndarray, DataFrame | None]:
        if late is None:
            run = _count_pairs(spark.sparkContext.broadcast(front), span)
            return _matrix(near.packed.select("before_w", "before_near", "before_n").mapInArrow(released(run), "ca bigint, cb int, n bigint"), span), None
        counts = _counted_near(near, front, late, span)
        return _matrix(counts.filter(F.col("c") < span).select(F.col("c").alias("ca"), F.col("own").alias("cb"), "n"), span), counts

    pair, counts = measure(front, late)
    for turn in range(rounds if words > 1 else 0):
        smooth = pair + 0.1
        log_next = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        if late is None:
            run = _move_whole(spark.sparkContext.broadcast(front), near.segments, log_next, pair.sum(axis=1), classes)
            moves = written(near.packed.mapInArrow(released(run), "w bigint, c int, n bigint"), "moves")
            found = moves.filter("n IS NULL").select(F.col("w").alias("symbol"), "c")
            split = np.flatnonzero(near.segments.value[:_SPECIAL] > 1)
            if len(split):
                own = spark.createDataFrame(pa.table({"w": split, "own": front[split].astype(np.int32)}))
                parts = moves.filter("n IS NOT NULL").groupBy("w", "c").agg(F.sum("n").alias("n")).join(F.broadcast(own), "w")
                parts = parts.select("w", "own", "c", "n").groupBy(block)
                found = found.unionByName(parts.applyInArrow(_moved(log_next, pair.sum(axis=1), classes), "symbol bigint, c int"))
            found = found.toArrow()
            drop_written(moves)
            late_then = None
        else:
            moves = counts.filter(F.col("own") < classes).groupBy(block).applyInArrow(_moved(log_next, pair.sum(axis=1), classes), "symbol bigint, c int")
            moves = written(moves, "moves")
            drop_written(counts)
            found = moves.filter(F.col("symbol").bitwiseAND(F.lit(_LATE)) == 0).toArrow()
            late_then = moves.filter(F.col("symbol").bitwiseAND(F.lit(_LATE)) != 0)
        then = front.copy()
        then[found["symbol"].to_numpy()] = found["c"].to_numpy()
        pair_then, counts = measure(then, late_then)
        rise = _likelihood(pair_then) - _likelihood(pair)
        _LOG.info("round %d: log likelihood rises by %.1f", turn + 1, rise)
        if rise <= 0:
            break
        front, late, pair = then, late_then, pair_then
    if counts is not None:
        drop_written(counts)
    return Classes(front, late, pair)


def _transitions(pair: np.ndarray) -> np.ndarray:
    """log10 P(class | class before)."""
    base = (pair.sum(axis=0) + 1) / (pair.sum() + len(pair))
    return np.log10((pair + PULL * base) / (pair.sum(axis=1, keepdims=True) + PULL))


_SCORED = (
    "row bigint, id bigint, n_tokens bigint, known bigint, base double, model double, tail array<bigint>, "
    "turns array<struct<a: bigint, ca: int, b: bigint, cb: int>>"
)


def _lists(values: pa.Array, doc: np.ndarray, texts: int) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=texts))])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _scores(heads, model, classes: int, late: bool):
    """tail: words beyond the head. turns: if those may have classes (`late`), the bigrams with
    one, with the classes that were taken; a, b are null for words of the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(heads.value)
        counts, of, emit, rare, step, end_count = model.value
        row = TaskContext.get().partitionId() << 33
        for rows, words in chunks(batches):
            texts = rows.num_rows
            at, shape = lookup(words.hashes), _shape(words)
            have, place = at >= 0, np.maximum(at, 0)
            known = len(counts) > 0
            own, before = _ordered(words, texts, np.where(have, of[place], classes + shape) if known else classes + shape, classes + _SHAPES)
            doc = np.repeat(np.arange(texts), np.diff(words.bounds) + 1)
            path = np.bincount(doc, step[before, own], minlength=texts)
            log_count = np.where(have, np.log10(counts[place] + 1.0), 0.0) if known else np.zeros(len(at))
            word = np.where(have, emit[place], -rare[shape]) if known else -rare[shape]
            base = np.bincount(words.doc, log_count, minlength=texts) + np.log10(end_count + 1.0)
            model_part = path + np.bincount(words.doc, word, minlength=texts)
            n_known = np.bincount(words.doc, have, minlength=texts).astype(np.int64) + (end_count > 0)
            tail = ~have
            h = words.hashes.view(np.int64)
            b_open, a_open = _ordered(words, texts, tail & late, False)
            b, a = _ordered(words, texts, h, 0)
            turn = a_open | b_open
            turns = pa.StructArray.from_arrays(
                [
                    pa.array(a[turn], mask=~a_open[turn]),
                    pa.array(before[turn].astype(np.int32)),
                    pa.array(b[turn], mask=~b_open[turn]),
                    pa.array(own[turn].astype(np.int32)),
                ],
                ["a", "ca", "b", "cb"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(texts)),
                    rows.column("id"),
                    pa.array(np.diff(words.bounds) + 1),
                    pa.array(n_known),
                    pa.array(base),
                    pa.array(model_part),
                    _lists(pa.array(h[tail]), words.doc[tail], texts),
                    _lists(turns, doc[turn], texts),
                ],
                ["row", "id", "n_tokens", "known", "base", "model", "tail", "turns"],
            )
            row += texts

    return run


def _turned(scored: DataFrame, late: DataFrame, step: np.ndarray) -> DataFrame:
    """`row, turned`: what the classes of words beyond the head (`word, c`) add to transitions."""
    turns = scored.select("row", F.explode("turns").alias("t")).select("row", "t.*")
    for side, other in ("ab", "ba"):
        # a word of the head gets a key that spreads and finds nothing
        key = F.coalesce(F.col(side), F.xxhash64("row", other))
        known = late.select(F.col("word").alias(f"w{side}"), F.col("c").alias(f"new_{side}"))
        turns = turns.withColumn(f"k{side}", key).join(known, F.col(f"k{side}") == F.col(f"w{side}"), "left")
        turns = turns.withColumn(f"new_{side}", F.when(F.col(side).isNotNull(), F.col(f"new_{side}"))).drop(f"k{side}", f"w{side}")
    turns = turns.filter("new_a IS NOT NULL OR new_b IS NOT NULL")
    turns = turns.select("row", "ca", "cb", F.coalesce("new_a", "ca").alias("na"), F.coalesce("new_b", "cb").alias("nb"))
    i, j = np.indices(step.shape).astype(np.int32)
    table = scored.sparkSession.createDataFrame(pa.table({"i": i.ravel(), "j": j.ravel(), "s": step.ravel()}))
    old, new = (F.broadcast(table.toDF(f"{x}a", f"{x}b", s)) for x, s in (("c", "old"), ("n", "new")))
    turns = turns.join(old, ["ca", "cb"]).join(new, ["na", "nb"])
    return turns.groupBy("row").agg(F.sum(F.col("new") - F.col("old")).alias("turned"))


def class_model_scores(
    docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text",
    head: int = HEAD, clustered: int | None = None, classes: int = CLASSES, rounds: int = ROUNDS, least: int = LEAST,
) -> DataFrame:
    """`id, n_tokens, n_known, train_tokens, base_score, score, perplexity` for every row of `docs`.

    trains: which rows are learned from (null: not). Tokens are the words and one end. base_score:
    log10 probability by single words with one count added (and one word for all unseen); score:
    that of the class model. A null or empty text has one token, its end. Repeated rows count and
    are scored each for itself; ids may repeat or be null. Without training rows every count is
    0. Other columns are read only by `trains`. Words are compared as 64-bit hashes. Words with
    `least` or more occurrences get classes by exchange; where `clustered` is given, only that
    many of them, the most frequent (at most `head`). The result does not depend on `head`, the
    number of words that every task holds (at most 2 ** 20).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    training = rows.filter("trains").select("text")
    words = written(vocabulary(training), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = words.filter("shape = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not ends:  # the end row of an empty table has no count
        v = words.filter("shape >= 0").count()
    top = words.filter((F.col("shape") >= 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "word").limit(head).toArrow()
    hashes = top["word"].to_numpy().view(np.uint64)
    counts = top["n"].to_numpy().astype(np.float64)
    classed = np.arange(len(counts)) < (len(counts) if clustered is None else clustered)
    late = clustered is None and len(counts) == head  # words beyond the head may get classes
    heads = spark.sparkContext.broadcast(hashes)


    def among_first(k: int) -> Column:
        if k <= 0 or not len(counts):
            return F.lit(False)
        least_n, last = int(counts[min(k, len(counts)) - 1]), int(hashes.view(np.int64)[min(k, len(counts)) - 1])
        return (F.col("n") > least_n) | ((F.col("n") == least_n) & (F.col("word") <= last))

    in_head, to_class = among_first(head), among_first(int(classed.sum()))
    named = words.filter("shape >= 0").select(
        "word", "shape", "n", (~in_head).alias("beyond"), F.col("word").bitwiseOR(F.lit(_LATE)).alias("symbol"),
        F.when(in_head, to_class).otherwise(F.lit(late) & (F.col("n") >= least)).alias("classed"),
    )
    mass = np.ones(_SHAPES)
    seen = np.zeros(_SHAPES)
    for shape, tokens, kinds in named.filter("NOT classed").groupBy("shape").agg(F.sum("n"), F.count(F.lit(1))).collect():
        mass[shape] += tokens + kinds
        seen[shape] += tokens

    front = np.full(_SPECIAL + _SHAPES + 1, -1, np.int64)
    ranked = np.flatnonzero(classed)
    front[ranked] = np.mod(hashes.view(np.int64)[ranked], classes)
    front[_SPECIAL:] = classes + np.arange(_SHAPES + 1)
    occurs = np.zeros(len(front))
    occurs[: len(counts)] = counts
    occurs[_SPECIAL:] = np.append(seen, ends)
    segments = spark.sparkContext.broadcast(np.maximum(np.ceil(occurs / _SEGMENT), 1).astype(np.int64))
    late_segments = max(1, int(np.ceil(counts[-1] / _SEGMENT))) if late else 1
    buckets = min(1 << 26, max(32, 2 * int(n) // _BUCKET))
    deal, count = _dealt(segments, late_segments, buckets), _bigrams(heads, classed, late)

    def count_and_deal(batches):
        yield from deal(count(batches))

    dealt = training.mapInArrow(released(count_and_deal), _NEAR)
    later, late_near, late_words = None, None, 0
    if late:
        others = named.filter("beyond AND classed")
        later = written(others.select("symbol", F.pmod("word", F.lit(classes)).cast("int").alias("c")), "start")
        late_words = later.count()
        bigrams = training.mapInArrow(released(_bigrams(heads, classed, late, beyond=True)), "a bigint, b bigint, n bigint")
        bigrams = written(bigrams.groupBy("a", "b").agg(F.sum("n").alias("n")), "bigrams")
        final = F.when(F.col("classed"), F.col("symbol")).otherwise(F.col("shape") + F.lit(_SPECIAL)).cast("bigint")
        told = _told(bigrams, written(named.filter("beyond").select("symbol", final.alias("final")), "symbols"))
        told = written(told.groupBy("a", "b").agg(F.sum("n").alias("n")), "bigrams")
        drop_written(bigrams)
        open_a, open_b = (F.col(x).bitwiseAND(F.lit(_LATE)) != 0 for x in "ab")
        in_front = told.filter(open_a).select(F.col("b").alias("w"), F.lit(0).alias("side"), F.col("a").alias("near"), "n")
        behind = told.filter(open_b).select(F.col("a").alias("w"), F.lit(1).alias("side"), F.col("b").alias("near"), "n")
        late_near = in_front.unionByName(behind)
        dealt = dealt.unionByName(told.mapInArrow(released(deal), _NEAR))
    packed = written(dealt.groupBy("bucket").applyInArrow(released(_merged), _NEAR), "near")
    of = exchange_classes(Near(packed, late_near, segments), front, later, len(ranked) + late_words, classes, rounds)
    drop_written(packed)
    if late:
        placed = written(others.select("symbol", "word", "n").join(of.late, "symbol"), "placed")
        drop_written(told)
    step = _transitions(of.pair)
    in_class = np.bincount(of.front[ranked], counts[ranked], minlength=classes)
    if late:
        for c, tokens in placed.groupBy("c").agg(F.sum("n")).collect():
            in_class[c] += tokens
    in_class = np.maximum(in_class, 1)
    rare = np.log10(mass)
    own = classes + top["shape"].to_numpy().astype(np.int64)
    emit = np.log10(counts + 1) - rare[own - classes]
    own[ranked] = of.front[ranked]
    emit[ranked] = np.log10(counts[ranked] / in_class[own[ranked]])
    model = spark.sparkContext.broadcast((counts, own, emit, rare, step, float(ends)))

    scored = written(rows.select("id", "text").mapInArrow(_scores(heads, model, classes, late), _SCORED), "scored")
    # counts and classes of the other words; those never seen add nothing
    others = named.filter("beyond").select("word", "shape", "n")
    added = F.log10(F.col("n") + 1)
    if late:
        later = placed.select("word", "c")
        others = written(others.join(later, "word", "left"), "others")
        table = [F.array(*[F.lit(float(x)) for x in values]) for values in (rare, np.log10(in_class))]
        in_model = F.coalesce(F.log10("n") + F.get(table[0], F.col("shape")) - F.get(table[1], F.col("c")), added)
    else:
        in_model = added
    tail = scored.select("row", F.explode("tail").alias("word")).join(others, "word")
    tail = tail.groupBy("row").agg(F.sum(added).alias("more"), F.sum(in_model).alias("more_model"), F.count(F.lit(1)).alias("seen"))
    out = scored.drop("tail", "turns").join(tail, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    score = F.col("model") + F.coalesce("more_model", F.lit(0.0))
    if late:
        out = out.join(_turned(scored, later, step), "row", "left")
        score = score + F.coalesce("turned", F.lit(0.0))
    return out.select(
        "id",
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
