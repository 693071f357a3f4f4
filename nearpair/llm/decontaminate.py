"""Finds benchmark items in documents by latent semantic retrieval.

Terms are the words of the benchmark (lower-cased runs without ASCII punctuation); a document is
encoded once as the places and numbers of its terms. Passages are cells of CELL words. Their
document frequencies over the whole corpus give idf weights; very common terms weigh nothing,
except those an item has too few rarer ones of. A randomised SVD of the passages' TF-IDF matrix,
with one power step, gives the latent space: each pass sums A'(A X) over all cells on Spark. The
rows of A are the corpus' cells and the items, the items weighed so that both halves have the
same mass.

Search: items are grouped by length, in powers of two, and every window of as many cells as the
longest of a group may stretch over is compared with the group's items in the latent space, by how
much of the item's vector it covers: whatever else is in the window takes nothing from that. A window
above the threshold is only a candidate: the longest common subsequence of the item and the words around the window decides, and where it is too short for a copy but long enough for a
paraphrase, the item's answer must be there as well.

The benchmark is worked through in blocks of a bounded number of items and terms. A space of fewer
dimensions than items blurs them and makes thousands of times as many candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpair.llm.brown import Lookup
from nearpair.llm.memory import released
from nearpair.llm.tables import column, without, written
from nearpair.llm.words import LETTERS, chunks, text_buffer, words_of

CELL = 32  # words
RANK = 256
OVERSAMPLE = 16
BLOCK_ITEMS = 200  # fewer than the rank, so that the space can tell a block's items apart
BLOCK_TERMS = 1 << 14  # words of the items in a block, about
COSINE = 0.2  # of a candidate's window with the item, times the window's length over the item's
COVERED = 0.45  # least share of the item's own length that the window has in its direction
COPY = 0.75  # least share of the item's words in order: a copy
PARAPHRASE = 0.55  # the same with the answer there
ANSWER = 0.75  # least share of the answer's words in order
LEAST_WORDS = 8  # an item with fewer must be there whole
COMMON = 0.003  # share of the cells from which a term is common
RARE_TERMS = 6  # an item's rarest terms are never common
FAN = 64  # partial sums added up at once
_STEP = 1 << 13  # term places worked on at once


class Items(NamedTuple):
    ids: list
    words: list[np.ndarray]  # term numbers, in order
    answers: list[np.ndarray]
    terms: np.ndarray  # hashes


def read_items(rows: list) -> Items:
    """Rows of `item_id, text, answer`; items without words are left out. Without an answer, it
    is the last quarter of the item, three words at least."""
    texts = pa.array([x for r in rows for x in (r["text"], r["answer"])], pa.string())
    found = words_of(*text_buffer(texts), LETTERS)
    terms, number = np.unique(found.hashes, return_inverse=True)
    ids, words, answers = [], [], []
    for i, r in enumerate(rows):
        a, b, c = found.bounds[2 * i : 2 * i + 3]
        if b > a:
            ids.append(r["item_id"])
            words.append(number[a:b])
            answers.append(number[b:c] if c > b else number[max(a, b - max(3, (b - a) // 4)) : b])
    return Items(ids, words, answers, terms)


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value, 18)
        for rows, words in chunks(batches, ends_word=LETTERS):
            term = lookup(words.hashes)
            keep = term >= 0
            place = (np.arange(len(term)) - words.bounds[words.doc])[keep].astype("<i4")
            term = term[keep].astype("<i4")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(words.doc[keep], minlength=rows.num_rows))])
            columns = [[x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])] for x in (place, term)]
            out = pa.RecordBatch.from_arrays([rows.column("id"), *(pa.array(c, pa.binary()) for c in columns)], ["id", "place", "term"])
            yield out.filter(pa.array(np.diff(bounds) > 0))

    return run


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Ids, document, place and term of the term places of whole documents, about _STEP at once."""
    for batch in batches:
        ids = batch.column("id").to_pylist()
        places, terms = batch.column("place"), batch.column("term")
        a, size = 0, 0
        for i in range(len(ids)):
            size += len(terms[i].as_buffer()) // 4
            if size >= _STEP or i == len(ids) - 1:
                raw = [x.slice(a, i + 1 - a).to_pylist() for x in (places, terms)]
                doc = np.repeat(np.arange(i + 1 - a), [len(x) // 4 for x in raw[1]])
                place, term = (np.frombuffer(b"".join(x), "<i4") for x in raw)
                yield ids[a : i + 1], doc, place, term
                a, size = i + 1, 0


def _cells(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each cell begins among the term places, its document and number."""
    cell = place // CELL
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])
    at = np.flatnonzero(new)
    return at, doc[at], cell[at]


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)  # last: cells
        for _, doc, place, term in _steps(batches):
            at, _, _ = _cells(doc, place)
            cell = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(doc))))
            df[:-1] += np.bincount(np.unique(cell * size + term) % size, minlength=size)
            df[-1] += len(at)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "n"])

    return run


def term_weights(items: Items, df: np.ndarray, cells: int) -> np.ndarray:
    """idf of each term, 0 for common ones that are not among an item's rarest."""
    keep = df <= COMMON * cells
    for words in items.words:
        distinct = np.unique(words)
        keep[distinct[np.argsort(df[distinct], kind="stable")[:RARE_TERMS]]] = True
    return np.where(keep, np.log((cells + 1.0) / (df + 1.0)) + 0.1, 0).astype(np.float32)


def _vectors(weights: np.ndarray, basis: np.ndarray, term: np.ndarray, at: np.ndarray) -> np.ndarray:
    """basis' of each cell's TF-IDF row; `at` says where its terms begin."""
    return np.add.reduceat(weights[term][:, None] * basis[term], at, axis=0)


def _products(shared):
    """Sums A'(A X) over the cells of a task, in slices of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis = shared.value
        total, mass = np.zeros(basis.shape, np.float32), 0
        for _, doc, place, term in _steps(batches):
            keep = weights[term] > 0
            doc, place, term = doc[keep], place[keep], term[keep]
            if not len(term):
                continue
            at, _, _ = _cells(doc, place)
            norm = np.add.reduceat(weights[term] ** 2, at)
            rows = _vectors(weights, basis, term, at) / norm[:, None]
            cell = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(term))))
            order = np.argsort(term, kind="stable")
            back = rows[cell[order]] * weights[term[order]][:, None]
            first = np.flatnonzero(np.concatenate([[True], term[order][1:] != term[order][:-1]]))
            total[term[order][first]] += np.add.reduceat(back, first, axis=0)
            mass += len(at)
        some = [a for a in range(0, len(total), 1024) if total[a : a + 1024].any()]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *some], pa.int64()),
                pa.array([part] * (len(some) + 1), pa.int64()),
                pa.array([np.array([mass], np.float32).tobytes(), *(total[a : a + 1024].tobytes() for a in some)], pa.binary()),
            ],
            ["slice", "part", "x"],
        )

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = 0
    for x in table["x"].to_pylist():
        total = total + np.frombuffer(x, np.float32).astype(np.float64)
    return pa.table({"slice": table["slice"][:1], "part": table["part"][:1], "x": [total.astype(np.float32).tobytes()]})


_PART = "slice bigint, part bigint, x binary"


def _normal(encoded: DataFrame, items: Items, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis), the corpus' part by Spark."""
    shared = encoded.sparkSession.sparkContext.broadcast((weights, basis.astype(np.float32)))
    tasks = encoded.rdd.getNumPartitions()
    parts = encoded.select("id", "place", "term").mapInArrow(released(_products(shared)), _PART)
    while tasks > 1:  # a tree: no group sums more than FAN parts
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("part", F.expr(f"part div {FAN}")).groupBy("slice", "part").applyInArrow(_summed, _PART)
    total, mass = np.zeros(basis.shape), 0.0
    for r in parts.collect():
        x = np.frombuffer(r["x"], np.float32).astype(np.float64)
        if r["slice"] < 0:
            mass = x[0]
        else:
            total[r["slice"] : r["slice"] + 1024] = x.reshape(-1, basis.shape[1])
    shared.destroy()
    each = max(1.0, mass / len(items.ids))
    for words in items.words:
        row = weights[words]
        if row.any():
            np.add.at(total, words, each / (row**2).sum() * np.outer(row, row @ basis[words]))
    return total


def latent_space(encoded: DataFrame, items: Items, weights: np.ndarray, rank: int) -> np.ndarray:
    """The right singular vectors (terms x rank) of the passages' TF-IDF matrix."""
    width = min(len(items.terms), rank + OVERSAMPLE)
    start = np.random.default_rng(7).standard_normal((len(items.terms), width))
    q, _ = np.linalg.qr(_normal(encoded, items, weights, start))
    product = _normal(encoded, items, weights, q)
    values, turn = np.linalg.eigh(q.T @ product)
    return (q @ turn[:, ::-1][:, :rank]).astype(np.float32)


def subsequence(masks: dict[int, int], text: list[int]) -> int:
    """Length of the longest common subsequence; masks: the places of each word in the item."""
    v = -1
    for x in text:
        m = masks.get(x)
        if m is not None:
            u = v & m
            v = (v + u) | (v - u)
    return v


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _length(masks: dict[int, int], size: int, text: list[int]) -> int:
    return size - (subsequence(masks, text) & ((1 << size) - 1)).bit_count()


class Judge:
    """Decides whether an item is in the words around a place."""

    def __init__(self, items: Items, copy: float, paraphrase: float, answer: float) -> None:
        self.items, self.limits = items, (copy, paraphrase, answer)
        self.masks = [_masks(w) for w in items.words]
        self.answers = [_masks(w) for w in items.answers]

    def __call__(self, item: int, place: np.ndarray, term: np.ndarray, first: int, last: int) -> tuple[bool, float, float, float]:
        """Found, and the best shares of item and answer, looking at places first..last - 1 in
        stretches half again as long as the item; with the place where the best begins."""
        size = len(self.items.words[item])
        span = size + size // 2 + 2
        best = (False, 0.0, 0.0, float(first))
        a, b = np.searchsorted(place, (first, last))
        # no stretch has more than all of them
        if b - a < self.limits[1] * size * 0.999 or _length(self.masks[item], size, term[a:b].tolist()) < self.limits[1] * size * 0.999:
            return best
        for begin in range(first, max(first + 1, last - span + size // 2 + 1), max(1, size // 4)):
            a, b = np.searchsorted(place, (begin, begin + span))
            text = term[a:b].tolist()
            if len(text) < self.limits[1] * size * 0.999:
                continue
            share = _length(self.masks[item], size, text) / size
            if share < self.limits[1]:
                continue
            count = len(self.items.answers[item])
            answer = _length(self.answers[item], count, text) / count
            full = share >= self.limits[0] or answer >= self.limits[2]
            found = share == 1 if size < LEAST_WORDS else full
            best = max(best, (found, share, answer, float(begin)))
        return best


def _search(shared, limits: tuple, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, basis = shared.value
        judge = Judge(items, *limits)
        target = np.stack([weights[w] @ basis[w] for w in items.words])
        size = np.maximum(np.linalg.norm(target, axis=1, keepdims=True), 1e-9)
        target /= size
        least = max(COVERED, cosine) * size[:, 0]
        stretch = [len(w) + len(w) // 2 + 2 for w in items.words]
        groups = []  # items and cells of their windows; a stretch that begins in the first fits
        for power in sorted({len(w).bit_length() for w in items.words}):
            members = np.flatnonzero([len(w).bit_length() == power for w in items.words])
            groups.append((members, -(-max(stretch[i] for i in members) // CELL) + 1))
        for ids, doc, place, term in _steps(batches):
            out: dict[tuple, tuple] = {}
            starts = np.searchsorted(doc, np.arange(len(ids) + 1))
            keep = np.flatnonzero(weights[term] > 0)
            if not len(keep):
                continue
            at, cell_doc, cell = _cells(doc[keep], place[keep])
            sums = np.zeros((len(at) + 1, basis.shape[1]))
            np.cumsum(_vectors(weights, basis, term[keep], at), axis=0, out=sums[1:])
            code = cell_doc * (int(cell.max()) + max(width for _, width in groups) + 1) + cell
            for members, width in groups:
                window = (sums[np.searchsorted(code, code + width)] - sums[:-1]).astype(np.float32)
                near = window @ target[members].T
                for w, m in zip(*np.nonzero(near >= least[members])):
                    d, item = int(cell_doc[w]), int(members[m])
                    if out.get((d, item), (0.0,))[0] == 1:
                        continue
                    mine = slice(starts[d], starts[d + 1])
                    low = int(cell[w]) * CELL
                    found = judge(item, place[mine], term[mine], max(0, low - stretch[item]), low + CELL + stretch[item])
                    if found[0]:
                        angle = float(near[w, m] / max(np.linalg.norm(window[w]), 1e-9))
                        out[d, item] = max(out.get((d, item), (0.0,)), (*found[1:], angle))
            if out:
                rows = [(ids[d], items.ids[i], len(items.words[i]), *v) for (d, i), v in out.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "item_id", "item_words", "share", "answer_share", "place", "cosine"])

    return run


_FOUND = "id bigint, item_id bigint, item_words bigint, share double, answer_share double, place double, cosine double"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None,
    rank: int = RANK, cosine: float = COSINE, copy: float = COPY, paraphrase: float = PARAPHRASE, answer: float = ANSWER,
) -> DataFrame:
    """`id, item_id, item_words, share, answer_share, place, cosine` of each item found in a document.

    share: the item's words found in order in a stretch of the document half again as long, best
    stretch; place: the word it begins at, about; answer_share: the same for the item's answer
    (`answer_col`, else its last quarter). Found is share >= copy, or share >= paraphrase and
    answer_share >= answer; an item of fewer than LEAST_WORDS words must be there whole. Texts and
    items without words, and null items, match nothing; an empty benchmark finds nothing. Rows of
    one id are one document, of which the best is returned. Other columns are not read.
    """
    rows = docs.select(column(id_col).cast("bigint").alias("id"), F.lower(column(text_col).cast("string")).alias("text"))
    given = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.lower(F.col(item_text).cast("string")).alias("text"), F.lower(given).alias("answer"))
    items = items.filter("text IS NOT NULL")
    number, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(math.ceil(size / 6 / BLOCK_TERMS), math.ceil(number / BLOCK_ITEMS), 1)
    if blocks > 1:  # dealt by hash: leave room for uneven blocks
        blocks = math.ceil(1.3 * blocks)
    parts = [_found_in_block(rows, items, i, blocks, rank, cosine, (copy, paraphrase, answer)) for i in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.max_by(F.struct("item_words", "share", "answer_share", "place", "cosine"), F.struct("share", "answer_share", "cosine"))
    return found.groupBy("id", "item_id").agg(best.alias("best")).select("id", "item_id", "best.*")


def _found_in_block(rows: DataFrame, items: DataFrame, block: int, blocks: int, rank: int, cosine: float, limits: tuple) -> DataFrame:
    spark = rows.sparkSession
    chosen = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
    known = read_items(chosen)
    if not known.ids:
        return spark.createDataFrame([], _FOUND)
    terms = spark.sparkContext.broadcast(known.terms)
    encoded = written(rows.mapInArrow(released(_encode(terms)), "id bigint, place binary, term binary"), "encoded")
    counts = encoded.mapInArrow(released(_frequencies(len(known.terms))), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()
    df = np.zeros(len(known.terms) + 1, np.int64)
    for term, n in counts:
        df[term] = n
    weights = term_weights(known, df[:-1], int(df[-1]))
    basis = latent_space(encoded, known, weights, rank)
    shared = spark.sparkContext.broadcast((known, weights, basis))
    return written(encoded.mapInArrow(released(_search(shared, limits, cosine)), _FOUND), "found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` in which no item of the benchmark was found, with their columns. Rows
    with a null id go only if an item is in one of them."""
    found = contaminated(docs, benchmark, id_col, **options).select("id")
    kept = without(docs, id_col, found.filter("id IS NOT NULL"))
    if found.filter("id IS NULL").isEmpty():
        return kept
    return kept.filter(column(id_col).isNotNull())
