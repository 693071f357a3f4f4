"""Token ids of documents as patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id, encoded, and stored as segments of whole
documents. A segment's payload, all little-endian:

    b"PFR1", u4 block size, u4 ids, u4 blocks
    per block: u4 minimum, u1 width, u2 exceptions; then u4 start of each block, one more at the end
    per block: ids minus minimum, low `width` bits, least bit first; exceptions' places as u2 and
    their remaining high bits as u4

The width holds a percentile of a block's values; what does not fit is an exception. Block
starts are the index: any block decodes alone. Segments are rows of a Parquet table, written by
Spark's committer, with the documents they hold and their starts.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearpair.llm.memory import give_back, released
from nearpair.llm.tables import written

BLOCK = 256  # ids in a block
SEGMENT = 1 << 18  # ids in a segment, about; a longer document is a segment of its own
PERCENTILE = 90
CACHED = 200_000  # words in each of the two halves of the cache
TOGETHER = 1 << 22  # bytes of texts whose words are looked up together, about
_ID = struct.Struct("<I")
_HEAD = b"PFR1"
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of rows of values, as rows of bytes; eight values make `width` bytes."""
    eights = (values & np.uint32((1 << width) - 1)).reshape(-1, 8).astype(np.uint64)
    words = np.zeros((len(eights), 5), "<u8")
    for i in range(8):
        k, shift = divmod(i * width, 64)
        words[:, k] |= eights[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, k + 1] |= eights[:, i] >> np.uint64(64 - shift)
    return words.view(np.uint8)[:, :width].reshape(len(values), -1)


def _unpacked(packed: np.ndarray, width: int) -> np.ndarray:
    raw = np.zeros((packed.size // width, 40), np.uint8)
    raw[:, :width] = packed.reshape(-1, width)
    words = raw.view("<u8")
    out = np.empty((len(raw), 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(8):
        k, shift = divmod(i * width, 64)
        value = words[:, k] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, k + 1] << np.uint64(64 - shift)
        out[:, i] = value & mask
    return out.reshape(len(packed), -1)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """The payload of the ids; `block` is a multiple of 8."""
    n = len(ids)
    blocks = -(-n // block)
    values = np.zeros(blocks * block, np.uint32)
    values[:n] = ids
    if n:
        values[n:] = values[n - 1]
    values = values.reshape(blocks, block)
    low = values.min(axis=1) if blocks else np.zeros(0, np.uint32)
    values = values - low[:, None]
    at = min(block - 1, block * percentile // 100)
    chosen = np.partition(values, at, axis=1)[:, at] if blocks else low
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    high = values >> width.astype(np.uint32)[:, None] if blocks else values
    high = np.where(width[:, None] >= 32, 0, high).astype(np.uint32)
    row, place = np.nonzero(high)
    exceptions = np.bincount(row, minlength=blocks).astype("<u2")
    size = block * width.astype(np.int64) // 8
    starts = np.concatenate([[0], np.cumsum(size + 6 * exceptions.astype(np.int64))])
    parts = [b""] * blocks
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        for b, row_bytes in zip(rows.tolist(), _packed(values[rows], int(w))):
            parts[b] = row_bytes.tobytes()
    first = np.concatenate([[0], np.cumsum(exceptions.astype(np.int64))])
    for b in np.flatnonzero(exceptions):
        span = slice(first[b], first[b + 1])
        parts[b] += place[span].astype("<u2").tobytes() + high[b, place[span]].astype("<u4").tobytes()
    head = _HEAD + struct.pack("<III", block, n, blocks)
    return b"".join([head, low.astype("<u4").tobytes(), width.tobytes(), exceptions.tobytes(), starts.astype("<u4").tobytes(), *parts])


class Blocks:
    """Reads a payload, whole or by blocks."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != _HEAD:
            raise ValueError("not a payload of token ids")
        self.block, self.n, blocks = struct.unpack_from("<III", payload, 4)
        at = 16
        self.low = np.frombuffer(payload, "<u4", blocks, at)
        self.width = np.frombuffer(payload, "u1", blocks, at + 4 * blocks)
        self.exceptions = np.frombuffer(payload, "<u2", blocks, at + 5 * blocks)
        self.starts = np.frombuffer(payload, "<u4", blocks + 1, at + 7 * blocks).astype(np.int64)
        self.data = np.frombuffer(payload, np.uint8, offset=at + 11 * blocks + 4)

    def read(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of the blocks first..last - 1."""
        last = len(self.low) if last is None else last
        width, starts = self.width[first:last], self.starts[first:last]
        out = np.zeros((last - first, self.block), np.uint32)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                size = self.block * int(w) // 8
                packed = np.stack([self.data[a : a + size] for a in starts[rows].tolist()])
                out[rows] = _unpacked(packed, int(w))
        for i in np.flatnonzero(self.exceptions[first:last]):
            k = int(self.exceptions[first + i])
            end = int(self.starts[first + i + 1])
            place = np.frombuffer(self.data[end - 6 * k : end - 4 * k].tobytes(), "<u2")
            high = np.frombuffer(self.data[end - 4 * k : end].tobytes(), "<u4")
            out[i, place] |= high << np.uint32(width[i])
        out += self.low[first:last, None]
        return out.ravel()[: self.n - first * self.block]


class _Cache(dict):
    """Ids of words as bytes. A full young half becomes the old one, and what the old one is
    asked for comes back, so frequent words stay. A word that `cut` parts takes a place once its
    body is known: most others are not seen again."""

    def __init__(self, ask: Callable[[str], bytes], cut: Callable[[str], int] = len) -> None:
        self.ask, self.cut, self.old = ask, cut, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word) or self.ask(word)
        self[word] = found
        return found

    def all(self, words: list[str]) -> list[bytes]:
        found, old = list(map(self.get, words)), self.old
        for i, word in enumerate(words):
            if found[i] is not None:
                continue
            ids = old.get(word)
            if ids is None and not word.isalpha() and (at := self.cut(word)) < len(word):
                body = word[:at]
                known = body in self or body in old
                found[i] = self[body] + self[word[at:]]
                if known:
                    self[word] = found[i]
                continue
            if ids is None:
                ids = self.ask(word)
            self[word] = found[i] = ids
        return found

    def trim(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Encodes texts word by word through a cache, by a tokenizer that leaves nothing of white
    space and never joins across it; with by_word=False whole texts, by any tokenizer.

    Texts in Latin-1 are lower-cased first if the tokenizer does so itself (there, both agree).
    A new word of theirs is taken without its trailing punctuation, and if it has letters only,
    straight to the tokenizer's BPE model where that gives what the whole tokenizer does: a word
    of letters is one piece, without anything to normalise.
    """

    def __init__(self, path: str, by_word: bool = True, cached: int = CACHED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word, self.cached = by_word, cached
        self.special = {x.content[:2] for x in self.tokenizer.get_added_tokens_decoder().values()}
        self.packed = [_ID.pack(i) for i in range(max(self.tokenizer.get_vocab().values(), default=0) + 1)]
        one, other, *probes = self._ids(["aB c,", "ab c,", *_PROBES])
        self.lowers = by_word and one == other
        self.direct = probes == [self._letters(w) for w in _PROBES]
        self.plain, self.other = _Cache(self._ask_plain, _body), _Cache(self._ask)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_byte_letters())
        packed = self.packed
        return b"".join([packed[x.id] for x in self.model.tokenize(word)])

    def _ask(self, word: str) -> bytes:
        return self._ids([word])[0]

    def _ask_plain(self, word: str) -> bytes:
        return self._letters(word) if self.direct and word.isalpha() else self._ids([word])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return self._ids(texts)
        plain = [self.lowers and _latin(t) and not any(x in t for x in self.special) for t in texts]
        found = {
            True: iter(self._words([t.lower() for t, p in zip(texts, plain) if p], self.plain)),
            False: iter(self._words([t for t, p in zip(texts, plain) if not p], self.other)),
        }
        return [next(found[p]) for p in plain]

    def _words(self, texts: list[str], cache: _Cache) -> list[bytes]:
        """The cache is asked for each different word of the texts once."""
        if not texts:
            return []
        rows = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
        words = rows.flatten().dictionary_encode()
        # to_pylist would make a scalar of each word first
        found = cache.all(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        cache.trim(self.cached)
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = words.indices.to_numpy()
        n, starts = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = ids[np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[rows.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


#: Words on which the short way to the model is compared with the whole tokenizer.
_PROBES = ["a", "word", "letters", "straße", "élève", "mañana", "über", "ñ"]


def _body(word: str) -> int:
    """Characters of a word without its trailing punctuation, if that leaves letters only; else all."""
    if word.isalpha():
        return len(word)
    body = word.rstrip(_PUNCTUATION)
    return len(body) if body.isalpha() else len(word)


@cache
def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be
    seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: 256 + i for i, b in enumerate(hidden)}


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ENCODERS: dict[tuple, WordEncoder] = {}

_SEGMENTS = "part int, segment int, first bigint, n_ids bigint, doc_ids array<bigint>, starts array<bigint>, payload binary"


def _segments(path: str, end_id: int, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, by_word) not in _ENCODERS:
            _ENCODERS[path, by_word] = WordEncoder(path, by_word)
        encoder = _ENCODERS[path, by_word]
        end = np.array([end_id], "<u4").tobytes()
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        raw: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])[:-1]
            payload = encode_blocks(np.frombuffer(b"".join(raw), "<u4"))
            values = ([part], [segment], [first], [size], [ids], [starts], [payload])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            names = ("part", "segment", "first", "n_ids", "doc_ids", "starts", "payload")
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], list(names))

        for batch in batches:
            docs, texts = batch.column("id").to_pylist(), batch.column("text")
            read = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lows = [0, *(np.flatnonzero(np.diff(read // TOGETHER)) + 1).tolist(), len(docs)]
            for low, high in zip(lows, lows[1:]):
                some = [x or "" for x in texts.slice(low, high - low).to_pylist()]
                for doc, found in zip(docs[low:high], encoder.encode(some)):
                    ids.append(doc)
                    raw.append(found + end)
                    size += len(found) // 4 + 1
                    if size >= SEGMENT:
                        yield row()
                        segment, first = segment + 1, first + size
                        ids, raw, size = [], [], 0
        if ids:
            yield row()

    return run


def token_segments(
    docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True
) -> DataFrame:
    """Segments of the documents in ascending order of id: `part, segment, first` (ids before it
    in its part), `n_ids, doc_ids, starts` (in the segment), `payload`.

    path: a file of the tokenizers library, present on every machine. Null and empty texts have
    the end id alone. Null ids come first; rows of one id follow each other by their texts'
    hashes; repeated rows are all kept. Other columns are not read. An empty table has no
    segments.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # tie: rows of one frequent id may lie in several parts
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    return rows.select("id", "text").mapInArrow(released(_segments(path, end_id, by_word)), _SEGMENTS)


def with_starts(segments: DataFrame) -> DataFrame:
    """Adds `base`, the ids of all parts before the segment's; one small row for each part."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return segments.join(bases, "part")


def read_documents(segments: DataFrame) -> DataFrame:
    """`id, start, n_tokens, ids_crc32, n_bytes` of each document, decoded from the segments.

    n_bytes: the document's share of the segment's payload, rounded down.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _ENCODERS:  # of the tasks that wrote; Spark keeps its workers
            _ENCODERS.clear()
            give_back()
        for batch in batches:
            for row in batch.to_pylist():
                ids = Blocks(row["payload"]).read().astype("<u4")
                starts = row["starts"]
                ends = [*starts[1:], row["n_ids"]]
                raw = memoryview(ids.view(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([row["base"] + row["first"] + s for s in starts], pa.int64()),
                        pa.array([e - s for s, e in zip(starts, ends)], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends)], pa.int64()),
                        pa.array([len(row["payload"]) * (e - s) // row["n_ids"] for s, e in zip(starts, ends)], pa.int64()),
                    ],
                    ["id", "start", "n_tokens", "ids_crc32", "n_bytes"],
                )

    return with_starts(segments).mapInArrow(released(run), "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, n_bytes bigint")


def encoded(docs: DataFrame, path: str, end_id: int, **options) -> DataFrame:
    """`read_documents` of the segments as written to the shared folder and read again."""
    return read_documents(written(token_segments(docs, path, end_id, **options), "segments"))
