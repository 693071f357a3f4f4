"""N-gram Jaccard join: documents linked by the share of their word n-grams.

Method: rare-first prefix filtering. N-grams are ordered by how many documents have them; two
sets with enough in common share an n-gram of both prefixes. An n-gram of one document alone
cannot match, so a document whose prefix has no other kind leaves at once. What is left joins
on prefix n-grams under the length and positional filters; the suffix filter (n-grams counted
by slices of the hash range) and one exact comparison follow, once for each pair.

The frequencies travel as packed arrays: map tasks deal the sorted n-gram hashes of about
CHUNK bytes of text out to hash buckets, a bucket finds what is repeated, and each chunk gets
its repeated n-grams back. An n-gram that a chunk has several times travels once, with a
count, so a very frequent one costs one entry a chunk.

Links of a group of near copies are not listed: first each n-gram's documents are compared
with the least document of like size (a star), then only documents that the components found
so far keep apart. After that every pair of different components that could link has been
compared, so components are exact while the work follows the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpair.llm.components import connected_components
from nearpair.llm.memory import released
from nearpair.llm.tables import column, packed_rows, without, written
from nearpair.llm.words import Words, chunks, mix

BUCKET = 1 << 20  # n-gram entries in a hash bucket, about
SLICES = 32  # of the hash range, for the suffix filter
_STEP = 0x5851F42D4C957F2D  # its powers weigh the words of an n-gram
_TOLD = 1 << 15  # an entry at or above it holds a count, not a document


def gram_sets(words: Words, n: int, size: int) -> list[np.ndarray]:
    """The distinct n-grams of each of n texts as sorted uint64 hashes.

    A text of fewer words has one element, its whole sequence; without words, none.
    """
    h = words.hashes
    grams = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        grams += h[k : k + len(grams)] * np.uint64(pow(_STEP, 2 * k + 1, 1 << 64))
    grams = mix(grams)
    out = []
    for i in range(n):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            short = h[a:b] * (np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            out.append(mix(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = s.sum(dtype=np.uint64) if len(s) else np.uint64(0)
    b = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) if len(s) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sizes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in chunks(batches):
            sets = gram_sets(words, rows.num_rows, size)
            keys = [_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                ],
                ["id", "n", "k1", "k2"],
            )

    return run


def _pack(h: np.ndarray) -> bytes:
    """The low 6 bytes of each hash; a bucket holds hashes that differ in them."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes, high: np.uint64 = np.uint64(0)) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | high


def _bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


_ENTRY = pa.schema(
    [("bucket", pa.int64()), ("chunk", pa.int64()), ("gram", pa.binary()), ("doc", pa.binary()), ("own", pa.bool_()), ("ids", pa.binary())]
)
_FOUND = pa.schema(
    [("chunk", pa.int64()), ("bucket", pa.int64()), ("gram", pa.binary()), ("doc", pa.binary()), ("df", pa.binary()), ("ids", pa.binary())]
)
_SET = pa.schema(
    [("id", pa.int64()), ("n", pa.int64()), ("grams", pa.binary()), ("at", pa.int64()), ("prefix", pa.list_(pa.int64())), ("slices", pa.binary())]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _dealt(size: int, bits: int):
    """Map side: the entries of each chunk, by bucket; its documents go along with one of them.

    Of equal sets in a chunk only the one with the least id goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for rows, words in chunks(batches):
            ids = rows.column("id").to_pylist()
            first: dict[tuple, int] = {}
            sets = gram_sets(words, len(ids), size)
            for i, s in enumerate(sets):
                if len(s) and ids[i] is not None:
                    j = first.setdefault((len(s), *_keys(s)), i)
                    if ids[i] < ids[j]:
                        first[(len(s), *_keys(s))] = i
            keep = sorted(first.values())
            for low in range(0, len(keep), _TOLD - 1):
                some = keep[low : low + _TOLD - 1]
                serial += 1
                yield from _entries(
                    (part << 32) + serial, [ids[i] for i in some], [sets[i] for i in some], bits
                )

    return run


def _entries(chunk: int, ids: list[int], sets: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk. gram, doc: n-grams that one document of the chunk has, and which; or,
    from _TOLD on, that so many have. own: which documents those are, kept for the chunk itself."""
    sizes = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    once = count == 1
    u = h[at]
    word = np.where(once, doc[at], np.minimum(_TOLD + count, 2 * _TOLD - 1)).astype("<u2")
    bucket = _bucket_of(u, bits)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(cut[1:], len(u))
    home = int(mix(np.array([chunk], np.uint64))[0] >> np.uint64(64 - bits))
    many = ~np.repeat(once, count)
    head = np.array(ids, "<i8").tobytes() + sizes.astype("<i8").tobytes()
    columns = [
        [*bucket[cut].tolist(), home],
        [chunk] * (len(cut) + 1),
        [_pack(u[a:b]) for a, b in zip(cut, ends)] + [h[many].astype("<u8").tobytes()],
        [word[a:b].tobytes() for a, b in zip(cut, ends)] + [doc[many].astype("<u2").tobytes()],
        [False] * len(cut) + [True],
        [None] * len(cut) + [head],
    ]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY)], schema=_ENTRY)


def _repeated(bits: int):
    """Reduce side of a bucket: what more than one document has, back to the chunks."""

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_pylist()
        chunk, gram = table.column("chunk").to_pylist(), table.column("gram").to_pylist()
        doc, ids = table.column("doc").to_pylist(), table.column("ids").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        rows = [i for i, x in enumerate(own) if not x]
        out: list[list] = [[] for _ in _FOUND]
        for i in (i for i, x in enumerate(own) if x):
            for column, value in zip(out, (chunk[i], None, gram[i], doc[i], None, ids[i])):
                column.append(value)
        if rows:
            h = np.concatenate([_unpack(gram[i]) for i in rows])
            word = np.concatenate([np.frombuffer(doc[i], "<u2") for i in rows])
            ends = np.cumsum([len(gram[i]) // 6 for i in rows])
            order = np.argsort(h, kind="stable")
            new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
            at = np.flatnonzero(new)
            total = np.add.reduceat(np.where(word >= _TOLD, word.astype(np.int64) - _TOLD, 1)[order], at)
            df = np.empty(len(h), "<i8")
            df[order] = np.repeat(total, np.diff(np.append(at, len(h))))
            for i, b in zip(rows, ends):
                a = b - len(gram[i]) // 6
                keep = np.flatnonzero(df[a:b] > 1)
                if len(keep):
                    packed = np.frombuffer(gram[i], np.uint8).reshape(-1, 6)[keep]
                    part = (packed.tobytes(), word[a:b][keep].tobytes(), df[a:b][keep].astype("<i4").tobytes())
                    for column, value in zip(out, (chunk[i], bucket, *part, None)):
                        column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND)], schema=_FOUND)

    return run


def prefix_length(n: int, percent: int) -> int:
    """N-grams of a set of n, rarest first, one of which any partner's prefix shares."""
    return n - -(-percent * n // 100) + 1


def _survivors(bits: int, percent: int):
    """The documents of a chunk that may link, each with its repeated n-grams, rarest first."""

    def run(table: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _SET]
        heads = [x for x in table.column("ids").to_pylist() if x is not None]
        grams, docs, dfs, told, told_df = [], [], [], [], []
        own: list[tuple] = []
        for bucket, gram, doc, df in zip(*(table.column(c).to_pylist() for c in ("bucket", "gram", "doc", "df"))):
            if df is None:
                own.append((np.frombuffer(gram, "<u8"), np.frombuffer(doc, "<u2")))
                continue
            high = np.uint64(bucket) << np.uint64(64 - bits)
            h, d, f = _unpack(gram), np.frombuffer(doc, "<u2"), np.frombuffer(df, "<i4")
            h |= high  # bits between the bucket's and the 48 sent stay zero, for all alike
            one = d < _TOLD
            grams.append(h[one])
            docs.append(d[one])
            dfs.append(f[one])
            told.append(h[~one])
            told_df.append(f[~one])
        (gram, doc), head = own[0], heads[0]
        if len(gram):
            top = np.uint64((1 << 64) - (1 << (64 - bits)))
            sent = gram & (top | np.uint64((1 << 48) - 1))
            known, df = np.concatenate(told), np.concatenate(told_df)
            order = np.argsort(known)
            at = order[np.searchsorted(known, sent, sorter=order)]
            grams.append(sent)
            docs.append(doc)
            dfs.append(df[at])
        n = len(head) // 16
        ids, sizes = np.frombuffer(head[: 8 * n], "<i8"), np.frombuffer(head[8 * n :], "<i8")
        if grams:
            gram, doc, df = np.concatenate(grams), np.concatenate(docs), np.concatenate(dfs)
            have = np.bincount(doc, minlength=n)
            keep = have[doc] * 100 >= percent * sizes[doc]
            gram, doc, df = gram[keep], doc[keep], df[keep]
            order = np.lexsort((gram, df, doc))
            gram, doc = gram[order], doc[order]
            at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else []
            for a, b in zip(at, np.append(at[1:], len(doc))):
                i, s = int(doc[a]), gram[a:b]
                size = int(sizes[i])
                unique = size - len(s)
                first = s[: max(0, prefix_length(size, percent) - unique)]
                slices = np.bincount((s >> np.uint64(3) & np.uint64(SLICES - 1)).astype(np.int64), minlength=SLICES)
                row = (int(ids[i]), size, np.sort(s).tobytes(), unique, first.view(np.int64), slices.astype("<u4").tobytes())
                for column, value in zip(out, row):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SET)], schema=_SET)

    return run


def gram_sizes(docs: DataFrame, size: int = 5) -> DataFrame:
    """`id, n, k1, k2` of `id, text`: the size of each n-gram set and 128 bits that name it."""
    return docs.mapInArrow(released(_sizes(size)), "id bigint, n bigint, k1 bigint, k2 bigint")


def surviving_sets(docs: DataFrame, entries: int, size: int = 5, percent: int = 80) -> DataFrame:
    """Sets that may link, one of each chunk's equal ones: `id, n`, `grams` (repeated n-grams,
    sorted, packed), `at` (n-grams before those), `prefix` (those in the prefix), `slices`."""
    bits = min(40, max(6, math.ceil(math.log2(max(1, entries) / BUCKET))))
    dealt = docs.mapInArrow(released(_dealt(size, bits)), _ddl(_ENTRY))
    found = dealt.groupBy("bucket").applyInArrow(released(_repeated(bits)), _ddl(_FOUND))
    return found.groupBy("chunk").applyInArrow(released(_survivors(bits, percent)), _ddl(_SET))


def _overlap(percent: int):
    """Least common n-grams of two linked sets: 100 c >= percent (n_l + n_r - c)."""
    return F.ceil(F.lit(percent) * (F.col("n_l") + F.col("n_r")) / F.lit(100 + percent))


def _near(percent: int):
    """The length filter and the positional filter."""
    small, large = F.least("n_l", "n_r"), F.greatest("n_l", "n_r")
    rest = F.least(F.col("n_l") - F.col("pos_l"), F.col("n_r") - F.col("pos_r"))
    return (small * 100 >= large * percent) & (rest >= _overlap(percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs `l, r` (once each) that link, after the suffix filter and an exact comparison."""

    def side(x: str, value: str) -> DataFrame:
        return sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col(value).alias(f"{value}_{x}"))

    def checked(bound):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, left, right = (batch.column(c).to_pylist() for c in ("n_l", "n_r", "x_l", "x_r"))
                keep = [
                    100 * (c := bound(x, y)) >= percent * (n + m - c) for n, m, x, y in zip(a, b, left, right)
                ]
                yield batch.select(["l", "r"]).filter(pa.array(keep, pa.bool_()))

        return run

    def at_most(x: bytes, y: bytes) -> int:
        return int(np.minimum(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")).sum())

    def common(x: bytes, y: bytes) -> int:
        both = np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")])
        both.sort()
        return int((both[1:] == both[:-1]).sum())

    for value, bound in (("slices", at_most), ("grams", common)):
        joined = pairs.join(side("l", value), "l").join(side("r", value), "r")
        joined = joined.select("l", "r", "n_l", "n_r", F.col(f"{value}_l").alias("x_l"), F.col(f"{value}_r").alias("x_r"))
        pairs = joined.mapInArrow(released(checked(bound)), "l bigint, r bigint")
    return pairs


def _components(sets: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """`id, root` of all sets that link with another."""
    # star: each n-gram's least document of a size band against the others of that band
    band = F.floor(F.log("n") / math.log(100 / percent))
    banded = postings.withColumn("band", band)
    star = banded.groupBy("gram", "band").agg(F.min(F.struct("id", "n", "pos")).alias("c"))
    pairs = banded.join(star, ["gram", "band"]).select(
        F.col("c.id").alias("l"), F.col("id").alias("r"),
        F.col("c.n").alias("n_l"), F.col("n").alias("n_r"), F.col("c.pos").alias("pos_l"), F.col("pos").alias("pos_r"),
    )
    pairs = pairs.filter((F.col("l") < F.col("r")) & _near(percent)).select("l", "r").distinct()
    first = written(_verified(pairs, sets, percent), "links")
    parts = connected_components(first.toDF("u", "v"))

    # what is left: documents of one n-gram in different components
    placed = postings.join(parts.withColumnRenamed("u", "id"), "id", "left")
    placed = written(placed.withColumn("root", F.coalesce("root", "id")), "placed")
    groups = placed.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("rows"))
    lists = groups.groupBy("gram").agg(
        F.max_by("root", "rows").alias("most"), F.count(F.lit(1)).alias("roots")
    )
    mixed = placed.join(lists.filter("roots > 1"), "gram")
    left = mixed.filter("root <> most").select("gram", *[F.col(c).alias(f"{c}_l") for c in ("id", "n", "pos", "root")])
    right = mixed.select("gram", *[F.col(c).alias(f"{c}_r") for c in ("id", "n", "pos", "root")])
    pairs = left.join(right, "gram").filter((F.col("root_l") != F.col("root_r")) & _near(percent))
    pairs = pairs.select(F.least("id_l", "id_r").alias("l"), F.greatest("id_l", "id_r").alias("r")).distinct()
    second = written(_verified(pairs, sets, percent), "links")
    return connected_components(first.unionByName(second).toDF("u", "v"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """`id, n, class_id, component_id` for every row of `docs`.

    n: distinct n-grams of `size` words (see `gram_sets`); class_id: the least id with the same
    set; component_id: the least id reachable by links, where two documents link when
    100 * common >= percent * union. A null or wordless text has n 0 and its own id for both; a
    null id gives a row with null class and component. Repeated rows are copies. A repeated id
    is one document for its links, with a row for each row. Other columns are not read.

    N-grams are compared as 64-bit hashes, of which 48 bits and the bucket number are kept.
    """
    docs = docs.select(column(id_col).cast("bigint").alias("id"), column(text_col).cast("string").alias("text"))
    sizes = written(gram_sizes(docs, size), "sizes")
    classes = sizes.filter("n > 0 AND id IS NOT NULL").groupBy("n", "k1", "k2").agg(F.min("id").alias("class_id"))
    entries = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sets = written(surviving_sets(docs, entries, size, percent), "sets")
    names = classes.select(F.col("class_id").alias("id")).distinct()
    kept = sets.select("id", "n", "at", "prefix").join(names, "id", "left_semi")
    # a repeated id may stand for several sets: its links are those of all of them
    postings = kept.select("id", "n", "at", F.posexplode("prefix").alias("i", "gram"))
    postings = written(postings.select("id", "n", "gram", (F.col("at") + F.col("i")).alias("pos")), "postings")
    roots = _components(sets, postings, percent).select(F.col("u").alias("class_id"), "root")
    named = sizes.join(classes, ["n", "k1", "k2"], "left").select("id", "n", F.coalesce("class_id", "id").alias("class_id"))
    named = named.join(roots, "class_id", "left")
    return named.select("id", "n", "class_id", F.coalesce("root", "class_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of `docs` for each component, the one with the least id, with the columns of `docs`.

    Rows without words and rows with a null id are kept. Of several rows with the kept id (their
    texts linked or not), the one with the least text hash stays.
    """
    found = jaccard_components(docs, id_col, text_col, **options)
    found = written(found.filter("n > 0").groupBy("id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("rows")), "kept")
    rest = without(docs, id_col, found.filter("id <> c").select("id"))
    again = found.filter("rows > 1").select(F.col("id").alias("_value"))
    if again.isEmpty():
        return rest
    once = packed_rows(rest, _id=column(id_col).cast("bigint"), _t=F.xxhash64(column(text_col)))
    twice = once.join(again, F.col("_id") == again["_value"], "left_semi").groupBy("_id").agg(F.min_by("_row", "_t").alias("_row"))
    return without(rest, id_col, again).unionByName(twice.select("_row.*"))
