"""Language of texts, in two steps: the family first, then the language within it.

Features are square roots of the shares of hashed character 1- to 3-grams of the lower-cased
letters of a whole text, scaled to length 1. Families are found from the training texts:
languages with the nearest mean features are merged until half as many families are left. One
linear support vector machine for each pair of families, and one for each pair of languages of a
family, decide by votes (then by margins).

Every machine is trained in a task of its own, on a sample of at most about `per_language` texts
for each language, the lowest by a hash of their text; copies count once.
"""

from __future__ import annotations

import itertools
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearpair.llm.tables import column, packed_rows, written
from nearpair.llm.words import mix

FEATURES = 4096
PER_LANGUAGE = 1000  # bound of the training sample
LANGUAGES = 1 << 16  # rows of counts that may travel to every task
CHUNK_CHARS = 1 << 18
UNKNOWN = "und"
_ITERATIONS = 150
_DECAY = 1e-4


@cache
def _letters() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, bool)
    table[[i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "L"]] = True
    return table


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each text, and whether it has a letter."""
    raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    rows = np.zeros((len(texts), FEATURES), np.float32)
    codes = np.concatenate([x for t in raw for x in (np.array([32], "<u4"), t)] + [np.array([32, 32, 32], "<u4")])
    doc = np.repeat(np.arange(len(texts) + 1), [*(len(t) + 1 for t in raw), 3])
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    has = np.bincount(doc, letter, minlength=len(texts) + 1)[: len(texts)] > 0
    counts = np.zeros((len(texts) + 1) * FEATURES, np.int64)
    gram = np.zeros(len(codes), np.uint64)
    for k in range(3):
        gram = gram * np.uint64(0x9E3779B97F4A7C15)
        gram[: len(codes) - k] += codes[k:] + np.uint64(k + 1)
        keep = letter.copy()  # a gram holds a letter at its first or its last place
        keep[: len(codes) - k] |= letter[k:]
        slot = (mix(gram[keep]) >> np.uint64(52)).astype(np.int64)
        counts += np.bincount(doc[keep] * FEATURES + slot, minlength=len(counts))
    rows = np.sqrt(counts.reshape(-1, FEATURES)[: len(texts)].astype(np.float32))
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.maximum(norm, 1e-9), has


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of texts of about CHUNK_CHARS characters, 256 at most."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS or i - a >= 255:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """`text, lang`: the texts of lowest hash, about `per_language` of each language at most.

    The languages' counts (as many rows as counted, LANGUAGES at most) go to all tasks, so that no
    text moves that is not in the sample; more languages than that are joined by a shuffle.
    """
    counts = written(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "language-counts")
    if counts.count() <= LANGUAGES:
        counts = F.broadcast(counts)
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    return docs.join(counts, "lang").filter(share * F.col("rows") < per_language).select("text", "lang").distinct()


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in _groups(texts):
            rows, has = features(texts[a:b])
            x = [r.astype(np.float16).tobytes() for r in rows]
            out = pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), pa.array(x, pa.binary())], ["lang", "x"])
            yield out.filter(pa.array(has))


def _centroids(table: pa.Table) -> pa.Table:
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float16).reshape(-1, FEATURES)
    mean = x.astype(np.float32).mean(axis=0)
    return pa.table({"lang": [table["lang"][0].as_py()], "x": [mean.tobytes()]})


def families(names: list[str], means: np.ndarray) -> list[list[str]]:
    """Merges the nearest groups of languages (mean cosine of the centred means) until half as many are left."""
    centred = means - means.mean(axis=0)
    centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    near = centred @ centred.T
    groups = [[i] for i in range(len(names))]
    while len(groups) > max(1, -(-len(names) // 2)):
        a, b = max(itertools.combinations(range(len(groups)), 2), key=lambda p: near[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return [sorted(names[i] for i in g) for g in groups]


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, bias of a linear support vector machine (squared hinge loss, classes
    weighed equally), by accelerated gradient steps. The last column of x is all ones."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    t, step = 1.0, np.float32(0.25)  # rows have length sqrt(2): the curvature is at most 4
    for _ in range(_ITERATIONS):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (_DECAY * ahead - 2 * (share * y * slack) @ x)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = (new + np.float32((last - 1) / t) * (new - w)).astype(np.float32)
        w = new
    return w


def _trained(table: pa.Table) -> pa.Table:
    x = np.ones((table.num_rows, FEATURES + 1), np.float32)
    for row, raw in zip(x, table["x"]):
        row[:FEATURES] = np.frombuffer(raw.as_buffer(), np.float16)
    y = table["y"].to_numpy().astype(np.float32)
    return pa.table({"machine": [table["machine"][0].as_py()], "w": [fit_machine(x, y).astype(np.float32).tobytes()]})


class Decider:
    """Predicts by the machines of the families and of each family's languages."""

    def __init__(self, groups: list[list[str]], weights: dict[tuple, np.ndarray]) -> None:
        self.groups, self.weights = groups, weights

    def _vote(self, x: np.ndarray, names: list, key) -> tuple[np.ndarray, np.ndarray]:
        votes = np.zeros((len(x), len(names)))
        least = np.full((len(x), len(names)), 8.0)
        for a, b in itertools.combinations(range(len(names)), 2):
            w = self.weights[key(names[a], names[b])]
            margin = x @ w[:-1] + w[-1]
            votes[:, a] += margin >= 0
            votes[:, b] += margin < 0
            least[:, a] = np.minimum(least[:, a], margin)
            least[:, b] = np.minimum(least[:, b], -margin)
        best = (votes + 1 / (1 + np.exp(-least))).argmax(axis=1)
        return best, 1 / (1 + np.exp(-4 * least[np.arange(len(x)), best]))

    def __call__(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self._vote(x, list(range(len(self.groups))), lambda a, b: ("family", a, b))
        names: list = [None] * len(x)
        for f, group in enumerate(self.groups):
            rows = np.flatnonzero(family == f)
            if len(rows):
                best, own = self._vote(x[rows], group, lambda a, b: ("lang", a, b))
                score[rows] *= own
                for i, k in zip(rows, best):
                    names[i] = group[k]
        return names, score


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Decider | None:
    """A decider from `text, lang`; None where no row has both. Null lang is not learned from."""
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    sample = written(_sample(rows, per_language).mapInArrow(_featured, "lang string, x binary"), "languages")
    means = sample.groupBy("lang").applyInArrow(_centroids, "lang string, x binary").toArrow().sort_by("lang")
    names = means["lang"].to_pylist()
    if not names:
        return None
    groups = families(names, np.array([np.frombuffer(x, np.float32) for x in means["x"].to_pylist()]))
    of = {name: f for f, group in enumerate(groups) for name in group}
    tasks = [(("family", a, b), {n: 1 if of[n] == a else -1 for n in names if of[n] in (a, b)}) for a, b in itertools.combinations(range(len(groups)), 2)]
    tasks += [(("lang", a, b), {a: 1, b: -1}) for group in groups for a, b in itertools.combinations(group, 2)]
    plan = [(k, name, y) for k, (_, sides) in enumerate(tasks) for name, y in sides.items()]
    if not plan:
        return Decider(groups, {})
    plan = docs.sparkSession.createDataFrame(plan, "machine bigint, lang string, y bigint")
    trained = sample.join(F.broadcast(plan), "lang").groupBy("machine").applyInArrow(_trained, "machine bigint, w binary")
    found = {tasks[r["machine"]][0]: np.frombuffer(r["w"], np.float32) for r in trained.collect()}
    return Decider(groups, found)


def _judged(batches: Iterator[pa.RecordBatch], decide: Decider | None, text_col: str) -> Iterator[tuple]:
    """Slices of the batches (`_row`) with the language and score of each row's text."""
    for batch in batches:
        whole = batch.column("_row")
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            texts = [t or "" for t in pc.struct_field(whole.slice(low, 256), [text_col]).cast(pa.string()).to_pylist()]
            for a, b in _groups(texts):
                names, scores = [UNKNOWN] * (b - a), np.zeros(b - a)
                if decide is not None:
                    x, has = features(texts[a:b])
                    found, p = decide(x)
                    names = [n if h else UNKNOWN for n, h in zip(found, has)]
                    scores = np.where(has, p, 0.0)
                yield part.slice(a, b - a), names, scores


def predict_languages(docs: DataFrame, decider: Decider | None, text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (0 to 1) instead of columns of these names.

    The language is `und`, with score 0, where the text is null or has no letter, or where no
    language was learned. Only the text is looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(decider)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, names, scores in _judged(batches, model.value, text_col):
            columns = [rows.column("_row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "lang_pred", "score"])

    rows = packed_rows(docs)
    schema = StructType([*rows.schema.fields]).add("lang_pred", "string").add("score", "double")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return rows.mapInArrow(run, schema).select(*kept, "lang_pred", "score")


def keep_known(docs: DataFrame, decider: Decider | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose language is not `und`, with the columns of `docs`. A text passes
    through Python once, in its row."""
    model = docs.sparkSession.sparkContext.broadcast(decider)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, names, _ in _judged(batches, model.value, text_col):
            yield rows.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))

    rows = packed_rows(docs)
    return rows.mapInArrow(run, rows.schema).select("_row.*")


def training_rows(docs: DataFrame, learns: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`text, lang` of the rows to learn from."""
    return docs.filter(learns).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
