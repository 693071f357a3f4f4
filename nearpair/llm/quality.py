"""Grades texts by ordinal regression on graded ratings.

A text is a set of hashed words (lower-cased, with and without ASCII punctuation) and of hashed
marks of its shape. One vector of
weights, shared by all grades, gives a latent value z; ordered thresholds t_1 < t_2 < ... cut it:

    P(grade >= k) = sigmoid(z - t_k)

so z orders texts, the sum of the tails is the expected grade, and a tail selects. Fitted by
gradient steps on at most about `per_grade` rated texts for each grade, those of lowest hash, copies once, by
one task of bounded memory; every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpair.llm.tables import written
from nearpair.llm.words import LETTERS, Words, chunks, mix, text_buffer, words_of

BITS = 18  # of a feature's number
PER_GRADE = 8000  # bound of the training sample
LEAST = 5  # rated texts a feature must occur in
_STEPS = 300
_RATE = 0.05
_DECAY = 1e-3
_MARKS = np.frombuffer(b"#*$%&|<>!?", np.uint8)


def text_features(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of each text (values, and where each text's begin)."""
    n = len(offsets) - 1
    slot = (mix(words.hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    code = np.unique((words.doc << BITS) | slot)
    bare = words_of(data, offsets, LETTERS)
    slot = (mix(bare.hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    # marks: how often, in steps of doubling, a byte of the list stands per 64 words
    count = np.diff(words.bounds)
    more = []
    for k, byte in enumerate(_MARKS):
        sums = np.concatenate([[0], np.cumsum(data == byte)])
        per = (sums[offsets[1:]] - sums[offsets[:-1]]) * 64 / np.maximum(count, 1)
        level = np.minimum(np.log2(per + 1), 7).astype(np.int64)
        level_slot = mix(np.arange(8, dtype=np.uint64) + np.uint64(1000 + 16 * k)) >> np.uint64(64 - BITS)
        more.append((np.arange(n) << BITS) | level_slot[level].astype(np.int64))
    repeated = np.bincount(words.doc, minlength=n) - np.bincount(code >> BITS, minlength=n)
    level = np.minimum(8 * repeated // np.maximum(count, 1), 7)
    level_slot = mix(np.arange(8, dtype=np.uint64) + np.uint64(5000)) >> np.uint64(64 - BITS)
    more.append((np.arange(n) << BITS) | level_slot[level].astype(np.int64))
    code = np.unique(np.concatenate([code, (bare.doc << BITS) | slot, *more]))
    return code & ((1 << BITS) - 1), np.searchsorted(code >> BITS, np.arange(n + 1))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, words in chunks(batches):
        data, offsets = text_buffer(rows.column("text"))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        values, at = text_features(words, data, offsets)
        x = [values[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([rows.column("grade"), pa.array(x, pa.binary())], ["grade", "x"])


def fit_ordinal(x: list[np.ndarray], grade: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. Grades are weighed equally; features of fewer than LEAST texts
    get weight 0."""
    size = 1 << BITS
    column = np.concatenate(x) if x else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    often = np.bincount(column, minlength=size) >= LEAST
    keep = often[column]
    names, column = np.unique(column[keep], return_inverse=True)
    row = row[keep]
    share = 1 / np.maximum(np.bincount(grade, minlength=grades), 1)[grade]
    share = share / max(share.sum(), 1e-9)
    above = grade[:, None] >= np.arange(1, grades)
    w = np.zeros(len(names))
    cuts = np.linspace(-1, 1, grades - 1)
    state = [np.zeros(len(names)), np.zeros(len(names)), np.zeros(grades - 1), np.zeros(grades - 1)]
    for step in range(1, _STEPS + 1):
        z = np.bincount(row, w[column], minlength=len(x))
        wrong = share[:, None] * (1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30))) - above)
        gradient = np.bincount(column, wrong.sum(axis=1)[row], minlength=len(names)) + _DECAY * w
        for value, slope, k in ((w, gradient, 0), (cuts, -wrong.sum(axis=0), 2)):
            state[k] = 0.9 * state[k] + 0.1 * slope
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * slope * slope
            value -= _RATE * (1 - step / (_STEPS + 1)) * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)
        cuts.sort()
    weights = np.zeros(size, np.float32)
    weights[names] = w
    return weights, cuts


def sample_ratings(docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`text, grade` of about `per_grade` rated documents for each grade at most.

    ratings: `id, grade`; of several for one id the lowest counts, null grades do not. The ids of
    lowest hash are chosen first and sent to all tasks (their number has the stated bound), so no
    text moves that is not in the sample. Of several texts with one id, one stays.
    """
    rated = ratings.filter("grade IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("grade").cast("int").alias("grade"))
    counts = rated.groupBy("grade").agg(F.count(F.lit(1)).alias("rows"))
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    chosen = rated.join(counts, "grade").filter(share * F.col("rows") < per_grade).select("id", "grade")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    return rows.groupBy("id").agg(F.min_by(F.struct("text", "grade"), F.xxhash64("text")).alias("x")).select("x.*")


def fit_grades(rated: DataFrame, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from `text, grade` (0..grades - 1), a sample of bounded size.

    Rows with a null or any other grade are not learned from; without rows all weights are 0.
    """
    rows = rated.select(F.col("text").cast("string").alias("text"), F.col("grade").cast("int").alias("grade"))
    rows = rows.filter(F.col("grade").between(0, grades - 1))
    sample = written(rows.select("text", "grade").distinct().mapInArrow(_featured, "grade int, x binary"), "ratings")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grade", "ascending"), ("x", "ascending")])
        x = [np.frombuffer(v, "<i4").astype(np.int64) for v in table["x"].to_pylist()]
        weights, cuts = fit_ordinal(x, table["grade"].to_numpy().astype(np.int64), grades)
        return pa.table({"w": [weights.tobytes()], "cuts": [cuts.tobytes()]})

    # the sample's bound makes this one group of bounded size
    fitted = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "w binary, cuts binary").collect()
    if not fitted:
        return np.zeros(1 << BITS, np.float32), np.zeros(grades - 1)
    return np.frombuffer(fitted[0]["w"], np.float32), np.frombuffer(fitted[0]["cuts"], np.float64)


def grade_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, latent, expected_grade, tails` for every row of `docs`.

    tails: P(grade >= k) for k = 1, 2, ... A null or empty text is graded by the marks of an
    empty text. Repeated rows and ids are graded each for itself. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        for rows, words in chunks(batches):
            data, offsets = text_buffer(rows.column("text"))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            values, at = text_features(words, data, offsets)
            sums = np.concatenate([[0.0], np.cumsum(weights[values], dtype=np.float64)])
            z = sums[at[1:]] - sums[at[:-1]]
            tails = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(z), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))],
                ["id", "latent", "expected_grade", "tails"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, latent double, expected_grade double, tails array<double>")
