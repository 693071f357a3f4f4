"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most `max_copies` times its size; what
is cut off there is shared out again by weight. Within a source, a document's expected copies
grow with its own weight. Whole copies are allocated outright; for the rest, documents are
ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in
that order until the words still missing are reached (a sample of fixed size in words).

The cut of a source is found on counts: words by 4,096 slices of the rank, then the documents
of one slice. No task sees all documents of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearpair.llm.tables import column, packed_rows, written

WORD = "[^\\x20\\x09-\\x0D]+"
SLICES = 4096
CYCLE = (5, 2, 1)  # weights of the sources in the order of their names


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def length_weight(size: Column) -> Column:
    """1 + floor(log2(words)): longer documents are expected somewhat more often."""
    return F.length(F.bin(F.greatest(size, F.lit(1)))).cast("double")


def _key(source: Column) -> Column:
    """Never null: a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """The `docs` columns the mix reads, as `_id, _key, _size, _weight, _u`."""
    size = word_count(F.col(text_col))
    rows = docs.withColumn("_size", size).withColumn("_id", F.col(id_col)).withColumn("_key", _key(F.col(source_col)))
    named = F.concat_ws("|", F.lit(str(seed)), F.col("_id").cast("string"), F.col("_size").cast("string"))
    bits = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double")
    return rows.withColumn("_u", (bits + 0.5) / float(1 << 52)).withColumn("_weight", length_weight(F.col("_size")))


def source_targets(sizes: DataFrame, max_copies: int = 3, cycle: tuple = CYCLE) -> DataFrame:
    """`_key, source_size, target` of `_key, source_size`, a row for each source.

    The shares fill up like vessels: each source gets level * weight, at most its cap, and the
    level is the one at which all words are given out.
    """
    by_name = Window.orderBy(F.col("_key") == "", "_key")  # null last
    turn = (F.row_number().over(by_name) - 1) % len(cycle) + 1
    rows = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), turn))
    rows = rows.withColumn("_cap", F.col("source_size").cast("double") * max_copies)
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_key")
    before = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("_key")
    rows = rows.withColumn("_level", (F.sum("source_size").over(everything) - before) / open_weight)
    fits = F.col("_cap") >= F.col("_level") * F.col("_w")
    rows = rows.withColumn("_level", F.min(F.when(fits, F.struct(F.col("_cap") / F.col("_w"), "_key", "_level"))).over(everything)["_level"])
    target = F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return rows.select("_key", "source_size", target.alias("target"))


def _rates(rows: DataFrame, max_copies: int) -> DataFrame:
    """`_key, source_size, target, _rate`: expected copies are _rate * weight, at most the cap."""
    bins = rows.groupBy("_key", "_weight").agg(F.sum("_size").alias("_words"))
    bins = written(bins, "mix")
    targets = source_targets(bins.groupBy("_key").agg(F.sum("_words").alias("source_size")), max_copies)
    heavy = Window.partitionBy("_key").orderBy(F.desc("_weight"))
    before = F.coalesce(F.sum("_words").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("_words") * F.col("_weight")).over(heavy.rowsBetween(0, Window.unboundedFollowing))
    tried = bins.join(targets, "_key").withColumn("_rate", F.try_divide(F.col("target") - before * max_copies, rest))
    fits = F.col("_rate") * F.col("_weight") <= max_copies * (1 + 1e-12)
    return tried.groupBy("_key").agg(
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        # the heaviest weight that is not cut off decides; all are cut off at the full target
        F.max_by(F.when(fits, F.col("_rate")), F.when(fits, F.col("_weight"))).alias("_rate"),
    )


def _allotted(rows: DataFrame, rates: DataFrame, max_copies: int) -> DataFrame:
    """Adds the source's columns, `_whole` copies and the `_rank` in (0, 1), null where none is left."""
    expected = F.least(F.lit(float(max_copies)), F.coalesce(F.col("_rate") * F.col("_weight"), F.lit(float(max_copies))))
    rows = rows.join(rates, "_key").withColumn("_expected", F.greatest(expected, F.lit(0.0)))
    rows = rows.withColumn("_whole", F.floor(F.col("_expected") + 1e-9))
    p = F.col("_expected") - F.col("_whole")
    odds = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
    return rows.withColumn("_rank", F.when((p > 1e-9) & (F.col("_size") > 0), odds / (1 + odds)))


def _cuts(rows: DataFrame) -> DataFrame:
    """`_key, _cut`: the last rank a source takes."""
    sliced = rows.withColumn("_slice", F.least(F.floor(F.col("_rank") * SLICES), F.lit(SLICES - 1)))
    counts = sliced.groupBy("_key", "_slice").agg(
        F.sum("_size").alias("_words"), F.sum(F.col("_size") * F.col("_whole")).alias("_given"), F.first("target").alias("target")
    )
    counts = written(counts, "mix")
    left = counts.groupBy("_key").agg((F.first("target") - F.sum("_given")).alias("_left"))
    order = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.filter("_slice IS NOT NULL").select(
        "_key", "_slice", "_words", F.coalesce(F.sum("_words").over(order), F.lit(0)).alias("_before")
    )
    # the slice in which the words still missing run out
    edge = slices.join(left, "_key").filter("_before < _left AND _left <= _before + _words")
    edge = edge.select("_key", "_slice", "_before", "_left")
    inside = sliced.select("_key", "_slice", "_rank", "_size").join(edge, ["_key", "_slice"])
    ranked = Window.partitionBy("_key").orderBy("_rank")
    taken = inside.withColumn("_sum", F.col("_before") + F.sum("_size").over(ranked.rangeBetween(Window.unboundedPreceding, 0)))
    # a document is taken if that brings the words nearer to the target
    near = F.abs(F.col("_left") - F.col("_sum")) <= F.abs(F.col("_left") - (F.col("_sum") - F.col("_size")))
    last = taken.groupBy("_key").agg(F.max(F.when(near, F.col("_rank"))).alias("_last"))
    low = edge.select("_key", (F.col("_slice") / SLICES).alias("_low"))
    some = low.join(last, "_key", "left").select("_key", F.coalesce("_last", F.col("_low")).alias("_cut"), F.col("_last").isNull().alias("_below"))
    # nothing missing: take none; more missing than there is: take all
    ends = left.join(slices.groupBy("_key").agg(F.sum("_words").alias("_all")), "_key", "left")
    ends = ends.select("_key", F.when(F.col("_left") > F.coalesce("_all", F.lit(0)), 2.0).otherwise(-1.0).alias("_end"))
    return ends.join(some, "_key", "left").select(
        "_key", F.coalesce("_cut", "_end").alias("_cut"), F.coalesce("_below", F.lit(False)).alias("_below")
    )


def _decided(rows: DataFrame, small: DataFrame, max_copies: int) -> DataFrame:
    """`rows` with `source_size, target, copies`; all statistics come from `small`."""
    rates = written(_rates(small, max_copies), "mix")
    cuts = written(_cuts(_allotted(small, rates, max_copies)), "mix")
    chosen = _allotted(rows, rates, max_copies).join(cuts, "_key")
    in_sample = F.when(F.col("_below"), F.col("_rank") < F.col("_cut")).otherwise(F.col("_rank") <= F.col("_cut"))
    return chosen.withColumn("_copies", F.col("_whole") + F.coalesce(in_sample, F.lit(False)).cast("bigint"))


def mixing_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    max_copies: int = 3, seed: int = 17,
) -> DataFrame:
    """`id, source, size, source_size, target, copies, taken` for every row of `docs`.

    taken: words the mix takes of the row, size * copies. A null or wordless text has size 0
    and is taken with the copies its source gets whole; a null source is a source of its own,
    the last. The draw depends on seed, id and size only, so reruns agree and repeated rows
    share their fate. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(column(id_col).alias("_i"), column(text_col).alias("_t"), column(source_col).alias("_source"))
    sized = _sized(rows, "_i", "_t", "_source", seed)
    small = written(sized.select("_id", "_source", "_key", "_size", "_weight", "_u"), "mix")
    rows = _decided(small, small, max_copies)
    return rows.select(
        F.col("_id").alias("id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target",
        F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    max_copies: int = 3, seed: int = 17,
) -> DataFrame:
    """The rows of `docs`, each as often as the plan takes it, with the columns of `docs`.

    Sizes are counted once for the statistics and once more on the way out, which costs less
    than shuffling texts to their decisions.
    """
    rows = packed_rows(docs, _i=column(id_col), _t=column(text_col), _s=column(source_col))
    sized = _sized(rows, "_i", "_t", "_s", seed)
    small = written(sized.select("_id", "_key", "_size", "_weight", "_u"), "mix")
    rows = _decided(sized, small, max_copies).filter("_copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select("_row.*")
