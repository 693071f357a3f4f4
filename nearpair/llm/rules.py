"""Quality rules with thresholds that follow the corpus, in SQL functions only.

Every text gets its measures. A quantile sketch of each measure for each language and source
counts texts by rounded value: exact below 64, then within 1/32 (the value's six leading bits).
Counts add up, so sketches merge: a language's is the sum of its sources', the corpus' the sum of
all. A group with fewer than LEAST texts takes the next wider one's.

The fences are q3 + max(3 * (q3 - q1), slack), for word length also q1 - max(...). The slack is a
measure's least spread, so that a group of equal texts does not reject small differences. Texts
that fail the base rules are not counted. The result joins texts and fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearpair.llm.tables import written

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST = 200  # texts of a group with fences of its own
SPREAD = 3
#: Measures, as whole numbers: the least spread, and whether low values count as well.
MEASURES = {
    "word_length": (150, True),  # characters in 100 words
    "symbols": (40, False),  # in 1,000 characters of words
    "dup_lines": (300, False),  # in 1,000 lines
    "repeats": (200, False),  # words in repeated windows, in 1,000
}


def repeated_words(words: Column, text_size: Column) -> list[tuple[str, Column]]:
    """Steps to `n_repeat_words`: words in 3-word windows found twice or more.

    A window's hash, cut to leave room, is packed with its place into one number; sorting puts
    equal windows side by side.
    """
    bits = F.length(F.bin(text_size))

    def packed(i: Column) -> Column:
        h = F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
        return F.call_function("shiftleft", F.call_function("shiftright", h, F.col("_bits")), F.col("_bits")).bitwiseOR(i.cast("bigint"))

    def same(p: Column, q: Column) -> Column:
        return F.coalesce(F.call_function("shiftright", p, F.col("_bits")) == F.call_function("shiftright", q, F.col("_bits")), F.lit(False))

    places = F.filter("_packed", lambda p, i: same(p, F.get("_packed", i - 1)) | same(p, F.get("_packed", i + 1)))
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bits")) - 1
    covered = F.aggregate(
        F.sort_array(F.transform(places, lambda p: p.bitwiseAND(low))),
        F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("bigint"), x - a["last"])).alias("n")),
    )["n"]
    windows = F.when(text_size >= 3, F.transform(F.sequence(F.lit(0), (text_size - 3).cast("int")), packed)).otherwise(F.array().cast("array<bigint>"))
    return [("_bits", bits.cast("int")), ("_packed", F.sort_array(windows)), ("n_repeat_words", covered)]


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """`id, lang, source` and the base counts of every row; a null text has no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), _key(F.col(lang_col)).alias("lang"), _key(F.col(source_col)).alias("source"), text.alias("_text"))
    bare = F.trim("_text", F.lit(SPACE))
    rows = rows.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    rows = rows.withColumn("_lines", lines).withColumn("n_words", F.size("_words").cast("bigint"))
    for name, value in repeated_words(F.col("_words"), F.col("n_words")):
        rows = rows.withColumn(name, value)
    return rows.select(
        "id", "lang", "source", "n_words",
        F.length(F.translate("_text", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("bigint").alias("n_lines"),
    )


def _key(name: Column) -> Column:
    """Never null: a null language or source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _values() -> dict[str, Column]:
    def share(part: str, whole: str, scale: int) -> Column:
        return F.expr(f"CAST({part} * {scale} div greatest({whole}, 1) AS bigint)")

    return {
        "word_length": share("word_chars", "n_words", 100),
        "symbols": share("n_symbols", "word_chars", 1000),
        "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000),
    }


def _rounded(value: str) -> Column:
    """The greatest number with the value's six leading bits and length."""
    cut = f"greatest(0, length(bin({value})) - 6)"
    return F.expr(f"shiftleft(shiftright({value}, {cut}) + 1, {cut}) - 1")


def sketches(rows: DataFrame) -> DataFrame:
    """`level, lang, source, measure, value, n`: mergeable counts. Level 0 is a language and
    source, 1 a language, 2 the corpus."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("x")) for k, v in _values().items()])
    long = rows.filter(~base_failed()).select("lang", "source", F.inline(values))
    own = long.groupBy("lang", "source", "measure", _rounded("x").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    own = written(own, "sketches").withColumn("level", F.lit(0))
    return _merged(own)


def _merged(own: DataFrame) -> DataFrame:
    wide = own.select("lang", "measure", "value", "n")
    langs = wide.groupBy("lang", "measure", "value").agg(F.sum("n").alias("n"))
    everything = wide.groupBy("measure", "value").agg(F.sum("n").alias("n"))
    columns = ["level", "lang", "source", "measure", "value", "n"]
    out = own.select(*columns).unionByName(langs.withColumns({"level": F.lit(1), "source": F.lit("")}).select(*columns))
    return out.unionByName(everything.withColumns({"level": F.lit(2), "lang": F.lit(""), "source": F.lit("")}).select(*columns))


def fences(sketch: DataFrame) -> DataFrame:
    """`level, lang, source, n, low, high`: maps from measure to fence, a row for each group."""
    group = ["level", "lang", "source", "measure"]
    order = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))

    def quantile(quarter: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("all") * quarter, F.col("value")))

    q = ranked.groupBy(*group).agg(quantile(1).alias("q1"), quantile(3).alias("q3"), F.sum("n").alias("n"))
    slack, low = F.lit(None).cast("bigint"), F.lit(False)
    for name, (least, both) in MEASURES.items():
        slack = F.when(F.col("measure") == name, F.lit(least)).otherwise(slack)
        low = F.when(F.col("measure") == name, F.lit(both)).otherwise(low)
    spread = F.greatest(SPREAD * (F.col("q3") - F.col("q1")), slack)
    q = q.withColumn("high", F.col("q3") + spread).withColumn("low", F.when(low, F.col("q1") - spread))
    return q.groupBy("level", "lang", "source").agg(
        F.max("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("measure", "high"))).alias("high"),
        F.map_from_entries(F.collect_list(F.struct("measure", "low"))).alias("low"),
    )


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST
) -> DataFrame:
    """`id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, fence_level`
    for every row of `docs`.

    kept: passes the base rules and lies within all fences; fence_level: 0 the fences of its
    language and source, 1 of its language, 2 of the corpus. Null and empty texts have no words
    and fail the base rules. A null language or source is one of its own. Rows are judged each
    for itself, ids may repeat or be null. Other columns are not read.
    """
    rows = written(measured(docs, id_col, text_col, lang_col, source_col), "measures")
    limits = written(fences(sketches(rows)), "fences")
    own = limits.filter((F.col("level") == 0) & (F.col("n") >= least)).select("lang", "source", F.struct("high", "low").alias("f0"))
    wider = limits.filter((F.col("level") == 1) & (F.col("n") >= least)).select("lang", F.struct("high", "low").alias("f1"))
    corpus = limits.filter("level = 2").select(F.lit(1).alias("one"), F.struct("high", "low").alias("f2"))
    joined = rows.withColumn("one", F.lit(1)).join(own, ["lang", "source"], "left").join(wider, "lang", "left").join(F.broadcast(corpus), "one", "left")
    joined = joined.withColumn("_f", F.coalesce("f0", "f1", "f2"))
    inside = F.lit(True)
    for name, value in _values().items():
        inside = inside & (value <= F.coalesce(F.col("_f.high")[name], F.lit(1 << 60)))
        if MEASURES[name][1]:
            inside = inside & (value >= F.coalesce(F.col("_f.low")[name], F.lit(0)))
    level = F.when(F.col("f0").isNotNull(), 0).when(F.col("f1").isNotNull(), 1).otherwise(2)
    return joined.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"), level.alias("fence_level"),
    )
