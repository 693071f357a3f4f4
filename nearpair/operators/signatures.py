"""Join keys that every matching pair has in common.

The first tokens two matching records share lie in both records' prefixes. A record
therefore emits a key per prefix token, and an equi-join on the keys finds every match.

A token that many records hold would make one large bucket and compare all its records.
Such a hot token is never a key by itself: it is paired with the second shared token, which
lies one place further at most, so the key becomes (first, second). Only records so small
that one shared token may be enough still meet on a hot token alone.

Pairing costs as many keys as the prefix is long, for each of the token's records. Sets are paired
only on tokens of more than ROWS_PAIRED times as many records as the larger set has tokens; the
smaller one makes both keys where its largest partner might not pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A token with more occurrences is paired with a second one. The pairs of a long prefix are
# many more than those of the few grams in a gram prefix, so tokens are split later.
HOT_TOKEN = 20_000
HOT_GRAM = 1_000

# A paired key is written, sorted and read; a comparison in a bucket is not.
ROWS_PAIRED = 4


def signature_keys(
    records: DataFrame,
    prefix: Column,
    least_shared: Column,
    hot_token: int = HOT_TOKEN,
    keep: tuple[str, ...] = (),
    ratio: float | None = None,
) -> DataFrame:
    """Keys of `id, n, ordered` records (ordered: (freq, token, pos) in the global order).

    `ordered` needs to reach one place beyond the prefix, no further.

    `prefix`: length of the prefix that holds the first shared token.
    `least_shared`: tokens a record shares with any partner, as implied by its size.
    Result: `id, n, key, used, last, pos1, pos2` - `used` tokens make the key, the last of
    them has rank `last`; pos1, pos2 are their positions in the text (pos2 null if one). Columns
    of `records` in `keep` follow. `ratio`: least size of a record as a share of any partner's, if
    tokens are to be paired only where that makes few keys (None: above `hot_token` always).
    """
    rows = records.select(
        "id",
        "n",
        "ordered",
        F.least(prefix, F.col("n")).cast("int").alias("_p1"),
        (F.col("n") - F.greatest(least_shared, F.lit(2)) + 2).cast("int").alias("_p2"),
        (least_shared <= 1).alias("_small"),
        *keep,
    ).filter(F.col("_p1") > 0)
    # keys come as rows, first by first token, then by second: no record holds them all at once
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("_p1"))).alias("last1"))
    rows = rows.withColumn("_first", F.get("ordered", F.col("last1") - 1))
    rows = rows.filter(_shared("_first"))
    rows = rows.select("*", F.explode(_seconds(hot_token, ratio)).alias("last2"))
    rows = rows.withColumn("_second", F.get("ordered", F.col("last2") - 1))
    alone = F.col("last2") == 0
    rows = rows.filter(alone | _shared("_second"))
    return rows.select(
        "id",
        "n",
        F.when(alone, F.xxhash64("_first.token"))
        .otherwise(F.xxhash64("_first.token", "_second.token"))
        .alias("key"),
        F.when(alone, 1).otherwise(2).alias("used"),
        F.when(alone, F.col("last1")).otherwise(F.col("last2")).alias("last"),
        F.col("_first.pos").alias("pos1"),
        F.when(~alone, F.col("_second.pos")).alias("pos2"),
        *keep,
    )


def _shared(entry: str) -> Column:
    """A token that occurs once in all tables matches nothing."""
    return F.col(f"{entry}.freq") > 1


def _seconds(hot_token: int, ratio: float | None) -> Column:
    """Ranks of the second tokens a first one is paired with; 0 is none.

    What a pair does with a token depends on the size of the larger record alone: a record as the
    larger one has its own size, as the smaller one up to its largest partner's.
    """
    first, p2, freq = F.col("last1"), F.col("_p2"), F.col("_first.freq")
    none, alone = F.array().cast("array<int>"), F.array(F.lit(0))
    paired = F.when(first < p2, F.sequence(first + 1, p2)).otherwise(none)
    hot = F.concat(F.when(F.col("_small"), alone).otherwise(none), paired)
    if ratio is None:
        return F.when(freq <= hot_token, alone).otherwise(hot)
    as_larger = freq <= F.greatest(F.lit(hot_token), ROWS_PAIRED * F.col("n"))
    as_smaller = freq <= F.greatest(F.lit(float(hot_token)), ROWS_PAIRED * (F.col("n") / ratio + 1))
    return F.when(as_larger, alone).when(as_smaller, F.concat(alone, paired)).otherwise(hot)


def rename_side(rows: DataFrame, side: str) -> DataFrame:
    """Suffix every column but `key` with _l or _r."""
    return rows.select(*[F.col(c).alias(c if c == "key" else f"{c}_{side}") for c in rows.columns])
