"""Record sources and the pair sink. A record is `id BIGINT, text STRING`."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: monotonically_increasing_id keeps the row number in its low 33 bits.
_ROW_BITS = 33


def with_row_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Add dense ids 0..n-1 in partition order.

    One narrow counting pass over `rows` plus a broadcast of one offset per partition; the
    rows themselves are not shuffled. `rows` must be a stable read (a file scan), as it is
    evaluated twice.
    """
    numbered = rows.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright(F.col("_mid"), _ROW_BITS)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # an unpartitioned window is fine here: it sees one row per input partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    in_part = F.col("_mid") - F.shiftleft(part, _ROW_BITS)
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(id_col, F.col("_offset") + in_part)
        .select(id_col, *[c for c in rows.columns if c != id_col])
    )


def records_from_columns(
    rows: DataFrame, id_col: str | None = None, columns: list[str] | None = None, sep: str = ","
) -> DataFrame:
    """One record per row: the named columns (all but the id by default) joined by `sep`.

    Null columns become empty text. Without `id_col`, dense row ids are assigned.
    """
    columns = columns or [c for c in rows.columns if c != id_col]
    text = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    if id_col is None:
        return with_row_ids(rows.select(text.alias("text")))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))


def read_csv_records(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = False,
    infer: bool = False,
    id_col: str | None = None,
    quote: str = '"',
    escape: str = '"',
    multi_line: bool = False,
) -> DataFrame:
    """Records from a delimited file. Values stay as written unless `infer` is set.

    `multi_line` reads quoted values with line breaks; such a file is read by one task.
    """
    rows = spark.read.csv(
        path, sep=sep, header=header, inferSchema=infer, quote=quote, escape=escape, multiLine=multi_line
    )
    return records_from_columns(rows, id_col=id_col, sep=sep)


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a pair table as parquet or csv (quotes doubled), one file per task."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"format must be parquet or csv, got {fmt!r}")
    writer = pairs.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True, escape='"')
    else:
        writer.parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below the cluster's `spark.checkpoint.dir`.

    Without the setting it is an error on a cluster; a session on one machine gets a temporary
    folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="nearpair-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
