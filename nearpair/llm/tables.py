"""Tables that a job writes on its way, in the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []  # the folder of a session on one machine that names none


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's `spark.checkpoint.dir`.

    Where a session on one machine names none (tests), one is set for it; on several machines
    a missing setting is an error, as no folder of one machine would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="nearpair-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(table: DataFrame, name: str) -> DataFrame:
    """The table, written as Parquet to the shared folder and read again (lineage ends here)."""
    path = shared_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def drop_written(table: DataFrame) -> None:
    """Deletes the files of a table that `written` gave and nothing will read again."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed_rows(table: DataFrame, **more: Column) -> DataFrame:
    """The rows as structs `_row`, so that no column's name can clash, and the columns of `more`."""
    return table.select(F.struct(*[column(c) for c in table.columns]).alias("_row"), *[c.alias(k) for k, c in more.items()])


def without(table: DataFrame, name: str, values: DataFrame, broadcast_rows: int = 1 << 20) -> DataFrame:
    """The rows of `table` whose column `name` has none of the values (one bigint column). Up to
    `broadcast_rows` values (8 MB) go to every task; more are joined by a shuffle. Null is kept."""
    values = written(values.distinct().toDF("_value"), "values")
    if values.count() <= broadcast_rows:
        values = F.broadcast(values)
    return table.join(values, column(name).cast("bigint") == values["_value"], "left_anti")
