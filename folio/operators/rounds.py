"""What operators that go round after round share: a table between the rounds, which executors that are lost don't cost."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

PART_ROWS = 1 << 18  # of a task, about


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that the driver and all executors see: below spark.checkpoint.dir, or else the warehouse's."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parts_for(spark: SparkSession, rows: int) -> int:
    """How many tasks so many rows are for: the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def spread(df: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """df dealt by these columns to tasks whose number grows with the table, so what a task sorts doesn't. Windows, groups and joins by these
    columns, or more, need no other exchange. The rows are counted first, unless their parts are given."""
    return df.repartition(parts or parts_for(df.sparkSession, df.count()), *by)


def by_task(df: DataFrame) -> DataFrame:
    """df as the side of a join that tasks hold, each its part. A table of a row a stretch or a document takes a byte or so a row in its files,
    so Spark holds it to be small at sizes at which its rows, sent whole by way of the driver, are not."""
    return df.hint("shuffle_hash")


def written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, parts: int, name: str, by: list[str]) -> DataFrame:
    """df, dealt by these columns to so many tasks, as a table with a bucket for each: windows, groups and joins by them need no exchange."""
    path = new_folder(df.sparkSession, name)
    called = f"{name}_{path[-32:]}"
    df.write.bucketBy(parts, *by).option("path", path).option("compression", "zstd").saveAsTable(called, format="parquet")
    return df.sparkSession.table(called)
