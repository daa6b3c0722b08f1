"""Writing tables: appended events, replaced partitions, numbered snapshots. All may be repeated without harm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.session import cut


def append_events(df: DataFrame, folder: str, key: str, at: str) -> int:
    """Append the events whose key is not stored yet, by day; returns how many.

    An event keeps its time, so only the days of the new rows are looked through.
    """
    spark = df.sparkSession
    new = cut(df.dropDuplicates([key]).withColumn("day", F.to_date(at)))
    first, last = new.agg(F.min("day"), F.max("day")).first()
    try:
        stored = spark.read.parquet(folder).where(F.col("day").between(F.lit(first), F.lit(last)) | F.col("day").isNull())
        stored = stored.join(F.broadcast(new.select("day").distinct()), stored["day"].eqNullSafe(new["day"]), "left_semi").select(key)  # days of one append
        new = new.join(stored.distinct(), key, "left_anti")
    except Exception as e:  # the folder is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = cut(new)
    new.write.mode("append").partitionBy("day").parquet(folder)
    return new.count()


def replace_partitions(df: DataFrame, folder: str, by: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def write_snapshot(df: DataFrame, folder: str, version: int) -> None:
    """Write one version of a table; readers of other versions never see it change."""
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of a table, or the last."""
    if version is not None:
        return spark.read.parquet(f"{folder}/version={version}")
    df = spark.read.parquet(folder)
    last = df.agg(F.max("version")).first()[0]
    return df.where(F.col("version") == last).drop("version")
