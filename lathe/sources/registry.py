"""The registry of sources, its rules, and what a source must offer."""

from __future__ import annotations

import tomllib
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.sources import boards, pages

REGISTRY = "kind string, instance string, status string, company string, added_at string, note string"
#: Statuses that a person decided; a found entry never replaces them.
DECIDED = ["active", "unhealthy", "disabled"]


class Source(Protocol):
    """A board system: recorded listings (source_instance, body) to postings in ``boards.POSTING``."""

    def __call__(self, listings: DataFrame) -> DataFrame: ...


SOURCES: dict[str, Source] = {"ashby": boards.ashby, "greenhouse": boards.greenhouse, "lever": boards.lever, "yc": pages.yc}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a registry file in TOML, each source once; a configuration file, so it is read by the driver."""
    entries = read_toml(spark, path, "sources", REGISTRY)
    if entries.groupBy("kind", "instance").count().where("count > 1").count():
        raise ValueError("a source is in the registry more than once")
    return entries


def read_toml(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """An array of tables of a TOML file, such as fixtures, as rows of a schema of strings; a small file, read by the driver."""
    with open(path, "rb") as f:
        entries = tomllib.load(f).get(name, [])
    columns = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(None if e.get(c) is None else str(e[c]) for c in columns) for e in entries], schema)


def upserted(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The registry with found entries added; they replace entries of their source that nobody has decided on."""
    cols = [c for c in registry.columns if c not in ("kind", "instance")]
    new = found.groupBy("kind", "instance").agg(F.max(F.struct(*cols)).alias("n"))
    both = registry.select("kind", "instance", F.struct(*cols).alias("o")).join(new, ["kind", "instance"], "full_outer")
    kept = F.col("n").isNull() | F.coalesce(F.col("o.status").isin(DECIDED), F.lit(False))
    return both.select("kind", "instance", *[F.when(kept, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in cols])


def configured(registry: DataFrame) -> DataFrame:
    """(source_kind, source_instance) of the entries that are read."""
    return registry.where(F.col("status").isin("active", "validated") & F.col("kind").isin(list(SOURCES))).select(F.col("kind").alias("source_kind"), F.col("instance").alias("source_instance"))


def responses(fetched: DataFrame) -> DataFrame:
    """Recorded answers (source_instance, status, validator, body) with their ``outcome``: batch, not_modified, not_found or failed."""
    s = F.col("status")
    outcome = F.when(s == 304, "not_modified").when(s.isin(404, 410), "not_found").when(s.between(200, 299) & F.col("body").isNotNull(), "batch").otherwise("failed")
    return fetched.withColumn("outcome", outcome)


def batch_counts(valid: DataFrame, rejected: DataFrame, listed: DataFrame) -> DataFrame:
    """(source_instance, received, normalized, rejected, skipped): what became of a listing's records; repeated ones were skipped."""
    n = lambda df, c: df.groupBy("source_instance").agg(F.count(F.lit(1)).alias(c))
    out = n(listed, "received").join(n(valid, "normalized"), "source_instance", "left").join(n(rejected, "rejected"), "source_instance", "left").na.fill(0, ["normalized", "rejected"])
    return out.withColumn("skipped", F.col("received") - F.col("normalized") - F.col("rejected"))


def expired(valid_through: Column | str, now: Column) -> Column:
    """Whether a linked-data posting's last day is over; a date counts until its end, no date never."""
    c = F.col(valid_through) if isinstance(valid_through, str) else valid_through
    end = F.when(F.length(F.trim(c)) == 10, F.trim(c).try_cast("timestamp") + F.expr("INTERVAL 1 DAY")).otherwise(F.trim(c).try_cast("timestamp"))
    return F.coalesce(end <= now, F.lit(False))
