"""The store of job records as one object: reads by key, histories, and scans applied to it.

A store is a folder of versions; each change writes a new version, so readers
of an older one never see it change. Every method returns a DataFrame and
collects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.text import has_terms, search_document
from lathe.operators import ledger, lifecycle, selection
from lathe.session import cut
from lathe.sources import sinks

STATE = ["source", "job_id", "status", "fingerprint", "content_fingerprint", "content_updated_at", "last_seen_at"]


class StaleVersion(ValueError):
    """The store has moved on since the version that a change was based on."""


class JobRepository:
    """Jobs (source, job_id, status, digests, times) with the events of every applied scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def version(self) -> int:
        """The last version, or -1 of an empty store."""
        try:
            return self.spark.read.parquet(f"{self.folder}/jobs").agg(F.max("version")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return -1
            raise

    def jobs(self, version: int | None = None) -> DataFrame:
        last = self.version() if version is None else version
        if last < 0:
            kinds = "source string, job_id string, status string, fingerprint string, content_fingerprint string, content_updated_at timestamp, last_seen_at timestamp"
            return self.spark.createDataFrame([], kinds)
        return sinks.read_snapshot(self.spark, f"{self.folder}/jobs", last).select(*STATE)

    def get(self, keys: DataFrame) -> DataFrame:
        """Jobs of the given job_ids, each once however often it was asked for."""
        return self.jobs().join(keys.select("job_id"), "job_id", "left_semi")

    def resolve(self, prefix: str) -> DataFrame:
        """(matches, only): how many job_ids begin so, and the one if it is the only one."""
        return selection.by_prefix(self.jobs(), "job_id", prefix)

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/events")

    def histories(self, keys: DataFrame) -> DataFrame:
        """Events of the given job_ids with their place in each job's history."""
        mine = self.events().join(keys.select("job_id"), "job_id", "left_semi")
        return ledger.history(mine, ["source", "job_id"], ["version", "action"], F.col("version"))

    def apply_scan(self, incoming: DataFrame, source: str, at: Column, closes: bool, retain: DataFrame | None = None, expected: int | None = None) -> int:
        """Apply one scan of a source (job_id, fingerprint, content_fingerprint); returns the new version.

        Only the source's rows change. ``closes`` says whether absent jobs may be
        closed, ``retain`` has job_ids that stay open. With ``expected`` a store
        that has another version refuses.
        """
        version = self.version()
        if expected is not None and expected != version:
            raise StaleVersion(f"expected version {expected}, the store has {version}")
        now = self.jobs(version) if version >= 0 else self.jobs()
        mine, others = now.where(F.col("source") == source), now.where(F.col("source") != source)
        listed = cut(incoming.dropDuplicates(["job_id"]).withColumn("source", F.lit(source)).select("source", "job_id", "fingerprint", "content_fingerprint"))
        keep = None if retain is None else retain.select(F.lit(source).alias("source"), "job_id")
        plan = cut(lifecycle.plan_scan(mine, listed, None if closes else F.lit(False), keep, ("source", "job_id")))
        after = ledger.applied(plan, mine, listed, ["source", "job_id"], at)
        sinks.write_snapshot(others.unionByName(after.select(*STATE)), f"{self.folder}/jobs", version + 1)
        said = plan.where("action NOT IN ('unchanged', 'kept')").withColumn("version", F.lit(version + 1))
        said.write.mode("append").parquet(f"{self.folder}/events")
        return version + 1

    def query(self, records: DataFrame, terms: str = "", sources: list[str] | None = None, statuses: list[str] | None = None, seen_since: Column | None = None) -> DataFrame:
        """Records (source, title, company, location, status, last_seen_at) by search terms, sources, statuses and recency; what is not given holds for all."""
        out = records
        if terms:
            out = out.where(has_terms(search_document("title", "company", "location"), terms))
        if sources is not None:
            out = out.where(F.col("source").isin(sources))
        if statuses is not None:
            out = out.where(F.col("status").isin(statuses))
        return out if seen_since is None else out.where(F.col("last_seen_at") >= seen_since)

    def export(self, path: str) -> None:
        """The state as JSON lines, in as many files as tasks; ``load`` reads it back."""
        self.jobs().write.mode("overwrite").option("ignoreNullFields", "false").json(path)

    def load(self, path: str) -> int:
        """Replace the state by an exported one; returns the new version."""
        version = self.version() + 1
        sinks.write_snapshot(self.spark.read.schema(self.jobs().schema).json(path), f"{self.folder}/jobs", version)
        return version
