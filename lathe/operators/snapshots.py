"""What changed between full snapshots: validity intervals by gaps and islands.

Every complete scan of a store key gets its place in time (``seq``). A key's
rows with the same content hash in adjacent scans form an island, that is an
interval of validity; interval starts, ends and adjacencies are the change
events. Two shuffles carry the stored rows: by scan to learn the place in time,
and by store key and job, which then serves the correction of duplicates, the
islands and the comparison. No key of a store alone is ever one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.session import cut, growing, ranked_within

STORE = ["store_id", "source_kind", "source_instance"]


def canonical(c: Column | str) -> Column:
    """Letter case and blanks around a value mean nothing; a blank one is absent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), F.lit(""))


def complete_scans(scans: DataFrame) -> DataFrame:
    """(scan_id, store, seq, next_scan_id, close_ids) of the complete scans.

    ``store`` stands for the store key: the least of its scan ids. Scans delivered twice count once; equal ``started_at`` go by ``scan_id``.
    The place in time is counted by day slices, so that a source with a third
    of all scans is still spread over many tasks.
    """
    one = (
        scans.where("complete AND scan_id IS NOT NULL")
        .groupBy("scan_id")
        .agg(F.max(F.struct("started_at", *STORE, "close_ids")).alias("s"))
        .select("scan_id", *[F.col(f"s.{c}").alias(c) for c in ("started_at", *STORE, "close_ids")])
    )
    stores = one.groupBy(*STORE).agg(F.min("scan_id").alias("store"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in STORE]
    keyed = one.alias("a").join(stores.alias("b"), on).select("scan_id", "started_at", "close_ids", "store")
    ranked = ranked_within(keyed, ["store"], ["started_at", "scan_id"], F.to_date("started_at"), "seq")
    after = ranked.select("store", (F.col("seq") - 1).alias("seq"), F.col("scan_id").alias("next_scan_id"))
    return ranked.join(after, ["store", "seq"], "left").select("scan_id", "store", F.col("seq").cast("int").alias("seq"), "next_scan_id", "close_ids")


def dumps(stored: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per complete scan and job: the latest loaded one, ties by content.

    Digests are only ever compared, so eight bytes stand for each in the shuffles.
    """
    placed = cut(complete_scans(scans))  # read twice below, and small beside the dumps
    rows = stored.select(
        "scan_id", "job_id", "loaded_at",
        F.coalesce(canonical("status"), F.lit("")).alias("status"),
        *[F.when(canonical(c).isNotNull(), F.xxhash64(canonical(c))).alias(a) for c, a in (("fingerprint", "fp"), ("content_fingerprint", "cfp"))],
    ).where("scan_id IS NOT NULL AND job_id IS NOT NULL")
    loaded = rows.join(growing(placed.drop("close_ids")), "scan_id").withColumn(
        "row", F.struct("loaded_at", "status", "fp", "cfp")
    ).drop("loaded_at", "status", "fp", "cfp").withColumn("closes", F.lit(False))
    # The plan's closings ride along as marker rows; so one aggregation replaces a join.
    closings = placed.select("*", F.explode("close_ids").alias("job_id")).drop("close_ids").where("job_id IS NOT NULL").withColumns(
        {"row": F.lit(None).cast(loaded.schema["row"].dataType), "closes": F.lit(True)}
    )
    both = loaded.unionByName(closings).repartition("store", "job_id")
    return (
        both.groupBy("store", "job_id", "seq", "scan_id", "next_scan_id")
        .agg(F.max("row").alias("row"), F.max("closes").alias("closes"))
        .where("row IS NOT NULL")
        .select(
            "store", "job_id", "seq", "scan_id", "next_scan_id",
            F.when(F.col("closes"), F.lit("closed")).otherwise(F.col("row.status")).alias("status"),
            F.col("row.fp").alias("fp"), F.col("row.cfp").alias("cfp"),
        )
    )


def validity_intervals(dump: DataFrame) -> DataFrame:
    """Islands of equal content in adjacent scans, with the scan that follows each."""
    by_job = Window.partitionBy("store", "job_id").orderBy("seq")
    content = F.xxhash64("status", "fp", F.lit(","), "cfp", F.col("cfp").isNull())
    marked = dump.withColumn("content", content)
    starts = (F.lag("seq").over(by_job).isNull()) | (F.lag("seq").over(by_job) != F.col("seq") - 1) | (F.lag("content").over(by_job) != F.col("content"))
    marked = marked.withColumn("starts", starts.cast("int"))
    marked = marked.withColumn("island", F.sum("starts").over(by_job.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("store", "job_id", "island").agg(
        F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"),
        F.min_by("scan_id", "seq").alias("first_scan_id"), F.max_by("next_scan_id", "seq").alias("next_scan_id"),
        F.first("status").alias("status"), F.first("fp").alias("fp"), F.first("cfp").alias("cfp"),
    )


def changes(stored: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, job_id, change) between each complete scan and the one before it.

    ``change`` is the first that fits of added, removed, closed / reopened,
    changed and refreshed. A first scan has no changes; a complete scan without
    rows removes every job; an unknown scan's rows and null ids are left out;
    a null status counts as a status of its own. Extra columns are ignored.
    """
    by_job = Window.partitionBy("store", "job_id").orderBy("from_seq")
    iv = validity_intervals(dumps(stored, scans))
    was = F.struct(F.lag("to_seq").over(by_job).alias("to"), *[F.lag(c).over(by_job).alias(c) for c in ("status", "fp", "cfp")])
    iv = iv.withColumn("was", was).withColumn("after", F.lead("from_seq").over(by_job))
    adjacent = F.coalesce(F.col("was.to") == F.col("from_seq") - 1, F.lit(False))
    both = F.col("cfp").isNotNull() & F.col("was.cfp").isNotNull()
    one = F.col("cfp").isNull() != F.col("was.cfp").isNull()
    event = (
        F.when(~adjacent, F.when(F.col("from_seq") > 1, F.lit("added")))
        .when(F.col("status") != F.col("was.status"), F.when(F.col("status") == "closed", F.lit("closed")).otherwise(F.lit("reopened")))
        .when(both & (F.col("cfp") != F.col("was.cfp")), F.lit("changed"))
        .when(~F.col("fp").eqNullSafe(F.col("was.fp")) | one, F.lit("refreshed"))
    )
    ends = F.col("next_scan_id").isNotNull() & (F.col("after").isNull() | (F.col("after") != F.col("to_seq") + 1))
    found = F.array(
        F.struct(F.col("first_scan_id").alias("scan_id"), event.alias("change")),
        F.struct(F.col("next_scan_id").alias("scan_id"), F.when(ends, F.lit("removed")).alias("change")),
    )
    return iv.select("job_id", F.explode(found).alias("e")).where("e.change IS NOT NULL").select("e.scan_id", "job_id", "e.change")
