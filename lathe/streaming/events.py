"""Structured Streaming over event records: windows with late data, state folds, snapshot merges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lathe.operators.ledger import applied
from lathe.operators.lifecycle import plan_scan
from lathe.session import checkpoint_dir, cut


def _watched(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs a time with a zone; a finished table stays as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, event_type, n_events, sum_value) of tumbling windows; rows later than ``late`` are dropped by the watermark in a stream."""
    timed = _watched(events, late)
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 2).alias("sum_value"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n_events", "sum_value")


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event id once within the watermark."""
    timed = _watched(events, late)
    return timed.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])


def fold_state(events: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(user_id, furthest, last_type, n_events) as a running fold: one updated row for each user of a batch.

    ``ranks`` orders the event types; state is five values a user, so a user
    with a third of all events still keeps a constant state. Of events at one
    instant the one of the greatest id is the last, in whatever batch it came.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        furthest, last, at, last_id, n = state.get if state.exists else (-1, "", -(2**62), -(2**62), 0)
        for b in batches:
            n += len(b)
            furthest = max([furthest, *(ranks.get(t, -1) for t in b["event_type"])])
            micros = b["ts"].astype("datetime64[us]").astype("int64")
            k = max(range(len(b)), key=lambda i: (micros.iloc[i], b["event_id"].iloc[i]))
            now = (int(micros.iloc[k]), int(b["event_id"].iloc[k]))
            if now >= (at, last_id):
                (at, last_id), last = now, b["event_type"].iloc[k]
        state.update((int(furthest), str(last), int(at), int(last_id), int(n)))
        yield pd.DataFrame({"user_id": [key[0]], "furthest": [int(furthest)], "last_type": [last], "n_events": [int(n)]})

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, furthest int, last_type string, n_events long", "furthest int, last string, at long, last_id long, n long", "update", GroupStateTimeout.NoTimeout
    )


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The files of a table as a stream, in the order in which they arrived."""
    path = f"{folder}/{name}.parquet"
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).isDirectory():  # one file: the folder is watched for it
        return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has said once all that was there is read: its last table in complete mode, else all rows of its batches.

    Batches and offsets are written beside the checkpoints; a batch that is run
    again replaces its own rows.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)


def batch_fold(events: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """``fold_state`` over a finished table, by one partial aggregation."""
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col("event_type")]
    agg = events.groupBy("user_id").agg(F.max(F.coalesce(rank, F.lit(-1))).alias("furthest"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("n_events"))
    return agg


STATE = "source string, job_id string, status string, fingerprint string, content_fingerprint string, content_updated_at timestamp, last_seen_at timestamp"
#: Folders that a source's state is spread over; a batch rewrites only those of its sources.
BUCKETS = 64


def merge_scans(scans: DataFrame, dumps, folder: str, checkpoint: str, buckets: int = BUCKETS):
    """Query that applies each scan of a stream to a stored state, writing the actions of each.

    ``scans`` is the stream of finished scans: (scan_id, source, at, closes,
    retain), where ``closes`` says whether the scan may close what it lacks and
    ``retain`` lists jobs that it named but could not read. ``dumps(spark)`` is
    the table of their rows (scan_id, job_id, fingerprint, content_fingerprint).
    A scan's rows are read whole with it, so how many scans a batch holds never
    closes a job, and a job that came without a digest is present all the same.
    Several scans of one source in a batch are applied in the order of their
    time. State and actions of a batch are folders of its own number and a
    bucket's state is the one of its last batch, so a batch may be run again,
    and sources that it does not touch are not written.
    """

    def before(spark, number: int) -> DataFrame:
        try:
            df = spark.read.schema(STATE + ", batch long, bucket int").parquet(f"{folder}/state").where(F.col("batch") < number)
        except AnalysisException:
            return spark.createDataFrame([], STATE + ", batch long, bucket int")
        last = df.select("batch", "bucket").distinct().groupBy("bucket").agg(F.max("batch").alias("batch"))
        return df.join(F.broadcast(last), ["bucket", "batch"], "left_semi")  # one row a bucket

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int")
        turn = F.row_number().over(Window.partitionBy("source").orderBy("at", "scan_id"))  # scans of one source in one batch
        due = cut(batch.dropDuplicates(["scan_id"]).withColumns({"turn": turn, "bucket": bucket}))
        turns = due.agg(F.max("turn")).first()[0]
        if not turns:
            return
        at_hand = due.select("bucket").distinct()
        state = cut(before(spark, number).join(F.broadcast(at_hand), "bucket", "left_semi").drop("batch", "bucket"))  # one row a bucket
        for k in range(1, turns + 1):
            now = due.where(F.col("turn") == k)
            rows = dumps(spark).join(now.select("scan_id", "source", "at"), "scan_id").where("job_id IS NOT NULL")
            incoming = cut(rows.groupBy("source", "job_id", "at").agg(F.max_by(F.struct("fingerprint", "content_fingerprint"), F.struct("fingerprint", "content_fingerprint")).alias("d")).select("source", "job_id", "at", "d.*"))
            stored = state.join(now.select("source"), "source", "left_semi")
            held = now.select("source", F.explode("retain").alias("job_id"))
            shut = stored.join(now.where("NOT coalesce(closes, false)").select("source"), "source", "left_semi").select("source", "job_id")
            plan = plan_scan(stored, incoming, keep=held.unionByName(shut), keys=("source", "job_id")).join(now.select("source", "at"), "source")
            after = cut(applied(plan, stored, incoming.drop("at"), ["source", "job_id"], F.col("at")))
            after.join(now.select("source", "scan_id"), "source").select("source", "scan_id", "job_id", "action").write.mode("overwrite").parquet(f"{folder}/actions/batch={number}/turn={k}")
            state = cut(state.join(now.select("source"), "source", "left_anti").unionByName(after.drop("action")))
        state.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/batch={number}")

    return scans.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state after the last batch: of each bucket the rows of its last one."""
    df = spark.read.schema(STATE + ", batch long, bucket int").parquet(f"{folder}/state")
    last = df.select("batch", "bucket").distinct().groupBy("bucket").agg(F.max("batch").alias("batch"))
    return df.join(F.broadcast(last), ["bucket", "batch"], "left_semi").drop("batch", "bucket")  # one row a bucket
