"""Session, tables and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A dimension is broadcast only after its rows were counted and found under this bound.
BROADCAST_ROWS = 200_000
#: And its values, written out, under this one.
BROADCAST_BYTES = 64_000_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lathe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; Parquet keeps column pruning and pushed filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
    local session without that setting gets a temporary one.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of checkpoints and of tables that loops and streams write."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lathe-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


class Rewritten:
    """A table that a loop writes anew each round, in the shared folder of the checkpoints.

    A checkpoint keeps the size that the plan was estimated to have, and joins
    multiply such estimates, so in a loop they grow beyond all measure; a table
    that is read back has the size of its files. The round before is removed
    once the next one is written.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.folder, self.round, self.df = f"{checkpoint_dir(self.spark)}/rounds-{uuid.uuid4().hex}", 0, df
        self.write(df)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.round}"
        df.write.mode("overwrite").parquet(path)
        self.df = self.spark.read.schema(df.schema).parquet(path)
        if self.round:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.round - 1}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.round += 1
        return self.df


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the side is proven small, in rows and in bytes of its values, else leave the join to AQE."""
    head = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("b"))
    n, total = head.agg(F.count(F.lit(1)), F.sum("b")).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def growing(df: DataFrame) -> DataFrame:
    """Mark a side that grows with the data: its joins sort and merge, and no estimate turns them into a broadcast."""
    return df.hint("merge")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows over three tasks a core and more: before costly functions on rows too short for AQE to keep them apart."""
    spark = df.sparkSession
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *by)


def ranked_within(df: DataFrame, keys: list[str], order: list, slice_by, out: str = "rank") -> DataFrame:
    """Row number (from 1) within ``keys`` without one task per key.

    ``slice_by`` is an expression that follows ``order`` (equal slices are
    adjacent in it, and later slices sort later), so that a hot key is cut into
    slices: rows are numbered inside (key, slice) and shifted by the running
    count of the key's earlier slices. Only the slice counts meet in one window
    per key. Nulls in keys form a group of their own.
    """
    s = "__slice"
    df = df.withColumn(s, slice_by)
    sizes = df.groupBy(*keys, s).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    on = None
    left, right = df.alias("l"), sizes.alias("r")
    for k in [*keys, s]:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        on = c if on is None else on & c
    joined = left.join(right, on, "inner").select("l.*", "r.__before")
    within = Window.partitionBy(*keys, s).orderBy(*order)
    return joined.withColumn(out, F.col("__before") + F.row_number().over(within)).drop(s, "__before")


def previous_within(df: DataFrame, keys: list[str], order: list[str], slice_by: Column, values: list[str], out: str = "previous") -> DataFrame:
    """Add ``out``: a struct of ``values`` of the row before in a key's order, null for the first one.

    ``slice_by`` follows the order, as in ``ranked_within``: the row before is
    looked for inside (key, slice), and the first row of a slice gets the last
    one of the key's slice before. Null keys are one key.
    """
    s = "__slice"
    df = df.withColumns({s: slice_by, "__v": F.struct(*values)})
    lasts = df.groupBy(*keys, s).agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    lasts = lasts.withColumn("__carried", F.lag("__last").over(Window.partitionBy(*keys).orderBy(s))).drop("__last")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, s]]
    joined = df.alias("l").join(lasts.alias("r"), on).select("l.*", "r.__carried")
    within = Window.partitionBy(*keys, s).orderBy(*order)
    first = F.row_number().over(within) == 1
    return joined.withColumn(out, F.when(first, F.col("__carried")).otherwise(F.lag("__v").over(within))).drop(s, "__v", "__carried")
