"""Joins that the engine's queries need beside the built-in ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.session import cut, growing

#: Share of the rows from which a key is hot; so at most 64 keys are.
HOT_SHARE = 1 / 64
#: Rows that no task minds, so fewer are never hot.
LEAST_HOT = 1000


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str], slice_by=None) -> DataFrame:
    """Left rows with the values of the latest right row of the key at or before them.

    One union, shuffled and sorted once by key and slice (days of the time,
    unless ``slice_by`` makes other slices of a column), so a hot key is spread
    over its slices; what a slice starts with is carried from the last right row
    of the slices before, one row each. Of right rows at the same time the
    greatest values win. Left rows without an earlier right row, or without a
    time, get nulls. Null keys match each other.
    """
    cols = left.columns
    whole = dict(left.dtypes)[at] in ("int", "bigint", "double", "float")
    cut_by = slice_by or ((lambda c: F.floor(c / 86_400)) if whole else F.to_date)
    packed = F.struct(*[F.col(v) for v in values])
    kind = right.select(packed).schema[0].dataType
    l = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__v"), F.struct(*cols).alias("__row"))  # noqa: E741
    r = right.where(F.col(right_at).isNotNull()).groupBy(*keys, F.col(right_at).alias("__at")).agg(F.max(packed).alias("__v"))
    both = r.select(*keys, "__at", F.lit(0).alias("__side"), "__v", F.lit(None).cast(l.schema["__row"].dataType).alias("__row")).unionByName(l).withColumn("__slice", cut_by(F.col("__at")))
    ends = both.groupBy(*keys, "__slice").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col("__at"))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"e.{k}")) for k in [*keys, "__slice"]]
    placed = both.alias("b").join(ends.alias("e"), on).select("b.*", "e.__carried")
    w = Window.partitionBy(*keys, "__slice").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col("__at").isNotNull(), F.coalesce(F.last("__v", ignorenulls=True).over(w), F.col("__carried")))
    out = placed.withColumn("__v", found).where("__side = 1")
    return out.select("__row.*", *[F.col(f"__v.{v}").alias(v) for v in values])


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: int, a_from: str, a_to: str, b_from: str, b_to: str) -> DataFrame:
    """Pairs of rows of equal keys whose closed integer ranges overlap.

    Ranges are cut into cells of ``width``, an equality join on the cell finds
    the pairs, and each is kept in the first cell that both share. Rows with a
    null bound never overlap. Columns of ``a`` and ``b`` must differ but for keys.
    """
    cell = lambda x: F.floor(F.col(x) / width).cast("long")
    x = a.where(F.col(a_from) <= F.col(a_to)).withColumn("__cell", F.explode(F.sequence(cell(a_from), cell(a_to))))
    y = b.where(F.col(b_from) <= F.col(b_to)).withColumn("__cell", F.explode(F.sequence(cell(b_from), cell(b_to))))
    both = x.join(y, [*keys, "__cell"]).where((F.col(a_from) <= F.col(b_to)) & (F.col(b_from) <= F.col(a_to)))
    return both.where(F.col("__cell") == F.greatest(cell(a_from), cell(b_from))).drop("__cell")


def all_keys_present(wanted: DataFrame, have: DataFrame, owner: str, item: str, key: str) -> DataFrame:
    """(owner, item): owners all of whose distinct wanted keys an item has (relational division)."""
    w = wanted.select(owner, key).distinct()
    need = w.groupBy(owner).agg(F.count(F.lit(1)).alias("need"))
    met = w.join(have.select(item, key).distinct(), key).groupBy(owner, item).agg(F.count(F.lit(1)).alias("met"))
    return met.join(need, owner).where("met = need").select(owner, item)


def salted(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equality join in which each key of the left side is spread over ``salts`` tasks and the right side repeated."""
    l = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if not c.startswith("__")]), F.lit(salts)).cast("int"))  # noqa: E741
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*keys, "__salt"], how).drop("__salt")


def skewed(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Equality join with a side of one row a key, in which no key is one task's work.

    ``n`` is the column of ``right``, or of ``counts`` (keys, n), with the number
    of left rows of a key. Keys with more than ``HOT_SHARE`` of them, 64 at most,
    are joined by broadcast where their rows lie; all others sort and merge.
    ``how`` is inner or left. The side with the numbers is written once; with hot
    keys both sides are read twice, so they should be tables or checkpoints.
    """
    if counts is None:
        right = counts = cut(right)
    total, top = counts.agg(F.sum(n), F.max(n)).first()
    least = max((total or 0) * HOT_SHARE, LEAST_HOT)
    if not total or top <= least:
        return left.join(growing(right), keys, how)
    hot = F.broadcast(counts.where(F.col(n) > least).select(*keys))  # at most 1 / HOT_SHARE rows
    cold = left.join(hot, keys, "left_anti").join(growing(right.join(hot, keys, "left_anti")), keys, how)
    return left.join(F.broadcast(right.join(hot, keys, "left_semi")), keys).unionByName(cold)
