"""Stored state against incoming scans: actions, events, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.session import previous_within


def plan_scan(stored: DataFrame, incoming: DataFrame, closes: Column | None = None, keep: DataFrame | None = None, keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """(keys, action) of one full-outer join on the keys.

    ``stored`` has the keys, status, fingerprint and content_fingerprint,
    ``incoming`` the keys and both digests, each key once; in a table without
    content digests the fingerprints stand for them, a null one as any other. Actions: new; reopened (closed
    before); updated (another content); refreshed (same content, another
    fingerprint, or a content digest learned first); unchanged; closed (open,
    absent, ``closes`` holds and not in ``keep``); kept (absent otherwise).
    A stored row without a content digest takes the incoming one as its first.
    """
    keys = list(keys)
    digests = "content_fingerprint" in stored.columns
    content = lambda df: F.col("content_fingerprint") if digests else F.coalesce("fingerprint", F.lit(""))
    s = stored.select(*keys, F.struct("status", "fingerprint", content(stored).alias("content")).alias("s"))
    i = incoming.select(*keys, F.struct("fingerprint", content(incoming).alias("content")).alias("i"))
    rows = s.join(i, keys, "full_outer")
    if keep is not None:
        rows = rows.join(keep.select(*keys, F.lit(True).alias("held")).distinct(), keys, "left")
    else:
        rows = rows.withColumn("held", F.lit(None).cast("boolean"))
    closing = F.lit(True) if closes is None else F.coalesce(closes, F.lit(False))
    was, now = F.col("s").isNotNull(), F.col("i").isNotNull()
    same = F.col("s.content").isNull() | F.col("s.content").eqNullSafe(F.col("i.content"))
    action = (
        F.when(~was, "new").when(now & (F.col("s.status") == "closed"), "reopened").when(now & ~same, "updated")
        .when(now & (~F.col("s.fingerprint").eqNullSafe(F.col("i.fingerprint")) | F.col("s.content").isNull()), "refreshed").when(now, "unchanged")
        .when((F.col("s.status") == "open") & closing & F.col("held").isNull(), "closed").otherwise("kept")
    )
    return rows.select(*keys, action.alias("action"))


def latest_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order; planned as a window group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def latest_and_latest_successful(df: DataFrame, key: str, at: str, tie: str, ok: Column, value: str) -> DataFrame:
    """One aggregation for both: the latest value of a key, and the latest among the successful."""
    order = F.struct(at, tie)
    return df.groupBy(key).agg(F.max_by(value, order).alias("latest"), F.max_by(value, F.when(ok, order)).alias("latest_ok"))


def value_changes(df: DataFrame, keys: list[str], order: list[str], slice_by: Column, value: str, out: str = "change") -> DataFrame:
    """first, unchanged, changed, new or removed against the value before, which is found by slices of the order."""
    df = previous_within(df, keys, order, slice_by, [value])
    before = F.col(f"previous.{value}")
    change = F.when(F.col("previous").isNull(), "first").when(F.col(value).eqNullSafe(before), "unchanged").when(before.isNull(), "new").when(F.col(value).isNull(), "removed").otherwise("changed")
    return df.withColumn(out, change).drop("previous")


def append_new(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose key is not stored yet, each key once: an idempotent insert."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep_when_null: list[str] = ()) -> DataFrame:
    """Stored rows replaced by incoming ones of the same key; named columns keep the old value where the new is null."""
    cols = [c for c in stored.columns if c not in keys]
    s, i = stored.alias("s"), incoming.alias("i")
    on = [F.col(f"s.{k}") == F.col(f"i.{k}") for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    is_new = F.col(f"i.{keys[0]}").isNotNull()
    picked = [F.coalesce(F.col(f"i.{c}"), F.col(f"s.{c}")).alias(c) if c in keep_when_null else F.when(is_new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in cols]
    return s.join(i, cond, "full_outer").select(*[F.coalesce(F.col(f"i.{k}"), F.col(f"s.{k}")).alias(k) for k in keys], *picked)


def merge_three_way(base: DataFrame, local: DataFrame, remote: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, value, side): field by field, a side that alone changed wins; where both did, the later by ``at``."""
    b = base.select(*keys, F.col("value").alias("vb"))
    x = local.select(*keys, F.col("value").alias("vl"), F.col(at).alias("al"), F.lit(True).alias("hl"))
    y = remote.select(*keys, F.col("value").alias("vr"), F.col(at).alias("ar"), F.lit(True).alias("hr"))
    j = x.join(y, keys, "full_outer").join(b, keys, "left")
    moved_l, moved_r = F.col("hl").isNotNull() & ~F.col("vl").eqNullSafe(F.col("vb")), F.col("hr").isNotNull() & ~F.col("vr").eqNullSafe(F.col("vb"))
    side = F.when(moved_l & ~moved_r, "local").when(moved_r & ~moved_l, "remote").when(F.col("hr").isNull(), "local").when(F.col("hl").isNull(), "remote").when(F.col("al") > F.col("ar"), "local").otherwise("remote")
    return j.withColumn("side", side).select(*keys, F.when(F.col("side") == "local", F.col("vl")).otherwise(F.col("vr")).alias("value"), "side")


def rotated(items: list, start: int, most: int) -> list:
    """At most ``most`` items of a short list from ``start`` on, round its end; each once."""
    return [items[(start + i) % len(items)] for i in range(min(most, len(items)))] if items else []
