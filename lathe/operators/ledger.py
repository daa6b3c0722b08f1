"""The ledger of scans and the state it keeps: closing gates, health, applied scans, touched rows, histories.

Nothing here takes a whole source into one task: what a source's rows have in
common comes from partial aggregates, and a row's place among its source's rows
is counted by slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.operators.joins import skewed
from lathe.session import cut, previous_within, ranked_within

#: Consecutive failures, or answers that nothing is there, that make a source unhealthy.
UNHEALTHY_FAILURES, UNHEALTHY_NOT_FOUND = 3, 2


def closing(scans: DataFrame, keys: list[str], unidentified: Column) -> DataFrame:
    """Add ``closing``: whether a listing may close the jobs that it lacks.

    ``incomplete``; ``unreadable`` where records without an id were rejected;
    ``empty`` where nothing was received right after a listing that was not
    empty, which a second empty one confirms; else ``allowed``. ``scans`` are
    listings with started_at, scan_id, complete and received.
    """
    df = previous_within(scans, keys, ["started_at", "scan_id"], F.to_date("started_at"), ["received"])
    empty = (F.coalesce("received", F.lit(0)) == 0) & (F.coalesce("previous.received", F.lit(0)) > 0)
    return df.withColumn("closing", F.when(~F.coalesce("complete", F.lit(False)), "incomplete").when(unidentified > 0, "unreadable").when(empty, "empty").otherwise("allowed")).drop("previous")


def failure_runs(scans: DataFrame, keys: list[str], order: list[str], ok: Column, counted: dict[str, Column]) -> DataFrame:
    """(keys, <counted>...): of the rows after the last good one of a key how many there are of each kind.

    Two partial aggregations and a join without hot keys; no row is sorted.
    """
    at = F.struct(*order)
    last = scans.groupBy(*keys).agg(F.max(F.when(ok, at)).alias("__ok"), F.count(F.lit(1)).alias("__n"))
    both = skewed(scans, last, keys, "__n")
    after = F.col("__ok").isNull() | (at > F.col("__ok"))
    return both.groupBy(*keys).agg(*[F.count_if(after & c).alias(name) for name, c in counted.items()])


def health(scans: DataFrame, keys: list[str], ok: Column, not_found: Column) -> DataFrame:
    """(keys, health, failures): healthy, degraded or unhealthy by a source's scans (finished_at, scan_id, status, received).

    Three failures in a row, or two that found nothing there, are unhealthy; a
    success is degraded only where its listing is empty and the one before was not.
    """
    order = ["finished_at", "scan_id"]
    runs = failure_runs(scans, keys, order, ok, {"failures": F.lit(True), "gone": F.coalesce(not_found, F.lit(False))})
    at = F.struct(*order)
    latest = scans.groupBy(*keys).agg(F.max_by(F.struct("status", "received", at.alias("at")), at).alias("last"), F.count(F.lit(1)).alias("__n"))
    listings = skewed(scans.where("status = 'listing'"), latest, keys, "__n").where(at < F.col("last.at"))
    before = listings.groupBy(*keys).agg(F.max_by("received", at).alias("before"))
    df = latest.join(runs, keys).join(before, keys, "left")
    emptied = (F.col("last.status") == "listing") & (F.coalesce("last.received", F.lit(0)) == 0) & (F.coalesce("before", F.lit(0)) > 0)
    state = (
        F.when(F.col("failures") == 0, F.when(emptied, "degraded").otherwise("healthy"))
        .when((F.col("gone") >= UNHEALTHY_NOT_FOUND) | (F.col("failures") >= UNHEALTHY_FAILURES), "unhealthy").otherwise("degraded")
    )
    return df.select(*keys, state.alias("health"), "failures")


def next_status(current: Column, state: Column, verdict: Column) -> Column:
    """Status that a source moves to: a candidate by its validation, an active one by its health and back."""
    by_verdict = F.when(verdict.isin("validated", "rejected"), verdict).otherwise(current)
    return F.when(current == "candidate", by_verdict).when((current == "active") & (state == "unhealthy"), "unhealthy").when((current == "unhealthy") & (state == "healthy"), "active").otherwise(current)


def applied(planned: DataFrame, stored: DataFrame, incoming: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Stored rows after a scan: (keys, status, fingerprint, content_fingerprint, content_updated_at, last_seen_at).

    ``planned`` is what ``plan_scan`` says of each key. Only a new or changed
    content moves ``content_updated_at``; what the scan lists is seen now; closed
    and kept rows keep their digests and times.
    """
    s = stored.select(*keys, F.struct("status", "fingerprint", "content_fingerprint", "content_updated_at", "last_seen_at").alias("s"))
    i = incoming.select(*keys, F.struct("fingerprint", "content_fingerprint").alias("i"))
    df = planned.join(s, keys, "left").join(i, keys, "left")
    listed = F.col("action").isin("new", "reopened", "updated", "refreshed", "unchanged")
    moved = F.col("action").isin("new", "updated") | ((F.col("action") == "reopened") & ~F.coalesce(F.col("s.content_fingerprint") == F.col("i.content_fingerprint"), F.col("s.content_fingerprint").isNull()))
    return df.select(
        *keys, "action", F.when(listed, "open").when(F.col("action") == "closed", "closed").otherwise(F.col("s.status")).alias("status"),
        F.when(listed, F.col("i.fingerprint")).otherwise(F.col("s.fingerprint")).alias("fingerprint"),
        F.when(listed, F.col("i.content_fingerprint")).otherwise(F.col("s.content_fingerprint")).alias("content_fingerprint"),
        F.coalesce(F.when(moved, at), F.col("s.content_updated_at")).alias("content_updated_at"),
        F.when(listed, at).otherwise(F.col("s.last_seen_at")).alias("last_seen_at"),
    )


def touched(stored: DataFrame, unmodified: DataFrame, keys: list[str], at: str, seen: str) -> DataFrame:
    """Stored rows; the open ones of sources that reported no change (keys, at) were seen then."""
    n = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    sides = n.join(unmodified.groupBy(*keys).agg(F.max(at).alias("__at")), keys)
    df = skewed(stored, sides, keys, "__n", "left") if not sides.isEmpty() else stored.withColumns({"__n": F.lit(None), "__at": F.lit(None).cast(dict(stored.dtypes)[seen])})
    return df.withColumn(seen, F.when(F.col("status") == "open", F.greatest(seen, "__at")).otherwise(F.col(seen))).drop("__n", "__at")


def observed(stored: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Stored rows with the ``action`` of an observation (key, found) of the posting itself.

    Only open and closed are definite; what was not looked at, or answered
    neither, is unknown and changes nothing.
    """
    f = F.col("found")
    action = F.when((f == "open") & (F.col("status") == "closed"), "reopened").when((f == "closed") & (F.col("status") == "open"), "closed").when(f.isin("open", "closed"), "confirmed").otherwise("unknown")
    return stored.join(seen, key, "left").withColumn("action", action)


def replaced_evidence(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(key, evidence): a record that came again has just its new evidence, each once; all others keep theirs."""
    again = incoming.select(key).distinct()
    return stored.select(key, "evidence").join(again, key, "left_anti").unionByName(incoming.select(key, "evidence").where("evidence IS NOT NULL")).distinct()


def updated_from(stored: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Stored rows with ``column`` replaced where ``values`` (key, column) has the key; one of equal keys wins, the greatest value."""
    new = values.groupBy(key).agg(F.max(column).alias("__new"))
    return stored.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def history(events: DataFrame, keys: list[str], order: list[str], day: Column) -> DataFrame:
    """Add ``pos``: a row's place, from 1, among those of its key; a key of any size is counted by slices."""
    return ranked_within(cut(events), keys, [F.col(c) for c in order], day, "pos")


def latest_live(versions: DataFrame, keys: list[str], version: str, deleted: str) -> DataFrame:
    """The last version of each key, unless that one is a tombstone."""
    cols = [c for c in versions.columns if c not in keys]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*cols), version).alias("v"))
    return last.where(~F.coalesce(F.col(f"v.{deleted}"), F.lit(False))).select(*keys, "v.*")
