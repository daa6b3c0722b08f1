"""The scan ledger against plain Python, with a source that has a third of all scans."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lathe.operators import ledger
from lathe.session import previous_within

SCANS = "source string, scan_id long, status string, complete boolean, received int, error string, started_at timestamp, finished_at timestamp, k int"


def scans(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ok = r.random() < 0.6
        at = datetime(2024, 1, 1) + timedelta(hours=r.randrange(24 * 60))
        rows.append(("hot" if i % 3 == 0 else f"s{r.randrange(20)}", i, "listing" if ok else "failed", ok and r.random() < 0.8, r.choice([0, 0, 5, None]) if ok else None, None if ok else r.choice(["HTTP 404", "timeout", None]), at, at + timedelta(minutes=5), 1))
    return rows, spark.createDataFrame(rows, SCANS)


def by_source(rows, key):
    out = {}
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append(r)
    return out


def test_previous_and_closing(spark):
    rows, df = scans(spark)
    listings = [r for r in rows if r[2] == "listing"]
    want = {}
    for s in by_source(listings, lambda r: (r[6], r[1])).values():
        before = None
        for r in s:
            empty = (r[4] or 0) == 0 and before is not None and (before or 0) > 0
            want[r[1]] = "incomplete" if not r[3] else "unreadable" if r[1] % 7 == 0 else "empty" if empty else "allowed"
            before = r[4] or 0
    got = {r.scan_id: r.closing for r in ledger.closing(df.where("status = 'listing'"), ["source"], (F.col("scan_id") % 7 == 0).cast("int")).collect()}
    assert got == want and set(want.values()) == {"incomplete", "unreadable", "empty", "allowed"}
    assert previous_within(df.limit(0), ["source"], ["started_at"], F.to_date("started_at"), ["received"]).count() == 0


def test_health(spark):
    rows, df = scans(spark, 300, 2)
    want = {}
    for name, s in by_source(rows, lambda r: (r[7], r[1])).items():
        s = s[::-1]
        run = 0
        while run < len(s) and s[run][2] != "listing":
            run += 1
        gone = sum("404" in (r[5] or "") for r in s[:run])
        if run == 0:
            before = next((r[4] or 0 for r in s[1:] if r[2] == "listing"), 0)
            state = "degraded" if not s[0][4] and before > 0 else "healthy"
        else:
            state = "unhealthy" if gone >= 2 or run >= 3 else "degraded"
        want[name] = (state, run)
    got = ledger.health(df, ["source"], F.col("status") == "listing", F.contains("error", F.lit("404"))).collect()
    assert {r.source: (r.health, r.failures) for r in got} == want and len({s for s, _ in want.values()}) == 3


def test_next_status(spark):
    df = spark.createDataFrame([("candidate", "healthy", "validated"), ("candidate", "unhealthy", None), ("candidate", "healthy", "inconclusive"), ("active", "unhealthy", None), ("active", "degraded", None), ("unhealthy", "healthy", None), ("disabled", "unhealthy", None)], "a string, b string, c string")
    assert [r.n for r in df.select(ledger.next_status(F.col("a"), F.col("b"), F.col("c")).alias("n")).collect()] == ["validated", "candidate", "candidate", "unhealthy", "active", "active", "disabled"]


def test_touch_evidence_updates_and_versions(spark):
    day = lambda n: datetime(2024, 1, n)
    stored = spark.createDataFrame([("a", 1, "open", day(5)), ("a", 2, "closed", day(5)), ("a", 3, "open", day(9)), ("b", 4, "open", day(5))], "source string, id int, status string, seen timestamp")
    same = spark.createDataFrame([("a", day(7)), ("a", day(6)), ("z", day(8))], "source string, at timestamp")
    assert {r.id: r.seen.day for r in ledger.touched(stored, same, ["source"], "at", "seen").collect()} == {1: 7, 2: 5, 3: 9, 4: 5}
    assert {r.id: r.seen.day for r in ledger.touched(stored, same.limit(0), ["source"], "at", "seen").collect()} == {1: 5, 2: 5, 3: 9, 4: 5}
    old = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id int, evidence string")
    new = spark.createDataFrame([(1, "q"), (1, "q"), (3, None)], "id int, evidence string")
    assert sorted(tuple(r) for r in ledger.replaced_evidence(old, new, "id").collect()) == [(1, "q"), (2, "z")]
    v = spark.createDataFrame([(1, "b"), (1, "c"), (9, "d"), (2, None)], "id int, evidence string")
    assert sorted(tuple(r) for r in ledger.updated_from(old, v, "id", "evidence").collect()) == [(1, "c"), (1, "c"), (2, "z")]
    versions = spark.createDataFrame([("k", 1, "old", False), ("k", 2, "new", False), ("g", 1, "was", False), ("g", 2, None, True), ("n", 1, "x", None)], "key string, version int, body string, deleted boolean")
    assert sorted((r.key, r.body) for r in ledger.latest_live(versions, ["key"], "version", "deleted").collect()) == [("k", "new"), ("n", "x")]
