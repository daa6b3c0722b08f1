"""Streams against the same work on finished tables."""

from lathe.streaming import events as ev

SF = "/root/testdata/sf0.001/events.parquet"
RANKS = {"view": 0, "click": 1, "signup": 2, "purchase": 3}


def test_windows_and_fold(spark, tmp_path):
    table = spark.read.parquet(SF)
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ev.windowed_counts(stream, late="60 days").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r.window_start), r.event_type, r.n_events, r.sum_value) for r in df.collect())
    assert key(spark.table("w")) == key(ev.windowed_counts(table))
    q = ev.fold_state(stream, RANKS).writeStream.format("memory").queryName("f").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("f").collect():
        if r.user_id not in last or r.n_events > last[r.user_id][2]:
            last[r.user_id] = (r.furthest, r.last_type, r.n_events)
    assert last == {r.user_id: (r.furthest, r.last_type, r.n_events) for r in ev.batch_fold(table, RANKS).collect()}


def test_merge_scans(spark, tmp_path):
    """Scans that arrive one a batch, or all in one, leave the same state; partial scans close nothing."""
    from datetime import datetime

    rows = [  # scan, source, closes, retain, jobs
        (1, "s1", True, [], {"a": "1", "b": "1", "r": "1"}), (2, "s2", True, [], {"x": None, "y": "1"}), (3, "s1", False, [], {"a": "2"}),
        (4, "s1", True, ["r"], {"a": "2", "c": None}), (5, "s2", True, [], {"x": None}), (6, "s1", True, [], {"a": "2", "b": "1", "c": None}),
    ]
    scan = "scan_id long, source string, at timestamp, closes boolean, retain array<string>"
    dump = [(n, j, f, f) for n, _, _, _, jobs in rows for j, f in jobs.items()]
    dumps = lambda s: s.createDataFrame(dump, "scan_id long, job_id string, fingerprint string, content_fingerprint string")
    for i, (n, src, closes, retain, _) in enumerate(rows):
        spark.createDataFrame([(n, src, datetime(2024, 1, 1 + i), closes, retain)], scan).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    got = []
    for most in (1, 100):
        stream = spark.readStream.schema(scan).option("maxFilesPerTrigger", most).parquet(str(tmp_path / "in" / "*"))
        ev.merge_scans(stream, dumps, str(tmp_path / f"out{most}"), str(tmp_path / f"c{most}")).awaitTermination()
        actions = {(r.scan_id, r.job_id): r.action for r in spark.read.option("basePath", str(tmp_path / f"out{most}/actions")).parquet(str(tmp_path / f"out{most}/actions")).collect()}
        state = {(r.source, r.job_id): (r.status, r.fingerprint, r.content_updated_at.day) for r in ev.merged_state(spark, str(tmp_path / f"out{most}")).collect()}
        got.append((actions, state))
    assert got[0] == got[1]
    actions, state = got[0]
    assert actions[1, "a"] == "new" and actions[3, "a"] == "updated" and actions[3, "b"] == "kept" and actions[4, "b"] == "closed" and actions[4, "r"] == "kept" and actions[6, "r"] == "closed"
    assert actions[6, "b"] == "reopened" and actions[5, "y"] == "closed" and actions[5, "x"] == "refreshed" and actions[6, "a"] == "unchanged"
    assert state == {
        ("s1", "a"): ("open", "2", 3), ("s1", "b"): ("open", "1", 1), ("s1", "c"): ("open", None, 4), ("s1", "r"): ("closed", "1", 1), ("s2", "x"): ("open", None, 2), ("s2", "y"): ("closed", "1", 2),
    }


def test_fold_keeps_the_greatest_id_of_an_instant(spark, tmp_path):
    from datetime import datetime

    schema = "event_id long, user_id long, ts timestamp, event_type string"
    for i, (n, kind) in enumerate([(9, "purchase"), (3, "view")]):
        spark.createDataFrame([(n, 1, datetime(2024, 1, 1), kind)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    ev.fold_state(stream, RANKS).writeStream.format("memory").queryName("g").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.last_type, r.n_events) for r in spark.table("g").orderBy("n_events").collect()][-1] == ("purchase", 2)


def test_drained_streams(spark):
    """What streams of a table's files say in the end is what the table says."""
    folder = SF.rsplit("/", 1)[0]
    table = spark.read.parquet(SF)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(ev.drained(ev.windowed_counts(ev.event_stream(spark, folder)), "complete")) == key(ev.windowed_counts(table))
    assert ev.drained(ev.deduplicated(ev.event_stream(spark, folder)).select("event_id"), "append").count() == table.select("event_id").distinct().count()
