"""The store of jobs: scans applied, reads by key, histories, stale versions, export."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lathe.repository import JobRepository, StaleVersion


def test_store(spark, tmp_path):
    repo = JobRepository(spark, str(tmp_path / "store"))
    scan = lambda **jobs: spark.createDataFrame([(k, v, v) for k, v in jobs.items()], "job_id string, fingerprint string, content_fingerprint string")
    at = lambda n: F.lit(datetime(2024, 1, n))
    assert repo.version() == -1 and repo.jobs().count() == 0
    assert repo.apply_scan(scan(a="1", b="1"), "s1", at(1), True) == 0
    assert repo.apply_scan(scan(x="1"), "s2", at(2), True, expected=0) == 1
    with pytest.raises(StaleVersion):
        repo.apply_scan(scan(a="2"), "s1", at(3), True, expected=0)
    repo.apply_scan(scan(a="2"), "s1", at(3), True, retain=scan(b="0").select("job_id"))
    repo.apply_scan(scan(a="2"), "s1", at(4), False)
    repo.apply_scan(scan(a="2"), "s1", at(5), True)
    now = {r.job_id: (r.source, r.status, r.fingerprint, r.content_updated_at.day, r.last_seen_at.day) for r in repo.jobs().collect()}
    assert now == {"a": ("s1", "open", "2", 3, 5), "b": ("s1", "closed", "1", 1, 1), "x": ("s2", "open", "1", 2, 2)}
    assert {r.job_id: r.status for r in repo.jobs(0).collect()} == {"a": "open", "b": "open"}
    keys = spark.createDataFrame([("a",), ("b",), ("b",), ("none",)], "job_id string")
    assert repo.get(keys).count() == 2 and repo.resolve("x").first().only == "x"
    assert [(r.job_id, r.pos, r.action) for r in repo.histories(keys).orderBy("job_id", "pos").collect()] == [("a", 1, "new"), ("a", 2, "updated"), ("b", 1, "new"), ("b", 2, "closed")]
    repo.export(str(tmp_path / "out"))
    other = JobRepository(spark, str(tmp_path / "other"))
    assert other.load(str(tmp_path / "out")) == 0 and sorted(map(str, other.jobs().collect())) == sorted(map(str, repo.jobs().collect()))


def test_query(spark, tmp_path):
    repo = JobRepository(spark, str(tmp_path))
    r = spark.createDataFrame([("s1", "Data Engineer", "Oat", "Postem", "open", datetime(2024, 1, 9)), ("s2", "Cook", None, None, "closed", None)], "source string, title string, company string, location string, status string, last_seen_at timestamp")
    assert repo.query(r).count() == 2 and repo.query(r, "eng oat").count() == 1 and repo.query(r, sources=["s2"]).first().title == "Cook" and repo.query(r, sources=[]).count() == 0
    assert repo.query(r, statuses=["open", "closed"], seen_since=F.lit(datetime(2024, 1, 1))).count() == 1
