"""Phrases, clauses and zones in texts."""

from pyspark.sql import functions as F

from lathe.functions import zones
from lathe.operators import phrases


def test_phrases(spark):
    t = spark.createDataFrame([(1, "Machine-learning, data & Data ENGINEER"), (2, None), (3, ""), (4, "engineer " * 20_000)], "id int, text string")
    v = spark.createDataFrame([("data engineer", "x"), ("Machine Learning", "y"), ("engineer", "z"), (" ", "w"), (None, "n")], "phrase string, tag string")
    got = phrases.phrases_in(t, "id", "text", v, "phrase")
    assert sorted((r.pos, r.n, r.tag) for r in got.where("id = 1").collect()) == [(0, 2, "y"), (3, 2, "x"), (4, 1, "z")]
    assert got.where("id IN (2, 3)").count() == 0 and got.where("id = 4").count() == 20_000
    assert phrases.phrases_in(t, "id", "text", v.limit(0), "phrase").count() == 0


def test_clauses(spark):
    t = spark.createDataFrame([("We like Rust, although Go is fine; no PHP. Really 3.5 - or 4!\nEnd",), ("",), (None,)], "t string")
    assert [r.c for r in t.select(phrases.clauses("t").alias("c")).collect()] == [["We like Rust", "although Go is fine", "no PHP", "Really 3.5", "or 4", "End"], [], None]


def test_zones(spark):
    t = spark.createDataFrame([("Call us in CET or UTC+5:30 hours, Europe/Paris, EST; not Estonia or pst. GMT -3",), (None,)], "t string")
    assert [r.z for r in t.select(zones.zones_named("t").alias("z")).collect()] == [["Europe/Berlin", "+05:30", "Europe/Paris", "America/New_York", "-03:00"], None]
    z = spark.createDataFrame([("a", "Europe/Berlin"), ("a", "Europe/Paris"), ("a", "Asia/Kolkata"), ("b", "UTC"), ("b", None)], "o string, zone string")
    assert {r.o: (r.lo, r.hi, r.clocks) for r in zones.zone_sets(z, "o", "zone", 2024).collect()} == {"a": (60, 330, 2), "b": (0, 0, 1)}
    assert {r.zone: r.seasonal for r in zones.offset_range(z, "zone", 2024).collect()} == {"Europe/Berlin": True, "Europe/Paris": True, "Asia/Kolkata": False, "UTC": False}
    assert zones.zone_sets(z.limit(0), "o", "zone", 2024).count() == 0 and F is not None
