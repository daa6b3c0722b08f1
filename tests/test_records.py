"""Facts from several statements on small tables."""

from pyspark.sql import functions as F

from lathe.operators import records


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_votes_and_shares(spark):
    v = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, None), (3, "a"), (3, "b"), (4, "?"), (4, "a"), (4, "a")], "k int, answer string")
    assert rows(records.majority(v, ["k"], "answer", F.col("answer") == "?")) == [(1, "a"), (2, "unclear"), (3, "unclear"), (4, "unclear")]
    assert rows(records.stability(v, ["k"], "answer")) == [(4, 0.0)]
    p = spark.createDataFrame([(1, True, "y"), (1, True, "m"), (2, False, "y")], "k int, s boolean, l string")
    assert rows(records.precision(p, ["k"], F.col("s"), F.col("l") == "y", F.col("l") == "m")) == [(1, 2, 0.5, 1.0), (2, 0, None, None)]


def test_entities(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "id int, b string, a string")
    b = spark.createDataFrame([(2, "y", "z"), (3, "n", "n"), (1, "changed", None)], "id int, b string, a string")
    s, n = records.entities(a, "job", "id", ["b", "a"]), records.entities(b, "job", "id", ["a", "b"])
    assert s.orderBy("key").first().body == '{"a":null,"b":"x"}'
    assert rows(records.changed_entities(s, n)) == [("job", "1", "put"), ("job", "3", "put")]
    assert rows(records.changed_entities(s, n.limit(0))) == [("job", "1", "deleted"), ("job", "2", "deleted")]


def test_owned_sightings_and_readings(spark):
    o = spark.createDataFrame([(1, "a", False, 1, 1), (1, "b", True, 0, 2), (2, "c", False, 1, 3), (2, "d", False, 2, 4)], "k int, v string, e boolean, at int, id int")
    assert rows(records.owned_fields(o, ["k"], "v", F.col("e"), "at", "id")) == [(1, "b", False), (2, "d", True)]
    s = spark.createDataFrame([("k", 2, "u2", "w"), ("k", 1, None, "w"), (None, 1, "u", "w")], "key string, at int, url string, place string")
    assert rows(records.sightings(s, "key", "at", ["url"], "place")) == [("k", "u2", 2, 1)]
    c = spark.createDataFrame([("p", 1, 100), ("p", 2, 9), ("q", 3, 50), ("q", 4, 40)], "n string, ref int, w int")
    assert rows(records.plausible_readings(c, "n", "ref", "w")) == [("p", 1, 1, False), ("q", 2, 3, True)]


def test_date_ranges(spark):
    df = spark.createDataFrame([("Dev, Mar 2021 – Present; before 2018 - 2020 and März 2010 bis 2011",)], "t string")
    assert df.select(records.date_ranges(F.col("t")).alias("r")).first().r == ["Mar 2021 – Present", "2018 - 2020", "März 2010 bis 2011"]
