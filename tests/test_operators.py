"""Graph, identity, lifecycle, selection, joins and ranks against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lathe.operators import identity, joins, lifecycle, selection
from lathe.operators.graph import connected_components
from lathe.session import ranked_within

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(1, 1), (None, 5), (3, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = sorted((x, find(x)) for x in root)
    assert rows(connected_components(spark.createDataFrame(edges, "src long, dst long"))) == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ranked_within(spark):
    data = [(k, v) for k in ("a", "b", None) for v in range(57)] + [("hot", v) for v in range(500)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k string, v int")
    got = ranked_within(df, ["k"], ["v"], F.floor(F.col("v") / 10), "rank")
    assert all(r.rank == r.v + 1 for r in got.collect()) and got.count() == len(data)


def test_scan_plan_and_upsert(spark):
    s = spark.createDataFrame([("a", "open", "1"), ("b", "closed", "1"), ("c", "open", "1"), ("d", "open", "1"), ("e", "closed", "1"), ("f", "open", None)], "job_id string, status string, fingerprint string")
    i = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("n", "9"), ("f", None)], "job_id string, fingerprint string")
    keep = spark.createDataFrame([("z",)], "job_id string")
    got = dict(rows(lifecycle.plan_scan(s, i, keep=keep)))
    assert got == {"a": "unchanged", "b": "reopened", "c": "updated", "d": "closed", "e": "kept", "n": "new", "f": "unchanged"}
    assert dict(rows(lifecycle.plan_scan(s, i, F.lit(False))))["d"] == "kept"
    assert dict(rows(lifecycle.plan_scan(s, i, keep=s.select("job_id"))))["d"] == "kept"
    a = spark.createDataFrame([(1, "x", "t"), (2, "y", "u")], "id int, v string, at string")
    b = spark.createDataFrame([(2, "z", None), (3, "w", "q")], "id int, v string, at string")
    assert rows(lifecycle.upsert(a, b, ["id"], ["at"])) == [(1, "x", "t"), (2, "z", "u"), (3, "w", "q")]
    assert rows(lifecycle.append_new(a, b.unionByName(b), ["id"])) == [(3, "w", "q")]


def test_three_way_merge(spark):
    f = lambda x: spark.createDataFrame(x, "id int, field string, value string, at int")
    base = f([(1, "a", "0", 0), (1, "b", "0", 0), (1, "c", "0", 0)])
    local = f([(1, "a", "1", 5), (1, "b", "0", 0), (1, "c", "l", 9)])
    remote = f([(1, "a", "0", 0), (1, "b", "r", 1), (1, "c", "r", 3), (1, "d", "n", 1)])
    got = {r.field: (r.value, r.side) for r in lifecycle.merge_three_way(base, local, remote, ["id", "field"], "at").collect()}
    assert got == {"a": ("1", "local"), "b": ("r", "remote"), "c": ("l", "local"), "d": ("n", "remote")}


def test_selection(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}", 100 - i) for i in range(20)], "id int, company string, score int")
    got = rows(selection.one_per_group(df, "company", [F.desc("score"), F.col("id")], 2, "id"))
    assert got == [("c0", 0, 1, 6), ("c1", 1, 2, 6)]
    a = rows(selection.seeded_sample(df, "id", 3, 5))
    assert a == rows(selection.seeded_sample(df.repartition(7), "id", 3, 5)) and len(a) == 5
    p = selection.percentile_nearest_rank(df, ["company"], "score", [0.5, 0.9]).where("company = 'c0'").first()
    v = sorted(100 - i for i in range(0, 20, 3))
    assert (p.p50, p.p90) == (v[3], v[6])
    assert tuple(selection.by_prefix(df, "company", "c1").first()) == (1, "c1") and tuple(selection.by_prefix(df, "company", "c").first()) == (3, None)


def test_as_of_and_overlaps(spark):
    r = random.Random(4)
    left = [(i, r.choice("ab"), r.randrange(50)) for i in range(60)]
    right = [(r.choice("abc"), r.randrange(50), r.randrange(9)) for _ in range(40)]
    L, R = spark.createDataFrame(left, "id int, k string, at int"), spark.createDataFrame(right, "k string, rat int, v int")
    want = []
    for i, k, at in left:
        best = max(((t, v) for kk, t, v in right if kk == k and t <= at), default=(None, None))
        want.append((i, k, at, best[1]))
    assert rows(joins.as_of(L, R, ["k"], "at", "rat", ["v"])) == sorted(want, key=lambda x: x[:3])
    a = [(i, r.choice("ab"), x, x + r.randrange(30)) for i in range(40) for x in [r.randrange(200)]] + [(99, "a", None, 5)]
    b = [(i, r.choice("ab"), x, x + r.randrange(30)) for i in range(40) for x in [r.randrange(200)]]
    A, B = spark.createDataFrame(a, "ia int, k string, fa int, ta int"), spark.createDataFrame(b, "ib int, k string, fb int, tb int")
    got = rows(joins.overlapping(A, B, ["k"], 10, "fa", "ta", "fb", "tb").select("ia", "ib"))
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[2] is not None and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    hot = spark.createDataFrame([("h", i) for i in range(100)], "k string, n int")
    assert joins.salted(hot, spark.createDataFrame([("h", 1), ("x", 2)], "k string, m int"), ["k"]).count() == 100


def test_identity(spark):
    rec = [
        ("a1", "s1", "Engineer", "Acme", T0), ("b1", "s2", "Senior Engineer", "Acme", T0 - timedelta(days=1)), ("c1", "s3", "Cook", "Acme", T0),
        ("a2", "s1", "Writer", "Bee", T0), ("b2", "s2", "Writer", "Bee", T0), ("a3", "s1", "Writer", "Bee", T0),
    ]
    R = spark.createDataFrame(rec, "job_id string, source string, title string, company string, first_seen_at timestamp")
    keys = {"a1": "u1", "b1": "u1", "c1": "u1", "a2": "u2", "b2": "u2", "a3": "u2"}
    R2 = R.withColumn("url", F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])[F.col("job_id")])
    ev = identity.evidence(R2, {"url": F.col("url"), "none": F.lit(None).cast("string")})
    links = identity.candidate_links(R, ev)
    assert rows(links) == [("url:u1", "a1", "b1", True), ("url:u1", "a1", "c1", False)]
    g = identity.groups(R, links)
    assert dict(rows(g)) == {"a1": "b1", "b1": "b1", "c1": "c1", "a2": "a2", "b2": "b2", "a3": "a3"}
    assert rows(identity.look_alikes(R, g)) == [("bee", "writer", 3)]


def test_group_refuses_two_records_of_a_source(spark):
    R = spark.createDataFrame([("a1", "s1", T0), ("a2", "s1", T0), ("b", "s2", T0)], "job_id string, source string, first_seen_at timestamp")
    L = spark.createDataFrame([("k1", "a1", "b", True), ("k2", "a2", "b", True)], "key string, a string, b string, accepted boolean")
    assert dict(rows(identity.groups(R, L))) == {"a1": "a1", "b": "a1", "a2": "a2"}


def test_groups_by_rounds_and_in_one_task(spark):
    """Components of any size give the same groups, whichever way they are joined."""
    import random
    from datetime import datetime, timedelta

    r = random.Random(4)
    for n, m, sources in ((60, 90, 6), (40, 60, 3)):
        recs = spark.createDataFrame([(f"j{i:03}", f"s{r.randrange(sources)}", datetime(2024, 1, 1) + timedelta(days=r.randrange(20))) for i in range(n)], "job_id string, source string, first_seen_at timestamp")
        links = spark.createDataFrame([(f"k{r.randrange(50)}", f"j{r.randrange(n):03}", f"j{r.randrange(n):03}", r.random() < 0.9) for _ in range(m)], "key string, a string, b string, accepted boolean").where("a <> b")
        one, wide = rows(identity.groups(recs, links)), rows(identity.groups(recs, links, most=1))
        assert one == wide and len({f for _, f in one}) < n


def test_skewed_join(spark):
    """A key with most of the rows, rare keys, and keys without a partner."""
    left = spark.createDataFrame([("hot", i) for i in range(5000)] + [(f"k{i}", i) for i in range(50)] + [("lost", 1), (None, 2)], "k string, v int")
    right = left.where("k <> 'lost'").groupBy("k").count().withColumnRenamed("count", "n")
    assert rows(joins.skewed(left, right, ["k"], "n").select("k", "v")) == rows(left.where("k IS NOT NULL AND k <> 'lost'"))
    assert joins.skewed(left, right, ["k"], "n", "left").count() == left.count()
    assert joins.skewed(left.limit(0), right.limit(0), ["k"], "n").count() == 0


def test_as_of_across_slices(spark):
    """Right rows of earlier days are carried over days without any, also for a key with a third of all rows."""
    import random
    from datetime import datetime, timedelta

    r = random.Random(6)
    t = lambda: datetime(2024, 1, 1) + timedelta(minutes=r.randrange(60 * 24 * 40))
    left = [(i, "hot" if i % 3 == 0 else f"k{r.randrange(9)}", t()) for i in range(600)] + [(600, "hot", None), (601, None, t())]
    right = [("hot" if i % 3 == 0 else f"k{r.randrange(9)}", t(), i) for i in range(150)] + [(None, datetime(2023, 1, 1), -1)]
    got = {x.i: x.v for x in joins.as_of(spark.createDataFrame(left, "i int, k string, at timestamp"), spark.createDataFrame(right, "k string, rat timestamp, v int"), ["k"], "at", "rat", ["v"]).collect()}
    want = {}
    for i, k, at in left:
        before = [(b, v) for x, b, v in right if x == k and at is not None and b <= at]
        want[i] = max(before)[1] if before else None
    assert got == want
