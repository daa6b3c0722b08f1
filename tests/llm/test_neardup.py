"""Groups against brute force; recall of the forest; hot groups, copies, short and null texts."""

import itertools
import random

import numpy as np
import regex

from lathe.llm.neardup import STEPS, expected_recall, final_depth, forest_keys, groups, opening_text, pairs_within, shingle_hashes


def brute(rows, width, threshold):
    sh, words = {}, {}
    for k, t in rows:
        if k is None or t is None:
            continue
        w = regex.findall(r"[\p{L}\p{N}]+", t.lower())
        words[k], sh[k] = tuple(w), {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    root = {k: k for k in sh}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sh), 2):
        same = words[a] == words[b]
        if same or (sh[a] and sh[b] and len(sh[a] & sh[b]) >= threshold * len(sh[a] | sh[b])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sh}


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        i = r.randrange(len(w))
        r.choice([lambda: w.insert(i, "neu"), lambda: w.pop(i), lambda: w.__setitem__(i, f"x{r.randrange(99)}")])()
    return " ".join(w)


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):
        base = r.choices(vocab, k=r.randint(20, 120))
        rows += [edited(r, base, r.randint(0, 9)) for _ in range(r.randint(1, 5))]
    hot = r.choices(vocab, k=60)
    rows += [edited(r, hot, r.randint(0, 2)) for _ in range(60)] + [" ".join(hot)] * 10
    rows += ["", "one", "one", "One two", None, "long " * 30_000, "ONE TWO!"]
    data = [(i, t) for i, t in enumerate(rows)] + [(None, "x y z")]
    df = spark.createDataFrame([(k, t, 1) for k, t in data], "row_id long, text string, id int")
    for width, threshold in ((3, 0.6), (5, 0.8)):
        got = {x.row_id: x.group for x in groups(df, "row_id", "text", width, threshold).collect()}
        assert got == brute(data, width, threshold)


def test_pairs(spark):
    g = spark.createDataFrame([(1, 1), (2, 1), (5, 1), (3, 3)], "row_id long, group long")
    assert sorted(tuple(x) for x in pairs_within(g).collect()) == [(1, 2), (1, 5), (2, 5)]


def test_recall_at_the_threshold(spark):
    """Pairs of just the threshold share a prefix of the final depth, deeper ones less often, as expected."""
    r = np.random.default_rng(1)
    for threshold, parts in ((0.6, (80, 25)), (0.8, (96, 12))):
        depth = final_depth(threshold)
        rows = []
        for i in range(1000):
            x = r.integers(-(2**62), 2**62, sum(parts) + parts[1])
            rows += [(2 * i, x[: sum(parts)].tolist()), (2 * i + 1, np.concatenate([x[: parts[0]], x[sum(parts) :]]).tolist())]
        out = {k.id: k for k in forest_keys(spark.createDataFrame(rows, "id long, shingles array<long>"), depth).collect()}
        s = parts[0] / (parts[0] + 2 * parts[1])
        assert sum(bool(set(out[2 * i]["keys"]) & set(out[2 * i + 1]["keys"])) for i in range(1000)) / 1000 >= 0.99
        for steps in range(1, STEPS + 1):
            code = lambda k: {(a, (b % 2**64) >> 16 * (STEPS - steps)) for a, b in zip(k["keys"], k["paths"])}  # noqa: E731, B023
            met = sum(bool(code(out[2 * i]) & code(out[2 * i + 1])) for i in range(1000)) / 1000
            assert abs(met - expected_recall(s, depth + steps)) < 0.06


def test_full_buckets_lose_no_pair(spark):
    """Buckets with more groups than are crossed: boilerplate that all records share, and edits beside it."""
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    boiler = r.choices(vocab, k=60)
    data = []
    for _ in range(60):
        own = r.choices(vocab, k=40)
        data += [(len(data), " ".join(boiler + own)), (len(data) + 1, " ".join(boiler) + " " + edited(r, own, r.randint(1, 14)))]
    df = spark.createDataFrame(data, "row_id long, text string")
    want = brute(data, 3, 0.6)
    for most in (1, 5, 50):
        assert {x.row_id: x.group for x in groups(df, "row_id", "text", 3, 0.6, most=most).collect()} == want
    assert len(set(want.values())) > 30


def test_openings_need_a_description(spark):
    df = spark.createDataFrame([(1, "T", "C", "d"), (2, "T", "C", None), (3, "T", "C", " \n "), (4, None, None, "d")], "row_id long, title string, company string, description_plain string")
    assert sorted(tuple(r) for r in opening_text(df).collect()) == [(1, "T C d"), (4, "d")]
    assert groups(opening_text(df).limit(0), "row_id", "text").count() == 0
    assert len(shingle_hashes(["a"], 3, {})) == 0
