"""Containers: capacity, whole items, no overlap, and unused space against first fit."""

import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lathe.llm.packing import pack, plan_slots


def expand(slots):
    fill, seen = defaultdict(list), defaultdict(list)
    for length, a, b, each, first, at in slots:
        for rank in range(a, b + 1):
            seen[length].append(rank)
            fill[first + (rank - a) // each].append((at + (rank - a) % each * length, length))
    return fill, seen


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 200), max_size=12))
def test_plan_holds_every_item_once(hist):
    slots, n = plan_slots(hist, 30)
    fill, seen = expand(slots)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(c)) for k, c in hist.items()}
    assert set(fill) == set(range(n))
    for parts in fill.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end = at + length
        assert end <= 30


def test_little_unused_space():
    r = random.Random(7)
    sizes = [min(2048, int(r.lognormvariate(5.2, 1))) or 1 for _ in range(20_000)]
    _, n = plan_slots(Counter(sizes), 2048)
    assert n <= -(-sum(sizes) // 2048) * 1.01 + 1


def check(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, size int, container_id string")
    got = pack(df, capacity).collect()
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        if r.length:
            fill[r.container_id].append((r.offset, r.length))
    assert set(pieces) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        p = sorted(pieces[i])
        assert sum(x[2] for x in p) == max(s or 0, 0) and [x[1] for x in p] == [capacity * k for k in range(len(p))]
        assert len(p) == max(1, -(-max(s or 0, 0) // capacity))
    for parts in fill.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end = at + length
        assert end <= capacity
    return len(fill)


def test_documents(spark):
    r = random.Random(3)
    sizes = [r.choice([7, 7, 7, r.randint(1, 250), 0]) for _ in range(600)] + [None, -1, 100, 101, 250, 1000]
    n = check(spark, sizes, 100)
    assert n <= -(-sum(max(s or 0, 0) for s in sizes) // 100) * 1.03 + 1


def test_empty_and_nothing_to_hold(spark):
    assert check(spark, [], 100) == 0 and check(spark, [0, None], 100) == 0
