"""Snapshot changes against brute force, with lost, late, corrected and repeated rows."""

import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from lathe.operators.snapshots import changes

SCANS = "scan_id long, store_id long, source_kind string, source_instance string, complete boolean, started_at timestamp, close_ids array<string>, extra int"
ROWS = "scan_id long, job_id string, status string, fingerprint string, content_fingerprint string, loaded_at timestamp, scan_note string"
T0 = datetime(2024, 1, 1)


def brute(scans, rows):
    out = set()
    by_store = {}
    for s in {s[0]: s for s in scans}.values():
        if s[4]:
            by_store.setdefault(s[1:4], []).append(s)
    norm = lambda x: (x or "").strip().lower() or None
    dump = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        d = dump.setdefault(r[0], {})
        if r[1] not in d or r[5] > d[r[1]][0]:
            d[r[1]] = (r[5], norm(r[2]), norm(r[3]), norm(r[4]))
    for s in scans:
        for j in s[6] or []:
            if j in dump.get(s[0], {}):
                x = dump[s[0]][j]
                dump[s[0]][j] = (x[0], "closed", x[2], x[3])
    for ss in by_store.values():
        ss.sort(key=lambda s: (s[5], s[0]))
        for a, b in zip(ss, ss[1:]):
            x, y = dump.get(a[0], {}), dump.get(b[0], {})
            for j in x.keys() | y.keys():
                if j not in x:
                    c = "added"
                elif j not in y:
                    c = "removed"
                else:
                    (_, s1, f1, c1), (_, s2, f2, c2) = x[j], y[j]
                    if s1 != s2:
                        c = "closed" if s2 == "closed" else "reopened"
                    elif c1 and c2 and c1 != c2:
                        c = "changed"
                    elif f1 != f2 or (c1 is None) != (c2 is None):
                        c = "refreshed"
                    else:
                        continue
                out.add((b[0], j, c))
    return out


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10**6))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    scans, rows = [], []
    ids = r.sample(range(100), 18)
    for k, i in enumerate(ids):
        done = r.random() < 0.8
        scans.append((i, k % 2, "ashby", "b", done, T0 + timedelta(days=k // 4, hours=k), r.sample("abcde", r.randint(0, 2)) if done else None, 1))
        for j in r.sample("abcde", r.randint(0, 5)):
            for c in range(r.choice([1, 1, 2])):
                f = r.choice(["x1", "X1 ", "x2", None])
                rows.append((i, j, r.choice(["open", " OPEN", "closed"]), f, r.choice(["c1", "C1", "", " ", None, "c2"]), T0 + timedelta(days=9, minutes=c), "n"))
    scans += scans[:2]
    rows += rows[:3]
    got = {tuple(x) for x in changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(scans, SCANS)).collect()}
    assert got == brute(scans, rows)


def test_empty_tables_and_nulls(spark):
    empty = changes(spark.createDataFrame([], ROWS), spark.createDataFrame([], SCANS))
    assert empty.columns == ["scan_id", "job_id", "change"] and empty.count() == 0
    scans = [(1, 1, None, "b", True, T0, None, 0), (2, 1, None, "b", True, T0 + timedelta(days=1), [None, "a"], 0), (3, 1, None, "b", None, T0, None, 0)]
    rows = [(1, "a", None, None, None, None, ""), (None, "b", "open", "f", "c", T0, ""), (1, None, "open", "f", "c", T0, ""), (2, "a", None, None, None, None, "")]
    got = changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(scans, SCANS)).collect()
    assert [tuple(r) for r in got] == [(2, "a", "closed")]


def test_scan_without_rows_removes_all(spark):
    scans = [(1, 1, "k", "b", True, T0, [], 0), (2, 1, "k", "b", True, T0 + timedelta(days=1), [], 0)]
    got = changes(spark.createDataFrame([(1, "a", "open", "f", "c", T0, "")], ROWS), spark.createDataFrame(scans, SCANS)).collect()
    assert [tuple(r) for r in got] == [(2, "a", "removed")]
