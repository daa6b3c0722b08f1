"""The driver's contract, with and without the optional subpackage."""

import importlib
import sys

import __spark_entry__ as entry


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {"p3_found", "p4_found", "p5_found", "p6_found"} <= set(q)


def test_without_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "lathe.llm", None)
    monkeypatch.setitem(sys.modules, "lathe.llm.queries", None)
    m = importlib.reload(entry)
    assert "p4_found" in m.queries() and "p1_found" not in m.queries()
    monkeypatch.undo()
    importlib.reload(entry)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["scan_id", "job_id", "change"] and df.count() > 0
