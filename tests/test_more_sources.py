"""Pages, registries, profiles and databases on small files."""

import html
import json
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lathe.sources import databases, pages, profiles, registry


def page(component, **props):
    return f'<html><div id="app" data-page="{html.escape(json.dumps({"component": component, "props": props}))}"></div></html>'


def test_company_pages(spark):
    jobs = [{"id": "1", "url": "/companies/oat/jobs/1-baker"}, {"id": "2", "url": "/companies/rye/jobs/2"}, {"url": "/companies/oat/jobs/3"}]
    df = spark.createDataFrame([("oat", page("WaasShowJobsPage", company={"name": " Oat & Rye "}, jobPostings=jobs)), ("x", page("Other")), ("y", "<p>nothing</p>"), ("z", 'data-page="{broken"')], "source_instance string, body string")
    assert [tuple(r)[1:] for r in pages.listed(df).collect()] == [("Oat & Rye", "1", "/companies/oat/jobs/1-baker", None), ("Oat & Rye", "2", "/companies/rye/jobs/2", "no path of the company"), ("Oat & Rye", None, "/companies/oat/jobs/3", "no identity")]
    job = {"id": "1", "title": "Baker", "url": "/companies/oat/jobs/1", "applyUrl": "https://apply.example/?continue=https%3A%2F%2Foat.example%2Fgo", "location": "Postem, XG, US / Remote (US)", "type": "Full-time",
           "prettyRole": "Ovens", "salaryRange": "US$90K - US$120K", "equityRange": "0.10% - 0.50%", "description": "Bake.\n"}
    r = pages.yc(spark.createDataFrame([("oat", "Oat", page("Job", job=job)), ("oat", "Oat", page("Job"))], "source_instance string, company string, body string")).collect()
    assert len(r) == 1
    p = r[0]
    assert (p.title, p.company, p.department, p.is_remote, p.workplace_type, p.url, p.apply_url) == ("Baker", "Oat", "Ovens", True, None, "https://www.ycombinator.com/companies/oat/jobs/1", "https://oat.example/go")
    assert [(x.name, x.country) for x in p.locations] == [("Postem, XG, US", "US"), ("Remote (US)", None)]
    assert [(c.kind, c.currency, c.min, c.max) for c in p.compensation.components] == [("salary", "USD", 90_000.0, 120_000.0), ("equity_percentage", None, 0.1, 0.5)] and p.compensation.summary == "US$90K - US$120K • 0.10% - 0.50% equity"
    links = spark.createDataFrame([('<a href="https://jobs.lever.co/oat/1"> https://jobs.lever.co/oat/2 https://x.example/',)], "p string").select(pages.board_links("p").alias("b")).first().b
    assert [(b.system, b.board) for b in links] == [("lever", "oat")]


def test_registry(spark, tmp_path):
    f = tmp_path / "r.toml"
    f.write_text('[[sources]]\nkind = "ashby"\ninstance = "oat"\nstatus = "active"\n[[sources]]\nkind = "lever"\ninstance = "rye"\nstatus = "candidate"\n')
    reg = registry.read_registry(spark, str(f))
    found = spark.createDataFrame([("ashby", "oat", "candidate", None, None, None), ("lever", "rye", "validated", "Rye", None, None), ("yc", "new", "candidate", None, None, None)], registry.REGISTRY)
    up = registry.upserted(reg, found)
    assert sorted((r.kind, r.status) for r in up.collect()) == [("ashby", "active"), ("lever", "validated"), ("yc", "candidate")]
    assert sorted(tuple(r) for r in registry.configured(up).collect()) == [("ashby", "oat"), ("lever", "rye")]
    f.write_text('[[sources]]\nkind = "a"\ninstance = "b"\n[[sources]]\nkind = "a"\ninstance = "b"\n')
    with pytest.raises(ValueError):
        registry.read_registry(spark, str(f))
    a = spark.createDataFrame([("x", 304, None), ("x", 200, "b"), ("x", 200, None), ("x", 404, "e"), ("x", 500, "e")], "source_instance string, status int, body string")
    assert [r.outcome for r in registry.responses(a).collect()] == ["not_modified", "batch", "failed", "not_found", "failed"]
    e = spark.createDataFrame([("2024-01-02",), ("2024-01-01T10:00:00Z",), (None,), ("soon",)], "v string")
    assert [r.x for r in e.select(registry.expired("v", F.lit(datetime(2024, 1, 2, 12))).alias("x")).collect()] == [False, True, False, False]


def test_profiles(spark, tmp_path):
    (tmp_path / "Positions.csv").write_text("Company Name,Title,Started On,Finished On\nOat,Baker,Mar 2020,\n")
    (tmp_path / "Skills.csv").write_text("Name\nSourdough\n\n")
    t = profiles.read_export(spark, str(tmp_path))
    assert sorted(t) == ["positions", "skills"]
    assert sorted((r.kind, r.name, r.detail, r.started_on) for r in profiles.export_records(t).collect()) == [("positions", "Baker", "Oat", "Mar 2020"), ("skills", "Sourdough", None, None)]
    repo = lambda n, **k: {"name": n, "full_name": f"me/{n}", "owner": "Me", "size": 5, "pushed_at": "2024", **k}
    rows = [repo("a", pushed_at="2025", languages={"Rust": 80, "C": 15, "Make": 5}), repo("b"), repo("f", fork=True), repo("me"), repo("p", private=True), repo("z", size=0)]
    (tmp_path / "g.json").write_text("\n".join(map(json.dumps, rows)))
    g = profiles.read_repositories(spark, str(tmp_path / "g.json"))
    assert [r.name for r in profiles.selected_repositories(g, 5).orderBy("place").collect()] == ["a", "b"] and profiles.selected_repositories(g, 1).count() == 1
    assert [(x.language, x.share) for x in g.where("name = 'a'").select(profiles.language_shares("languages").alias("l")).first().l] == [("Rust", 80), ("C", 15)]
    (tmp_path / "cv.md").write_text("# Ann Oat\n**Baker**\n\n## Experience\nHead baker, Oat Mill  Mar 2021 - Present\n- bread\n\n## Education:\nMill School\n")
    s = profiles.resume_sections(profiles.read_resumes(spark, str(tmp_path / "cv.md")))
    assert [(r.section, r.line) for r in s.orderBy("pos").collect()] == [("head", "Ann Oat"), ("head", "Baker"), ("experience", "Head baker, Oat Mill Mar 2021 - Present"), ("experience", "- bread"), ("education", "Mill School")]
    assert [(r.title, r.company, r.period) for r in profiles.resume_positions(s).collect()] == [("Head baker", "Oat Mill", "Mar 2021 - Present")]
    (tmp_path / "p1.json").write_text('{"name": "Ann",\n "skills": ["x"]}')
    (tmp_path / "p2.json").write_text('{"name": ')
    assert [tuple(r) for r in profiles.read_profiles(spark, str(tmp_path / "p*.json"), "name string, skills array<string>, city string").collect()] == [("Ann", ["x"], None)]


def test_sqlite(spark, tmp_path):
    f = str(tmp_path / "s.db")
    with sqlite3.connect(f) as c:
        c.execute("CREATE TABLE jobs (id TEXT, n INTEGER, extra BLOB)")
        c.execute("CREATE TABLE none (id TEXT)")
        c.executemany("INSERT INTO jobs VALUES (?, ?, ?)", [(f"j{i}", i if i % 2 else None, b"x") for i in range(1000)])
    df = databases.read_sqlite(spark, f, "jobs", "id string, n double")
    assert df.count() == 1000 and df.where("n IS NULL").count() == 500 and df.agg(F.sum("n")).first()[0] == sum(range(1, 1000, 2))
    assert databases.read_sqlite(spark, f, "none", "id string").count() == 0
