"""Recorded payloads to postings; exports and lists to tables."""

import json

from lathe.sources import boards as b


def listing(spark, body):
    return spark.createDataFrame([("acme", json.dumps(body))], "source_instance string, body string")


def test_ashby(spark):
    jobs = [
        {"id": "1", "title": " Dev ", "location": "Postem", "secondaryLocations": [{"location": "Trisk"}], "isListed": True, "publishedAt": "2024-01-02T03:04:05+01:00", "jobUrl": "https://X.io/1/?utm_a=1",
         "employmentType": "FullTime", "workplaceType": "Hybrid", "descriptionHtml": "<p>Hi</p>", "compensation": {"compensationTierSummary": "$1", "summaryComponents": [{"compensationType": "EquityPercentage", "minValue": 0.1}]}},
        {"id": "2", "title": "Hidden", "isListed": False},
    ]
    p = b.ashby(listing(spark, {"jobs": jobs})).collect()
    assert len(p) == 1
    r = p[0]
    assert (r.title, r.url, r.workplace_type, r.description_text, [x.name for x in r.locations]) == ("Dev", "https://x.io/1", "hybrid", "Hi", ["Postem", "Trisk"])
    assert r.employment_type == "full_time" and r.compensation.components[0].kind == "equity_percentage" and r.posted_at is not None
    assert b.completeness(listing(spark, {"jobs": jobs}), "ashby").first().complete and not b.completeness(spark.createDataFrame([("x", "{bad")], "source_instance string, body string"), "ashby").first().complete


def test_greenhouse_and_prepared(spark):
    job = {"id": 7, "title": "Dev", "company_name": "Acme", "absolute_url": "https://x.io/jobs/7", "location": {"name": "Postem"}, "metadata": [{"name": "Workplace Type", "value": "Remote"}],
           "pay_input_ranges": [{"min_cents": 100, "max_cents": 50, "currency_type": "USD", "title": "t"}], "content": "&lt;p&gt;A&lt;/p&gt;", "first_published": "bad"}
    body = {"jobs": [job, {**job, "pay_input_ranges": []}, {**job, "pay_input_ranges": None, "title": "Second"}, {**job, "id": 8, "title": " "}], "meta": {"total": 5}}
    p = b.greenhouse(listing(spark, body))
    first = p.first()
    assert (first.workplace_type, first.description_text, first.posted_at) == ("remote", "A", None)
    assert not b.completeness(listing(spark, body), "greenhouse").first().complete
    from pyspark.sql import functions as F

    good, bad = b.prepared(p.withColumn("arrival", F.monotonically_increasing_id()), "arrival")
    assert sorted(r.reason for r in bad.collect()) == ["bad pay", "no title"]
    g = good.collect()
    assert len(g) == 1 and g[0].title == "Dev" and g[0].job_id.startswith("job_") and " dev " in g[0].search_text


def test_lever(spark):
    body = [{"id": "u", "text": "Dev", "categories": {"location": "Postem", "commitment": "Full time"}, "createdAt": 1700000000000, "hostedUrl": "https://jobs.lever.co/a/u", "descriptionPlain": "Intro", "lists": [{"text": "Do", "content": "<li>x</li>"}]}]
    r = b.lever(listing(spark, body)).first()
    assert (r.title, r.employment_type, r.description_text) == ("Dev", "full_time", "Intro\n\nDo\n\n• x") and r.posted_at.year == 2023


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Company Name,Title,Description\nAcme,Dev,"two\nlines, ""quoted"""\nBee,,\n')
    rows = b.read_linkedin(spark, str(tmp_path / "p.csv")).collect()
    assert [tuple(r) for r in rows] == [("Acme", "Dev", 'two\nlines, "quoted"'), ("Bee", None, None)]
    (tmp_path / "c.tsv").write_text("# note\nXA\tGoub\tSA\t10\tA/B;C/D\tGr,Ki\nXB\tSko\tEU\tx\n")
    g = b.read_gazetteer(spark, str(tmp_path / "c.tsv")).orderBy("code").collect()
    assert g[0].zones == ["A/B", "C/D"] and g[0].other_names == ["Gr", "Ki"] and g[1].population is None and g[1].zones == []
    (tmp_path / "l.txt").write_text("Acme https://acme.io\n\nBee\n")
    assert [tuple(r) for r in b.read_leads(spark, str(tmp_path / "l.txt"), "plain").collect()] == [("Acme", "https://acme.io", None), ("Bee", None, None)]
    (tmp_path / "l.csv").write_text("Company,Website\nAcme,https://acme.io\n")
    assert tuple(b.read_leads(spark, str(tmp_path / "l.csv"), "csv").first()) == ("Acme", "https://acme.io", None)
