"""Discovery payloads and sinks on small files."""

import json
from datetime import datetime

from lathe.sources import leads, sinks


def test_leads(spark, tmp_path):
    (tmp_path / "cdx.json").write_text("\n".join(json.dumps(x) for x in [
        {"url": "https://boards.greenhouse.io/acme", "status": "200", "timestamp": "2"}, {"url": "https://boards.greenhouse.io/acme", "status": "200", "timestamp": "3"}, {"url": "https://x.io", "status": "404"},
    ]) + "\n{broken\n")
    r = leads.crawl_index(spark, str(tmp_path / "cdx.json")).collect()
    assert len(r) == 1 and (r[0].board.system, r[0].board.board, r[0].timestamp) == ("greenhouse", "acme", "3")
    body = {"id": 1, "title": "Who is hiring?", "children": [
        {"id": 2, "author": "a", "text": 'Acme | Engineer | Postem | Remote<p>See <a href="https:&#x2F;&#x2F;jobs.lever.co&#x2F;acme">here</a>', "created_at_i": 1}, {"id": 3, "author": "b", "text": "thanks"}, {"id": 4, "author": "c", "text": None},
    ]}
    t = leads.hiring_thread(spark.createDataFrame([(json.dumps(body),), ("bad",)], "body string")).collect()
    assert [(x.id, x.name, x.url, x.place) for x in t] == [(2, "Acme", "https://jobs.lever.co/acme", "Postem")]
    firms = [
        {"name": " Oat & Rye ", "website": "https://oat-rye.example/?utm_source=x", "all_locations": "Sosulaedaelt; Postem", "isHiring": True}, {"name": "Quiet Mill", "website": "https://mill.example", "isHiring": False},
        {"name": "Shut Kiln", "isHiring": True, "status": "Inactive"}, {"name": None, "isHiring": True}, {"name": "Plain", "isHiring": True, "status": "Active"},
    ]
    (tmp_path / "dir.json").write_text(json.dumps(firms))
    d = leads.company_directory(spark, str(tmp_path / "dir.json")).orderBy("name").collect()
    assert [(x.name, x.url, x.place) for x in d] == [("Oat & Rye", "https://oat-rye.example/", "Sosulaedaelt"), ("Plain", None, None)]


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))], "id int, at timestamp")
    f = str(tmp_path / "e")
    assert [sinks.append_events(e, f, "id", "at"), sinks.append_events(e, f, "id", "at")] == [2, 0]
    assert spark.read.parquet(f).count() == 2
    p = str(tmp_path / "p")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), p, ["k"])
    sinks.replace_partitions(spark.createDataFrame([(9, "b")], "v int, k string"), p, ["k"])
    assert sorted(r.v for r in spark.read.parquet(p).collect()) == [1, 9]
    s = str(tmp_path / "s")
    for v in (0, 1):
        sinks.write_snapshot(spark.createDataFrame([(v,)], "x int"), s, v)
    assert sinks.read_snapshot(spark, s).first().x == 1 and sinks.read_snapshot(spark, s, 0).first().x == 0
