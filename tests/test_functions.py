"""Scalar functions against plain Python."""

from datetime import datetime

from pyspark.sql import functions as F

from lathe.functions import dates, html, ids, text, urls


def one(spark, expr, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", datetime: "timestamp", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(expr.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.clean_line("v"), v="\u2003Baker \u00a0 and\v miller\r\n") == "Baker and miller"
    assert one(spark, text.clean_line("v"), v="\t\u200a ") is None
    assert one(spark, text.clean_block("v"), v="\r\n\r\nbread  \rsalt\t\n\n\nwater \n ") == "bread\nsalt\n\n\nwater"
    assert one(spark, text.search_key("v"), v="Œuf (ÉTÉ): 3×4_b/ßa") == "œuf été 3 4 b ßa"
    assert one(spark, text.search_key("v"), v="--") == ""
    assert one(spark, text.has_terms(text.search_document("v"), "sen eng"), v="Senior  Engineer") is True
    assert one(spark, text.has_terms(text.search_document("v"), "ngin"), v="Senior  Engineer") is False
    assert one(spark, text.titles_compatible("a", "b"), a="Engineer", b="Senior Engineer") is True
    assert one(spark, text.titles_compatible("a", "b"), a="", b="x") is False
    assert one(spark, text.clip("v", 12), v="alpha beta gamma") == "alpha beta…"
    assert one(spark, text.clip("v", 5), v="short") == "short"
    assert one(spark, text.summarize("v", 20), v="First one. Second one is long.") == "First one."
    assert one(spark, text.age_text("v"), v=7300) == "2 hours ago" and one(spark, text.age_text("v"), v=5) == "just now"
    assert one(spark, text.grouped_number("v"), v=1234567.0) == "1,234,567"
    assert one(spark, text.contains_word("v", "go"), v="Rust, Go") is True and one(spark, text.contains_word("v", "go"), v="Golang") is False
    assert one(spark, text.fold_key("v"), v="Pört-Łódź") == "port lodz"
    words = one(spark, text.words_with_offsets("v"), v="C++ and .NET, node.js")
    assert [(w.word, w.start, w.end) for w in words] == [("C++", 0, 3), ("and", 4, 7), (".NET", 8, 12), ("node.js", 14, 21)]
    assert one(spark, text.sentence_list("v"), v="We use e.g. Rust. It is fast!\n- Next item") == ["We use e.g. Rust.", "It is fast!", "Next item"]
    changed = text.changed_fields({"a": (F.col("a"), F.col("b")), "n": (F.lit(None), F.lit(None))})
    assert one(spark, changed, a="x", b="y") == ["a"]


def test_ids(spark):
    import hashlib
    import struct

    def framed(s):
        return struct.pack(">Q", len(s.encode())) + s.encode()

    want = "job_" + hashlib.sha256(framed("ns") + framed("é") + framed("")).hexdigest()[:32]
    assert one(spark, ids.stable_id("ns", "a", "b", prefix="job_"), a="é", b="") == want
    f = lambda v: one(spark, ids.fingerprint({"a": F.col("a")}), a=v)
    assert f(None) != f("") and len(f("x")) == 64


def test_urls(spark):
    c = urls.canonical
    assert c(" HTTPS://User:pw@Example.COM.:443/a/b/?utm_source=x&b=2&a=1&gh_src=1#frag ") == "https://example.com/a/b?a=1&b=2"
    assert c("http://x.io/a/../b/./c//") == "http://x.io/b/c"
    assert c("https://x.io/#/route/1") == "https://x.io/#/route/1"
    assert c("https://x.io?q=a b&q=1") == "https://x.io/?q=a+b&q=1"
    assert c("ftp://x.io") is None and c("") is None and c(None) is None and c("http://") is None
    for u in ("https://x.io/ü?z=ä&a=%20", "http://[::1]:8080/x"):
        assert c(c(u)) == c(u)
    r = one(spark, urls.job_reference("v"), v="https://boards.greenhouse.io/acme/jobs/4000")
    assert (r.system, r.id) == ("greenhouse", "4000")
    r = one(spark, urls.job_reference("v"), v="https://jobs.ashbyhq.com/acme/0080645F-cc95-4ffd-a778-19c373ed4a26")
    assert (r.system, r.id) == ("ashby", "0080645f-cc95-4ffd-a778-19c373ed4a26")
    assert one(spark, urls.job_reference("v"), v="https://acme.com/jobs") is None
    assert one(spark, urls.board_reference("v"), v="https://jobs.lever.co/acme/x").board == "acme"
    assert one(spark, urls.is_tracking("v"), v="UTM_campaign") is True and one(spark, urls.is_tracking("v"), v="id") is False


def test_html(spark):
    t = html.to_text
    assert t("<p>One</p><p>Two<br>Three</p>") == "One\n\nTwo\nThree"
    assert t("<ul><li>a</li><li>b</li></ul>after") == "• a\n• b\n\nafter"
    assert t("<ol><li>a<li>b</ol>") == "1. a\n2. b"
    assert t("<ul><li><p>a</p></li><li><p>b</p><p>c</p></li></ul>") == "• a\n• b\nc"
    assert t("<ol><li>x<ul><li>y<ol><li>z</li></ol></li></ul></li><li>w</li></ol><p>v") == "1. x\n  • y\n    1. z\n2. w\n\nv"
    assert t("<pre>if x:\n    y()\n</pre>done") == "if x:\n    y()\n\ndone"
    assert t("salt<br><br><br>bread<br/>water") == "salt\n\nbread\nwater"
    assert t("<div>oil</div><div>\u00a0</div><div>figs</div><div><br/></div><div>rye") == "oil\n\nfigs\n\nrye"
    assert t("5 < 7 & <p>so</div></p><b>un<i>even") == "5 < 7 &\n\nso\n\nuneven"
    assert t("a<span> b</span>c <i>d</i>") == "a bc d"
    assert t("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep" and t("<head><title>t</title></head>x") == "x"
    assert t("<table><tr><td><p>a</p><p>b</p><td>c<tr><td>d</table>") == "a b | c\nd"
    assert t("<script>x</script><style>y</style>z &amp; &lt;w&gt; &nosuch; &amp") == "z & <w> &nosuch; &amp"
    assert t("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == "a | b\nc"
    assert t("&lt;p&gt;Hi&lt;/p&gt;", escaped=True) == "Hi"
    assert t("a < b and <3") and t("") is None and t(None) is None and t("<p> </p>") is None
    page = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Dev","hiringOrganization":{"name":"Acme"},"jobLocationType":"TELECOMMUTE"}]}</script><script type="application/ld+json">{bad</script>'
    p = one(spark, html.embedded_postings(F.col("v")), v=page)
    assert len(p) == 1 and (p[0].title, p[0].company, p[0].remote) == ("Dev", "Acme", True)
    s = one(spark, html.sitemap_urls("v"), v="<urlset><url><loc> https://x.io/?a=1&amp;b=2 </loc></url></urlset>")
    assert not s.is_index and s.urls == ["https://x.io/?a=1&b=2"]
    robots = "User-agent: bot\nDisallow: /all\n\nUser-agent: *\nAllow: /a\nDisallow: /private*\nDisallow:\n"
    assert one(spark, html.disallowed("v"), v=robots) == ["/private"]
    shared = "Sitemap: https://x.io/s.xml\r\nuser-agent : *\r\nUser-Agent: crumb\r\nDisallow: /oven # hot\r\nCrawl-delay: 3\r\n\r\nUser-agent: crumb\r\nDisallow: /salt"
    assert one(spark, html.disallowed("v"), v=shared) == ["/oven"] and one(spark, html.robots_sitemaps("v"), v=shared) == ["https://x.io/s.xml"]
    assert one(spark, html.allowed(F.lit("/private/x"), html.disallowed("v")), v=robots) is False


def test_dates(spark):
    from zoneinfo import ZoneInfo

    local = lambda v, z: one(spark, dates.local_instant("v", F.lit(z)), v=v)
    assert local(datetime(2026, 3, 8, 2, 30), "America/New_York") == datetime(2026, 3, 8, 7, 0)
    assert local(datetime(2026, 11, 1, 1, 30), "America/New_York") == datetime(2026, 11, 1, 5, 30)
    assert local(datetime(2026, 7, 1, 12, 0), "Europe/Berlin") == datetime(2026, 7, 1, 10, 0)
    assert one(spark, dates.utc_offset_minutes("v", F.lit("Asia/Kolkata")), v=datetime(2026, 1, 1)) == ZoneInfo("Asia/Kolkata").utcoffset(datetime(2026, 1, 1)).seconds // 60
    quiet = lambda m, s, e: one(spark, dates.in_quiet_hours("m", "s", "e"), m=m, s=s, e=e)
    assert quiet(30, 1320, 420) and not quiet(600, 1320, 420) and quiet(10, 5, 20) and not quiet(5, 5, 5)
    assert one(spark, dates.backoff_seconds("n", 60, 3600), n=3) == 480 and one(spark, dates.backoff_seconds("n", 60, 3600), n=99) == 3600
    assert one(spark, dates.age_class("a", "b"), a=datetime(2026, 1, 3), b=datetime(2026, 1, 1)) == "aging"
    assert one(spark, dates.periods_overlap("a", "b", "c", F.lit(None).cast("long")), a=1, b=5, c=2) is False
    assert one(spark, dates.weekday_allowed(F.lit(1), F.lit("2026-01-05").cast("date")), v=1) is True
