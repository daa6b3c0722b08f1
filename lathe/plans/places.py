"""Queries of places, zones, phrases and small helpers, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import text, urls, zones
from lathe.functions.html import embedded_postings
from lathe.operators import phrases
from lathe.plans.general import _jobs, key_sql
from lathe.session import bounded_broadcast, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_AT = "(date_diff('minute', TIMESTAMP '{t}', timezone(zone, TIMESTAMPTZ '{t}+00')))::INT"


@query("s197_board_offsets", f"SELECT board, {_AT.format(t='2025-01-15 00:00:00')} AS winter, {_AT.format(t='2025-07-15 00:00:00')} AS summer FROM boards")
def board_offsets(spark, d):
    from lathe.functions.dates import utc_offset_minutes

    at = lambda t: utc_offset_minutes(F.lit(t).cast("timestamp"), "zone")
    return table(spark, d, "boards").select("board", at("2025-01-15 00:00:00").alias("winter"), at("2025-07-15 00:00:00").alias("summer"))


_YEAR = """o AS (SELECT z.zone, (date_diff('minute', t, timezone(z.zone, timezone('UTC', t))))::INT AS o, t FROM z, range(TIMESTAMP '2025-01-01 12:00:00', TIMESTAMP '2026-01-01 12:00:00', INTERVAL 1 DAY) r(t))"""


@query("s115_zone_offsets", f"WITH z AS (SELECT DISTINCT zone FROM boards WHERE zone IS NOT NULL), {_YEAR} SELECT zone, min(o) AS lo, max(o) AS hi, min(o) <> max(o) AS seasonal FROM o GROUP BY zone")
def zone_offsets(spark, d):
    return zones.offset_range(table(spark, d, "boards"), "zone", 2025)


@query(
    "s198_zone_sets",
    f"""WITH m AS (SELECT DISTINCT code, unnest(zones) AS zone FROM countries), z AS (SELECT DISTINCT zone FROM m WHERE zone IS NOT NULL), {_YEAR},
    c AS (SELECT zone, min(o) AS lo, max(o) AS hi, string_agg(o::VARCHAR, ',' ORDER BY t) AS clock FROM o GROUP BY zone)
    SELECT code, min(lo) AS lo, max(hi) AS hi, count(DISTINCT clock) AS clocks FROM m JOIN c USING (zone) GROUP BY code""",
)
def zone_sets(spark, d):
    m = table(spark, d, "countries").select("code", F.explode("zones").alias("zone"))
    return zones.zone_sets(m, "code", "zone", 2025)


@query(
    "s333_area_zones",
    """SELECT country_code AS code, region, zone, count(*) AS places FROM places WHERE zone IS NOT NULL GROUP BY ALL UNION ALL
    SELECT code, NULL, zone, (SELECT count(*) FROM places p WHERE p.country_code = m.code AND p.zone = m.zone) FROM (SELECT DISTINCT code, unnest(zones) AS zone FROM countries) m WHERE zone IS NOT NULL""",
)
def area_zones(spark, d):
    """Clocks of regions, by their places, and of countries."""
    p = table(spark, d, "places").where("zone IS NOT NULL").groupBy(F.col("country_code").alias("code"), "region", "zone").agg(F.count(F.lit(1)).alias("places"))
    c = table(spark, d, "countries").select("code", F.explode("zones").alias("zone")).distinct().where("zone IS NOT NULL")
    n = p.groupBy("code", "zone").agg(F.sum("places").alias("places"))
    return p.unionByName(c.join(n, ["code", "zone"], "left").select("code", F.lit(None).cast("string").alias("region"), "zone", F.coalesce("places", F.lit(0)).alias("places")))


@query(
    "s200_zones_in_text",
    r"""WITH f AS (SELECT doc_id, regexp_extract_all(text, '\b((?:UTC|GMT)\s?[+-]\d{1,2}(?::?\d{2})?|(?:Africa|America|Antarctica|Asia|Atlantic|Australia|Europe|Indian|Pacific)/[A-Za-z_]+(?:/[A-Za-z_]+)?|(?:"""
    + "|".join(sorted((a.upper() for a in zones.ABBREVIATIONS), key=lambda a: (-len(a), a)))
    + r""")\b)', 1) AS xs FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(xs) AS x FROM f)
    SELECT CASE WHEN regexp_matches(x, '[+-]\d{1,2}(:?\d{2})?$') THEN regexp_extract(x, '([+-])\d', 1) || lpad(regexp_extract(x, '[+-](\d{1,2})', 1), 2, '0') || ':' || rpad(regexp_extract(x, '[+-]\d{1,2}:?(\d{2})$', 1), 2, '0') ELSE """
    + "CASE x " + " ".join(f"WHEN '{k.upper()}' THEN '{v}'" for k, v in zones.ABBREVIATIONS.items())
    + " ELSE x END END AS zone, count(*) AS n, count(DISTINCT doc_id) AS docs FROM e GROUP BY 1",
)
def zones_in_text(spark, d):
    each = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(zones.zones_named("text")).alias("zone"))
    # Documents are counted from (zone, document) pairs: no zone is one task's work.
    pairs = each.groupBy("zone", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return pairs.groupBy("zone").agg(F.sum("k").alias("n"), F.count("doc_id").alias("docs"))


@query(
    "s216_places_in_prose",
    f"""WITH v AS (SELECT DISTINCT {key_sql("name")} AS k FROM places), t AS (SELECT doc_id, ' ' || {key_sql("text")} || ' ' AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, k AS place FROM t JOIN v ON contains(t, ' ' || k || ' ') WHERE k <> ''""",
)
def places_in_prose(spark, d):
    names = table(spark, d, "places").select(text.search_key("name").alias("place")).distinct()
    return phrases.phrases_in(table(spark, d, "documents"), "doc_id", "text", names, "place").select("doc_id", "place").distinct()


#: Phrases of technologies and trades that titles name.
_TERMS = ["engineer", "data engineer", "machine learning", "site reliability", "product manager", "software engineer", "designer", "backend engineer", "sales", "support"]


@query(
    "s354_vocabulary",
    f"""WITH v AS (SELECT unnest({_TERMS!r}) AS term), t AS (SELECT 'ashby' AS tbl, title FROM ashby_jobs UNION ALL SELECT 'records', title FROM job_records)
    SELECT tbl, term, count(*) AS titles FROM t JOIN v ON contains(' ' || {key_sql("title")} || ' ', ' ' || term || ' ') GROUP BY 1, 2""",
)
def vocabulary(spark, d):
    parts = [table(spark, d, t).select(F.concat_ws(":", F.lit(n), F.col("row_id").cast("string")).alias("id"), "title") for t, n in (("ashby_jobs", "ashby"), ("job_records", "records"))]
    terms = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    met = phrases.phrases_in(parts[0].unionByName(parts[1]), "id", "title", terms, "term").select("id", "term").distinct()
    return met.groupBy(F.substring_index("id", ":", 1).alias("tbl"), "term").agg(F.count(F.lit(1)).alias("titles"))


@query(
    "s165_clauses",
    r"""WITH m AS (SELECT row_id, regexp_split_to_array(regexp_replace(regexp_replace(description_plain, '(?i)\s+(but|although|however)\s', chr(10) || '\1 ', 'g'), '[,;:](\s+)|\s[-–—]\s|[.!?](\s+)', chr(10), 'g'), '[\r\n]+') AS xs
      FROM ashby_jobs WHERE description_plain IS NOT NULL), c AS (SELECT row_id, list_filter(list_transform(xs, lambda x: trim(regexp_replace(x, '[.!?]+\s*$', ''))), lambda x: x <> '') AS xs FROM m)
    SELECT row_id, len(xs) AS n_clauses, xs[1] AS first_clause FROM c""",
)
def clause_counts(spark, d):
    t = table(spark, d, "ashby_jobs").where("description_plain IS NOT NULL").select("row_id", phrases.clauses("description_plain").alias("xs"))
    return t.select("row_id", F.size("xs").cast("long").alias("n_clauses"), F.get("xs", F.lit(0)).alias("first_clause"))


_LEVELS = {"intern": "intern|trainee|apprentice", "junior": "junior|jr|graduate|entry", "senior": "senior|sr", "staff": "staff", "principal": "principal|distinguished", "lead": "lead|head", "manager": "manager|director"}


@query(
    "s168_title_levels",
    f"""WITH k AS (SELECT row_id, ' ' || {key_sql("title")} || ' ' AS t FROM job_records WHERE title IS NOT NULL) SELECT row_id, CASE """
    + " ".join(f"WHEN regexp_matches(t, ' ({v}) ') THEN '{k}'" for k, v in _LEVELS.items())
    + " ELSE 'none' END AS level FROM k",
)
def title_levels(spark, d):
    k = F.concat(F.lit(" "), text.search_key("title"), F.lit(" "))
    out = F.lit("none")
    for name, words in reversed(list(_LEVELS.items())):
        out = F.when(k.rlike(f" ({words}) "), F.lit(name)).otherwise(out)
    return _jobs(spark, d).where("title IS NOT NULL").select("row_id", out.alias("level"))


@query(
    "s218_code_lookup",
    """WITH f AS (SELECT row_id, upper(trim(regexp_extract(location, ',\\s*([A-Za-z]{2})\\s*$', 1))) AS code FROM job_records) SELECT f.row_id, c.code, c.c1 AS country FROM f JOIN countries c ON c.code = f.code""",
)
def code_lookup(spark, d):
    """Country of the code that ends a location after a comma."""
    code = F.upper(F.trim(F.regexp_extract("location", r",\s*([A-Za-z]{2})\s*$", 1)))
    c = table(spark, d, "countries").select("code", F.col("c1").alias("country"))
    return _jobs(spark, d).select("row_id", code.alias("code")).join(bounded_broadcast(c), "code").select("row_id", "code", "country")


@query(
    "s332_common_area",
    """SELECT name, CASE WHEN count(DISTINCT country_code) = 1 THEN CASE WHEN count(DISTINCT region) = 1 AND count(region) = count(*) THEN 'region:' || min(region) ELSE 'country:' || min(country_code) END
    WHEN count(DISTINCT continent) = 1 THEN 'continent:' || min(continent) END AS area FROM places p JOIN countries c ON c.code = p.country_code GROUP BY name""",
)
def common_area(spark, d):
    """The smallest area that holds all places of one name, null where there is none."""
    p = table(spark, d, "places").join(bounded_broadcast(table(spark, d, "countries").select(F.col("code").alias("country_code"), "continent")), "country_code")
    one = lambda c: F.countDistinct(c) == 1
    area = F.when(one("country_code"), F.when(one("region") & (F.count("region") == F.count(F.lit(1))), F.concat(F.lit("region:"), F.min("region"))).otherwise(F.concat(F.lit("country:"), F.min("country_code")))).when(
        one("continent"), F.concat(F.lit("continent:"), F.min("continent"))
    )
    return p.groupBy("name").agg(area.alias("area"))


@query(
    "s331_membership",
    """WITH r AS (SELECT p.name, c.continent, count(*) AS n FROM places p JOIN countries c ON c.code = p.country_code GROUP BY 1, 2), t AS (SELECT name, sum(n) AS total FROM r GROUP BY 1)
    SELECT r.name, r.continent, CASE WHEN n = total THEN 'yes' ELSE 'maybe' END AS member FROM r JOIN t USING (name)""",
)
def membership(spark, d):
    """Continents that a place name may lie in: yes where all its readings do, else maybe; pairs that are missing are no."""
    c = table(spark, d, "countries").select(F.col("code").alias("country_code"), "continent")
    r = table(spark, d, "places").join(bounded_broadcast(c), "country_code").groupBy("name", "continent").agg(F.count(F.lit(1)).alias("n"))
    t = r.groupBy("name").agg(F.sum("n").alias("total"))
    return r.join(t, "name").select("name", "continent", F.when(F.col("n") == F.col("total"), "yes").otherwise("maybe").alias("member"))


@query(
    "s156_query_matrix",
    f"""SELECT k.kind || '/' || t.term || '/' || w.w AS query FROM (SELECT DISTINCT kind FROM boards) k, (SELECT unnest({_TERMS!r}) AS term) t, (SELECT unnest(['remote', 'hybrid', 'onsite']) AS w) w""",
)
def query_matrix(spark, d):
    """All combinations of the dimensions of a search, exploded from short lists."""
    k = table(spark, d, "boards").select("kind").distinct()
    m = k.select("kind", F.explode(F.array(*[F.lit(t) for t in _TERMS])).alias("term")).select("kind", "term", F.explode(F.array(*[F.lit(w) for w in ("remote", "hybrid", "onsite")])).alias("w"))
    return m.select(F.concat_ws("/", "kind", "term", "w").alias("query"))


@query(
    "s056_source_sets",
    "SELECT row_id FROM job_records WHERE source.kind || ':' || source.instance IN (SELECT kind || ':' || board FROM boards WHERE date_order = 'mdy') AND last_seen_at >= (SELECT max(last_seen_at) FROM job_records) - INTERVAL 30 DAY",
)
def source_sets(spark, d):
    """Rows of a set of sources that were seen within 30 days of the newest one."""
    j = _jobs(spark, d)
    newest = j.agg(F.max("last_seen_at")).first()[0]  # reaches the scan as a pushed filter
    b = table(spark, d, "boards").where("date_order = 'mdy'").select("kind", F.col("board").alias("instance"))
    recent = j.where(F.col("last_seen_at") >= F.lit(newest) - F.expr("INTERVAL 30 DAYS")).select("row_id", F.col("source.kind").alias("kind"), F.col("source.instance").alias("instance"))
    return recent.join(bounded_broadcast(b), ["kind", "instance"], "left_semi").select("row_id")


@query(
    "s149_show_limits",
    """SELECT doc_kind, doc_id FROM documents WHERE doc_kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_kind ORDER BY received_at DESC, doc_id) <= 5""",
)
def show_limits(spark, d):
    from lathe.operators.lifecycle import latest_per

    return latest_per(table(spark, d, "documents").where("doc_kind IS NOT NULL").select("doc_kind", "doc_id", "received_at"), ["doc_kind"], [F.desc("received_at"), F.col("doc_id")], 5).select("doc_kind", "doc_id")


@query(
    "s173_escapes",
    r"""SELECT row_id, replace(replace(replace(title, '\', '\\'), '%', '\%'), '_', '\_') AS pattern, hex(encode(title)) AS hexed, title AS back FROM ashby_jobs WHERE title IS NOT NULL""",
)
def escapes(spark, d):
    """Pattern escape, hexadecimal digits and back again."""
    t = table(spark, d, "ashby_jobs").where("title IS NOT NULL")
    return t.select("row_id", text.like_escape("title").alias("pattern"), F.hex(F.encode("title", "UTF-8")).alias("hexed"), F.decode(F.unhex(F.hex(F.encode("title", "UTF-8"))), "UTF-8").alias("back"))


@query(
    "s211_defaults",
    """SELECT row_id, coalesce(employment_type, 'unknown') AS employment_type, coalesce(len(locations), 0) AS n_places, list_sort(list_distinct(list_filter(coalesce(locations, []), lambda x: x IS NOT NULL)))[1] AS first_place,
    coalesce(list_contains(locations, 'Remote'), false) AS remote FROM job_records""",
)
def defaults(spark, d):
    """Absent fields as their defaults; a list without nulls and repeats, and whether it has a value."""
    empty = F.coalesce("locations", F.array().cast("array<string>"))
    clean = F.array_sort(F.array_distinct(F.array_compact(empty)))
    return _jobs(spark, d).select(
        "row_id", F.coalesce("employment_type", F.lit("unknown")).alias("employment_type"), F.size(empty).cast("long").alias("n_places"), F.get(clean, F.lit(0)).alias("first_place"),
        F.exists(empty, lambda x: F.coalesce(x == "Remote", F.lit(False))).alias("remote"),
    )


_TRACKED = "^(" + "|".join([*urls.TRACKING, *[p + ".*" for p in urls.TRACKING_PREFIXES]]) + ")$"


@query(
    "s177_canonical_urls",
    rf"""WITH u AS (SELECT row_id, trim(absolute_url) AS u FROM greenhouse_jobs), p AS (SELECT row_id, u, lower(regexp_extract(u, '^(https?)://', 1, 'i')) AS scheme, rtrim(lower(regexp_extract(u, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.') AS host,
      regexp_extract(u, '^[a-zA-Z]+://[^/?#]*?(?::(\d+))?(?:[/?#]|$)', 1) AS port, regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS q, regexp_extract(u, '#(.*)$', 1) AS frag FROM u),
    x AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda kv: kv <> '' AND split_part(kv, '=', 1) <> '' AND NOT regexp_matches(lower(split_part(kv, '=', 1)), '{_TRACKED}'))) AS kv FROM p)
    SELECT row_id, CASE WHEN scheme <> '' AND host <> '' THEN scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'https' AND port = '443') OR (scheme = 'http' AND port = '80') THEN '' ELSE ':' || port END
      || coalesce(nullif(rtrim(path, '/'), ''), '/') || CASE WHEN len(kv) > 0 THEN '?' || array_to_string(list_transform(kv, lambda y: CASE WHEN contains(y, '=') THEN y ELSE y || '=' END), '&') ELSE '' END
      || CASE WHEN starts_with(frag, '/') OR starts_with(frag, '!/') THEN '#' || frag ELSE '' END END AS url FROM x""",
)
def canonical_urls(spark, d):
    return table(spark, d, "greenhouse_jobs").select("row_id", urls.canonical_url(F.col("absolute_url")).alias("url"))


@query("s360_derived_boards", r"""WITH r AS (SELECT lower(regexp_extract(absolute_url, '^https?://([^/:?#]+)', 1)) AS host, board FROM greenhouse_jobs WHERE absolute_url IS NOT NULL)
    SELECT host, count(*) AS postings, count(DISTINCT board) AS boards FROM r GROUP BY host""")
def derived_boards(spark, d):
    pairs = table(spark, d, "greenhouse_jobs").where("absolute_url IS NOT NULL").groupBy(F.lower(F.regexp_extract("absolute_url", "^https?://([^/:?#]+)", 1)).alias("host"), "board").agg(F.count(F.lit(1)).alias("k"))
    return pairs.groupBy("host").agg(F.sum("k").alias("postings"), F.count("board").alias("boards"))


@query("s019_embedded_postings", """SELECT row_id, title, company AS company, job_url AS url FROM ashby_jobs WHERE title IS NOT NULL AND trim(title) <> '' AND company IS NOT NULL AND trim(company) <> '' AND job_url IS NOT NULL AND trim(job_url) <> ''""")
def embedded(spark, d):
    """Postings written into a page as linked data, and read out of it again."""
    t = table(spark, d, "ashby_jobs").where("title IS NOT NULL AND trim(title) <> '' AND company IS NOT NULL AND trim(company) <> '' AND job_url IS NOT NULL AND trim(job_url) <> ''")
    body = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", F.struct(F.col("company").alias("name")).alias("hiringOrganization"), F.col("job_url").alias("url")))
    page = F.concat(F.lit('<html><script type="application/ld+json">'), F.replace(body, F.lit("</"), F.lit("<\\/")), F.lit("</script></html>"))
    return t.select("row_id", page.alias("page")).select("row_id", F.explode(embedded_postings(F.col("page"))).alias("p")).select("row_id", "p.title", "p.company", "p.url")
