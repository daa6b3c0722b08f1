"""Queries of the engine's general operators on the job tables, each with its SQL where SQL can say it.

Names begin with the number of the operator in the survey's inventory.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import dates, ids, text, urls
from lathe.functions.html import absolute_urls, html_to_text
from lathe.operators import identity, joins, ledger, lifecycle, records, selection
from lathe.session import table
from lathe.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Search key in SQL, as ``text.search_key``.
_KEY = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


def key_sql(c: str) -> str:
    return _KEY.format(c=c)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _jobs(spark, d):
    return table(spark, d, "job_records")


def _scans(spark, d):
    """Scans once each, with one key for the source."""
    s = table(spark, d, "source_scans").dropDuplicates(["scan_id"])
    return s.withColumn("source", F.concat_ws(":", F.col("store_id").cast("string"), "source_kind", "source_instance"))


_SCANS = "WITH s AS (SELECT DISTINCT ON (scan_id) *, concat_ws(':', store_id, source_kind, source_instance) AS source FROM source_scans)"


@query(
    "s055_keyword_search",
    f"""SELECT row_id, title FROM job_records WHERE status = 'open'
    AND contains(' ' || {key_sql("concat_ws(' ', title, company, location, workplace_type)")} || ' ', ' senior')
    AND contains(' ' || {key_sql("concat_ws(' ', title, company, location, workplace_type)")} || ' ', ' engin')""",
)
def keyword_search(spark, d):
    doc = text.search_document("title", "company", "location", "workplace_type")
    return _jobs(spark, d).where((F.col("status") == "open") & text.has_terms(doc, "Senior engin")).select("row_id", "title")


@query(
    "s125_best_record",
    """SELECT opportunity_id, row_id, status FROM job_records WHERE opportunity_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY coalesce(status = 'open', false) DESC, first_seen_at NULLS FIRST, row_id) = 1""",
)
def best_record(spark, d):
    order = [F.coalesce(F.col("status") == "open", F.lit(False)).desc(), F.col("first_seen_at").asc_nulls_first(), F.col("row_id")]
    return selection.best_of(_jobs(spark, d).where("opportunity_id IS NOT NULL"), "opportunity_id", order).select("opportunity_id", "row_id", "status")


@query("s126_latest_scans", f"{_SCANS} SELECT source, scan_id, status FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY finished_at DESC, scan_id DESC) <= 3")
def latest_scans(spark, d):
    return lifecycle.latest_per(_scans(spark, d), ["source"], [F.desc("finished_at"), F.desc("scan_id")], 3).select("source", "scan_id", "status")


@query(
    "s127_latest_and_successful",
    f"""{_SCANS} SELECT source, arg_max(scan_id, finished_at::VARCHAR || lpad(scan_id::VARCHAR, 12, '0')) AS latest,
    arg_max(scan_id, finished_at::VARCHAR || lpad(scan_id::VARCHAR, 12, '0')) FILTER (WHERE status = 'listing') AS latest_ok FROM s GROUP BY source""",
)
def latest_and_successful(spark, d):
    return lifecycle.latest_and_latest_successful(_scans(spark, d), "source", "finished_at", "scan_id", F.col("status") == "listing", "scan_id")


@query(
    "s130_failure_run",
    f"""{_SCANS}, r AS (SELECT source, sum((status = 'listing')::INT) OVER (PARTITION BY source ORDER BY finished_at DESC, scan_id DESC ROWS UNBOUNDED PRECEDING) AS ok FROM s)
    SELECT source, count(*) FILTER (WHERE ok = 0) AS failures FROM r GROUP BY source""",
)
def failure_run(spark, d):
    return ledger.failure_runs(_scans(spark, d), ["source"], ["finished_at", "scan_id"], F.col("status") == "listing", {"failures": F.lit(True)})


@query(
    "s132_listing_size_change",
    f"""{_SCANS}, l AS (SELECT source, scan_id, received, lag(received) OVER w AS b, row_number() OVER w AS i FROM s WHERE complete WINDOW w AS (PARTITION BY source ORDER BY started_at, scan_id))
    SELECT source, scan_id, CASE WHEN i = 1 THEN 'first' WHEN received IS NOT DISTINCT FROM b THEN 'unchanged' WHEN b IS NULL THEN 'new' WHEN received IS NULL THEN 'removed' ELSE 'changed' END AS change FROM l""",
)
def listing_size_change(spark, d):
    return lifecycle.value_changes(_scans(spark, d).where("complete"), ["source"], ["started_at", "scan_id"], F.to_date("started_at"), "received").select("source", "scan_id", "change")


@query("s154_keep_first", "SELECT id, row_id FROM greenhouse_jobs QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at, row_id) = 1")
def keep_first(spark, d):
    return selection.best_of(table(spark, d, "greenhouse_jobs"), "id", [F.col("received_at"), F.col("row_id")]).select("id", "row_id")


@query(
    "s095_store_counts",
    "SELECT count(*) AS n_rows, count(DISTINCT job_id) AS n_jobs, count(DISTINCT opportunity_id) AS n_opportunities, count(*) FILTER (WHERE status = 'open') AS n_open, min(first_seen_at)::DATE AS first_day FROM job_records",
)
def store_counts(spark, d):
    return _jobs(spark, d).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("job_id").alias("n_jobs"), F.countDistinct("opportunity_id").alias("n_opportunities"),
        F.count_if(F.col("status") == "open").alias("n_open"), F.to_date(F.min("first_seen_at")).alias("first_day"),
    )


@query("s097_last_checked", f"{_SCANS} SELECT source, strftime(max(finished_at) FILTER (WHERE status = 'listing'), '%Y-%m-%d %H:%M:%S') AS last_ok FROM s GROUP BY source")
def last_checked(spark, d):
    return _scans(spark, d).groupBy("source").agg(F.date_format(F.max(F.when(F.col("status") == "listing", F.col("finished_at"))), "yyyy-MM-dd HH:mm:ss").alias("last_ok"))


@query(
    "s100_ingest_counters",
    f"{_SCANS} SELECT source_kind, count(*) AS scans, count(*) FILTER (WHERE complete) AS complete_scans, sum(received)::BIGINT AS received, sum(normalized)::BIGINT AS normalized, sum(rejected)::BIGINT AS rejected FROM s GROUP BY source_kind",
)
def ingest_counters(spark, d):
    total = [F.sum(c).alias(c) for c in ("received", "normalized", "rejected")]
    return _scans(spark, d).groupBy("source_kind").agg(F.count(F.lit(1)).alias("scans"), F.count_if("complete").alias("complete_scans"), *total)


@query(
    "s108_freshness",
    """WITH a AS (SELECT source.kind AS source_kind, floor((epoch_us(last_seen_at) - epoch_us(posted_at)) / 86400000000) AS days FROM job_records)
    SELECT source_kind, count(*) FILTER (WHERE days < 7) AS under_7, count(*) FILTER (WHERE days < 30) AS under_30, count(*) FILTER (WHERE days > 90) AS over_90, count(*) FILTER (WHERE days IS NULL) AS undated,
    round(count(*) FILTER (WHERE days > 90) / nullif(count(days), 0), 4) AS stale_share FROM a GROUP BY source_kind""",
)
def freshness(spark, d):
    a = _jobs(spark, d).select(F.col("source.kind").alias("source_kind"), dates.whole_days("last_seen_at", "posted_at").alias("days"))
    over = F.count_if(F.col("days") > 90)
    return a.groupBy("source_kind").agg(
        F.count_if(F.col("days") < 7).alias("under_7"), F.count_if(F.col("days") < 30).alias("under_30"), over.alias("over_90"), F.count_if(F.col("days").isNull()).alias("undated"),
        F.round(over / F.nullif(F.count("days"), F.lit(0)), 4).alias("stale_share"),
    )


@query(
    "s110_source_yield",
    """SELECT source.instance AS board, count(*) FILTER (WHERE workplace_type = 'remote') AS remote, count(*) FILTER (WHERE workplace_type = 'hybrid') AS hybrid,
    count(*) FILTER (WHERE workplace_type IS NULL OR workplace_type NOT IN ('remote', 'hybrid')) AS other FROM job_records GROUP BY source.instance""",
)
def source_yield(spark, d):
    w = F.coalesce(F.col("workplace_type"), F.lit("?"))
    df = _jobs(spark, d).select(F.col("source.instance").alias("board"), F.when(w.isin("remote", "hybrid"), w).otherwise("other").alias("w"))
    return df.groupBy("board").agg(*[F.count_if(F.col("w") == x).alias(x) for x in ("remote", "hybrid", "other")])


@query("s116_complete_share", f"{_SCANS} SELECT source_kind, round(count(*) FILTER (WHERE complete) / nullif(count(*), 0), 4) AS share FROM s GROUP BY source_kind")
def complete_share(spark, d):
    return _scans(spark, d).groupBy("source_kind").agg(F.round(F.try_divide(F.count_if("complete"), F.count(F.lit(1))), 4).alias("share"))


@query("s120_percentiles", "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
def percentiles(spark, d):
    return selection.percentile_nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", [0.5, 0.9])


@query(
    "s133_one_per_company",
    f"""WITH k AS (SELECT *, {key_sql("company")} AS company_key FROM job_records WHERE company IS NOT NULL), r AS (
      SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY posted_at DESC NULLS LAST, row_id) AS n, count(*) OVER (PARTITION BY company_key) - 1 AS followers FROM k)
    SELECT company_key, row_id AS leader, (row_number() OVER (ORDER BY posted_at DESC NULLS LAST, row_id))::INT AS position, followers FROM r WHERE n = 1 ORDER BY position LIMIT 10""",
)
def one_per_company(spark, d):
    df = _jobs(spark, d).where("company IS NOT NULL").withColumn("company_key", text.search_key("company"))
    return selection.one_per_group(df, "company_key", [F.col("posted_at").desc_nulls_last(), F.col("row_id")], 10, "row_id")


@query("s137_listing_order", "SELECT row_id, title FROM job_records ORDER BY posted_at DESC NULLS LAST, first_seen_at DESC, row_id LIMIT 25")
def listing_order(spark, d):
    return _jobs(spark, d).orderBy(F.col("posted_at").desc_nulls_last(), F.desc("first_seen_at"), "row_id").limit(25).select("row_id", "title")


@query("s148_seeded_sample", "SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 20")
def seeded_sample(spark, d):
    return selection.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 7, 20)


@query("s142_work_queue", f"{_SCANS} SELECT scan_id FROM s ORDER BY CASE WHEN status = 'failed' THEN 0 WHEN NOT complete THEN 1 ELSE 2 END, finished_at NULLS FIRST, scan_id LIMIT 50")
def work_queue(spark, d):
    first = F.when(F.col("status") == "failed", 0).when(~F.col("complete"), 1).otherwise(2)
    return selection.work_queue(_scans(spark, d), first, "finished_at", "scan_id", 50).select("scan_id")


@query(
    "s059_prefix",
    "WITH h AS (SELECT DISTINCT job_id FROM job_records WHERE starts_with(job_id, 'job_00')) SELECT count(*) AS matches, CASE WHEN count(*) = 1 THEN min(job_id) END AS only FROM h",
)
def prefix(spark, d):
    return selection.by_prefix(_jobs(spark, d), "job_id", "job_00")


@query(
    "s159_text_keys",
    f"""SELECT row_id, nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') AS line, {key_sql("title")} AS key, regexp_replace(lower(title), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g') AS squashed,
    replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM ashby_jobs""",
)
def text_keys(spark, d):
    t = table(spark, d, "ashby_jobs")
    return t.select("row_id", text.clean_line("title").alias("line"), text.search_key("title").alias("key"), text.squash("title").alias("squashed"), text.html_escape("title").alias("escaped"))


@query(
    "s157_title_similarity",
    f"""WITH b AS (SELECT *, first_value(title) OVER (PARTITION BY opportunity_id ORDER BY row_id) AS first_title FROM job_records WHERE opportunity_id IS NOT NULL AND title IS NOT NULL),
    w AS (SELECT row_id, list_distinct(list_filter(string_split({key_sql("title")}, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split({key_sql("first_title")}, ' '), lambda x: x <> '')) AS y FROM b)
    SELECT row_id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0), 4) AS similarity FROM w""",
)
def title_similarity(spark, d):
    df = _jobs(spark, d).where("opportunity_id IS NOT NULL AND title IS NOT NULL").select("row_id", "opportunity_id", "title")
    first = df.groupBy("opportunity_id").agg(F.min_by("title", "row_id").alias("first_title"))
    return df.join(first, "opportunity_id").select("row_id", F.round(text.word_similarity("title", "first_title"), 4).alias("similarity"))


@query(
    "s167_title_compatibility",
    f"""WITH a AS (SELECT opportunity_id, min({key_sql("title")}) AS x, max({key_sql("title")}) AS y FROM job_records WHERE opportunity_id IS NOT NULL AND title IS NOT NULL GROUP BY opportunity_id)
    SELECT opportunity_id, x <> '' AND y <> '' AND (contains(' ' || x || ' ', ' ' || y || ' ') OR contains(' ' || y || ' ', ' ' || x || ' ')) AS compatible FROM a""",
)
def title_compatibility(spark, d):
    k = text.search_key("title")
    df = _jobs(spark, d).where("opportunity_id IS NOT NULL AND title IS NOT NULL").groupBy("opportunity_id").agg(F.min(k).alias("x"), F.max(k).alias("y"))
    return df.select("opportunity_id", text.titles_compatible("x", "y").alias("compatible"))


@query("s180_url_parts", "SELECT row_id, lower(regexp_extract(job_url, '^https?://([^/:?#]+)', 1)) AS host, nullif(regexp_extract(job_url, '/p/([0-9a-f-]{36})', 1), '') AS native FROM ashby_jobs")
def url_parts(spark, d):
    t = table(spark, d, "ashby_jobs")
    return t.select("row_id", urls.host("job_url").alias("host"), F.nullif(F.regexp_extract("job_url", "/p/([0-9a-f-]{36})", 1), F.lit("")).alias("native"))


@query("s182_posting_text")
def posting_text(spark, d):
    return table(spark, d, "greenhouse_jobs").select("row_id", html_to_text(F.col("content"), escaped=True).alias("text"))


@query(
    "s018_urls_in_text",
    r"""WITH u AS (SELECT doc_id, regexp_extract_all(text, '(https?://[^\s"''<>\\)\]}]+)', 1) AS us FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, unnest(range(1, len(us) + 1)) AS pos, unnest(us) AS url FROM u""",
)
def urls_in_text(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.posexplode(absolute_urls(F.col("text"))).alias("i", "url")).select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), "url")


@query("s123_domains", r"""WITH u AS (SELECT unnest(regexp_extract_all(text, 'https?://([^\s/"''<>\\)\]}]+)', 1)) AS domain FROM documents) SELECT lower(domain) AS domain, count(*) AS n FROM u GROUP BY 1""")
def domains(spark, d):
    u = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"""https?://([^\s/"'<>\\)\]}]+)"""), 1)).alias("domain"))
    return u.groupBy(F.lower("domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s184_stable_ids",
    "SELECT row_id, 'job_' || left(sha256(unhex(printf('%016x', 3)) || 'job'::BLOB || unhex(printf('%016x', strlen(board))) || encode(board) || unhex(printf('%016x', strlen(id))) || encode(id)), 32) AS stable_id FROM ashby_jobs",
)
def stable_ids(spark, d):
    return table(spark, d, "ashby_jobs").select("row_id", ids.stable_id("job", "board", "id", prefix="job_").alias("stable_id"))


def _records(spark, d):
    return _jobs(spark, d).select("job_id", F.concat_ws(":", "source.kind", "source.instance").alias("source"), "title", "location", "first_seen_at", "received_at", "row_id").transform(
        lambda x: selection.best_of(x, "job_id", [F.col("received_at"), F.col("row_id")])
    )


def _links(spark, d):
    r = _records(spark, d)
    keys = {"name": F.concat_ws("|", text.search_key("location"), text.search_key("title"))}
    return r, identity.candidate_links(r, identity.evidence(r, keys))


@query(
    "s299_identity_links",
    f"""WITH r AS (SELECT job_id, concat_ws(':', source.kind, source.instance) AS source, title, concat_ws('|', {key_sql("location")}, {key_sql("title")}) AS k FROM job_records
      QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY received_at, row_id) = 1), p AS (SELECT k, source, count(*) AS n, min(job_id) AS job_id FROM r WHERE k <> '' GROUP BY k, source),
    g AS (SELECT k, min_by(job_id, source) AS a FROM p GROUP BY k HAVING count(*) > 1 AND max(n) = 1)
    SELECT 'name:' || p.k AS key, g.a, p.job_id AS b FROM p JOIN g USING (k) WHERE p.job_id <> g.a""",
)
def identity_links(spark, d):
    return _links(spark, d)[1].select("key", "a", "b")


@query("s300_identity_groups")
def identity_groups(spark, d):
    return identity.groups(*_links(spark, d))


@query(
    "s302_look_alikes",
    f"""WITH r AS (SELECT row_id, id, board, {key_sql("company")} AS company_key, {key_sql("title")} AS title_key FROM ashby_jobs WHERE id IS NOT NULL)
    SELECT company_key, title_key, count(*) AS n_jobs FROM r WHERE company_key <> '' AND title_key <> '' GROUP BY 1, 2 HAVING count(DISTINCT board) > 1 AND count(DISTINCT id) > 1""",
)
def look_alikes(spark, d):
    """Equal company and title on several boards under several ids."""
    j = table(spark, d, "ashby_jobs").where("id IS NOT NULL").select(F.col("row_id").alias("job_id"), F.col("board").alias("source"), "company", "title", "id")
    return identity.look_alikes(j.drop("id"), j.select("job_id", F.col("id").alias("founder")))


@query("s073_semi_join", "SELECT row_id FROM job_records r WHERE EXISTS (SELECT 1 FROM stored_jobs s WHERE s.job_id = r.job_id)")
def semi_join(spark, d):
    return _jobs(spark, d).join(table(spark, d, "stored_jobs").select("job_id"), "job_id", "left_semi").select("row_id")


@query("s079_anti_join", "SELECT board FROM boards b WHERE NOT EXISTS (SELECT 1 FROM source_scans s WHERE s.source_kind = b.kind AND s.source_instance = b.board)")
def anti_join(spark, d):
    s = table(spark, d, "source_scans").select(F.col("source_kind").alias("kind"), F.col("source_instance").alias("board"))
    return table(spark, d, "boards").join(s, ["kind", "board"], "left_anti").select("board")


@query(
    "s077_companies_seen",
    f"""SELECT DISTINCT {key_sql("b.company")} AS company_key FROM stored_jobs t JOIN source_scans s USING (scan_id) JOIN boards b ON b.board = s.source_instance AND b.kind = s.source_kind WHERE s.complete""",
)
def companies_seen(spark, d):
    s = table(spark, d, "source_scans").where("complete").select("scan_id", F.col("source_instance").alias("board"), F.col("source_kind").alias("kind")).distinct()
    held = s.join(table(spark, d, "stored_jobs").select("scan_id"), "scan_id", "left_semi")
    return held.join(table(spark, d, "boards"), ["board", "kind"]).select(text.search_key("company").alias("company_key")).distinct()


@query(
    "s074_lateral_latest",
    f"""{_SCANS} SELECT b.board, l.scan_id FROM boards b LEFT JOIN LATERAL (SELECT scan_id FROM s WHERE s.source_instance = b.board AND s.source_kind = b.kind ORDER BY started_at DESC, scan_id DESC LIMIT 1) l ON true""",
)
def lateral_latest(spark, d):
    s = _scans(spark, d).groupBy(F.col("source_kind").alias("kind"), F.col("source_instance").alias("board")).agg(F.max_by("scan_id", F.struct("started_at", "scan_id")).alias("scan_id"))
    return table(spark, d, "boards").join(s, ["kind", "board"], "left").select("board", "scan_id")


@query(
    "s074_as_of_join",
    """WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def as_of_join(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.as_of(bought, views, ["user_id"], "ts", "seen", ["view_id"]).select("event_id", "view_id")


@query(
    "s092_period_overlap",
    f"""{_SCANS}, e AS (SELECT scan_id, source_kind, epoch_us(started_at) // 1000000 AS f, epoch_us(finished_at) // 1000000 + 86400 AS t FROM s WHERE NOT complete)
    SELECT a.scan_id AS scan_a, b.scan_id AS scan_b FROM e a JOIN e b ON a.source_kind = b.source_kind AND a.scan_id < b.scan_id AND a.f <= b.t AND b.f <= a.t""",
)
def period_overlap(spark, d):
    sec = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).cast("long")
    e = _scans(spark, d).where("NOT complete").select("scan_id", "source_kind", sec("started_at").alias("f"), (sec("finished_at") + 86_400).alias("t"))  # a scan counts for the day after it
    a, b = e.select("source_kind", F.col("scan_id").alias("scan_a"), F.col("f").alias("fa"), F.col("t").alias("ta")), e.select("source_kind", F.col("scan_id").alias("scan_b"), F.col("f").alias("fb"), F.col("t").alias("tb"))
    return joins.overlapping(a, b, ["source_kind"], 86_400, "fa", "ta", "fb", "tb").where("scan_a < scan_b").select("scan_a", "scan_b")


@query(
    "s088_all_keys_present",
    """WITH w AS (SELECT DISTINCT source_kind AS owner, status AS k FROM source_scans), h AS (SELECT DISTINCT source_kind || ':' || source_instance AS item, status AS k FROM source_scans)
    SELECT owner, item FROM w JOIN h USING (k) GROUP BY owner, item HAVING count(*) = (SELECT count(*) FROM w w2 WHERE w2.owner = w.owner)""",
)
def all_keys(spark, d):
    s = table(spark, d, "source_scans")
    wanted = s.select(F.col("source_kind").alias("owner"), F.col("status").alias("k"))
    have = s.select(F.concat_ws(":", "source_kind", "source_instance").alias("item"), F.col("status").alias("k"))
    return joins.all_keys_present(wanted, have, "owner", "item", "k")


@query(
    "s091_containment",
    """SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
)
def containment(spark, d):
    # Aggregated by the key before the two small joins.
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "customers", F.round("balance", 2).alias("balance"))


@query("s150_union_distinct", "SELECT company FROM job_records WHERE company IS NOT NULL UNION SELECT company FROM ashby_jobs WHERE company IS NOT NULL UNION SELECT company_name FROM greenhouse_jobs WHERE company_name IS NOT NULL")
def union_distinct(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("company")) for t, c in (("job_records", "company"), ("ashby_jobs", "company"), ("greenhouse_jobs", "company_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("company IS NOT NULL").distinct()


@query("s155_missing_set", "SELECT job_id FROM job_records WHERE status = 'open' AND job_id IS NOT NULL EXCEPT SELECT job_id FROM stored_jobs")
def missing_set(spark, d):
    return _jobs(spark, d).where("status = 'open' AND job_id IS NOT NULL").select("job_id").subtract(table(spark, d, "stored_jobs").select("job_id"))


@query("s158_intersection", "SELECT job_id FROM job_records INTERSECT SELECT job_id FROM stored_jobs")
def intersection(spark, d):
    return _jobs(spark, d).select("job_id").intersect(table(spark, d, "stored_jobs").select("job_id"))


_RANKS = {"view": 0, "click": 1, "signup": 2, "purchase": 3}


@query(
    "s284_state_fold",
    """SELECT user_id, max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END)::INT AS furthest,
    last(event_type ORDER BY ts, event_id) AS last_type, count(*) AS n_events FROM events GROUP BY user_id""",
)
def state_fold(spark, d):
    return ev.batch_fold(table(spark, d, "events"), _RANKS)


@query(
    "s046_exposures",
    """SELECT user_id, (json_extract(props, '$.k'))::INT AS item, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day, count(*) AS times, arg_max(event_type, ts) AS last_type FROM events GROUP BY 1, 2""",
)
def exposures(spark, d):
    e = table(spark, d, "events").withColumn("item", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("user_id", "item").agg(F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"), F.count(F.lit(1)).alias("times"), F.max_by("event_type", "ts").alias("last_type"))


@query("stream_windowed_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n_events, round(sum(value), 2) AS sum_value FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    w = ev.windowed_counts(table(spark, d, "events"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", "sum_value")


@query("stream_live_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n_events, round(sum(value), 2) AS sum_value FROM events GROUP BY 1, 2")
def live_counts(spark, d):
    """The windowed counts of the stream of the events' files, with its watermark."""
    w = ev.drained(ev.windowed_counts(ev.event_stream(spark, d)), "complete")
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", "sum_value")


@query("stream_live_once", "SELECT DISTINCT event_id, user_id FROM events")
def live_once(spark, d):
    """Each event of the stream once, by the state that the watermark keeps."""
    return ev.drained(ev.deduplicated(ev.event_stream(spark, d)).select("event_id", "user_id"), "append")


@query(
    "stream_live_fold",
    """SELECT user_id, max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END)::INT AS furthest, last(event_type ORDER BY ts, event_id) AS last_type, count(*) AS n_events FROM events GROUP BY user_id""",
)
def live_fold(spark, d):
    """The keyed state of every user after the stream: of a user's rows the last one, which has counted most events."""
    rows = ev.drained(ev.fold_state(ev.event_stream(spark, d), _RANKS), "update")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("furthest", "last_type", "n_events"), "n_events").alias("x")).select("user_id", "x.*")


@query("s292_changes_after_cursor", "SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) - 500 FROM events)")
def after_cursor(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("event_id")).first()[0]  # the cursor: one number, which then reaches the scan as a pushed filter
    return e.where(F.col("event_id") > F.lit((last or 0) - 500)).select("event_id", "user_id")


@query(
    "s102_tally",
    "SELECT coalesce(closing_withheld, 'none') AS reason, count(*) FILTER (WHERE source_kind = 'ashby') AS ashby, count(*) FILTER (WHERE source_kind = 'greenhouse') AS greenhouse FROM (SELECT DISTINCT ON (scan_id) * FROM source_scans) GROUP BY 1",
)
def tally(spark, d):
    return _scans(spark, d).groupBy(F.coalesce("closing_withheld", F.lit("none")).alias("reason")).agg(*[F.count_if(F.col("source_kind") == k).alias(k) for k in ("ashby", "greenhouse")])


@query("s044_idempotent_insert", "SELECT DISTINCT s.job_id FROM stored_jobs s WHERE NOT EXISTS (SELECT 1 FROM job_records r WHERE r.job_id = s.job_id)")
def idempotent_insert(spark, d):
    return lifecycle.append_new(_jobs(spark, d).select("job_id"), table(spark, d, "stored_jobs").select("job_id"), ["job_id"])


# Facts from several statements

_P = "SELECT *, concat_ws(':', source.kind, source.instance) AS src FROM job_records"


@query("s254_supersession", "SELECT row_id, row_number() OVER (PARTITION BY job_id ORDER BY received_at DESC, row_id DESC) = 1 AS active FROM job_records")
def supersession(spark, d):
    return records.standing(_jobs(spark, d), ["job_id"], [F.col("received_at"), F.col("row_id")]).select("row_id", "active")


@query(
    "s255_composition",
    """WITH b AS (SELECT opportunity_id, arg_min(workplace_type, (CASE WHEN status = 'open' THEN '0' ELSE '1' END) || lpad(row_id::VARCHAR, 12, '0')) AS value, count(DISTINCT workplace_type) - 1 AS others
      FROM job_records WHERE workplace_type IS NOT NULL AND opportunity_id IS NOT NULL GROUP BY opportunity_id)
    SELECT b.opportunity_id, b.value, count(*) AS agreeing, any_value(others) AS others FROM b JOIN job_records r ON r.opportunity_id = b.opportunity_id AND r.workplace_type = b.value GROUP BY 1, 2""",
)
def composition(spark, d):
    j = _jobs(spark, d).where("workplace_type IS NOT NULL AND opportunity_id IS NOT NULL")
    return records.composed(j, ["opportunity_id"], "workplace_type", F.when(F.col("status") == "open", 0).otherwise(1), "row_id")


@query(
    "s251_field_ownership",
    """SELECT job_id, arg_max(title, (status IS NOT DISTINCT FROM 'open')::INT::VARCHAR || received_at::VARCHAR || lpad(row_id::VARCHAR, 12, '0')) AS value,
    count(DISTINCT title) > 1 AND NOT bool_or(status IS NOT DISTINCT FROM 'open') AS disputed FROM job_records WHERE title IS NOT NULL GROUP BY job_id""",
)
def field_ownership(spark, d):
    return records.owned_fields(_jobs(spark, d).where("title IS NOT NULL"), ["job_id"], "title", F.col("status").eqNullSafe(F.lit("open")), "received_at", "row_id")


@query(
    "s119_majority",
    """WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT user_id, sum(n) AS total, max(n) AS most, arg_max(event_type, lpad(n::VARCHAR, 9, '0') || event_type) AS top, bool_or(event_type = 'error' AND n > 0) AS veto FROM v GROUP BY 1)
    SELECT user_id, CASE WHEN veto OR most * 2 <= total THEN 'unclear' ELSE top END AS verdict FROM a""",
)
def majority_vote(spark, d):
    return records.majority(table(spark, d, "events"), ["user_id"], "event_type", F.col("event_type") == "error")


@query(
    "s118_stability",
    "WITH e AS (SELECT opportunity_id, count(DISTINCT coalesce(employment_type, chr(1))) = 1 AS same FROM job_records WHERE opportunity_id IS NOT NULL GROUP BY 1) SELECT count(*) AS items, round(avg(same::INT), 4) AS stable_share FROM e",
)
def answer_stability(spark, d):
    return records.stability(_jobs(spark, d).where("opportunity_id IS NOT NULL"), ["opportunity_id"], "employment_type")


@query(
    "s116_precision",
    """SELECT source.kind AS kind, count(*) FILTER (WHERE status = 'open') AS surfaced, round(count(*) FILTER (WHERE status = 'open' AND workplace_type = 'remote') / nullif(count(*) FILTER (WHERE status = 'open'), 0), 4) AS strict,
    round(count(*) FILTER (WHERE status = 'open' AND workplace_type IN ('remote', 'hybrid')) / nullif(count(*) FILTER (WHERE status = 'open'), 0), 4) AS relaxed FROM job_records GROUP BY 1""",
)
def precision_shares(spark, d):
    w = F.col("workplace_type")
    j = _jobs(spark, d).withColumn("kind", F.col("source.kind"))
    return records.precision(j, ["kind"], F.col("status").eqNullSafe(F.lit("open")), w.eqNullSafe(F.lit("remote")), w.eqNullSafe(F.lit("hybrid")))


@query(
    "s303_sightings",
    f"""WITH p AS ({_P}) SELECT company, arg_min(workplace_type, first_seen_at::VARCHAR || workplace_type) AS workplace_type, arg_min(employment_type, first_seen_at::VARCHAR || employment_type) AS employment_type,
    count(*) AS seen, count(DISTINCT src) AS places FROM p WHERE company IS NOT NULL GROUP BY company""",
)
def lead_sightings(spark, d):
    j = _jobs(spark, d).withColumn("src", F.concat_ws(":", "source.kind", "source.instance"))
    return records.sightings(j, "company", "first_seen_at", ["workplace_type", "employment_type"], "src")


@query(
    "s217_plausible_readings",
    """WITH t AS (SELECT name, max(population) AS top FROM places GROUP BY name) SELECT p.name, count(DISTINCT geo_id) AS refs, arg_max(geo_id, population * 1000000 + geo_id) AS first, count(DISTINCT geo_id) > 1 AS ambiguous
    FROM places p JOIN t USING (name) WHERE population >= top * 0.1 GROUP BY p.name""",
)
def plausible(spark, d):
    return records.plausible_readings(table(spark, d, "places"), "name", "geo_id", "population")


@query(
    "s219_place_containment",
    """SELECT c.continent, c.c1 AS country, p.region, count(*) AS places, sum(p.population)::BIGINT AS population FROM places p JOIN countries c ON c.code = p.country_code GROUP BY ALL""",
)
def place_containment(spark, d):
    p = table(spark, d, "places").groupBy(F.col("country_code").alias("code"), "region").agg(F.count(F.lit(1)).alias("places"), F.sum("population").alias("population"))
    return p.join(table(spark, d, "countries").select("code", "continent", F.col("c1").alias("country")), "code").select("continent", "country", "region", "places", "population")


@query(
    "s111_yield_report",
    """SELECT source.kind AS kind, count(*) AS hits, count(DISTINCT job_id) AS jobs, count(DISTINCT company) AS companies, round(1 - count(DISTINCT job_id) / count(*), 4) AS duplicate_rate,
    round(count(*) FILTER (WHERE status = 'closed') / count(*), 4) AS stale_rate FROM job_records GROUP BY 1""",
)
def yield_report(spark, d):
    n = F.count(F.lit(1))
    return _jobs(spark, d).groupBy(F.col("source.kind").alias("kind")).agg(
        n.alias("hits"), F.countDistinct("job_id").alias("jobs"), F.countDistinct("company").alias("companies"), F.round(1 - F.countDistinct("job_id") / n, 4).alias("duplicate_rate"),
        F.round(F.count_if(F.col("status") == "closed") / n, 4).alias("stale_rate"),
    )


@query("s164_sentences")
def sentences(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.posexplode(text.sentence_list("text")).alias("pos", "sentence"))


@query("s163_words")
def words(spark, d):
    t = table(spark, d, "ashby_jobs").where("title IS NOT NULL")
    return t.select("row_id", F.posexplode(text.words_with_offsets("title")).alias("pos", "w")).select("row_id", "pos", "w.*")
