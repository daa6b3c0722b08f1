"""Queries of statements about people and companies, of marks and observations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import text
from lathe.operators import identity, ledger, lifecycle, phrases
from lathe.plans.general import _jobs, key_sql
from lathe.plans.places import _TERMS
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


def _positions(spark, d):
    p = table(spark, d, "linkedin_positions")
    return p.withColumns({"company_key": text.search_key("company_name"), "title_key": text.search_key("title")})


_POS = f"p AS (SELECT *, {key_sql('company_name')} AS company_key, {key_sql('title')} AS title_key FROM linkedin_positions)"


@query(
    "s093_same_position",
    f"""WITH {_POS} SELECT row_id, min(row_id) OVER (PARTITION BY profile_id, company_key, title_key, coalesce(started_on, '')) AS class_id FROM p WHERE profile_id IS NOT NULL AND company_key <> '' AND title_key <> ''""",
)
def same_position(spark, d):
    """Rows of a profile that state one position: company, title and start agree; the class is its least row."""
    keys = ["profile_id", "company_key", "title_key", "start"]
    p = _positions(spark, d).where("profile_id IS NOT NULL AND company_key <> '' AND title_key <> ''").select("row_id", *keys[:3], F.coalesce("started_on", F.lit("")).alias("start"))
    return p.join(p.groupBy(*keys).agg(F.min("row_id").alias("class_id")), keys).select("row_id", "class_id")


@query("s062_claims", "SELECT row_id, title FROM linkedin_positions WHERE title IS NOT NULL AND company_name IS NOT NULL AND finished_on IS NULL AND description IS NOT NULL")
def claims(spark, d):
    return table(spark, d, "linkedin_positions").where("title IS NOT NULL AND company_name IS NOT NULL AND finished_on IS NULL AND description IS NOT NULL").select("row_id", "title")


_STAND = f"""WITH {_POS}, gone AS (SELECT {key_sql('company')} AS company_key FROM job_records WHERE company IS NOT NULL GROUP BY 1 HAVING bool_and(coalesce(status, '') = 'closed')),
    s AS (SELECT p.*, CASE WHEN g.company_key IS NOT NULL THEN 'rejected' WHEN started_on IS NULL OR title IS NULL THEN 'review' ELSE 'usable' END AS standing FROM p LEFT JOIN gone g USING (company_key))"""


def _standing(spark, d):
    """Positions with their standing: rejected with a company that has only closed jobs, to review without title or start."""
    gone = _jobs(spark, d).where("company IS NOT NULL").groupBy(text.search_key("company").alias("company_key")).agg(F.bool_and(F.coalesce("status", F.lit("")) == "closed").alias("gone")).where("gone")
    p = _positions(spark, d).join(gone, "company_key", "left")
    return p.withColumn("standing", F.when(F.col("gone"), "rejected").when(F.col("started_on").isNull() | F.col("title").isNull(), "review").otherwise("usable"))


@query("s063_claim_standing", f"{_STAND} SELECT row_id, standing FROM s")
def claim_standing(spark, d):
    return _standing(spark, d).select("row_id", "standing")


@query("s064_visible", f"{_STAND} SELECT profile_id, row_id, row_number() OVER (PARTITION BY profile_id ORDER BY row_id)::INT AS pos FROM s WHERE standing <> 'rejected' AND profile_id IS NOT NULL")
def visible(spark, d):
    seen = _standing(spark, d).where("standing <> 'rejected' AND profile_id IS NOT NULL").select("profile_id", "row_id")
    return ledger.history(seen, ["profile_id"], ["row_id"], F.floor(F.col("row_id") / 10_000)).select("profile_id", "row_id", F.col("pos").cast("int").alias("pos"))


@query(
    "s141_claim_order",
    f"{_STAND} SELECT row_id FROM s ORDER BY CASE standing WHEN 'usable' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, finished_on IS NOT NULL, profile_id NULLS LAST, row_id LIMIT 60",
)
def claim_order(spark, d):
    rank = F.when(F.col("standing") == "usable", 0).when(F.col("standing") == "review", 1).otherwise(2)
    return _standing(spark, d).orderBy(rank, F.col("finished_on").isNotNull(), F.col("profile_id").asc_nulls_last(), "row_id").limit(60).select("row_id")


@query(
    "s082_skill_evidence",
    f"""WITH v AS (SELECT unnest({_TERMS!r}) AS term), p AS (SELECT DISTINCT profile_id, term FROM linkedin_positions JOIN v ON contains(' ' || {key_sql('title')} || ' ', ' ' || term || ' ') WHERE profile_id IS NOT NULL),
    j AS (SELECT term, count(*) AS jobs FROM job_records JOIN v ON contains(' ' || {key_sql('title')} || ' ', ' ' || term || ' ') GROUP BY term) SELECT profile_id, term, jobs FROM p JOIN j USING (term)""",
)
def skill_evidence(spark, d):
    """Terms that a profile's titles say, with the number of jobs that say them."""
    terms = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    said = phrases.phrases_in(table(spark, d, "linkedin_positions").where("profile_id IS NOT NULL"), "profile_id", "title", terms, "term").select("profile_id", "term").distinct()
    jobs = phrases.phrases_in(_jobs(spark, d), "row_id", "title", terms, "term").select("row_id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("jobs"))
    return said.join(bounded_broadcast(jobs), "term").select("profile_id", "term", "jobs")


@query(
    "s085_candidates",
    """WITH b AS (SELECT opportunity_id, min(row_id) AS row_id, count(*) AS siblings FROM job_records WHERE opportunity_id IS NOT NULL GROUP BY 1),
    k AS (SELECT job_id, max(loaded_at) AS checked, count(DISTINCT scan_id) AS scans FROM stored_jobs GROUP BY 1)
    SELECT r.row_id, b.siblings, k.scans, strftime(k.checked, '%Y-%m-%d') AS checked, c.company IS NOT NULL AS on_board FROM b JOIN job_records r USING (row_id) LEFT JOIN k ON k.job_id = r.job_id LEFT JOIN boards c ON c.board = r.source.instance AND c.company = r.company""",
)
def candidates(spark, d):
    """One row an opportunity: its first record with siblings, checks and whether its board names its company."""
    j = _jobs(spark, d)
    b = j.where("opportunity_id IS NOT NULL").groupBy("opportunity_id").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("siblings"))
    seen = table(spark, d, "stored_jobs").groupBy("job_id", "scan_id").agg(F.max("loaded_at").alias("at")).groupBy("job_id").agg(F.max("at").alias("checked"), F.count("scan_id").alias("scans"))
    boards = bounded_broadcast(table(spark, d, "boards").select(F.col("board").alias("instance"), "company", F.lit(True).alias("on_board")))
    r = j.select("row_id", "job_id", "company", F.col("source.instance").alias("instance")).join(b, "row_id").join(seen, "job_id", "left").join(boards, ["instance", "company"], "left")
    return r.select("row_id", "siblings", "scans", F.date_format("checked", "yyyy-MM-dd").alias("checked"), F.coalesce("on_board", F.lit(False)).alias("on_board"))


@query(
    "s087_zipped",
    """WITH z AS (SELECT row_id, unnest(range(1, len(locations) + 1)) AS pos, unnest(locations) AS place, len(locations) AS n FROM job_records WHERE len(locations) > 0) SELECT row_id, pos::INT AS pos, place, n::INT AS n FROM z""",
)
def zipped(spark, d):
    """Parallel arrays as rows: each place with its position."""
    t = _jobs(spark, d).where("size(locations) > 0").select("row_id", F.size("locations").alias("n"), F.sequence(F.lit(1), F.size("locations")).alias("pos"), F.col("locations").alias("place"))
    return t.select("row_id", "n", F.explode(F.arrays_zip("pos", "place")).alias("x")).select("row_id", "x.pos", "x.place", "n")


@query("s045_array_rows", "SELECT scan_id, job_id FROM (SELECT DISTINCT scan_id, unnest(close_ids) AS job_id FROM source_scans) WHERE job_id IS NOT NULL")
def array_rows(spark, d):
    return table(spark, d, "source_scans").select("scan_id", F.explode("close_ids").alias("job_id")).where("job_id IS NOT NULL").distinct()


_PAIRS = [("remote", "remote", 1.0), ("hybrid", "hybrid", 1.0), ("onsite", "onsite", 1.0), ("remote", "hybrid", 0.5), ("hybrid", "onsite", 0.5)]


@query(
    "s094_relatedness",
    f"""WITH w(a, b, weight) AS (VALUES {', '.join(f"('{a}', '{b}', {x})" for a, b, x in _PAIRS)}), pairs AS (SELECT * FROM w UNION SELECT b, a, weight FROM w),
    o AS (SELECT opportunity_id, min(workplace_type) AS a, max(workplace_type) AS b FROM job_records WHERE opportunity_id IS NOT NULL AND workplace_type IS NOT NULL GROUP BY 1)
    SELECT o.opportunity_id, coalesce(weight, 0.0)::DOUBLE AS weight FROM o LEFT JOIN pairs USING (a, b)""",
)
def relatedness(spark, d):
    """How near the most different workplaces of an opportunity's records are, by a table of pairs."""
    pairs = spark.createDataFrame(sorted({(a, b, x) for a, b, x in _PAIRS} | {(b, a, x) for a, b, x in _PAIRS}), "a string, b string, weight double")
    o = _jobs(spark, d).where("opportunity_id IS NOT NULL AND workplace_type IS NOT NULL").groupBy("opportunity_id").agg(F.min("workplace_type").alias("a"), F.max("workplace_type").alias("b"))
    return o.join(bounded_broadcast(pairs), ["a", "b"], "left").select("opportunity_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))


@query(
    "s047_marks",
    """SELECT user_id, (json_extract(props, '$.k'))::INT AS item, coalesce(max(ts) FILTER (WHERE event_type = 'error') > coalesce(max(ts) FILTER (WHERE event_type = 'click'), TIMESTAMP '1970-01-01'), false) AS dismissed FROM events GROUP BY 1, 2""",
)
def marks(spark, d):
    """Items that a user put aside and did not take up again since: the later of two marks holds."""
    e = table(spark, d, "events").withColumn("item", F.get_json_object("props", "$.k").cast("int"))
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    a = e.groupBy("user_id", "item").agg(at("error").alias("aside"), at("click").alias("again"))
    return a.select("user_id", "item", F.coalesce(F.col("aside").isNotNull() & (F.col("again").isNull() | (F.col("aside") > F.col("again"))), F.lit(False)).alias("dismissed"))


@query(
    "s301_reassigned",
    f"""WITH g AS (SELECT row_id, job_id, min(job_id) OVER (PARTITION BY {key_sql("company")}, {key_sql("title")}) AS founder FROM job_records WHERE job_id IS NOT NULL AND company IS NOT NULL AND title IS NOT NULL)
    SELECT row_id, founder FROM g WHERE founder <> job_id""",
)
def reassigned(spark, d):
    """Records whose group, by company and title, is founded by another record: only changed labels come out."""
    j = _jobs(spark, d).where("job_id IS NOT NULL AND company IS NOT NULL AND title IS NOT NULL").select("row_id", "job_id", text.search_key("company").alias("c"), text.search_key("title").alias("t"))
    now = j.join(j.groupBy("c", "t").agg(F.min("job_id").alias("founder")), ["c", "t"])
    return identity.reassigned(now.select("row_id", F.col("job_id").alias("was"), "founder"), "row_id", "was", "founder")


@query(
    "s304_ownership",
    """WITH r AS (SELECT DISTINCT source.instance AS board, company FROM job_records WHERE company IS NOT NULL), l AS (SELECT DISTINCT board, company_name AS company FROM greenhouse_jobs WHERE company_name IS NOT NULL UNION SELECT DISTINCT board, company FROM ashby_jobs WHERE company IS NOT NULL)
    SELECT b.board, CASE (EXISTS (SELECT 1 FROM r WHERE r.board = b.board AND r.company = b.company))::INT + (EXISTS (SELECT 1 FROM l WHERE l.board = b.board AND l.company = b.company))::INT WHEN 2 THEN 'verified' WHEN 1 THEN 'corroborated' ELSE 'unverified' END AS ownership FROM boards b""",
)
def ownership(spark, d):
    """Whether independent sources name a board's company: two verify it, one corroborates it."""
    b = table(spark, d, "boards").select("board", "company")
    hints = _jobs(spark, d).select(F.lit("records").alias("via"), F.col("source.instance").alias("board"), "company")
    for t, c in (("greenhouse_jobs", "company_name"), ("ashby_jobs", "company")):
        hints = hints.unionByName(table(spark, d, t).select(F.lit("listings").alias("via"), "board", F.col(c).alias("company")))
    agree = hints.groupBy("via", "board", "company").agg(F.count(F.lit(1)).alias("n")).join(bounded_broadcast(b), ["board", "company"]).groupBy("board").agg(F.count("via").alias("ways"))
    state = F.when(F.col("ways") >= 2, "verified").when(F.col("ways") == 1, "corroborated").otherwise("unverified")
    return b.join(agree, "board", "left").select("board", state.alias("ownership"))


@query(
    "s283_observed",
    """WITH o AS (SELECT job_id, arg_max(lower(trim(status)), loaded_at::VARCHAR || lpad(scan_id::VARCHAR, 12, '0') || coalesce(lower(trim(status)), '')) AS found FROM stored_jobs WHERE job_id IS NOT NULL GROUP BY 1)
    SELECT r.row_id, CASE WHEN found = 'open' AND r.status = 'closed' THEN 'reopened' WHEN found = 'closed' AND r.status = 'open' THEN 'closed' WHEN found IN ('open', 'closed') THEN 'confirmed' ELSE 'unknown' END AS action FROM job_records r LEFT JOIN o USING (job_id)""",
)
def observed(spark, d):
    """Records after a look at each posting alone: only a definite answer changes a status."""
    s = F.lower(F.trim("status"))
    o = table(spark, d, "stored_jobs").where("job_id IS NOT NULL").groupBy("job_id").agg(F.max_by(s, F.struct("loaded_at", "scan_id", F.coalesce(s, F.lit("")))).alias("found"))
    return ledger.observed(_jobs(spark, d).select("row_id", "job_id", "status"), o, "job_id").select("row_id", "action")


@query(
    "s324_upserted",
    """WITH s AS (SELECT job_id, max(status) AS status, max(title) AS title FROM job_records WHERE job_id IS NOT NULL GROUP BY 1), i AS (SELECT job_id, max(lower(trim(status))) AS status FROM stored_jobs WHERE job_id IS NOT NULL GROUP BY 1)
    SELECT coalesce(s.job_id, i.job_id) AS job_id, CASE WHEN i.job_id IS NOT NULL THEN i.status ELSE s.status END AS status, s.title FROM s FULL JOIN i USING (job_id)""",
)
def upserted(spark, d):
    """Stored values by key, replaced by newer ones; a field that they lack keeps its value."""
    s = _jobs(spark, d).where("job_id IS NOT NULL").groupBy("job_id").agg(F.max("status").alias("status"), F.max("title").alias("title"))
    i = table(spark, d, "stored_jobs").where("job_id IS NOT NULL").groupBy("job_id").agg(F.max(F.lower(F.trim("status"))).alias("status")).withColumn("title", F.lit(None).cast("string"))
    return lifecycle.upsert(s, i, ["job_id"], ["title"])


@query("s174_quotes", f"""SELECT row_id, {key_sql("title")} <> '' AND contains(' ' || {key_sql("description_plain")} || ' ', ' ' || {key_sql("title")} || ' ') AS quoted FROM ashby_jobs""")
def quotes(spark, d):
    return table(spark, d, "ashby_jobs").select("row_id", text.quoted_in("description_plain", "title").alias("quoted"))


@query(
    "s359_rotated_plan",
    f"""WITH q AS (SELECT k.kind || '/' || t.term AS query FROM (SELECT DISTINCT kind FROM boards) k, (SELECT unnest({_TERMS!r}) AS term) t), n AS (SELECT query, row_number() OVER (ORDER BY query) - 1 AS i, count(*) OVER () AS total FROM q)
    SELECT query FROM n WHERE (i - 3 + total) % total < 5""",
)
def rotated_plan(spark, d):
    """Five searches of the list of all, starting at the third: each run takes the next ones."""
    k = table(spark, d, "boards").select("kind").distinct()
    q = [f"{r.kind}/{t}" for r in k.collect() for t in _TERMS]  # kinds of boards times terms
    return spark.createDataFrame([(x,) for x in lifecycle.rotated(sorted(q), 3, 5)], "query string")
