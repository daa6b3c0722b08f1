"""Queries of the board systems' projections on the job tables, and checks across tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.plans.general import _SCANS, _jobs, _scans
from lathe.sources import boards, registry
from lathe.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _line(c: str) -> str:
    return rf"nullif(trim(regexp_replace({c}, '[\s\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')), '')"


def _ashby(spark, d):
    """Listings of one job each, as the board system sends them."""
    t = table(spark, d, "ashby_jobs")
    job = F.struct(
        F.col("id"), F.col("title"), F.col("department"), F.col("team"), F.col("employment_type").alias("employmentType"), F.col("location"), F.transform("secondary_locations", lambda x: F.struct(x["location"].alias("location"))).alias("secondaryLocations"),
        F.col("is_listed").alias("isListed"), F.col("is_remote").alias("isRemote"), F.col("workplace_type").alias("workplaceType"), F.col("job_url").alias("jobUrl"), F.col("description_plain").alias("descriptionPlain"),
    )
    return t.select(F.col("board").alias("source_instance"), "row_id", F.to_json(F.struct(F.array(job).alias("jobs"))).alias("body"))


@query(
    "s005_ashby_postings",
    f"""SELECT board AS source_instance, id AS source_job_id, {_line("title")} AS title, {_line("department")} AS department, {_line("location")} AS location,
    ((CASE WHEN {_line("location")} IS NULL THEN 0 ELSE 1 END) + coalesce(len(list_filter(secondary_locations, lambda x: {_line("x.location")} IS NOT NULL)), 0))::INT AS n_places, is_remote FROM ashby_jobs WHERE coalesce(is_listed, true)""",
)
def ashby_postings(spark, d):
    p = boards.ashby(_ashby(spark, d))
    return p.select("source_instance", "source_job_id", "title", "department", "location", F.size("locations").alias("n_places"), "is_remote")


def _greenhouse(spark, d):
    t = table(spark, d, "greenhouse_jobs")
    job = F.struct("id", "title", "company_name", "absolute_url", "location", "departments", "pay_input_ranges", "content")
    return t.select(F.col("board").alias("source_instance"), "row_id", F.to_json(F.struct(F.array(job).alias("jobs"), F.struct(F.lit(1).alias("total")).alias("meta"))).alias("body"))


@query(
    "s007_greenhouse_postings",
    f"""SELECT board AS source_instance, id::VARCHAR AS source_job_id, coalesce({_line("coalesce(company_name, board)")}, '') AS company, {_line("title")} AS title, {_line("departments[1].name")} AS department,
    CASE WHEN len(pay_input_ranges) > 0 THEN round(pay_input_ranges[1].min_cents / 100, 2) END AS least FROM greenhouse_jobs""",
)
def greenhouse_postings(spark, d):
    p = boards.greenhouse(_greenhouse(spark, d))
    least = F.round(F.get("compensation.components", F.lit(0))["min"], 2)
    return p.select("source_instance", "source_job_id", F.coalesce("company", F.lit("")).alias("company"), "title", "department", least.alias("least"))


@query(
    "s009_lever_postings",
    f"""SELECT board AS source_instance, id AS source_job_id, {_line("title")} AS title, {_line("team")} AS team, {_line("location")} AS location FROM ashby_jobs""",
)
def lever_postings(spark, d):
    t = table(spark, d, "ashby_jobs")
    job = F.struct(F.col("id"), F.col("title").alias("text"), F.struct(F.col("team"), F.col("department"), F.col("location"), F.col("employment_type").alias("commitment")).alias("categories"), F.col("job_url").alias("hostedUrl"))
    listings = t.select(F.col("board").alias("source_instance"), F.to_json(F.array(job)).alias("body"))
    return boards.lever(listings).select("source_instance", "source_job_id", "title", "team", "location")


@query(
    "s002_batch_counts",
    f"""WITH l AS (SELECT board, id, {_line("title")} AS title, {_line("board")} AS company FROM ashby_jobs WHERE coalesce(is_listed, true)), g AS (SELECT board, count(*) AS received, count(DISTINCT id) FILTER (WHERE title IS NOT NULL) AS normalized,
      count(*) FILTER (WHERE title IS NULL) AS rejected FROM l GROUP BY board) SELECT board AS source_instance, received, normalized, rejected, received - normalized - rejected AS skipped FROM g""",
)
def batch_counts(spark, d):
    """What became of the records of each board: valid, rejected, or skipped as repeated."""
    p = boards.ashby(_ashby(spark, d)).withColumn("arrival", F.xxhash64("source_job_id", "title"))
    good, bad = boards.prepared(p, "arrival")
    return registry.batch_counts(good, bad, p)


@query(
    "s186_job_ids",
    """SELECT DISTINCT 'job_' || left(sha256(unhex(printf('%016x', 3)) || 'job'::BLOB || unhex(printf('%016x', strlen('ashby:' || board))) || encode('ashby:' || board) || unhex(printf('%016x', strlen(id))) || encode(id)), 32) AS job_id
    FROM ashby_jobs WHERE coalesce(is_listed, true) AND trim(title) <> ''""",
)
def job_ids(spark, d):
    p = boards.ashby(_ashby(spark, d)).withColumn("arrival", F.xxhash64("source_job_id", "title"))
    return boards.prepared(p, "arrival")[0].select("job_id")


@query(
    "s373_consistency",
    """SELECT 'stored row without its scan' AS problem, count(*) AS n FROM stored_jobs t WHERE NOT EXISTS (SELECT 1 FROM source_scans s WHERE s.scan_id = t.scan_id)
    UNION ALL SELECT 'scan of an unknown board', count(*) FROM source_scans s WHERE NOT EXISTS (SELECT 1 FROM boards b WHERE b.board = s.source_instance AND b.kind = s.source_kind)
    UNION ALL SELECT 'record of an unknown board', count(*) FROM job_records r WHERE NOT EXISTS (SELECT 1 FROM boards b WHERE b.board = r.source.instance)
    UNION ALL SELECT 'place in an unknown country', count(*) FROM places p WHERE NOT EXISTS (SELECT 1 FROM countries c WHERE c.code = p.country_code)""",
)
def consistency(spark, d):
    """Rows whose key names nothing in the table that it points to, by kind of problem."""
    t = lambda n: table(spark, d, n)
    b = t("boards").select("board", "kind")
    lost = {
        "stored row without its scan": t("stored_jobs").select("scan_id").join(t("source_scans").select("scan_id"), "scan_id", "left_anti"),
        "scan of an unknown board": t("source_scans").select(F.col("source_instance").alias("board"), F.col("source_kind").alias("kind")).join(b, ["board", "kind"], "left_anti"),
        "record of an unknown board": t("job_records").select(F.col("source.instance").alias("board")).join(b, "board", "left_anti"),
        "place in an unknown country": t("places").select(F.col("country_code").alias("code")).join(t("countries").select("code"), "code", "left_anti"),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("problem"), "n") for k, df in lost.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("s117_confusion", "SELECT coalesce(status, 'none') AS predicted, coalesce(workplace_type, 'none') AS actual, count(*) AS n FROM job_records GROUP BY 1, 2")
def confusion(spark, d):
    none = F.lit("none")
    return _jobs(spark, d).groupBy(F.coalesce("status", none).alias("predicted"), F.coalesce("workplace_type", none).alias("actual")).agg(F.count(F.lit(1)).alias("n"))


@query("s325_listing_of_user", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def listing_of_user(spark, d):
    """The last three events of each user; each task passes on three of a user at most."""
    from lathe.operators.lifecycle import latest_per

    return latest_per(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "event_type")


@query("s327_scan_history", f"{_SCANS} SELECT source, scan_id, status, row_number() OVER (PARTITION BY source ORDER BY started_at, scan_id)::INT AS pos FROM s")
def scan_history(spark, d):
    from lathe.operators import ledger

    s = _scans(spark, d).select("source", "scan_id", "status", "started_at")
    return ledger.history(s, ["source"], ["started_at", "scan_id"], F.to_date("started_at")).select("source", "scan_id", "status", F.col("pos").cast("int").alias("pos"))


@query(
    "s318_field_stability",
    """WITH g AS (SELECT opportunity_id, count(DISTINCT coalesce(title, chr(1))) = 1 AS title, count(DISTINCT coalesce(company, chr(1))) = 1 AS company, count(DISTINCT coalesce(employment_type, chr(1))) = 1 AS employment_type FROM job_records WHERE opportunity_id IS NOT NULL GROUP BY 1)
    SELECT round(avg(title::INT), 4) AS title, round(avg(company::INT), 4) AS company, round(avg(employment_type::INT), 4) AS employment_type FROM g""",
)
def field_stability(spark, d):
    """Of the opportunities the share whose records agree on a field, field by field."""
    fields = ["title", "company", "employment_type"]
    none = F.lit("\x01")
    # The least and the greatest value tell whether all agree, with partial aggregates of two values a key.
    g = _jobs(spark, d).where("opportunity_id IS NOT NULL").groupBy("opportunity_id").agg(*[(F.min(F.coalesce(f, none)) == F.max(F.coalesce(f, none))).cast("int").alias(f) for f in fields])
    return g.agg(*[F.round(F.avg(f), 4).alias(f) for f in fields])
