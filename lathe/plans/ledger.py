"""Queries of the scan ledger, of state after scans, and of histories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.operators import ledger, lifecycle, records
from lathe.plans.general import _SCANS, _jobs, _scans
from lathe.session import cut, previous_within, ranked_within, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

STORE = ["store_id", "source_kind", "source_instance"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Two complete scans of each store: what it held before the last one, and what the last one delivered.

_DIGEST = "nullif(lower(trim({c})), '')"
_LAST_TWO = f"""{_SCANS}, c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, scan_id DESC) AS back FROM s WHERE complete),
    d AS (SELECT j.job_id, c.source, c.back, c.started_at, {_DIGEST.format(c='j.status')} AS st, {_DIGEST.format(c='fingerprint')} AS fp, {_DIGEST.format(c='content_fingerprint')} AS cfp,
      row_number() OVER (PARTITION BY j.scan_id, j.job_id ORDER BY j.loaded_at DESC, {_DIGEST.format(c='fingerprint')} DESC NULLS LAST, {_DIGEST.format(c='content_fingerprint')} DESC NULLS LAST) AS n
      FROM stored_jobs j JOIN c ON c.scan_id = j.scan_id AND c.back <= 2 WHERE j.job_id IS NOT NULL),
    a AS (SELECT * FROM d WHERE n = 1 AND back = 2), i AS (SELECT * FROM d WHERE n = 1 AND back = 1),
    z AS (SELECT source FROM c WHERE back = 2), w AS (SELECT source, started_at AS moment, coalesce(received, 0) > 0 OR coalesce(lag_received, 0) = 0 AS closes
      FROM (SELECT source, back, started_at, received, lead(received) OVER (PARTITION BY source ORDER BY back) AS lag_received FROM c) WHERE back = 1),
    p AS (SELECT coalesce(a.source, i.source) AS source, coalesce(a.job_id, i.job_id) AS job_id, a.st, a.fp AS afp, a.cfp AS acfp, i.fp AS ifp, i.cfp AS icfp, w.moment,
      CASE WHEN a.job_id IS NULL THEN 'new' WHEN i.job_id IS NOT NULL AND a.st = 'closed' THEN 'reopened'
      WHEN i.job_id IS NOT NULL AND a.cfp IS NOT NULL AND a.cfp IS DISTINCT FROM i.cfp THEN 'updated'
      WHEN i.job_id IS NOT NULL AND (a.fp IS DISTINCT FROM i.fp OR a.cfp IS NULL) THEN 'refreshed' WHEN i.job_id IS NOT NULL THEN 'unchanged'
      WHEN a.st = 'open' AND w.closes THEN 'closed' ELSE 'kept' END AS action
      FROM a FULL JOIN i ON a.source = i.source AND a.job_id = i.job_id JOIN w ON w.source = coalesce(a.source, i.source) JOIN z ON z.source = w.source)"""


def _last_two(spark, d):
    """(stored, incoming, sides): the dumps of each store's last two complete scans, one row a job."""
    scans = _scans(spark, d).where("complete")
    back = ranked_within(cut(scans.select("scan_id", "source", "started_at", "received")), ["source"], [F.desc("started_at"), F.desc("scan_id")], -F.datediff("started_at", F.lit("1970-01-01")), "back")
    two = cut(back.where("back <= 2"))
    at = lambda n, *more: two.where(F.col("back") == n).select("source", *more)
    digest = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = table(spark, d, "stored_jobs").where("job_id IS NOT NULL").select("scan_id", "job_id", F.struct("loaded_at", digest("fingerprint").alias("fp"), digest("content_fingerprint").alias("cfp"), digest("status").alias("st")).alias("r"))
    dump = rows.join(two.select("scan_id", "source", "back"), "scan_id").groupBy("source", "job_id", "back").agg(F.max("r").alias("r"))
    dump = cut(dump.select("source", "job_id", "back", F.col("r.st").alias("status"), F.col("r.fp").alias("fingerprint"), F.col("r.cfp").alias("content_fingerprint")))
    last = at(1, F.col("started_at").alias("at"), F.col("received").alias("r1")).join(at(2, F.col("received").alias("r2")), "source")
    sides = last.select("source", "at", ((F.coalesce("r1", F.lit(0)) > 0) | (F.coalesce("r2", F.lit(0)) == 0)).alias("closes"))
    return dump.where("back = 2").drop("back"), dump.where("back = 1").drop("back", "status"), sides


def _planned(spark, d):
    """(stored, incoming, plan): of sources with two complete scans; an empty listing after a full one closes nothing."""
    stored, incoming, sides = _last_two(spark, d)
    allowed = sides.select("source", "closes", "at")
    stored, incoming = stored.join(allowed.select("source"), "source", "left_semi"), incoming.join(allowed.select("source"), "source", "left_semi")
    held = stored.join(allowed.where("NOT closes").select("source"), "source", "left_semi").select("source", "job_id")
    return stored, incoming, lifecycle.plan_scan(stored, incoming, keep=held, keys=("source", "job_id")), allowed


@query("s086_scan_plan", f"{_LAST_TWO} SELECT source, job_id, action FROM p")
def scan_plan(spark, d):
    return _planned(spark, d)[2].select("source", "job_id", "action")


@query(
    "s038_applied_scan",
    f"""{_LAST_TWO} SELECT source, job_id, action, CASE WHEN action IN ('closed') THEN 'closed' WHEN action = 'kept' THEN st ELSE 'open' END AS status, CASE WHEN action IN ('closed', 'kept') THEN afp ELSE ifp END AS fingerprint,
    strftime(CASE WHEN action IN ('new', 'updated') OR (action = 'reopened' AND acfp IS NOT NULL AND acfp IS DISTINCT FROM icfp) THEN moment END, '%Y-%m-%d %H:%M:%S') AS content_moved,
    CASE WHEN action IN ('closed', 'kept') THEN NULL ELSE strftime(moment, '%Y-%m-%d %H:%M:%S') END AS seen FROM p""",
)
def applied_scan(spark, d):
    """Stored rows after the last scan; times that the scan did not move are null here, since the dumps hold none."""
    stored, incoming, plan, sides = _planned(spark, d)
    none = F.lit(None).cast("timestamp_ntz")
    stored = stored.withColumns({"content_updated_at": none, "last_seen_at": none})
    plan = plan.join(sides.select("source", "at"), "source")
    out = ledger.applied(plan, stored, incoming, ["source", "job_id"], F.col("at"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("source", "job_id", "action", "status", "fingerprint", day("content_updated_at").alias("content_moved"), day("last_seen_at").alias("seen"))


_GATE = f"""{_SCANS}, l AS (SELECT *, lag(received) OVER (PARTITION BY source ORDER BY started_at, scan_id) AS b FROM s WHERE status = 'listing')
    SELECT scan_id, CASE WHEN NOT coalesce(complete, false) THEN 'incomplete' WHEN coalesce(received, 0) - coalesce(normalized, 0) - coalesce(rejected, 0) > 0 THEN 'unreadable'
    WHEN coalesce(received, 0) = 0 AND coalesce(b, 0) > 0 THEN 'empty' ELSE 'allowed' END AS closing FROM l"""


@query("s279_closing_gate", _GATE)
def closing_gate(spark, d):
    lost = F.coalesce("received", F.lit(0)) - F.coalesce("normalized", F.lit(0)) - F.coalesce("rejected", F.lit(0))
    return ledger.closing(_scans(spark, d).where("status = 'listing'"), ["source"], lost).select("scan_id", "closing")


@query(
    "s298_source_health",
    f"""{_SCANS}, r AS (SELECT *, row_number() OVER w AS n, sum((status = 'listing')::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS oks FROM s WINDOW w AS (PARTITION BY source ORDER BY finished_at DESC, scan_id DESC)),
    a AS (SELECT source, count(*) FILTER (WHERE oks = 0) AS failures, count(*) FILTER (WHERE oks = 0 AND coalesce(contains(error, '404') OR contains(error, 'not found'), false)) AS gone,
      max(status) FILTER (WHERE n = 1) AS latest, max(received) FILTER (WHERE n = 1) AS now, arg_max(received, -n) FILTER (WHERE n > 1 AND status = 'listing') AS before FROM r GROUP BY source)
    SELECT source, failures, CASE WHEN failures = 0 THEN CASE WHEN latest = 'listing' AND coalesce(now, 0) = 0 AND coalesce(before, 0) > 0 THEN 'degraded' ELSE 'healthy' END
      WHEN gone >= 2 OR failures >= 3 THEN 'unhealthy' ELSE 'degraded' END AS health FROM a""",
)
def source_health(spark, d):
    gone = F.contains("error", F.lit("404")) | F.contains("error", F.lit("not found"))
    return ledger.health(_scans(spark, d), ["source"], F.col("status") == "listing", gone)


@query(
    "s281_touched",
    f"""{_SCANS}, c AS (SELECT source_kind, source_instance, validator, finished_at, lag(validator) OVER (PARTITION BY source ORDER BY started_at, scan_id) AS b FROM s WHERE complete),
    u AS (SELECT source_kind, source_instance, max(finished_at) AS moment FROM c WHERE validator = b GROUP BY 1, 2)
    SELECT row_id, strftime(CASE WHEN status = 'open' THEN greatest(last_seen_at, moment) ELSE last_seen_at END, '%Y-%m-%d %H:%M:%S') AS seen FROM job_records r LEFT JOIN u ON u.source_kind = r.source.kind AND u.source_instance = r.source.instance""",
)
def touched_rows(spark, d):
    """Open rows of sources whose complete scan had the validator of the one before were seen at that scan."""
    c = previous_within(_scans(spark, d).where("complete"), ["source"], ["started_at", "scan_id"], F.to_date("started_at"), ["validator"])
    same = c.where("validator = previous.validator").select(F.col("source_kind").alias("kind"), F.col("source_instance").alias("instance"), "finished_at")
    jobs = _jobs(spark, d).select("row_id", "status", "last_seen_at", F.col("source.kind").alias("kind"), F.col("source.instance").alias("instance"))
    out = ledger.touched(jobs, same, ["kind", "instance"], "finished_at", "last_seen_at")
    return out.select("row_id", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query(
    "s282_reusable_validator",
    f"""{_SCANS}, l AS (SELECT source, arg_max({{'v': validator, 'c': complete, 'f': finished_at}}, finished_at::VARCHAR || lpad(scan_id::VARCHAR, 12, '0')) AS x FROM s WHERE status = 'listing' GROUP BY source)
    SELECT source, CASE WHEN x.c AND x.f > (SELECT max(finished_at) FROM s) - INTERVAL 30 DAY THEN x.v END AS validator FROM l""",
)
def reusable_validator(spark, d):
    """The validator of a source's last listing, if that was complete and is younger than 30 days."""
    s = _scans(spark, d)
    now = s.agg(F.max("finished_at")).first()[0]
    last = s.where("status = 'listing'").groupBy("source").agg(F.max_by(F.struct("validator", "complete", "finished_at"), F.struct("finished_at", "scan_id")).alias("x"))
    return last.select("source", F.when(F.col("x.complete") & (F.col("x.finished_at") > F.lit(now) - F.expr("INTERVAL 30 DAYS")), F.col("x.validator")).alias("validator"))


@query(
    "s040_replaced_evidence",
    """WITH a AS (SELECT job_id, 'title:' || lower(title) AS evidence FROM job_records WHERE title IS NOT NULL), again AS (SELECT DISTINCT job_id FROM job_records WHERE status = 'open'),
    n AS (SELECT job_id, 'company:' || lower(company) AS evidence FROM job_records WHERE status = 'open' AND company IS NOT NULL)
    SELECT job_id, evidence FROM a WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT job_id FROM again WHERE job_id IS NOT NULL) UNION SELECT job_id, evidence FROM n WHERE job_id IS NOT NULL""",
)
def replaced_evidence(spark, d):
    j = _jobs(spark, d).where("job_id IS NOT NULL")
    was = j.select("job_id", F.concat(F.lit("title:"), F.lower("title")).alias("evidence")).where("evidence IS NOT NULL")
    now = j.where("status = 'open'").select("job_id", F.concat(F.lit("company:"), F.lower("company")).alias("evidence"))
    return ledger.replaced_evidence(was, now, "job_id")


@query("s034_multi_get", "SELECT row_id, job_id, title FROM job_records WHERE job_id IN (SELECT job_id FROM stored_jobs WHERE lower(trim(status)) = 'closed')")
def multi_get(spark, d):
    wanted = table(spark, d, "stored_jobs").where(F.lower(F.trim("status")) == "closed").select("job_id")
    return _jobs(spark, d).join(wanted, "job_id", "left_semi").select("row_id", "job_id", "title")


@query(
    "s076_multi_key_probe",
    """SELECT DISTINCT r.row_id, s.scan_id FROM job_records r JOIN stored_jobs s ON s.job_id = r.job_id AND s.source_kind = r.source.kind AND s.source_instance = r.source.instance WHERE lower(trim(s.status)) = 'open' AND r.status = 'closed'""",
)
def multi_key_probe(spark, d):
    keys = table(spark, d, "stored_jobs").where(F.lower(F.trim("status")) == "open").select("job_id", F.col("source_kind").alias("kind"), F.col("source_instance").alias("instance"), "scan_id")
    r = _jobs(spark, d).where("status = 'closed'").select("row_id", "job_id", F.col("source.kind").alias("kind"), F.col("source.instance").alias("instance"))
    return r.join(keys, ["job_id", "kind", "instance"]).select("row_id", "scan_id").distinct()


@query("s083_records_of_opportunity", "SELECT opportunity_id, row_id, row_number() OVER (PARTITION BY opportunity_id ORDER BY first_seen_at, row_id)::INT AS pos FROM job_records WHERE opportunity_id IS NOT NULL")
def records_of_opportunity(spark, d):
    j = _jobs(spark, d).where("opportunity_id IS NOT NULL").select("opportunity_id", "row_id", "first_seen_at")
    return ledger.history(j, ["opportunity_id"], ["first_seen_at", "row_id"], F.to_date("first_seen_at")).select("opportunity_id", "row_id", F.col("pos").cast("int").alias("pos"))


@query(
    "s084_job_histories",
    """WITH e AS (SELECT DISTINCT job_id, scan_id, loaded_at, lower(trim(status)) AS status FROM stored_jobs WHERE job_id IS NOT NULL)
    SELECT job_id, scan_id, status, row_number() OVER (PARTITION BY job_id ORDER BY loaded_at, scan_id, status)::INT AS pos FROM e""",
)
def job_histories(spark, d):
    e = table(spark, d, "stored_jobs").where("job_id IS NOT NULL").select("job_id", "scan_id", "loaded_at", F.lower(F.trim("status")).alias("status")).distinct()
    return ledger.history(e, ["job_id"], ["loaded_at", "scan_id", "status"], F.to_date("loaded_at")).select("job_id", "scan_id", "status", F.col("pos").cast("int").alias("pos"))


@query("s328_job_history", "SELECT scan_id, lower(trim(status)) AS status, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS at FROM stored_jobs WHERE job_id = (SELECT min(job_id) FROM stored_jobs)")
def job_history(spark, d):
    e = table(spark, d, "stored_jobs")
    first = e.agg(F.min("job_id")).first()[0]
    return e.where(F.col("job_id") == F.lit(first)).select("scan_id", F.lower(F.trim("status")).alias("status"), F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "s075_update_from_values",
    """WITH v AS (SELECT job_id, max(source_kind || ':' || source_instance) AS v FROM stored_jobs GROUP BY job_id) SELECT row_id, coalesce(v.v, r.source_job_id) AS source_job_id FROM job_records r LEFT JOIN v USING (job_id)""",
)
def update_from_values(spark, d):
    v = table(spark, d, "stored_jobs").select("job_id", F.concat_ws(":", "source_kind", "source_instance").alias("source_job_id"))
    return ledger.updated_from(_jobs(spark, d).select("row_id", "job_id", "source_job_id"), v, "job_id", "source_job_id").select("row_id", "source_job_id")


@query(
    "s078_scalar_subqueries",
    """SELECT b.board, (SELECT count(*) FROM job_records r WHERE r.source.instance = b.board) AS n_jobs, (SELECT max(received) FROM source_scans s WHERE s.source_instance = b.board) AS most,
    (SELECT count(*) FROM greenhouse_jobs g WHERE g.board = b.board) + (SELECT count(*) FROM ashby_jobs a WHERE a.board = b.board) AS n_listed FROM boards b""",
)
def scalar_subqueries(spark, d):
    n = F.count(F.lit(1))
    jobs = _jobs(spark, d).groupBy(F.col("source.instance").alias("board")).agg(n.alias("n_jobs"))
    most = table(spark, d, "source_scans").groupBy(F.col("source_instance").alias("board")).agg(F.max("received").alias("most"))
    listed = table(spark, d, "greenhouse_jobs").select("board").unionByName(table(spark, d, "ashby_jobs").select("board")).groupBy("board").agg(n.alias("n_listed"))
    b = table(spark, d, "boards").select("board")
    for side in (jobs, most, listed):
        b = b.join(side, "board", "left")
    return b.select("board", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"), "most", F.coalesce("n_listed", F.lit(0)).alias("n_listed"))


@query(
    "s151_latest_kinds",
    f"""{_SCANS}, o AS (SELECT *, finished_at::VARCHAR || lpad(scan_id::VARCHAR, 12, '0') AS o FROM s)
    SELECT source, 'latest' AS kind, arg_max(scan_id, o) AS scan_id FROM o GROUP BY source UNION ALL SELECT source, 'latest_listing', arg_max(scan_id, o) FROM o WHERE status = 'listing' GROUP BY source
    UNION ALL SELECT source, 'latest_complete', arg_max(scan_id, o) FROM o WHERE complete GROUP BY source""",
)
def latest_kinds(spark, d):
    """One pass for all kinds: the union of latest rows is one aggregation, taken apart afterwards."""
    o = F.struct("finished_at", "scan_id")
    kinds = {"latest": F.lit(True), "latest_listing": F.col("status") == "listing", "latest_complete": F.col("complete")}
    one = _scans(spark, d).groupBy("source").agg(*[F.max_by("scan_id", F.when(c, o)).alias(k) for k, c in kinds.items()])
    return one.unpivot(["source"], list(kinds), "kind", "scan_id").where("scan_id IS NOT NULL")


@query("s152_union_by_id", "SELECT scan_id, any_value(status) AS status FROM (SELECT scan_id, status FROM source_scans WHERE source_kind = 'ashby' OR complete UNION ALL SELECT scan_id, status FROM source_scans WHERE source_kind = 'greenhouse') GROUP BY scan_id")
def union_by_id(spark, d):
    s = table(spark, d, "source_scans")
    here, there = s.where("source_kind = 'ashby' OR complete"), s.where("source_kind = 'greenhouse'")
    return here.select("scan_id", "status").unionByName(there.select("scan_id", "status")).dropDuplicates(["scan_id"])


@query("s103_stage_counts", "SELECT event_type AS stage, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stage_counts(spark, d):
    # Distinct users are counted from (stage, user) pairs, so no stage is one task's work.
    pairs = table(spark, d, "events").groupBy(F.col("event_type").alias("stage"), "user_id").agg(F.count(F.lit(1)).alias("k"))
    return pairs.groupBy("stage").agg(F.sum("k").alias("n"), F.count("user_id").alias("users"))


@query(
    "s140_stage_order",
    """SELECT event_id, user_id FROM events ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, ts DESC, event_id LIMIT 40""",
)
def stage_order(spark, d):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return table(spark, d, "events").orderBy(rank, F.desc("ts"), "event_id").limit(40).select("event_id", "user_id")


@query(
    "s143_due_sources",
    f"""{_SCANS}, a AS (SELECT source, max(finished_at) AS moment, count(*) FILTER (WHERE status = 'failed') AS failed FROM s GROUP BY source), n AS (SELECT max(finished_at) AS now FROM s)
    SELECT source FROM (SELECT source, moment + CASE WHEN failed > 0 THEN INTERVAL 12 HOUR ELSE INTERVAL 3 HOUR END AS due FROM a), n WHERE due <= now ORDER BY due, source LIMIT 20""",
)
def due_sources(spark, d):
    """Sources whose time has come: three hours after the last scan, twelve where any failed; longest overdue first."""
    s = _scans(spark, d)
    now = s.agg(F.max("finished_at")).first()[0]
    a = s.groupBy("source").agg(F.max("finished_at").alias("at"), F.count_if(F.col("status") == "failed").alias("failed"))
    due = F.when(F.col("failed") > 0, F.col("at") + F.expr("INTERVAL 12 HOURS")).otherwise(F.col("at") + F.expr("INTERVAL 3 HOURS"))
    return a.withColumn("due", due).where(F.col("due") <= F.lit(now)).orderBy("due", "source").limit(20).select("source")


@query(
    "s289_tiers",
    f"""{_SCANS}, a AS (SELECT source, max(finished_at) FILTER (WHERE complete) AS ok FROM s GROUP BY source), n AS (SELECT max(finished_at) AS now FROM s)
    SELECT source, CASE WHEN ok IS NULL THEN 'never' WHEN ok >= now - INTERVAL 14 DAY THEN 'active' ELSE 'normal' END AS tier FROM a, n""",
)
def tiers(spark, d):
    s = _scans(spark, d)
    now = s.agg(F.max("finished_at")).first()[0]
    a = s.groupBy("source").agg(F.max(F.when(F.col("complete"), F.col("finished_at"))).alias("ok"))
    return a.select("source", F.when(F.col("ok").isNull(), "never").when(F.col("ok") >= F.lit(now) - F.expr("INTERVAL 14 DAYS"), "active").otherwise("normal").alias("tier"))


@query(
    "s296_refresh_needed",
    f"""{_SCANS}, l AS (SELECT source_kind, source, max(finished_at) FILTER (WHERE status = 'listing') AS ok FROM s GROUP BY 1, 2), n AS (SELECT max(finished_at) AS now FROM s)
    SELECT source_kind, CASE WHEN bool_or(ok IS NULL) THEN 'never checked' WHEN min(ok) < any_value(now) - INTERVAL 60 DAY THEN 'stale' ELSE 'fresh' END AS reason FROM l, n GROUP BY 1""",
)
def refresh_needed(spark, d):
    s = _scans(spark, d)
    now = s.agg(F.max("finished_at")).first()[0]
    last = s.groupBy("source_kind", "source").agg(F.max(F.when(F.col("status") == "listing", F.col("finished_at"))).alias("ok"))
    reason = F.when(F.bool_or(F.col("ok").isNull()), "never checked").when(F.min("ok") < F.lit(now) - F.expr("INTERVAL 60 DAYS"), "stale").otherwise("fresh")
    return last.groupBy("source_kind").agg(reason.alias("reason"))


@query("s330_not_definitive", f"{_SCANS} SELECT scan_id FROM s WHERE coalesce(status, '') NOT IN ('listing') OR NOT coalesce(complete, false)")
def not_definitive(spark, d):
    return _scans(spark, d).where(~F.coalesce(F.col("status").isin("listing"), F.lit(False)) | ~F.coalesce("complete", F.lit(False))).select("scan_id")


_BODY = "to_json({'company': company, 'date_order': date_order, 'kind': kind, 'zone': zone})"


@query("s051_entities", f"SELECT 'board' AS kind, board AS key, {_BODY}::VARCHAR AS body, sha256({_BODY}::VARCHAR) AS digest FROM boards")
def entity_rows(spark, d):
    return records.entities(table(spark, d, "boards"), "board", "board", ["kind", "company", "zone", "date_order"])


@query("s351_recomposed", "SELECT board, kind, company, zone, date_order FROM boards")
def recomposed(spark, d):
    """Entities back to typed rows, as they were before they were taken apart."""
    fields = {c: "string" for c in ("kind", "company", "zone", "date_order")}
    return records.recomposed(records.entities(table(spark, d, "boards"), "board", "board", list(fields)), "board", "board", fields)


@query(
    "s352_live_entities",
    """WITH v AS (SELECT DISTINCT job_id, source_kind || ':' || store_id AS store, scan_id, lower(trim(status)) = 'closed' AS gone FROM stored_jobs WHERE job_id IS NOT NULL),
    l AS (SELECT job_id, store, max(scan_id) AS scan_id, arg_max(gone, scan_id * 2 + coalesce(gone, false)::INT) AS gone FROM v GROUP BY 1, 2) SELECT job_id, store, scan_id FROM l WHERE NOT coalesce(gone, false)""",
)
def live_entities(spark, d):
    """The last version of each job in a store, unless it was closed there."""
    gone = F.lower(F.trim("status")) == "closed"
    v = table(spark, d, "stored_jobs").where("job_id IS NOT NULL").select("job_id", F.concat_ws(":", "source_kind", F.col("store_id").cast("string")).alias("store"), "scan_id", F.coalesce(gone, F.lit(False)).alias("gone"))
    last = v.groupBy("job_id", "store").agg(F.max(F.struct("scan_id", "gone")).alias("x"))
    return ledger.latest_live(last.select("job_id", "store", "x.*"), ["job_id", "store"], "scan_id", "gone").select("job_id", "store", "scan_id")


@query("s353_newest_first", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def newest_first(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "user_id", "event_type")


@query(
    "s358_board_check",
    """WITH j AS (SELECT source.instance AS board, count(*) AS jobs, count(source_job_id) AS with_id, count(DISTINCT company) AS companies FROM job_records GROUP BY 1)
    SELECT b.board, coalesce(jobs, 0) AS jobs, coalesce(with_id, 0) AS with_id, coalesce(companies, 0) AS companies,
    (SELECT count(*) FROM job_records r WHERE r.source.instance = b.board AND r.company = b.company) AS naming_company FROM boards b LEFT JOIN j USING (board)""",
)
def board_check(spark, d):
    """What a board holds: its rows, those with a native id, its companies, and the rows that name the board's company."""
    j = _jobs(spark, d).groupBy(F.col("source.instance").alias("board"), F.col("company").alias("named")).agg(F.count(F.lit(1)).alias("n"), F.count("source_job_id").alias("i"))
    b = table(spark, d, "boards").select("board", "company").join(j, "board", "left")
    zero = F.lit(0)
    return b.groupBy("board").agg(F.coalesce(F.sum("n"), zero).alias("jobs"), F.coalesce(F.sum("i"), zero).alias("with_id"), F.count("named").alias("companies"), F.coalesce(F.sum(F.when(F.col("named") == F.col("company"), F.col("n"))), zero).alias("naming_company"))


@query(
    "s252_source_removal",
    """SELECT job_id, string_agg(DISTINCT src, ',' ORDER BY src) AS left_sources FROM (SELECT job_id, source.kind || ':' || source.instance AS src FROM job_records WHERE job_id IS NOT NULL) WHERE src NOT LIKE 'ashby:%' GROUP BY job_id""",
)
def source_removal(spark, d):
    """Jobs that other sources still support once a source kind is removed, with those sources."""
    return records.without_source(_jobs(spark, d).where("job_id IS NOT NULL").select("job_id", F.concat_ws(":", "source.kind", "source.instance").alias("src")), "job_id", "src", F.col("src").startswith("ashby:"))


@query("s345_claim_sources", "SELECT company, source.kind AS origin, count(*) AS n FROM job_records WHERE company IS NOT NULL GROUP BY 1, 2")
def claim_sources(spark, d):
    return _jobs(spark, d).where("company IS NOT NULL").groupBy("company", F.col("source.kind").alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@query("s101_dedupe_stats", "WITH g AS (SELECT opportunity_id, count(DISTINCT source.kind || ':' || source.instance) AS sources, count(*) AS n FROM job_records WHERE opportunity_id IS NOT NULL GROUP BY 1) SELECT count(*) AS opportunities, count(*) FILTER (WHERE sources > 1) AS multi_source, sum(n)::BIGINT - count(*) AS duplicates FROM g")
def dedupe_stats(spark, d):
    pairs = _jobs(spark, d).where("opportunity_id IS NOT NULL").groupBy("opportunity_id", F.concat_ws(":", "source.kind", "source.instance").alias("src")).agg(F.count(F.lit(1)).alias("k"))
    g = pairs.groupBy("opportunity_id").agg(F.count("src").alias("sources"), F.sum("k").alias("n"))
    return g.agg(F.count(F.lit(1)).alias("opportunities"), F.count_if(F.col("sources") > 1).alias("multi_source"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))
