"""ANSI SQL of the core queries, for the side-by-side check."""

P4_FOUND = """
WITH sc AS (
  SELECT scan_id, any_value(store_id) store_id, any_value(source_kind) source_kind,
         any_value(source_instance) source_instance, max(started_at) started_at, any_value(close_ids) close_ids
  FROM source_scans WHERE complete GROUP BY scan_id
), seqd AS (
  SELECT *, lag(scan_id) OVER w AS prev_id, lead(scan_id) OVER w AS next_id
  FROM sc WINDOW w AS (PARTITION BY store_id, source_kind, source_instance ORDER BY started_at, scan_id)
), norm AS (
  SELECT scan_id, job_id, loaded_at, coalesce(lower(trim(status)), '') AS status,
         nullif(lower(trim(fingerprint)), '') AS fp, nullif(lower(trim(content_fingerprint)), '') AS cfp
  FROM stored_jobs
), one AS (
  SELECT * FROM norm QUALIFY row_number() OVER (
    PARTITION BY scan_id, job_id ORDER BY loaded_at DESC, status DESC, fp DESC NULLS LAST, cfp DESC NULLS LAST) = 1
), plan AS (SELECT DISTINCT scan_id, unnest(close_ids) AS job_id FROM seqd),
d AS (
  SELECT o.scan_id, o.job_id, CASE WHEN p.job_id IS NOT NULL THEN 'closed' ELSE o.status END AS status, o.fp, o.cfp
  FROM one o JOIN seqd s USING (scan_id) LEFT JOIN plan p ON p.scan_id = o.scan_id AND p.job_id = o.job_id
), later AS (SELECT d.*, s.prev_id FROM d JOIN seqd s USING (scan_id) WHERE s.prev_id IS NOT NULL),
earlier AS (SELECT d.*, s.next_id FROM d JOIN seqd s USING (scan_id) WHERE s.next_id IS NOT NULL),
pairs AS (
  SELECT coalesce(l.scan_id, e.next_id) AS scan_id, coalesce(l.job_id, e.job_id) AS job_id,
    CASE WHEN e.job_id IS NULL THEN 'added' WHEN l.job_id IS NULL THEN 'removed'
         WHEN l.status <> e.status THEN CASE WHEN l.status = 'closed' THEN 'closed' ELSE 'reopened' END
         WHEN l.cfp <> e.cfp THEN 'changed'
         WHEN l.fp IS DISTINCT FROM e.fp OR (l.cfp IS NULL) <> (e.cfp IS NULL) THEN 'refreshed' END AS change
  FROM later l FULL JOIN earlier e ON e.scan_id = l.prev_id AND e.job_id = l.job_id
)
SELECT scan_id, job_id, change FROM pairs WHERE change IS NOT NULL
"""


def _p5() -> str:
    """The four timestamp fields by other means: text forms by SQL patterns, zones by the database's own rules."""
    from lathe.functions.timestamps import MONTHS

    names = {n: i + 1 for line in MONTHS.values() for i, n in enumerate(line.split())}
    months = "MAP {" + ", ".join(f"'{n}': {i}" for n, i in sorted(names.items())) + "}"
    tail = r"(?:[Tt]|,? )(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? ?([AaPp]\.?[Mm]\.?)? ?([Zz]|[+-]\d{2}(?::?\d{2})?|\pL{2,5})? ?(?:\[([\w/+-]+)\])?$"
    forms = {  # pattern of the date: places of year, month, month's name and day
        "ymd": (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 1, 2, 0, 3), "slash": (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, -1, 0, -2), "dmy": (r"^(\d{1,2})[.-](\d{1,2})[.-](\d{4})$", 3, 2, 0, 1),
        "d name y": (r"^(?:\pL{2,4}\.?,? )?(\d{1,2})\.?(?: de)?[ -]+(\pL{3,12})\.?(?: de)?[ -]+(\d{4})$", 3, 0, 2, 1), "name d y": (r"^(?:\pL{2,4}\.?,? )?(\pL{3,12})\.? (\d{1,2}),? (\d{4})$", 3, 0, 1, 2),
        "name y": (r"^(\pL{3,12})\.?(?: de)?,? (\d{4})$", 2, 0, 1, 0), "m y": (r"^(\d{1,2})[/.](\d{4})$", 2, 1, 0, 0), "y m": (r"^(\d{4})[-/.](\d{1,2})$", 1, 2, 0, 0), "y": (r"^(\d{4})$", 1, 0, 0, 0),
    }
    part = lambda p, i: f"regexp_extract(d, '{p}', {i})"
    month = lambda p, m, n: f"({part(p, 2)} , {part(p, 1)})" if m < 0 else part(p, m) if m else f"coalesce(({months})[lower({part(p, n)})], 0)::VARCHAR" if n else "'1'"
    when = {"y": [], "m": [], "d": []}
    for p, y, m, n, day in forms.values():
        hit = f"WHEN regexp_matches(d, '{p}') THEN"
        when["y"].append(f"{hit} {part(p, y)}")
        when["m"].append(f"{hit} " + (f"CASE WHEN first THEN {part(p, 2)} ELSE {part(p, 1)} END" if m < 0 else month(p, m, n)))
        when["d"].append(f"{hit} " + (f"CASE WHEN first THEN {part(p, 1)} ELSE {part(p, 2)} END" if day < 0 else part(p, day) if day else "'1'"))
    case = lambda k: "CASE " + " ".join(when[k]) + " END"
    later = "'EST','CST','MST','PST','AKST','HST','NST','AST','CET','EET','WET','GMT','MSK','AEST','ACST','NZST'"
    return rf"""WITH v AS (SELECT 'greenhouse_jobs' AS tbl, row_id, 'first_published' AS field, first_published AS v, board FROM greenhouse_jobs UNION ALL SELECT 'greenhouse_jobs', row_id, 'updated_at', updated_at, board FROM greenhouse_jobs
      UNION ALL SELECT 'ashby_jobs', row_id, 'published_at', published_at, board FROM ashby_jobs UNION ALL SELECT 'linkedin_positions', row_id, 'started_on', started_on, NULL FROM linkedin_positions),
    b AS (SELECT board, any_value(zone) AS zone, any_value(date_order) <> 'mdy' AS first FROM boards GROUP BY board),
    s AS (SELECT tbl, row_id, field, coalesce(zone, 'UTC') AS zone, coalesce(first, true) AS first, regexp_replace(regexp_replace(trim(regexp_replace(v, '[\s\x{{00a0}}]+', ' ', 'g')), '^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})', '\1-\2-\3T\4:\5:\6'),
      '^(\d{{4}})(\d{{2}})(\d{{2}})((?:[Tt]\d{{4}}[^0-9].*)?)$', '\1-\2-\3\4') AS s FROM v LEFT JOIN b USING (board) WHERE v IS NOT NULL),
    e AS (SELECT *, regexp_extract(s, '{tail}', ['h', 'mi', 's', 'f', 'ap', 'z', 'r']) AS x, regexp_replace(s, '{tail}', '') AS d FROM s),
    p AS (SELECT *, {case("y")} AS y, {case("m")} AS m, {case("d")} AS dd, coalesce(try_cast(nullif(x.h, '') AS INT), 0) AS h0, lower(left(x.ap, 1)) AS ap, upper(x.z) AS z FROM e),
    w AS (SELECT *, try_cast(y || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS day, CASE WHEN ap = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE ap WHEN 'p' THEN 12 ELSE 0 END END AS h,
      coalesce(try_cast(nullif(x.mi, '') AS INT), 0) AS mi, coalesce(try_cast(nullif(x.s, '') AS INT), 0) AS sec, coalesce(try_cast(nullif(rpad(left(x.f, 6), CASE WHEN x.f = '' THEN 0 ELSE 6 END, '0'), '') AS BIGINT), 0) AS us FROM p),
    u AS (SELECT *, CASE WHEN h BETWEEN 0 AND 23 AND mi <= 59 AND sec <= 59 THEN epoch_us(day::TIMESTAMP) + ((h * 60 + mi) * 60 + sec) * 1000000::BIGINT + us END AS wall, CASE WHEN x.r <> '' THEN x.r ELSE zone END AS place FROM w),
    i AS (SELECT *, epoch_us(timezone(place, make_timestamp(wall))) AS inst FROM u WHERE wall IS NOT NULL),
    o AS (SELECT tbl, row_id, field, CASE WHEN z IN ('Z', 'UTC', 'GMT', 'UT') THEN wall WHEN regexp_matches(z, '^[+-]') THEN wall - (CASE left(z, 1) WHEN '-' THEN -1 ELSE 1 END) * ((try_cast(substr(z, 2, 2) AS INT) * 60 + coalesce(try_cast(nullif(right(replace(substr(z, 4), ':', ''), 2), '') AS INT), 0)) * 60000000::BIGINT)
      WHEN z IN ({later}) THEN inst WHEN epoch_us(timezone(place, make_timestamptz(inst - 3600000000))) = wall THEN inst - 3600000000 ELSE inst END AS instant_us FROM i
      UNION ALL SELECT tbl, row_id, field, CASE WHEN length(s) <= 11 THEN try_cast(s AS BIGINT) * 1000000 WHEN length(s) <= 14 THEN try_cast(s AS BIGINT) * 1000 WHEN length(s) <= 17 THEN try_cast(s AS BIGINT) ELSE try_cast(s AS BIGINT) // 1000 END FROM s WHERE regexp_matches(s, '^\d{{9,19}}$'))
    SELECT tbl, row_id, field, instant_us FROM o WHERE instant_us IS NOT NULL"""


P5_FOUND = _p5()
