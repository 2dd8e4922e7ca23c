"""The queries again as plain SQL, to compare results with."""

from __future__ import annotations

from postlake import schema as S
from postlake.plans import tables as t

_ADDRESS = "zip_code, prefecture_id, city_id, prefecture, city, town"
_FMT = "'%Y-%m-%d %H:%M:%S'"


def _at(expr: str, name: str) -> str:
    return f"strftime({expr}, {_FMT}) AS {name}"


SQL: dict[str, str] = {}

# ---- lookups -------------------------------------------------------------------------

SQL["zip_lookup_batch"] = f"""WITH {t.ADDR_SQL}, {t.ZIP_REQUESTS_SQL}
SELECT request_id, zip,
       CASE WHEN length(z) <> 7 THEN 'invalid' WHEN a.zip_code IS NULL THEN 'not_found' ELSE 'ok' END AS status,
       CASE WHEN length(z) = 7 THEN z ELSE '' END AS zip_code,
       coalesce(prefecture_id, 0) AS prefecture_id, coalesce(city_id, '') AS city_id,
       coalesce(prefecture, '') AS prefecture, coalesce(city, '') AS city, coalesce(town, '') AS town
FROM zip_norm LEFT JOIN addr a ON z = a.zip_code"""

SQL["zip_lookup_null_town"] = f"""WITH {t.ADDR_SQL}, {t.ZIP_REQUESTS_SQL}
SELECT request_id,
       CASE WHEN length(z) <> 7 THEN 'invalid' WHEN a.zip_code IS NULL THEN 'not_found' ELSE 'ok' END AS status,
       CASE WHEN a.zip_code IS NULL THEN '<null>' WHEN city LIKE '%7' THEN '' ELSE town END AS town
FROM zip_norm LEFT JOIN addr a ON z = a.zip_code"""

SQL["zip_lookup_one"] = f"WITH {t.ADDR_SQL} SELECT {_ADDRESS} FROM addr WHERE zip_code = '0000003'"

SQL["zip_format"] = """WITH n AS (
  SELECT o_orderkey, substr(regexp_replace(concat_ws('-', o_orderpriority, o_custkey, o_orderkey),
         '[^0-9]', '', 'g'), 1, 7) AS zip FROM orders
)
SELECT o_orderkey, zip,
       CASE WHEN length(zip) <= 3 THEN zip ELSE substr(zip, 1, 3) || '-' || substr(zip, 4) END AS formatted,
       length(zip) = 7 AS valid FROM n"""

SQL["address_autofill"] = f"""WITH {t.ADDR_SQL}, {t.ZIP_REQUESTS_SQL},
best AS (
  SELECT *, count(*) OVER (PARTITION BY zip_code) AS n,
         row_number() OVER (PARTITION BY zip_code ORDER BY city_id, town) AS rn FROM addr
)
SELECT request_id, CASE WHEN n IS NULL THEN zip ELSE z END AS zip_code,
       coalesce(prefecture, 'typed') AS prefecture, coalesce(city, '') AS city,
       CASE WHEN n IS NULL THEN zip ELSE town END AS town, coalesce(n, 0) AS candidate_count,
       CASE WHEN length(z) <> 7 THEN 'invalid' WHEN n IS NULL THEN 'not_found' ELSE 'ok' END AS status
FROM zip_norm LEFT JOIN best ON z = zip_code AND rn = 1"""

SQL["zip_city_options"] = f"""WITH {t.ADDR_SQL},
best AS (
  SELECT zip_code, prefecture_id, city_id,
         row_number() OVER (PARTITION BY zip_code ORDER BY city_id, town) AS rn FROM addr
),
req AS (SELECT s_suppkey AS request_id, lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS zip FROM supplier)
SELECT request_id, zip, c.prefecture_id, c.city_id, c.city, c.city_id = b.city_id AS selected
FROM req JOIN best b ON zip = zip_code AND rn = 1
JOIN (SELECT DISTINCT prefecture_id, city_id, city FROM addr) c ON c.prefecture_id = b.prefecture_id"""

SQL["prefectures"] = f"WITH {t.ADDR_SQL} SELECT DISTINCT prefecture_id, prefecture FROM addr ORDER BY 1"
SQL["cities_by_prefecture"] = f"""WITH {t.ADDR_SQL}
SELECT DISTINCT prefecture_id, city_id, city FROM addr ORDER BY 1, 2, 3"""
SQL["cities_of_prefecture"] = f"""WITH {t.ADDR_SQL}
SELECT DISTINCT city_id, city FROM addr WHERE prefecture_id = 13 ORDER BY 1, 2"""
SQL["cities_of_suppliers"] = f"""WITH {t.ADDR_SQL}
SELECT DISTINCT prefecture_id, city_id, city FROM addr
WHERE prefecture_id IN (SELECT s_nationkey + 1 FROM supplier) ORDER BY 1, 2, 3"""

# ---- search --------------------------------------------------------------------------

for _mode in S.SEARCH_MODES:
    SQL[f"search_{_mode}"] = t.search_sql(_mode)
SQL["search_concat"] = t.SPAN_SQL
SQL["search_status"] = f"""SELECT o_orderkey AS request_id,
  CASE WHEN o_orderkey % 8 = 6 THEN 'empty' WHEN n IS NULL THEN 'not_found' ELSE 'ok' END AS status,
  coalesce(n, 0) AS hits
FROM orders LEFT JOIN (SELECT request_id, count(*) AS n FROM ({t.search_sql("exact")}) GROUP BY 1)
  ON request_id = o_orderkey"""
SQL["search_json"] = f"""SELECT request_id, '[' || string_agg(
  '{{"zip_code":"' || zip_code || '","prefecture_id":' || prefecture_id || ',"city_id":"' || city_id
  || '","prefecture":"' || prefecture || '","city":"' || city || '","town":"' || town || '"}}',
  ',' ORDER BY position) || ']' AS records
FROM ({t.search_sql("exact")}) GROUP BY request_id"""

SQL["search_fold_width"] = f"""WITH {t.ADDR_SQL},
norm AS (
  SELECT o_orderkey AS request_id, 'LDING-' || CAST(o_custkey % 40 AS VARCHAR) AS word,
         length(o_orderpriority || 'ー' || CAST(o_custkey % 40 AS VARCHAR)) AS lim FROM orders
),
ranked AS (
  SELECT word, addr.*, row_number() OVER (
    PARTITION BY word ORDER BY zip_code, prefecture_id, city_id, city, town, prefecture
  ) AS position
  FROM (SELECT DISTINCT word FROM norm) JOIN addr ON contains(city, word)
)
SELECT request_id, CAST(position AS INTEGER) AS position, {_ADDRESS}
FROM norm JOIN ranked USING (word) WHERE position <= lim"""

# ---- text ----------------------------------------------------------------------------

_KANA_DOC = "translate(text, 'abcdefghijklmnop', 'あいうえおがぎゔゖぁアイウヴヶー')"
SQL["kana_fold"] = f"""WITH d AS (
  SELECT doc_id, {_KANA_DOC} AS w, translate({_KANA_DOC}, '{S.HIRAGANA}', '{S.KATAKANA}') AS k,
         translate({_KANA_DOC}, '{S.KATAKANA}', '{S.HIRAGANA}') AS h FROM documents
)
SELECT doc_id, md5(k) AS katakana, md5(h) AS hiragana,
       len(list_distinct([w, k, h])) AS candidates FROM d"""

SQL["width_normalise"] = """WITH d AS (
  SELECT doc_id, regexp_replace(text, '[\\s\\x{0B}\\x{85}\\x{A0}\\x{2028}\\x{2029}\\x{3000}]', '', 'g') AS w
  FROM documents
)
SELECT doc_id, md5(w) AS word, length(w) AS chars FROM d"""

# Depth after each piece is the running sum lifted by its lowest value below zero.
SQL["paren_strip"] = """WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, ',.', '()'), '[()]|[^()]+') AS pieces FROM documents
),
p AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM d),
s AS (
  SELECT *, sum(CASE piece WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)
              OVER (PARTITION BY doc_id ORDER BY i) AS total FROM p
),
k AS (
  SELECT *, total - least(0, min(total) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM s
),
kept AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY i) FILTER (depth = 0 AND piece NOT IN ('(', ')')) AS kept
  FROM k GROUP BY doc_id
)
SELECT doc_id, md5(coalesce(kept, '')) AS kept, length(coalesce(kept, '')) AS chars
FROM documents LEFT JOIN kept USING (doc_id)"""

SQL["keyword_pattern"] = """SELECT o_orderkey,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority || '%'
       ELSE '%' || o_orderpriority || '%' END AS pattern,
  CAST(greatest(1, least(200, o_custkey - 10)) AS INTEGER) AS "limit" FROM orders"""

SQL["version_ids"] = """SELECT event_id,
  strftime(ts, 'v%Y%m%d%H%M%S') || strftime(ts, '%g') AS data_version,
  strftime(ts, '%Y-%m-%d %H:%M:%S.000') AS batch FROM events"""

# ---- feeds ---------------------------------------------------------------------------

SQL["split_row_merge"] = f"""WITH {t.LINEITEM_FEED_SQL},
marked AS (
  SELECT *, CASE WHEN lag(zip_code) OVER w = zip_code AND lag(city_id) OVER w = city_id
                  AND NOT lag(flag) OVER w AND NOT flag THEN 0 ELSE 1 END AS b
  FROM feed WINDOW w AS (ORDER BY line_no)
),
runs AS (SELECT *, sum(b) OVER (ORDER BY line_no) AS run FROM marked),
merged AS (
  SELECT min(line_no) AS line_no, zip_code, city_id, string_agg(town, '' ORDER BY line_no) AS town
  FROM runs GROUP BY run, zip_code, city_id
)
SELECT line_no, zip_code, city_id, town FROM merged
QUALIFY row_number() OVER (PARTITION BY zip_code, town ORDER BY line_no) = 1"""

SQL["feed_files_clean"] = t.feed_files_sql(merge_before_strip=False)
SQL["feed_archives_clean"] = SQL["feed_files_clean"]
SQL["feed_merge_before_strip"] = t.feed_files_sql(merge_before_strip=True)

SQL["feed_quarantine"] = f"""SELECT 'broken,' || {t.FEED_ZIP.format(div="o_custkey // 3")} AS line,
  count(*) AS lines FROM orders WHERE {t.FEED_BAD} GROUP BY 1"""

# ---- versions ------------------------------------------------------------------------

_KEY = "zip_code, prefecture_id, city, town"
_T1, _T2 = "'2026-01-01 03:00:00'", "'2026-01-02 03:00:00'"
_UPSERT = f"""WITH {t.NEXT_SQL},
applied AS (
  SELECT zip_code, prefecture_id, coalesce(n.city_id, a.city_id) AS city_id,
         coalesce(n.prefecture, a.prefecture) AS prefecture, city, town,
         CASE WHEN a.city_id IS NULL THEN {_T2} ELSE {_T1} END AS created_at,
         CASE WHEN n.city_id IS NULL THEN {_T1} ELSE {_T2} END AS updated_at,
         CASE WHEN a.city_id IS NULL THEN 'inserted' WHEN n.city_id IS NULL THEN 'deleted'
              ELSE 'updated' END AS op,
         coalesce(a.city_id <> n.city_id OR a.prefecture <> n.prefecture, false) AS changed
  FROM addr a FULL JOIN next_addr n USING ({_KEY})
)"""
_STORED = f"{_ADDRESS}, created_at, updated_at"

SQL["upsert_rows"] = f"{_UPSERT} SELECT {_STORED}, op, changed FROM applied"
_COUNTS = """SELECT count(*) FILTER (op IN ('inserted', 'updated')) AS records_in_feed,
  count(*) FILTER (op = 'inserted') AS inserted_count, count(*) FILTER (op = 'updated') AS updated_count,
  count(*) FILTER (op = 'deleted') AS deleted_count, count(*) FILTER (op <> 'deleted') AS total_count,
  count(*) FILTER (changed) AS changed_count"""
SQL["diff_counts"] = f"{_UPSERT} {_COUNTS} FROM applied"
SQL["upsert_large"] = f"""WITH side AS (
  SELECT l_partkey, l_suppkey, l_linestatus AS s, max(l_linenumber) AS line FROM lineitem GROUP BY ALL
),
applied AS (
  SELECT CASE WHEN p.line IS NULL THEN 'inserted' WHEN f.line IS NULL THEN 'deleted' ELSE 'updated' END AS op,
         coalesce(p.line <> f.line, false) AS changed
  FROM (SELECT * FROM side WHERE s = 'O') p FULL JOIN (SELECT * FROM side WHERE s = 'F') f
    USING (l_partkey, l_suppkey)
)
{_COUNTS} FROM applied"""
SQL["version_diff"] = f"""{_UPSERT}
SELECT {_KEY}, CASE op WHEN 'inserted' THEN 'added' WHEN 'deleted' THEN 'removed' ELSE 'changed' END AS change_type,
       CASE WHEN changed THEN 'city_id' ELSE '' END AS changed_columns
FROM applied WHERE op <> 'updated' OR changed"""
SQL["prefecture_drift"] = f"""WITH {t.NEXT_SQL}
SELECT prefecture_id, coalesce(o, 0) AS old_count, coalesce(n, 0) AS new_count,
       coalesce(n, 0) - coalesce(o, 0) AS change
FROM (SELECT prefecture_id, count(*) AS o FROM addr GROUP BY 1)
FULL JOIN (SELECT prefecture_id, count(*) AS n FROM next_addr GROUP BY 1) USING (prefecture_id)"""
SQL["publish_current"] = f"{_UPSERT} SELECT {_STORED} FROM applied WHERE op <> 'deleted'"
SQL["rollback_view"] = f"""WITH {t.ADDR_SQL}
SELECT {_ADDRESS}, {_T1} AS created_at, {_T1} AS updated_at FROM addr"""
SQL["republish_null_towns"] = f"""WITH {t.ADDR_SQL},
n AS (SELECT count(*) AS c FROM (SELECT DISTINCT zip_code, prefecture_id, city,
  CASE WHEN city NOT LIKE '%7' THEN town END AS town FROM addr))
SELECT 'first' AS run, c AS inserted_count, 0 AS updated_count, 0 AS deleted_count, c AS total_count FROM n
UNION ALL SELECT 'second', 0, c, 0, c FROM n UNION ALL SELECT 'rows kept', 0, 0, 0, c FROM n"""
_FEW = "zip_code::BIGINT * 3 < (SELECT count(*) FROM addr) // 100"
SQL["publish_small_change"] = f"""WITH {t.ADDR_SQL}
SELECT * REPLACE (CASE WHEN {_FEW} THEN '99999' ELSE city_id END AS city_id),
       {_T1} AS created_at, {_T2} AS updated_at FROM (SELECT {_ADDRESS} FROM addr)"""
SQL["publish_partial_feed"] = f"""WITH {t.ADDR_SQL}
SELECT * REPLACE (CASE WHEN {_FEW} THEN '99999' ELSE city_id END AS city_id), {_T1} AS created_at,
       CASE WHEN {_FEW} THEN {_T2} ELSE {_T1} END AS updated_at FROM (SELECT {_ADDRESS} FROM addr)"""
SQL["publish_rewrites_little"] = f"""WITH {t.ADDR_SQL}
SELECT partial, true AS little, (SELECT count(*) FROM addr) AS rows, 0 AS changed_before
FROM (VALUES (false), (true)) v(partial)"""
SQL["published_diff"] = SQL["version_diff"]
SQL["published_diff_reads_little"] = f"""WITH {t.ADDR_SQL}
SELECT 'changed' AS change_type, count(*) AS rows, true AS little FROM addr WHERE {_FEW} AND city_id <> '99999'
GROUP BY ALL"""
SQL["publish_conflict"] = f"""{_UPSERT},
n AS (SELECT count(*) AS c FROM addr), m AS (SELECT count(*) AS c FROM applied WHERE op <> 'deleted')
SELECT 'first' AS run, 'success' AS status, '' AS error, c AS total_count FROM n
UNION ALL SELECT 'second', 'success', '', c FROM m UNION ALL SELECT 'day 3', 'success', '', c FROM n
UNION ALL SELECT 'day 4', 'failed', 'commit: another run was published meanwhile', 0
UNION ALL SELECT 'current', '', '', c FROM n"""
_V1, _V2 = "'v20260101030000123'", "'v20260102030000456'"
SQL["publish_audits"] = f"""{_UPSERT},
n AS ({_COUNTS} FROM applied), one AS (SELECT count(*) AS c FROM addr)
SELECT {_V1} AS data_version, {_V1} AS content_version, 'first' AS source_url, c AS records_in_feed,
       c AS inserted_count, 0 AS updated_count, 0 AS deleted_count, c AS total_count, 'success' AS status FROM one
UNION ALL SELECT {_V2}, {_V2}, 'second', records_in_feed, inserted_count, updated_count, deleted_count,
       total_count, 'success' FROM n
UNION ALL SELECT 'rv20260103030000456', {_V1}, 'rollback_cli:' || {_V1}, c, c, 0, 0, c, 'rollback' FROM one"""
SQL["snapshot_counts"] = f"""{_UPSERT}
SELECT {_V1} AS data_version, count(*) AS rows FROM addr
UNION ALL SELECT {_V2}, count(*) FROM applied WHERE op <> 'deleted'"""
SQL["run_drift"] = f"""WITH {t.ORDER_RUNS_SQL},
d AS (
  SELECT strftime(run_finished_at, 'v%Y%m%d') AS data_version, total_count,
         coalesce(lag(total_count) OVER (ORDER BY run_finished_at), 0) AS previous_count
  FROM runs WHERE status = 'success'
)
SELECT *, previous_count > 0 AND abs((total_count - previous_count) / previous_count) > 0.2 AS suspicious FROM d"""

_DIRTY = """dirty AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN '12' ELSE lpad(CAST(o_custkey AS VARCHAR), 7, '0') END AS zip_code,
         o_custkey % 26 AS prefecture_id, lpad(CAST(o_custkey % 40 AS VARCHAR), 5, '0') AS city_id,
         repeat(o_orderpriority, 4) AS prefecture,
         CASE WHEN o_custkey % 9 > 0 THEN o_orderpriority ELSE '' END AS city,
         repeat(o_orderpriority, o_custkey % 100) AS town FROM orders
)"""
_RULES = {
    "blank_key": "zip_code = '' OR city = ''",
    "zip_not_7_digits": "NOT regexp_matches(zip_code, '^[0-9]{7}$')",
    "unknown_prefecture": "prefecture_id = 0",
    "long_city_id": "length(city_id) > 10",
    "long_prefecture": "length(prefecture) > 32",
    "long_city": "length(city) > 50",
    "long_town": "length(town) > 500",
}
SQL["quality_counts"] = (
    f"WITH {_DIRTY} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER ({rule}) AS broken_count FROM dirty"
        for name, rule in _RULES.items()
    )
    + f" UNION ALL SELECT 'duplicate_key', (SELECT count(*) FROM dirty) - count(*) FROM (SELECT DISTINCT {_KEY} FROM dirty)"
)
_BROKEN = "concat_ws(',', " + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in _RULES.items()) + ")"
SQL["quality_quarantine"] = f"""WITH {_DIRTY}, b AS (SELECT {_BROKEN} AS broken_rules FROM dirty)
SELECT broken_rules, count(*) AS rows FROM b WHERE broken_rules <> '' GROUP BY 1"""
_KEPT_RULES = {n: r for n, r in _RULES.items() if n != "unknown_prefecture"}
_KEPT_BROKEN = "concat_ws(',', " + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in _KEPT_RULES.items()) + ")"
_PUBLISHED_DIRTY = f"""{_DIRTY},
checked AS (SELECT *, {_KEPT_BROKEN} AS broken_rules FROM dirty),
published AS (
  SELECT {_KEY}, min({{'city_id': city_id, 'prefecture': prefecture}}) AS p FROM checked WHERE broken_rules = '' GROUP BY ALL
)"""
SQL["publish_dirty_feed"] = f"""WITH {_PUBLISHED_DIRTY}
SELECT {_KEY}, p.city_id AS city_id, p.prefecture AS prefecture, {_T1} AS created_at, {_T1} AS updated_at FROM published"""
SQL["publish_dirty_quarantine"] = f"""WITH {_PUBLISHED_DIRTY}
SELECT broken_rules AS what, count(*) AS rows FROM checked WHERE broken_rules <> '' GROUP BY 1
UNION ALL SELECT 'duplicate_key', (SELECT count(*) FROM checked WHERE broken_rules = '') - (SELECT count(*) FROM published)
UNION ALL SELECT 'success', count(*) FROM published
UNION ALL SELECT 'current', count(*) FROM published"""
_RELEASE_LINE = ", ',', ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in S.ADDRESS_COLUMNS)
SQL["export_manifest"] = f"WITH {t.ADDR_SQL} SELECT count(*) AS row_count, true AS hash_matches, "
SQL["export_manifest"] += f"CAST(sum(strlen(concat({_RELEASE_LINE})) + 1) AS BIGINT) AS row_bytes FROM addr"

# ---- monitoring ----------------------------------------------------------------------

_POSTAL = "path LIKE '/postal_codes/%'"


def _metrics(by: str = "") -> str:
    return f"""count(*) AS requests{by}, count(*) FILTER (status BETWEEN 500 AND 599) AS errors{by},
  count(*) FILTER (status = 404) AS not_found{by}"""


def _win(width: str) -> str:
    return f"""win AS (
  SELECT time_bucket(INTERVAL '{width}', ts) AS window_start, {_metrics()},
         quantile_cont(latency_ms, 0.95) FILTER ({_POSTAL}) AS p95_ms,
         count(*) FILTER (path = '/ready') AS probes,
         count(*) FILTER (path = '/ready' AND status BETWEEN 200 AND 299) AS probes_ok
  FROM log GROUP BY 1
)"""


_WIN_COLUMNS = f"""{_at("window_start", "window_start")}, requests, errors, not_found,
  round(errors / requests, 6) AS error_rate, round(not_found / requests, 6) AS not_found_ratio,
  round(coalesce(p95_ms, -1), 6) AS p95_ms, probes, probes_ok"""

SQL["request_metrics"] = f"""WITH {t.LOG_SQL}
SELECT {_metrics("_total")}, round(errors_total / requests_total, 6) AS error_rate,
       round(avg(latency_ms), 6) AS average_latency_ms FROM log"""
SQL["request_metrics_by_path"] = f"""WITH {t.LOG_SQL}
SELECT path, count(*) AS requests_total, count(*) FILTER (status = 500) AS errors_total,
       round(avg(latency_ms), 6) AS average_latency_ms FROM log GROUP BY 1"""
SQL["log_lines"] = f"""WITH {t.LOG_SQL}
SELECT event_id, method, path, status, latency_ms FROM log WHERE event_type NOT IN ('view', 'purchase')"""
SQL["dependency_error_counts"] = f"""WITH {t.LOG_SQL}
SELECT {_at("date_trunc('hour', ts)", "window_start")},
       CASE event_type WHEN 'error' THEN 'database' ELSE 'redis' END AS dependency, count(*) AS errors
FROM log WHERE event_type IN ('error', 'signup') GROUP BY 1, 2"""
SQL["sli_5min"] = f"WITH {t.LOG_SQL}, {_win('5 minutes')} SELECT {_WIN_COLUMNS} FROM win"
SQL["stored_rollup"] = f"""WITH {t.LOG_SQL}
SELECT {_at("date_trunc('day', ts)", "day")}, {_metrics()}, count(*) FILTER ({_POSTAL}) AS lookups,
       round(coalesce(avg(latency_ms) FILTER ({_POSTAL}), -1), 6) AS mean_ms,
       count(*) FILTER (path = '/ready') AS probes,
       count(*) FILTER (path = '/ready' AND status BETWEEN 200 AND 299) AS probes_ok,
       lookups > 0 AS p95_within_bound
FROM log GROUP BY 1"""
SQL["sli_6h"] = f"WITH {t.LOG_SQL}, {_win('6 hours')} SELECT {_WIN_COLUMNS} FROM win"

_STEP = "INTERVAL 5 MINUTE"
# Each window with the two before it, if they are adjacent.
_TRIPLES = f"""{t.LOG_SQL}, {_win("5 minutes")},
tri AS (
  SELECT w.*, w.window_start + {_STEP} AS window_end, a.window_start AS a_start, b.window_start AS b_start,
         a.errors / a.requests AS a_rate, b.errors / b.requests AS b_rate, w.errors / w.requests AS rate,
         a.p95_ms AS a_p95, b.p95_ms AS b_p95,
         w.probes > 0 AND w.probes_ok = 0 AS down, a.probes > 0 AND a.probes_ok = 0 AS a_down
  FROM win w LEFT JOIN win a ON a.window_start = w.window_start - {_STEP}
             LEFT JOIN win b ON b.window_start = w.window_start - 2 * {_STEP}
),
alert AS (
  SELECT *, coalesce(p95_ms >= 300 AND a_p95 >= 300 AND b_p95 >= 300, false) AS slow_15m,
         coalesce(down AND a_down, false) AS not_ready_10m FROM tri
),
leveled AS (
  SELECT *, CASE WHEN rate >= 0.03 OR not_ready_10m THEN 'P1' WHEN rate >= 0.01 OR slow_15m THEN 'P2'
                 ELSE 'none' END AS level FROM alert
)"""
SQL["sustained_breach"] = f"""WITH {_TRIPLES}
SELECT {_at(f"window_end - 3 * {_STEP}", "start")}, {_at("window_end", '"end"')}
FROM tri WHERE rate >= 0.01 AND a_rate >= 0.01 AND b_rate >= 0.01"""


def _islands(source: str, keep: str, extra: str = "") -> str:
    return f"""isl AS (
  SELECT *, sum(fresh) OVER (ORDER BY window_start) AS run FROM (
    SELECT *, CASE WHEN lag(window_end) OVER (ORDER BY window_start) = window_start THEN 0 ELSE 1 END AS fresh
    FROM {source} WHERE {keep})
),
found AS (
  SELECT min(window_start) AS s, max(window_end) AS e, count(*) AS windows{extra} FROM isl GROUP BY run
)"""


SQL["breach_runs"] = f"""WITH {_TRIPLES}, {_islands("tri", "rate >= 0.01")}
SELECT {_at("s", "started_at")}, {_at("e", "ended_at")}, windows FROM found"""
_ALERT_COLUMNS = f"{_at('window_end', 'window_end')}, requests, slow_15m, not_ready_10m, level"
SQL["alert_level"] = f"WITH {_TRIPLES} SELECT {_ALERT_COLUMNS} FROM leveled"
_FAILING = f"CASE WHEN event_type = 'click' AND event_id % 5 > 0 THEN 503 ELSE {t.LOG_STATUS} END"
_FAILING_LOG = t.LOG_SQL.replace(f"{t.LOG_STATUS} AS status", f"{_FAILING} AS status")
SQL["alert_not_ready"] = f"WITH {_TRIPLES.replace(t.LOG_SQL, _FAILING_LOG)} SELECT {_ALERT_COLUMNS} FROM leveled"
SQL["alert_freshness"] = f"""WITH {_TRIPLES},
runs AS (SELECT min(ts) AS done FROM log GROUP BY date_trunc('day', ts)),
last AS (
  SELECT window_end, level, (SELECT max(done) FROM runs WHERE done <= window_end) AS done FROM leveled
)
SELECT {_at("window_end", "window_end")},
       CASE WHEN level = 'none' AND (done IS NULL OR window_end - done > INTERVAL 12 HOUR) THEN 'P3'
            ELSE level END AS level FROM last"""
def _silent(until: str) -> str:
    """Ends of 5-minute windows, from a service's first good probe to ``until``, with no good
    probe in the 10 minutes before."""
    return f"""WITH {t.LOG_SQL},
good AS (SELECT 's' || user_id % 20 AS service, ts FROM log WHERE path = '/ready' AND status BETWEEN 200 AND 299),
ends AS (
  SELECT service, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, first) + INTERVAL 5 MINUTE, last, INTERVAL 5 MINUTE)) AS w
  FROM (SELECT service, min(ts) AS first FROM good GROUP BY 1), (SELECT {until} AS last FROM log))
SELECT e.service, {_at("w", "window_end")}, {_at("ts", "last_good")}, 'P1' AS level
FROM ends e ASOF JOIN good g ON e.service = g.service AND e.w > g.ts WHERE w - ts >= INTERVAL 10 MINUTE"""


SQL["silent_probes"] = _silent("max(ts)")
SQL["stream_silent_probes"] = _silent("max(ts) - INTERVAL 10 MINUTE")
_ALERTED = _islands("leveled", "level <> 'none'", ", min(level) AS level")
_INCIDENTS = f"WITH {_TRIPLES}, {_ALERTED}"
SQL["incident_list"] = f"""{_INCIDENTS}
SELECT printf('INC-%s-%03d', strftime(s, '%Y%m'),
              row_number() OVER (PARTITION BY strftime(s, '%Y-%m') ORDER BY s)) AS incident,
       level, {_at("s", "started_at")}, {_at("e", "ended_at")}, windows FROM found"""
SQL["incident_counts"] = f"""{_INCIDENTS}
SELECT strftime(s, '%Y-%m') AS month, level, count(*) AS incidents FROM found GROUP BY 1, 2"""
SQL["dashboard"] = f"""WITH {t.LOG_SQL},
r AS (SELECT * FROM (VALUES ('15m', 15), ('1h', 60), ('24h', 1440)) v(range, minutes))
SELECT range, count(ts) AS requests, count(*) FILTER (status BETWEEN 500 AND 599) AS errors,
       count(*) FILTER (status = 404) AS not_found,
       CASE WHEN requests = 0 THEN 0 ELSE round(errors / requests, 6) END AS error_rate,
       round(quantile_cont(latency_ms, 0.95) FILTER ({_POSTAL}), 6) AS p95_ms
FROM r LEFT JOIN log ON ts > TIMESTAMP '2024-01-31' - minutes * INTERVAL 1 MINUTE AND ts <= TIMESTAMP '2024-01-31'
GROUP BY range"""
_AS_OF = "TIMESTAMP '2024-01-31'"
_BEFORE = f"ts > {_AS_OF} - 2 * minutes * INTERVAL 1 MINUTE AND ts <= {_AS_OF} - minutes * INTERVAL 1 MINUTE"
SQL["dashboard_panels"] = f"""WITH {t.LOG_SQL},
r AS (SELECT * FROM (VALUES ('15m', 15), ('1h', 60), ('24h', 1440)) v(range, minutes)),
probed AS (SELECT * REPLACE (CASE WHEN path = '/ready' AND event_id % 3 = 0 THEN 503 ELSE status END AS status) FROM log),
m AS (
  SELECT range, count(ts) AS requests,
         coalesce(count(*) FILTER (status BETWEEN 500 AND 599) / nullif(count(ts), 0), 0) AS error_rate,
         coalesce(count(*) FILTER (status = 404) / nullif(count(ts), 0), 0) AS missing,
         quantile_cont(latency_ms, 0.95) FILTER ({_POSTAL}) AS p95,
         count(*) FILTER (path = '/ready' AND status = 200) / nullif(count(*) FILTER (path = '/ready'), 0) AS ready,
         count(*) FILTER (path = '/ready' AND status = 200 AND ts > {_AS_OF} - INTERVAL 10 MINUTE) AS late_ok,
         count(*) FILTER (event_type = 'error') AS db, count(*) FILTER (event_type = 'signup') AS cache
  FROM r LEFT JOIN probed ON ts > {_AS_OF} - minutes * INTERVAL 1 MINUTE AND ts <= {_AS_OF} GROUP BY 1
),
b AS (
  SELECT range, count(*) FILTER (event_type = 'error') AS db_before,
         count(*) FILTER (event_type = 'signup') AS cache_before
  FROM r LEFT JOIN log ON {_BEFORE} GROUP BY 1
),
f AS (
  SELECT date_diff('microsecond', max(ts), {_AS_OF}) / 3600000000 AS hours
  FROM log WHERE event_type = 'purchase' AND ts <= {_AS_OF}
),
p AS (
  SELECT range, 'request_throughput' AS panel, CAST(requests AS DOUBLE) AS value, 'ok' AS state FROM m
  UNION ALL SELECT range, 'error_rate', error_rate,
    CASE WHEN error_rate >= 0.03 THEN 'critical' WHEN error_rate >= 0.01 THEN 'warning' ELSE 'ok' END FROM m
  UNION ALL SELECT range, 'p95_latency', p95, CASE WHEN p95 > 300 THEN 'warning' ELSE 'ok' END FROM m
  UNION ALL SELECT range, 'ready_status', ready, CASE WHEN late_ok = 0 THEN 'critical' ELSE 'ok' END FROM m
  UNION ALL SELECT range, 'not_found_ratio', missing, 'ok' FROM m
  UNION ALL SELECT range, 'update_freshness', hours,
    CASE WHEN hours IS NULL OR hours > 24 THEN 'critical' WHEN hours > 12 THEN 'warning' ELSE 'ok' END FROM r, f
  UNION ALL SELECT range, 'database_errors', db, CASE WHEN db > db_before THEN 'warning' ELSE 'ok' END FROM m JOIN b USING (range)
  UNION ALL SELECT range, 'redis_errors', cache, CASE WHEN cache > cache_before THEN 'warning' ELSE 'ok' END FROM m JOIN b USING (range)
)
SELECT range, panel, round(value, 6) AS value, state FROM p"""
SQL["incident_categories"] = f"""{_INCIDENTS},
numbered AS (
  SELECT printf('INC-%s-%03d', strftime(s, '%Y%m'),
                row_number() OVER (PARTITION BY strftime(s, '%Y-%m') ORDER BY s)) AS incident, s, e FROM found
),
causes AS (
  SELECT ts, 'update failure' AS category FROM log WHERE user_id % 7 = 0
  UNION ALL SELECT ts, 'database' FROM log WHERE event_type = 'error'
  UNION ALL SELECT ts, 'cache' FROM log WHERE event_type = 'signup'
)
SELECT incident, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), 'other') AS category
FROM numbered LEFT JOIN causes ON ts >= s AND ts < e GROUP BY 1"""
SQL["update_freshness"] = f"""WITH {t.ORDER_RUNS_SQL},
asked AS (SELECT unnest([{", ".join(f"TIMESTAMP '{a}'" for a in t.FRESHNESS_AT)}]) AS as_of),
l AS (SELECT as_of, max(run_finished_at) FILTER (status = 'success') AS last
      FROM asked JOIN runs ON run_finished_at <= as_of GROUP BY 1),
h AS (SELECT *, date_diff('second', last, as_of) / 3600 AS hours FROM l)
SELECT {_at("as_of", "as_of")}, {_at("last", "last_success")}, round(hours, 6) AS hours,
       CASE WHEN hours IS NULL OR hours > 24 THEN 'critical' WHEN hours > 12 THEN 'warning' ELSE 'ok' END AS state
FROM h"""
_DAYS = "day(last_day(strptime(month || '-01', '%Y-%m-%d')))"
_BUDGET = f"""{t.ORDER_LOG_SQL},
budget AS (
  SELECT strftime(ts, '%Y-%m') AS month, count(*) AS probes,
         count(*) FILTER (status BETWEEN 200 AND 299) AS probes_ok, probes_ok / probes AS availability
  FROM log WHERE path = '/ready' GROUP BY 1
)"""
SQL["error_budget"] = f"""WITH {_BUDGET}
SELECT month, probes, probes_ok, round(availability, 6) AS availability,
       CAST(floor({_DAYS} * 86.4) AS BIGINT) AS budget_seconds,
       round((1 - availability) / 0.001, 6) AS consumed_ratio,
       (1 - availability) / 0.001 > 0.5 AS freeze, (1 - availability) / 0.001 > 0.8 AS stop FROM budget"""
_MONTHLY = f"""{_BUDGET}, {t.ORDER_RUNS_SQL},
ind AS (
  SELECT strftime(ts, '%Y-%m') AS month, {_metrics()}, errors / requests AS error_rate,
         not_found / requests AS not_found_ratio, quantile_cont(latency_ms, 0.95) FILTER ({_POSTAL}) AS p95_ms FROM log GROUP BY 1
)"""
SQL["slo_report"] = f"""WITH {_MONTHLY},
ends AS (SELECT max(run_finished_at) AS stop FROM runs),
ok_runs AS (SELECT DISTINCT run_finished_at AS done FROM runs WHERE status = 'success'),
spine AS (
  SELECT unnest(generate_series(date_trunc('month', (SELECT min(done) FROM ok_runs)),
                                date_trunc('month', (SELECT stop FROM ends)), INTERVAL 1 MONTH)) AS first
),
edges AS (
  -- a month's successes, its own edges, and the end of the report
  SELECT first, done FROM spine JOIN ok_runs ON done >= first AND done < first + INTERVAL 1 MONTH
  UNION SELECT first, greatest(first, (SELECT min(done) FROM ok_runs)) FROM spine
  UNION SELECT first, least(first + INTERVAL 1 MONTH, (SELECT stop FROM ends)) FROM spine
),
gaps AS (
  SELECT strftime(first, '%Y-%m') AS month,
         date_diff('second', lag(done) OVER (PARTITION BY first ORDER BY done), done) / 3600 AS gap FROM edges
),
g AS (SELECT month, CAST(coalesce(max(gap), 0) AS DOUBLE) AS gap FROM gaps GROUP BY 1),
m AS (SELECT * FROM ind FULL JOIN budget USING (month) FULL JOIN g USING (month)),
rows AS (
  SELECT month, 'availability' AS item, 0.999::DOUBLE AS target, availability::DOUBLE AS actual, availability >= 0.999 AS ok FROM m
  UNION ALL SELECT month, 'error_rate', 0.01, error_rate, error_rate < 0.01 FROM m
  UNION ALL SELECT month, 'p95_ms', 300.0, p95_ms, p95_ms < 300 FROM m
  UNION ALL SELECT month, 'freshness_hours', 24.0, gap, gap <= 24 FROM m
)
SELECT month, item, target, round(coalesce(actual, -1), 6) AS actual,
       CASE WHEN actual IS NULL THEN 'no data' WHEN ok THEN 'Pass' ELSE 'Fail' END AS result FROM rows"""
_SHOWN = ["record_count", "not_found_ratio", "error_rate", "p95_ms"]
SQL["monthly_compare"] = (
    f"""WITH {_MONTHLY},
recs AS (
  SELECT strftime(run_finished_at, '%Y-%m') AS month, arg_max(total_count, run_finished_at) AS record_count
  FROM runs WHERE status = 'success' GROUP BY 1
),
j AS (SELECT month, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SHOWN)} FROM ind FULL JOIN recs USING (month))
SELECT j.month, """
    + ", ".join(
        [f"round(coalesce(j.{c}, -1), 6) AS {c}" for c in _SHOWN]
        + [f"round(coalesce(p.{c}, -1), 6) AS previous_{c}" for c in _SHOWN]
        + [f"round(coalesce(j.{c} - p.{c}, -1), 6) AS change_{c}" for c in _SHOWN]
    )
    + """ FROM j LEFT JOIN j p
      ON p.month = strftime(strptime(j.month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m')"""
)
SQL["update_history"] = f"""WITH {t.ORDER_RUNS_SQL}
SELECT {_at("run_finished_at", "at")}, 'data update' AS kind,
       strftime(run_finished_at, 'v%Y%m%d') AS data_version,
       CASE status WHEN 'success' THEN '成功' ELSE '失敗' END AS result
FROM runs WHERE strftime(run_finished_at, '%Y-%m') = '1997-05'"""

# ---- access --------------------------------------------------------------------------

SQL["network_match"] = f"""WITH {t.LOG_SQL},
net AS (
  SELECT DISTINCT (s_suppkey % 6) * 256 + (s_suppkey % 32) * 8 + 1 AS base, 5 - s_suppkey % 4 AS host_bits
  FROM supplier
),
c AS (
  SELECT event_id, user_id, event_type = 'signup' AS v6, CASE WHEN event_type = 'signup'
    THEN '2001:db8::' || lower(printf('%x', user_id))
    ELSE '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS ip FROM log
)
SELECT event_id, ip, CASE WHEN v6
    THEN EXISTS (SELECT 1 FROM region WHERE user_id // 16 = CAST('0x' || (r_regionkey * 10) AS BIGINT) // 16)
    ELSE EXISTS (SELECT 1 FROM net WHERE user_id >> host_bits = base >> host_bits) END AS allowed
FROM c"""
SQL["client_ips"] = f"""WITH {t.LOG_SQL}
SELECT event_id, CASE WHEN event_type = 'view' THEN '10.0.0.1'
    WHEN event_type = 'signup' THEN '2001:db8::' || lower(printf('%x', user_id))
    ELSE '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS client_ip,
  path IN ('/ready', '/postal_codes/1') AS anonymous FROM log"""
SQL["access_audit"] = f"""WITH {t.LOG_SQL},
a AS (
  SELECT event_type, event_id,
         CASE WHEN event_type = 'view' THEN true WHEN event_type = 'signup' THEN user_id < 64
              ELSE user_id < 64 OR user_id BETWEEN 128 AND 255 END AS known,
         path = '/ready' OR user_id % 3 > 0 AS may FROM log
)
SELECT event_type, CASE WHEN NOT known THEN 403 WHEN NOT may THEN 401 ELSE 200 END AS outcome,
       count(*) AS requests FROM a GROUP BY 1, 2"""

# ---- streams -------------------------------------------------------------------------

_CLOSED = "(SELECT max(ts) FROM log) - INTERVAL 10 MINUTE"
SQL["stream_sli"] = f"""WITH {t.LOG_SQL}, {_win("5 minutes")}
SELECT {_WIN_COLUMNS} FROM win WHERE window_start + {_STEP} <= {_CLOSED}"""
SQL["stream_alerts"] = f"WITH {_TRIPLES} SELECT {_ALERT_COLUMNS} FROM leveled WHERE window_end <= {_CLOSED}"
_BOTH_CLOSED = "(SELECT least(max(ts), (SELECT max(done) FROM runs)) FROM log) - INTERVAL 10 MINUTE"
SQL["stream_freshness"] = f"""{SQL["alert_freshness"]} WHERE window_end <= {_BOTH_CLOSED}"""
SQL["stream_late_rows"] = """WITH e AS (
  SELECT event_id % 10 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS late FROM events)
SELECT count(*) AS rows_in, count(*) FILTER (late) AS dropped, count(*) FILTER (NOT late) AS kept FROM e"""
SQL["stream_incidents"] = f"""{SQL["incident_list"]}
WHERE e + INTERVAL 301 SECOND <= date_trunc('millisecond', {_CLOSED})"""
SQL["stream_sustained_latency"] = f"""WITH {_TRIPLES}
SELECT {_at(f"window_end - 3 * {_STEP}", "start")}, {_at("window_end", '"end"')}
FROM alert WHERE slow_15m AND window_end <= {_CLOSED}"""
SQL["stream_dedup"] = "SELECT event_id FROM events"
SQL["joined_parts_in_order"] = t.feed_files_sql(merge_before_strip=False)
SQL["feed_arrivals"] = f"SELECT *, {_T1} AS created_at, {_T1} AS updated_at FROM ({t.feed_files_sql(merge_before_strip=False)})"
SQL["late_part_ignored"] = SQL["feed_arrivals"]
