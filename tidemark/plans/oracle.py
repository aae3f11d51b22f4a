"""DuckDB equivalents of the catalogue's queries."""

from __future__ import annotations

START, END = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-12 00:00:00'"

USER = "u AS (SELECT user_id::VARCHAR AS id, ts AS time, value, event_id AS seq FROM events)"
TYPE = "u AS (SELECT event_type AS id, ts AS time, value, event_id AS seq FROM events)"
ORDERS = "u AS (SELECT o_orderpriority AS id, o_orderdate AS time, o_totalprice AS value, o_orderkey AS seq, 'price' AS field FROM orders)"
SHIP = """w AS (SELECT l_suppkey::VARCHAR AS id, l_shipdate AS time, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount FROM lineitem),
u AS (SELECT id, time, seq, field, value FROM (UNPIVOT w ON quantity, price, discount INTO NAME field VALUE value))"""
SERIES = "s AS (SELECT id, time, value, seq, row_number() OVER (PARTITION BY id ORDER BY time, seq) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM u)"


def rolled(base: str, bucket: str, field: str = "'value'", where: str = "true", places: int = 6) -> str:
    return f"""WITH {base}, b AS (SELECT id, {field} AS field, {bucket} AS bucket, time, value FROM u WHERE {where}),
m AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM b WINDOW w AS (PARTITION BY id, field, bucket))
SELECT id, field, epoch_us(bucket) AS bucket_us, count(*) AS count, round(sum(value), 6) AS sum, round(sum(value) / count(*), {places}) AS avg,
  any_value(lo) AS min, any_value(hi) AS max, epoch_us(min(time) FILTER (value = lo)) AS min_time_us, epoch_us(min(time) FILTER (value = hi)) AS max_time_us
FROM m GROUP BY id, field, bucket"""


Q = "q AS (SELECT id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s GROUP BY id)"
POPULATION = """p AS (SELECT id, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM s GROUP BY id),
k AS (SELECT s.id, avg(pow((value - m) / sd, 3)) AS skew, avg(pow((value - m) / sd, 4)) - 3 AS kurt FROM s JOIN p USING (id) GROUP BY s.id)"""


def zscore(threshold: float, source: str = "s") -> str:
    return f"""SELECT id, epoch_us(time) AS time_us, value, round(CASE WHEN flat THEN 1 ELSE abs(z) END, 6) AS score,
  CASE WHEN flat THEN 'flatline' WHEN z > 0 THEN 'spike' ELSE 'drop' END AS type, 'zscore' AS algorithm,
  round(CASE WHEN NOT flat THEN m - {threshold} * sd END, 6) AS expected_min, round(CASE WHEN NOT flat THEN m + {threshold} * sd END, 6) AS expected_max
FROM (SELECT *, lo = hi AS flat, (value - m) / nullif(sd, 0) AS z FROM (
  SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, min(value) OVER w AS lo, max(value) OVER w AS hi FROM {source} WHERE n >= 10 WINDOW w AS (PARTITION BY id)))
WHERE flat OR abs(z) > {threshold}"""


def fences(k: float, source: str = "s") -> str:
    return f"""SELECT id, epoch_us(time) AS time_us, value, round(CASE WHEN q3 > q1 THEN greatest(value - hi, lo - value) / (q3 - q1) ELSE 1 END, 6) AS score,
  CASE WHEN value > hi THEN 'spike' ELSE 'drop' END AS type, 'iqr' AS algorithm, round(lo, 6) AS expected_min, round(hi, 6) AS expected_max
FROM (SELECT *, q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi FROM {source} JOIN q USING (id) WHERE n >= 10) WHERE value > hi OR value < lo"""


def local(threshold: float, source: str = "s") -> str:
    return f"""SELECT id, epoch_us(time) AS time_us, value, round(d, 6) AS score, CASE WHEN value > m THEN 'spike' ELSE 'drop' END AS type, 'moving_avg' AS algorithm,
  round(m - {threshold} * sd, 6) AS expected_min, round(m + {threshold} * sd, 6) AS expected_max
FROM (SELECT *, CASE WHEN sd > 0 THEN abs(value - m) / sd WHEN value <> m THEN {threshold} + 1 ELSE 0 END AS d FROM (
  SELECT *, sqrt(list_sum(list_transform(near, lambda x: (x - m) * (x - m))) / len(near)) AS sd FROM (
    SELECT *, list_sum(near) / len(near) AS m FROM (
      SELECT *, list_concat(coalesce(list(value) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []), coalesce(list(value) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), [])) AS near
      FROM {source} WHERE n >= 10)))) WHERE d > {threshold}"""


TREND = """t AS (SELECT id, count(*) AS n, regr_slope(value, i) AS slope, regr_intercept(value, i) AS intercept,
  coalesce(CASE WHEN var_pop(value) > 0 THEN regr_r2(value, i) END, 0) AS r2, corr(value, i) AS r FROM s GROUP BY id)"""

SPIKY = """x AS (SELECT *, avg(value) OVER (PARTITION BY id) AS m, stddev_pop(value) OVER (PARTITION BY id) AS sd, value - lag(value) OVER (PARTITION BY id ORDER BY i) AS d FROM s),
sp AS (SELECT id, any_value(n) AS n, CASE WHEN any_value(n) < 10 OR any_value(sd) = 0 THEN 0 ELSE least(1, (count(*) FILTER (abs(value - m) > 2 * sd) / any_value(n) + 1.5::DOUBLE * (count(*) FILTER (abs(d) > sd)) / (any_value(n) - 1)) / 2.5::DOUBLE) END AS spikiness FROM x GROUP BY id),
mo AS (SELECT id, n, spikiness, CASE WHEN spikiness > 0.2 THEN 'minmax' WHEN n > 100000 THEN 'avg' WHEN spikiness > 0.1 THEN 'm4' ELSE 'lttb' END AS mode FROM sp)"""


def bucketed(threshold: int, buckets: int, source: str = "s", name: str = "bk") -> str:
    """The bucket of each point in doubles; null where none holds it."""
    holds = lambda c: f"WHEN {c} >= 0 AND {c} < {buckets} AND floor(({c})::DOUBLE * z) <= i AND i < floor(({c} + 1)::DOUBLE * z) THEN {c}"
    return f"""{name} AS (SELECT *, n <= {threshold} AS whole, CASE WHEN n > {threshold} THEN CASE {holds('g')} {holds('g - 1')} {holds('g + 1')} END END AS b
  FROM (SELECT *, floor(i / z)::BIGINT AS g FROM (SELECT *, n::DOUBLE / {buckets}::DOUBLE AS z FROM {source})))"""


def extremes(m4: bool, name: str = "bk") -> str:
    more = " OR i = min(i) OVER w OR i = max(i) OVER w" if m4 else ""
    return f"""SELECT id, epoch_us(time) AS time_us, round(value, 6) AS value FROM (SELECT *, whole OR (b IS NOT NULL AND (i = first_value(i) OVER (w ORDER BY value, i) OR i = first_value(i) OVER (w ORDER BY value DESC, i){more})) AS keep
  FROM {name} WINDOW w AS (PARTITION BY id, b)) WHERE keep"""


def averages(name: str = "bk") -> str:
    return f"""SELECT id, epoch_us(max(time) FILTER (k = c // 2)) AS time_us, round(avg(value), 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY id, b ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY id, b) AS c FROM (SELECT * REPLACE (CASE WHEN whole THEN i ELSE b END AS b) FROM {name})
  WHERE b IS NOT NULL) GROUP BY id, b"""


def lttb(threshold: int, source: str = "s") -> str:
    """CTEs bo, step, and what to select from them."""
    t = max(threshold, 100)
    return f"""bo AS (SELECT *, (n - 2)::DOUBLE / {t - 2} AS z, CASE WHEN i BETWEEN 1 AND n - 2 THEN greatest(0, floor((i - 1) / ((n - 2)::DOUBLE / {t - 2})) - 1) END AS g0 FROM {source} WHERE n > {t}),
bi AS (SELECT * EXCLUDE (g0), (SELECT max(k) FROM range(g0::BIGINT, g0::BIGINT + 3) AS r(k) WHERE floor(k * z)::BIGINT + 1 <= i) AS g FROM bo WHERE g0 IS NOT NULL),
nx AS (SELECT id, g, avg(i) AS mx, avg(value) AS my FROM (SELECT id, g, i, value FROM bi UNION ALL SELECT id, {t - 2}, i, value FROM bo WHERE i = n - 1) GROUP BY id, g),
step AS (SELECT id, -1::BIGINT AS g, 0::BIGINT AS a, value AS v FROM bo WHERE i = 0
  UNION ALL
  SELECT id, g, best.a, best.v FROM (SELECT bi.id, bi.g, first(struct_pack(a := bi.i, v := bi.value) ORDER BY 0.5 * abs((step.a - mx) * (bi.value - step.v) - (step.a - bi.i) * (my - step.v)) DESC, bi.i) AS best
    FROM step JOIN bi ON bi.id = step.id AND bi.g = step.g + 1 JOIN nx ON nx.id = bi.id AND nx.g = bi.g + 1 GROUP BY bi.id, bi.g))""", f"""SELECT id, epoch_us(time) AS time_us, round(value, 6) AS value FROM {source} WHERE n <= {t} OR i = 0 OR i = n - 1
UNION ALL SELECT step.id, epoch_us(time), round(value, 6) FROM step JOIN {source} AS o ON o.id = step.id AND o.i = step.a WHERE step.g >= 0"""


def ahead(fit: str, value: str, band: str, name: str, ctes: str = "") -> str:
    return f"""WITH {TYPE}, {SERIES}, {ctes} f AS ({fit})
SELECT id, h::INT AS h, epoch_us(last_time) + h * 3600000000 AS time_us, round({value}, 6) AS value, round({value} - 1.96 * ({band}), 6) AS lower, round({value} + 1.96 * ({band}), 6) AS upper, '{name}' AS algorithm
FROM f, range(1, 25) AS r(h)"""


SMA = "sm AS (SELECT *, avg(value) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS fitted FROM s)"
LINE = "li AS (SELECT id, count(*) AS n, regr_slope(value, i) AS b, regr_intercept(value, i) AS a, avg(i) AS mi, regr_sxx(value, i) AS sxx, max(time) AS last_time FROM s GROUP BY id)"
SMOOTH = """ex AS (SELECT id, i, n, time, value, value AS f FROM s WHERE i = 0
  UNION ALL SELECT s.id, s.i, s.n, s.time, s.value, 0.3::DOUBLE * ex.value + 0.7::DOUBLE * ex.f FROM ex JOIN s ON s.id = ex.id AND s.i = ex.i + 1),"""
EMA = """em AS (SELECT id, i, value AS e FROM s WHERE i = 0
  UNION ALL SELECT s.id, s.i, 0.3::DOUBLE * s.value + 0.7::DOUBLE * em.e FROM em JOIN s ON s.id = em.id AND s.i = em.i + 1)"""
AGAIN = f"{USER}, x AS (SELECT *, time AS ins FROM u UNION ALL SELECT id, time, value + 1, seq, time + INTERVAL 1 HOUR FROM u WHERE seq % 7 = 0)"
FLAT = "u AS (SELECT event_type AS id, ts AS time, CASE WHEN event_type IN ('click', 'view') THEN 0.1 ELSE value END::DOUBLE AS value, event_id AS seq FROM events)"
_LTTB_CTES, _LTTB = lttb(120)
_AUTO_CTES, _AUTO = lttb(150, "(SELECT s.* FROM s JOIN mo USING (id) WHERE mode = 'lttb')")
_PICKED = lambda m: f"(SELECT s.* FROM s JOIN mo USING (id) WHERE mode = '{m}')"
_CHOSEN = lambda c: f"(SELECT s.* FROM s JOIN ch USING (id) WHERE choice = '{c}')"

# what a store keeps: the last write of a moment
KEPT = "k AS (SELECT user_id::VARCHAR AS id, ts AS time, value, event_type AS kind, value > 50 AS large FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)"
ASKED = "(" + ", ".join(f"'{k}'" for k in range(1, 21)) + ")"
TYPE_KEPT = "u AS (SELECT event_type AS id, ts AS time, value, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id DESC) = 1)"
THRESHOLD = "th AS (SELECT CASE WHEN count(*) <= 1000 THEN count(*) WHEN count(*) <= 10000 THEN 1000 WHEN count(*) <= 100000 THEN 2000 ELSE least(count(*) // 20, 5000) END AS t FROM u)"


def by_threshold(per: int, rest: str) -> str:
    """A downsampling whose threshold follows from the number of points of all devices."""
    return f"WITH {TYPE_KEPT}, {SERIES}, {THRESHOLD}, {bucketed('(SELECT t FROM th)', f'(SELECT greatest(1, t // {per}) FROM th)')} {rest}"


def fnv1a(text: str) -> str:
    """FNV-1a with 32 bits, letter by letter; the letters are ASCII."""
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619::BIGINT) % 4294967296)"


def levels(base: str, field: str = "'value'") -> str:
    """All levels of rollups, one after the other."""
    units = {"1h": "hour", "1d": "day", "1M": "month", "1y": "year"}
    return " UNION ALL ".join(f"SELECT *, '{k}' AS level FROM ({rolled(base, f"date_trunc('{u}', time)::TIMESTAMP", field, places=8)})" for k, u in units.items())


KEPT_LONG = f"{KEPT}, u AS (SELECT id, time, 'value' AS field, value FROM k UNION ALL SELECT id, time, 'twice', 2 * value FROM k)"
EXPORTED = f"WITH {KEPT} SELECT id, strftime(time, '%Y-%m-%dT%H:%M:%SZ') AS time, value, 2 * value AS twice, kind, large FROM k WHERE id IN {ASKED}"

# level, slope and a ring of 24 seasons, point by point
WINTERS = """w0 AS (SELECT *, list_reduce(v, lambda x, y: x + y) / 24 AS l FROM (SELECT id, (max(value) FILTER (i = 24) - max(value) FILTER (i = 0)) / 24 AS b, list(value ORDER BY i) FILTER (i < 24) AS v FROM s GROUP BY id)),
hw AS (SELECT id, 0::BIGINT AS i, l, b, list_transform(v, lambda x: x / l) AS ring, pow(v[1] - l * (v[1] / l), 2) AS sse FROM w0
  UNION ALL
  SELECT id, i, l2, 0.1::DOUBLE * (l2 - l) + 0.9::DOUBLE * b, list_transform(ring, lambda x, k: CASE WHEN k <> i % 24 + 1 THEN x WHEN l2 = 0 THEN z ELSE 0.1::DOUBLE * value / l2 + 0.9::DOUBLE * z END), sse + pow(value - (l + b) * z, 2)
  FROM (SELECT *, 0.3::DOUBLE * value / z + 0.7::DOUBLE * (l + b) AS l2 FROM (SELECT s.id, s.i, s.value, l, b, ring, sse, coalesce(nullif(ring[s.i % 24 + 1], 0), 1) AS z FROM hw JOIN s ON s.id = hw.id AND s.i = hw.i + 1))),"""
WINTERS_FIT = "SELECT hw.id, s.n, l, b, ring, s.time AS last_time, sqrt(sse / (s.n - 1)) AS se FROM hw JOIN s ON s.id = hw.id AND s.i = hw.i WHERE s.i = s.n - 1"

# autoregressive weights of the differences by Levinson's recursion, moving-average weights from what they leave
ARIMA = """d AS (SELECT id, i - 1 AS t, value - lag(value) OVER (PARTITION BY id ORDER BY i) AS y FROM s QUALIFY i > 0),
dc AS (SELECT id, t, y - avg(y) OVER (PARTITION BY id) AS c FROM d),
dr AS (SELECT id, sum(c * c1) / sum(c * c) AS r1, sum(c * c2) / sum(c * c) AS r2 FROM (SELECT *, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM dc WINDOW w AS (PARTITION BY id ORDER BY t)) GROUP BY id),
ph AS (SELECT id, r1 - (r2 - r1 * r1) / (1 - r1 * r1) * r1 AS p1, (r2 - r1 * r1) / (1 - r1 * r1) AS p2 FROM dr),
au AS (SELECT id, t, y, p1, p2, p1 * lag(y) OVER w + p2 * lag(y, 2) OVER w AS a FROM d JOIN ph USING (id) WINDOW w AS (PARTITION BY id ORDER BY t)),
ec AS (SELECT id, t, y - a - avg(y - a) OVER (PARTITION BY id) AS c FROM au WHERE t >= 2),
th AS (SELECT id, 0.5::DOUBLE * sum(c * c1) / sum(c * c) AS q1, 0.5::DOUBLE * sum(c * c2) / sum(c * c) AS q2 FROM (SELECT *, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM ec WINDOW w AS (PARTITION BY id ORDER BY t)) GROUP BY id),
ep AS (SELECT id, 1::BIGINT AS t, 0::DOUBLE AS e, 0::DOUBLE AS e1 FROM ph
  UNION ALL SELECT au.id, au.t, au.y - (au.a + q1 * ep.e + q2 * ep.e1), ep.e FROM ep JOIN au ON au.id = ep.id AND au.t = ep.t + 1 JOIN th ON th.id = ep.id),
rs AS (SELECT id, stddev_pop(r) AS se FROM (SELECT id, e AS r FROM ep WHERE t > 1 UNION ALL SELECT id, y FROM d WHERE t < 2) WHERE r <> 0 GROUP BY id),
ft AS (SELECT au.id, 0 AS h, y AS y0, lag(y) OVER (PARTITION BY au.id ORDER BY au.t) AS y1, 0::DOUBLE AS total FROM au QUALIFY row_number() OVER (PARTITION BY au.id ORDER BY au.t DESC) = 1
  UNION ALL SELECT id, h, nxt, y0, total + nxt FROM (SELECT ft.id, ft.h + 1 AS h, ft.y0, ft.total,
    p1 * y0 + p2 * y1 + CASE ft.h WHEN 0 THEN q1 * e + q2 * e1 WHEN 1 THEN q2 * e ELSE 0 END AS nxt
    FROM ft JOIN ph ON ph.id = ft.id JOIN th ON th.id = ft.id JOIN (SELECT id, arg_max(e, t) AS e, arg_max(e1, t) AS e1 FROM ep GROUP BY id) AS le ON le.id = ft.id WHERE ft.h < 24)),
la AS (SELECT id, arg_max(value, i) AS v, max(time) AS last_time FROM s GROUP BY id)"""


SQL = {
    "stored_rollups": levels(KEPT_LONG, "field"),
    "stream_rollups": levels(USER),
    "compaction": f"WITH {AGAIN} SELECT id, epoch_us(time) AS time_us, value, seq FROM x QUALIFY row_number() OVER (PARTITION BY id, time ORDER BY ins DESC, seq DESC) = 1",
    "compaction_rollup": rolled(KEPT_LONG, "date_trunc('hour', time)", "field", places=8),
    "partition_stats": "SELECT ts::DATE::VARCHAR AS local_date, count(*) AS rows, true AS has_files FROM events GROUP BY ALL",
    "retention": "SELECT ts::DATE::VARCHAR AS local_date, count(*) AS rows, true AS has_files FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL",
    "export_csv": EXPORTED,
    "export_json": EXPORTED,
    "present": f"""WITH {KEPT} SELECT id, count(*) AS points, md5(string_agg(strftime(time, '%Y-%m-%dT%H:%M:%SZ'), ',' ORDER BY time)) AS times_md5, md5(string_agg(kind, ',' ORDER BY time)) AS kinds_md5, round(sum(value), 4) AS total
      FROM k WHERE id IN {ASKED} GROUP BY id""",
    "json_points": "SELECT user_id::VARCHAR AS id, CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) END AS time_us, value, event_type AS kind FROM events",
    "catalog_devices": "SELECT DISTINCT user_id::VARCHAR AS id FROM events",
    "stream_windows": f"""WITH {USER}, b AS (SELECT id, time_bucket(INTERVAL 6 HOUR, time, TIMESTAMP '2024-01-01') AS bucket, value FROM u)
      SELECT id, epoch_us(bucket) AS bucket_us, count(*) AS count, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max FROM b
      WHERE bucket + INTERVAL 6 HOUR <= (SELECT max(time) - INTERVAL 1 HOUR FROM u) GROUP BY id, bucket""",
    "stream_sessions": f"""WITH {USER}, g AS (SELECT *, coalesce(time - lag(time) OVER (PARTITION BY id ORDER BY time) >= INTERVAL 12 HOUR, true)::INT AS fresh FROM u),
      n AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY time) AS k FROM g)
      SELECT id, epoch_us(min(time)) AS start_us, epoch_us(max(time) + INTERVAL 12 HOUR) AS end_us, count(*) AS count, round(sum(value), 6) AS sum FROM n
      GROUP BY id, k HAVING max(time) + INTERVAL 12 HOUR <= (SELECT max(time) - INTERVAL 1 HOUR FROM u)""",
    "downsample_query": f"""WITH w AS (SELECT l_suppkey::VARCHAR AS id, l_shipdate::TIMESTAMP + to_microseconds(l_orderkey * 10 + l_linenumber) AS time, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount FROM lineitem),
      u AS (SELECT id, time, seq, discount AS value FROM w), {SERIES}, {bucketed(20, 10)},
      c AS (SELECT DISTINCT id, time_us FROM ({extremes(False)})), l AS (SELECT id, time, field, value FROM (UNPIVOT w ON quantity, price, discount INTO NAME field VALUE value))
      SELECT l.id, epoch_us(l.time) AS time_us, field, value FROM l JOIN c ON c.id = l.id AND c.time_us = epoch_us(l.time)""",
    "forecast_holt_winters": ahead(WINTERS_FIT, "coalesce(nullif(ring[(n - 24 + (n + h - 1) % 24) % 24 + 1], 0), 1) * (l + h * b)", "se * sqrt(h)", "holt_winters", WINTERS).replace("WITH ", "WITH RECURSIVE ", 1),
    "forecast_arima": f"""WITH RECURSIVE {TYPE}, {SERIES}, {ARIMA}
      SELECT ft.id, h::INT AS h, epoch_us(last_time) + h * 3600000000 AS time_us, round(v + total, 6) AS value, round(v + total - 1.96 * se * sqrt(h), 6) AS lower, round(v + total + 1.96 * se * sqrt(h), 6) AS upper, 'arima' AS algorithm
      FROM ft JOIN la ON la.id = ft.id JOIN rs ON rs.id = ft.id WHERE h > 0""",
    "query_mixed_fields": f"WITH {KEPT} SELECT id, epoch_us(time) AS time_us, kind, value, large, NULL::DOUBLE AS absent FROM k WHERE id IN {ASKED} QUALIFY row_number() OVER (ORDER BY id, time) <= 400",
    "query_limit_rollup": f"WITH {KEPT} SELECT id, epoch_us(date_trunc('hour', time)) AS time_us, max(2 * value) AS twice, max(value) AS value FROM k WHERE id IN {ASKED} AND date_trunc('hour', time) BETWEEN {START} AND {END} GROUP BY ALL ORDER BY id, time_us LIMIT 25",
    "query_auto_threshold_minmax": by_threshold(2, extremes(False).replace("round(value, 6)", "value")),
    "query_auto_threshold_m4": by_threshold(4, extremes(True).replace("round(value, 6)", "value")),
    "query_auto_threshold_avg": by_threshold(1, f"SELECT u.id, epoch_us(u.time) AS time_us, u.value FROM u JOIN ({averages()}) AS a ON a.id = u.id AND a.time_us = epoch_us(u.time)"),
    "chunk_points": f"WITH {KEPT} SELECT id, epoch_us(time) AS time_us, (row_number() OVER (ORDER BY id, time) - 1) // 50 AS chunk, kind, value, 2 * value AS twice, large FROM k WHERE id IN {ASKED} AND time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-30'",
    "project_fields_whole": "SELECT l_suppkey::VARCHAR AS id, epoch_us(l_shipdate) AS time_us, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS quantity, NULL::DOUBLE AS absent FROM lineitem",
    "chunk_by_interval_whole": f"WITH {USER} SELECT floor((epoch_us(time) - epoch_us({START})) / 21600000000)::BIGINT AS chunk, count(*) AS points, min(epoch_us(time)) AS first_us FROM u GROUP BY ALL",
    "rollup_metric_whole": f"""WITH {USER}, b AS (SELECT id, date_trunc('hour', time) AS bucket, time, value, max(value) OVER (PARTITION BY id, date_trunc('hour', time)) AS hi FROM u)
      SELECT id, epoch_us(bucket) AS time_us, (epoch_us(min(time) FILTER (value = hi)) // 1000)::DOUBLE AS value FROM b GROUP BY id, bucket""",
    "group_routing": f"WITH {USER} SELECT id, {fnv1a("'db:events:' || id")} AS hash, ({fnv1a("'db:events:' || id")} % 256)::INT AS group_id FROM (SELECT DISTINCT id FROM u)",
    "checksum": """WITH h AS (SELECT sha256(user_id::VARCHAR || '|' || epoch_us(ts)::VARCHAR || '|value=' || value::VARCHAR) AS x FROM events),
      t AS (SELECT count(*) AS points, (sum(('0x' || x[1:8])::BIGINT) % 4294967296)::BIGINT AS a, (sum(('0x' || x[9:16])::BIGINT) % 4294967296)::BIGINT AS b FROM h)
      SELECT printf('%08x%08x', a, b) AS checksum, points FROM t""",
    "scan_range": f"WITH {USER} SELECT id, epoch_us(time) AS time_us, value FROM u WHERE time BETWEEN {START} AND {END}",
    "scan_devices": f"WITH {USER} SELECT id, epoch_us(time) AS time_us, value FROM u WHERE time BETWEEN {START} AND {END} AND id IN ('1', '3', '7')",
    "project_fields": "SELECT l_suppkey::VARCHAR AS id, epoch_us(l_shipdate) AS time_us, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS quantity, NULL::DOUBLE AS absent FROM lineitem WHERE l_suppkey IN (1, 2)",
    "predicate_filter": "SELECT l_suppkey::VARCHAR AS id, epoch_us(l_shipdate) AS time_us, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS quantity, l_discount AS discount FROM lineitem WHERE l_quantity >= 49 AND l_discount < 0.02 AND l_extendedprice IS NOT NULL",
    "gap_fill": f"""WITH {USER}, h AS (SELECT id, date_trunc('hour', time) AS b, count(*) AS c, avg(value) AS v FROM u GROUP BY ALL),
      e AS (SELECT id, unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM h GROUP BY id)
      SELECT id, epoch_us(b) AS bucket_us, coalesce(c, 0) AS count, round(last_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY b), 6) AS value FROM e LEFT JOIN h USING (id, b)""",
    "gap_fill_5m": f"""WITH {TYPE}, h AS (SELECT id, time_bucket(INTERVAL 5 MINUTE, time) AS b, count(*) AS c, avg(value) AS v FROM u GROUP BY ALL),
      e AS (SELECT id, unnest(generate_series(min(b), max(b), INTERVAL 5 MINUTE)) AS b FROM h GROUP BY id)
      SELECT id, epoch_us(b) AS bucket_us, coalesce(c, 0) AS count, round(v, 6) AS value FROM e LEFT JOIN h USING (id, b)""",
    "device_list": f"WITH {USER} SELECT DISTINCT id FROM u",
    "unpivot_long": f"WITH {SHIP} SELECT id, field, count(*) AS points, round(sum(value), 4) AS total FROM u WHERE field IN ('quantity', 'discount') GROUP BY id, field",
    "dedup_lww": f"WITH {AGAIN} SELECT id, epoch_us(time) AS time_us, value, seq FROM x QUALIFY row_number() OVER (PARTITION BY id, time ORDER BY ins DESC, seq DESC) = 1",
    "merge_tiers": f"WITH {AGAIN} SELECT id, epoch_us(time) AS time_us, value, seq FROM x QUALIFY row_number() OVER (PARTITION BY id, time ORDER BY ins DESC, seq DESC) = 1",
    "merge_overlay": f"""WITH {USER}, x AS (SELECT id, time, time AS ins, seq, value AS a, NULL::DOUBLE AS b FROM u
      UNION ALL SELECT id, time, time + INTERVAL 1 HOUR, seq, CASE WHEN seq % 2 = 0 THEN value * 2 END, value FROM u WHERE seq % 3 = 0)
      SELECT id, epoch_us(time) AS time_us, arg_max(a, (ins, seq)) FILTER (a IS NOT NULL) AS a, arg_max(b, (ins, seq)) FILTER (b IS NOT NULL) AS b FROM x GROUP BY id, time""",
    "limit_global": f"WITH {USER} SELECT id, epoch_us(time) AS time_us, value, seq FROM u QUALIFY row_number() OVER (ORDER BY id, time, seq) <= 100",
    "rollup_1h": rolled(USER, "date_trunc('hour', time)"),
    "rollup_1d": rolled(USER, "date_trunc('day', time)::TIMESTAMP"),
    "rollup_1mo": rolled(ORDERS, "date_trunc('month', time)::TIMESTAMP", "field", places=8),
    "rollup_1y": rolled(SHIP, "date_trunc('year', time)::TIMESTAMP", "field", places=8),
    "rollup_1d_tokyo": rolled(USER, "date_trunc('day', time + INTERVAL 9 HOUR)::TIMESTAMP - INTERVAL 9 HOUR"),
    "rollup_1h_gaps": rolled(USER, "date_trunc('hour', time)", where="seq % 10 <> 0 AND seq % 31 <> 0"),
    "rollup_cascade_1d": rolled(USER, "date_trunc('day', time)::TIMESTAMP"),
    "rollup_cascade_1y": rolled(ORDERS, "date_trunc('year', time)::TIMESTAMP", "field"),
    "rollup_scan_metric": f"""WITH {USER}, b AS (SELECT id, date_trunc('hour', time) AS bucket, time, value, max(value) OVER (PARTITION BY id, date_trunc('hour', time)) AS hi FROM u)
      SELECT id, epoch_us(bucket) AS time_us, (epoch_us(min(time) FILTER (value = hi)) // 1000)::DOUBLE AS value FROM b WHERE id IN ('1', '2', '3') AND bucket BETWEEN {START} AND {END} GROUP BY id, bucket""",
    "variance_rollup": f"WITH {USER} SELECT id, epoch_us(date_trunc('day', time)::TIMESTAMP) AS bucket_us, count(*) AS count, round(var_pop(value), 6) AS variance FROM u GROUP BY ALL",
    "stats_profile": f"""WITH {TYPE}, {SERIES}, {POPULATION} SELECT s.id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev_samp, round(stddev_pop(value), 6) AS stddev_pop,
      round(any_value(skew), 6) AS skewness, round(any_value(kurt), 6) AS kurtosis, min(value) AS min, max(value) AS max FROM s JOIN k USING (id) GROUP BY s.id""",
    "iqr_bounds": f"WITH {USER} SELECT id, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM u GROUP BY id",
    "mad": f"WITH {USER}, m AS (SELECT id, quantile_cont(value, 0.5) AS median FROM u GROUP BY id) SELECT id, round(any_value(median), 6) AS median, round(quantile_cont(abs(value - median), 0.5), 6) AS mad FROM u JOIN m USING (id) GROUP BY id",
    "trend_fit": f"WITH {TYPE}, {SERIES}, {TREND} SELECT id, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(r, 6) AS r, round(CASE WHEN slope > 0 THEN r2 ELSE -r2 END, 6) AS strength FROM t",
    "autocorrelation": f"""WITH {TYPE}, {SERIES}, x AS (SELECT *, value - avg(value) OVER (PARTITION BY id) AS d FROM s), y AS (SELECT *, lag(d, 24) OVER (PARTITION BY id ORDER BY i) AS e FROM x)
      SELECT id, any_value(n) AS n, round(sum(d * e) FILTER (i >= 24) / sum(d * d) FILTER (i >= 24), 6) AS autocorrelation FROM y GROUP BY id""",
    "acf": f"""WITH {TYPE}, {SERIES}, x AS (SELECT *, value - avg(value) OVER (PARTITION BY id) AS d FROM s)
      SELECT a.id, k::INT AS lag, round(sum(a.d * b.d) / any_value(t.q), 6) AS acf FROM x AS a, range(1, 4) AS r(k), x AS b, (SELECT id, sum(d * d) AS q FROM x GROUP BY id) AS t WHERE a.id = b.id AND b.i = a.i - k AND t.id = a.id GROUP BY a.id, k""",
    "moving_average": f"WITH {TYPE}, {SERIES} SELECT id, epoch_us(time) AS time_us, i, round(avg(value) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS moving_average FROM s",
    "trailing_average": f"WITH {TYPE}, {SERIES} SELECT id, epoch_us(time) AS time_us, i, round(avg(value) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM s",
    "ema": f"WITH RECURSIVE {USER}, {SERIES}, {EMA} SELECT id, i, round(e, 6) AS ema FROM em",
    "difference": f"WITH {TYPE}, {SERIES} SELECT id, i, round(value, 6) AS value FROM (SELECT id, i, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS value FROM s WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE value IS NOT NULL",
    "anomaly_zscore": f"WITH {TYPE}, {SERIES} {zscore(1.5)}",
    "anomaly_flatline": f"WITH {FLAT}, {SERIES} {zscore(1.6)}",
    "anomaly_iqr": f"WITH {TYPE}, {SERIES}, {Q} {fences(1.5)}",
    "anomaly_moving_avg": f"WITH {TYPE}, {SERIES} {local(3.0)}",
    "anomaly_auto": f"""WITH {TYPE}, {SERIES}, {Q}, {POPULATION}, {TREND}, o AS (SELECT s.id, 100.0 * count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*) AS share FROM s JOIN q USING (id) GROUP BY s.id),
      ch AS (SELECT id, CASE WHEN share > 5 THEN 'iqr' WHEN r2 > 0.1 AND r2 > 0.3 THEN 'moving_avg' WHEN t.n >= 10 AND abs(skew) < 1 AND abs(kurt) < 2 THEN 'zscore' ELSE 'iqr' END AS choice FROM o JOIN t USING (id) JOIN k USING (id))
      {zscore(1.6, _CHOSEN('zscore'))} UNION ALL {fences(1.6, _CHOSEN('iqr'))} UNION ALL {local(1.6, _CHOSEN('moving_avg'))}""",
    "downsample_minmax": f"WITH {TYPE}, {SERIES}, {bucketed(98, 49)} {extremes(False)}",
    "downsample_minmax_exact": f"WITH {TYPE}, {SERIES}, bk AS (SELECT *, n <= 98 AS whole, CASE WHEN n > 98 THEN ((i + 1) * 49 - 1) // n END AS b FROM s) {extremes(False)}",
    "downsample_avg": f"WITH {TYPE}, {SERIES}, {bucketed(97, 97)} {averages()}",
    "downsample_m4": f"WITH {TYPE}, {SERIES}, {bucketed(100, 25)} {extremes(True)}",
    "downsample_lttb": f"WITH RECURSIVE {TYPE}, {SERIES}, {_LTTB_CTES} {_LTTB}",
    "downsample_auto": f"""WITH RECURSIVE {TYPE}, {SERIES}, {SPIKY}, {bucketed(150, 75, _PICKED('minmax'), 'bm')}, {bucketed(150, 150, _PICKED('avg'), 'ba')}, {bucketed(150, 37, _PICKED('m4'), 'b4')}, {_AUTO_CTES}
      {extremes(False, 'bm')} UNION ALL {averages('ba')} UNION ALL {extremes(True, 'b4')} UNION ALL {_AUTO}""",
    "spikiness": f"WITH {TYPE}, {SERIES}, {SPIKY} SELECT id, n, round(spikiness, 6) AS spikiness, mode FROM mo",
    "time_aligned_pick": f"WITH {USER} SELECT id, epoch_us(time) AS time_us, value FROM u WHERE (id, time) IN (SELECT (id, time) FROM u WHERE seq % 11 = 0) QUALIFY row_number() OVER (PARTITION BY id, time ORDER BY seq) = 1",
    "master_field": f"WITH {SHIP} SELECT id, field, count(*) AS points FROM u WHERE field = 'discount' GROUP BY id, field",
    "forecast_sma": ahead("SELECT id, max(time) AS last_time, arg_max(fitted, i) AS v, sqrt(sum((value - fitted) * (value - fitted)) / (count(*) - 1)) AS se FROM sm GROUP BY id", "v", "se", "sma", SMA + ","),
    "forecast_linear": ahead("SELECT li.id, any_value(li.n) AS n, any_value(a) AS a, any_value(b) AS b, any_value(mi) AS mi, any_value(sxx) AS sxx, any_value(last_time) AS last_time, sqrt(sum(pow(value - (a + b * i), 2)) / (count(*) - 2)) AS se FROM s JOIN li USING (id) GROUP BY li.id", "a + b * (n + h - 1)", "se * sqrt(1 + 1 / n + pow(n + h - 1 - mi, 2) / sxx)", "linear", LINE + ","),
    "forecast_exponential": ahead("SELECT id, max(time) AS last_time, arg_max(0.3::DOUBLE * value + 0.7::DOUBLE * f, i) AS v, sqrt(sum((value - f) * (value - f)) / (count(*) - 1)) AS se FROM ex GROUP BY id", "v", "se * sqrt(h)", "exponential", SMOOTH).replace("WITH ", "WITH RECURSIVE ", 1),
    "forecast_accuracy": f"""WITH {TYPE}, {SERIES}, {SMA}, {LINE}, f AS (SELECT id, 'sma' AS algorithm, value, fitted FROM sm UNION ALL SELECT s.id, 'linear', value, a + b * i FROM s JOIN li USING (id))
      SELECT id, algorithm, round(coalesce(100 * avg(abs((value - fitted) / value)) FILTER (value <> 0), 0), 6) AS mape, round(avg(abs(value - fitted)), 6) AS mae, round(sqrt(avg(pow(value - fitted, 2))), 6) AS rmse, count(*) AS data_points FROM f GROUP BY id, algorithm""",
    "chunk_by_size": f"WITH {USER} SELECT id, epoch_us(time) AS time_us, seq, (row_number() OVER (ORDER BY id, time, seq) - 1) // 500 AS chunk FROM u",
    "chunk_by_devices": f"WITH {USER}, t AS (SELECT id, count(*) AS points FROM u GROUP BY id) SELECT coalesce(sum(points) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 500 AS chunk, id, points FROM t",
    "chunk_by_interval": f"WITH {USER} SELECT (epoch_us(time) - epoch_us({START})) // 21600000000 AS chunk, count(*) AS points, min(epoch_us(time)) AS first_us FROM u WHERE time BETWEEN {START} AND {END} GROUP BY ALL",
    "checksum_light": f"WITH {USER} SELECT count(*) || ':' || epoch_us(min(time)) // 1000 || ':' || epoch_us(max(time)) // 1000 AS checksum FROM u",
    "last_timestamp": "SELECT epoch_us(max(ts)) AS last_time_us FROM events",
    "first_data_date": "SELECT min(ts)::DATE::VARCHAR AS first_date FROM events",
    "point_count": "SELECT count(*) AS points, count(DISTINCT user_id) AS devices FROM events",
    "replica_repair": f"""WITH {AGAIN} SELECT id, epoch_us(time) AS time_us, value, seq FROM x WHERE seq % 5 = 0 OR ins > time
      QUALIFY row_number() OVER (PARTITION BY id, time ORDER BY ins DESC, seq DESC) = 1""",
    "replica_compare": f"WITH {USER} SELECT id::INT % 8 AS group_id, count(*) AS count_mine, nullif(count(*) FILTER (seq % 97 <> 0 OR id = '1'), 0) AS count_theirs FROM u GROUP BY ALL HAVING count(*) FILTER (seq % 97 = 0 AND id <> '1') > 0",
    "stream_rollup_1h": rolled(USER, "date_trunc('hour', time)"),
}

_CHOICE = f"""WITH {TYPE}, {SERIES}, {TREND}, x AS (SELECT *, value - avg(value) OVER (PARTITION BY id) AS d FROM s), y AS (SELECT *, lag(d, 24) OVER (PARTITION BY id ORDER BY i) AS e FROM x),
c AS (SELECT id, sum(d * e) FILTER (i >= 24) / sum(d * d) FILTER (i >= 24) AS rho FROM y GROUP BY id)
SELECT id, CASE WHEN n >= 48 AND rho > 0.5 THEN 'holt_winters' WHEN n >= 5 AND abs(r) > 0.5 THEN 'linear' WHEN n >= 20 THEN 'exponential' ELSE 'sma' END AS choice FROM t JOIN c USING (id)"""
SQL["forecast_auto"] = " UNION ALL ".join(f"SELECT a.* REPLACE (algorithm || ' (auto-selected)' AS algorithm) FROM ({SQL[f'forecast_{m}']}) AS a JOIN ({_CHOICE}) AS c ON c.id = a.id AND c.choice = '{m}'" for m in ("holt_winters", "linear", "exponential", "sma"))
