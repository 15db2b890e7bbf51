"""DuckDB SQL twins of the registered queries (tables are pre-registered views)."""

from __future__ import annotations

# events -> check-ins, with the 3-hour bin (epoch-aligned, left-closed)
CHECKINS = """
ck AS (
  SELECT user_id,
         CAST(json_extract(props, '$.k') AS BIGINT) AS venue_id,
         'r' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS region,
         ts, event_id AS seq,
         time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') AS t
  FROM events
  WHERE event_type <> 'error'
)"""

CELL_USER = """
cu AS (
  SELECT t, region, user_id, count(venue_id) AS v, count(*) AS n
  FROM ck WHERE user_id IS NOT NULL AND t IS NOT NULL AND region IS NOT NULL
  GROUP BY t, region, user_id
),
ut AS (
  SELECT user_id, count(venue_id) AS tot
  FROM ck WHERE user_id IS NOT NULL AND t IS NOT NULL AND region IS NOT NULL
  GROUP BY user_id
),
stats AS (
  SELECT cu.t, cu.region, count(*) AS visitor_count, CAST(sum(cu.n) AS BIGINT) AS obs_freq,
         coalesce(sum(CASE WHEN v > 0 AND tot > 0 THEN -(v::DOUBLE / tot) * log2(v::DOUBLE / tot) END), 0.0) + 0.0 AS visitor_entropy
  FROM cu JOIN ut USING (user_id)
  GROUP BY cu.t, cu.region
)"""

FIRST_VISITS = """
uvr AS (
  SELECT user_id, venue_id, ts, t, region,
         row_number() OVER (PARTITION BY user_id, venue_id ORDER BY ts, seq) AS rn,
         count(*) OVER (PARTITION BY user_id, venue_id) AS n
  FROM ck WHERE user_id IS NOT NULL AND venue_id IS NOT NULL AND t IS NOT NULL AND region IS NOT NULL
),
topv AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, venue_id ASC) AS rk
  FROM uvr WHERE rn = 1
),
fvc AS (
  SELECT t, region, count(*) AS first_visits FROM topv WHERE rk <= 4 GROUP BY t, region
)"""

GRID = """
bounds AS (SELECT min(t) AS lo, max(t) AS hi FROM ck WHERE region IS NOT NULL),
regs AS (SELECT DISTINCT region FROM ck WHERE t IS NOT NULL AND region IS NOT NULL),
grid AS (
  SELECT unnest(generate_series(lo, hi, INTERVAL '3 hours')) AS t, region FROM bounds, regs
)"""

FEATURE_MATRIX_BODY = """
fm AS (
  SELECT g.t, g.region,
         coalesce(s.visitor_count, 0) AS visitor_count,
         coalesce(s.obs_freq, 0) AS obs_freq,
         coalesce(s.visitor_entropy, 0.0) AS visitor_entropy,
         coalesce(coalesce(f.first_visits, 0)::DOUBLE / nullif(coalesce(s.obs_freq, 0), 0), 0.0) AS visitor_ratio,
         coalesce(coalesce(s.obs_freq, 0)::DOUBLE
                  / nullif(sum(coalesce(s.obs_freq, 0)) OVER (PARTITION BY g.t), 0), 0.0) AS region_popularity
  FROM grid g LEFT JOIN stats s ON g.t = s.t AND g.region = s.region
              LEFT JOIN fvc f ON g.t = f.t AND g.region = f.region
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


FM_COLS = """t, region, visitor_count, obs_freq, round(visitor_entropy, 6) AS visitor_entropy,
       round(visitor_ratio, 6) AS visitor_ratio, round(region_popularity, 6) AS region_popularity"""

SQL: dict[str, str] = {}

SQL["interval_spine"] = with_(CHECKINS, GRID) + """
, cnt AS (SELECT t, count(user_id) AS n FROM ck GROUP BY t),
spine AS (SELECT unnest(generate_series(lo, hi, INTERVAL '3 hours')) AS t FROM bounds)
SELECT spine.t, coalesce(cnt.n, 0) AS n FROM spine LEFT JOIN cnt ON spine.t = cnt.t
"""

SQL["obs_freq"] = with_(CHECKINS) + """
SELECT t, region, count(user_id) AS obs_freq FROM ck WHERE t IS NOT NULL AND region IS NOT NULL GROUP BY t, region
"""

SQL["visitor_count"] = with_(CHECKINS) + """
SELECT t, region, count(DISTINCT user_id) AS visitor_count FROM ck WHERE t IS NOT NULL AND region IS NOT NULL GROUP BY t, region
"""

SQL["user_cell_visits"] = with_(CHECKINS, CELL_USER) + """
SELECT t, region, user_id, v AS reg_time_visits FROM cu
"""

SQL["user_totals"] = with_(CHECKINS, CELL_USER) + """
SELECT user_id, tot AS total_visits FROM ut
"""

SQL["visit_probability"] = with_(CHECKINS, CELL_USER) + """
SELECT t, region, user_id, v AS reg_time_visits, tot AS total_visits,
       round(v::DOUBLE / nullif(tot, 0), 6) AS probability
FROM cu JOIN ut USING (user_id)
"""

SQL["visitor_entropy"] = with_(CHECKINS, CELL_USER) + """
SELECT t, region, round(visitor_entropy, 6) AS visitor_entropy FROM stats
"""

SQL["region_popularity"] = with_(CHECKINS) + """
, o AS (SELECT t, region, count(user_id) AS obs_freq FROM ck WHERE t IS NOT NULL AND region IS NOT NULL GROUP BY t, region)
SELECT t, region, obs_freq,
       round(obs_freq::DOUBLE / nullif(sum(obs_freq) OVER (PARTITION BY t), 0), 6) AS region_popularity
FROM o
"""

SQL["user_venue_count"] = with_(CHECKINS) + """
SELECT user_id, venue_id, count(*) AS n FROM ck
WHERE user_id IS NOT NULL AND venue_id IS NOT NULL AND t IS NOT NULL AND region IS NOT NULL
GROUP BY user_id, venue_id
"""

SQL["top_venues"] = with_(CHECKINS) + """
, uv AS (SELECT user_id, venue_id, count(*) AS n FROM ck
         WHERE user_id IS NOT NULL AND venue_id IS NOT NULL AND t IS NOT NULL AND region IS NOT NULL
         GROUP BY user_id, venue_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, venue_id) AS INTEGER) AS rank FROM uv)
SELECT user_id, venue_id, n, rank FROM r WHERE rank <= 4
"""

SQL["first_visits"] = with_(CHECKINS, FIRST_VISITS) + """
SELECT user_id, venue_id, ts, t, region FROM topv WHERE rk <= 4
"""

SQL["visitor_ratio"] = with_(CHECKINS, FIRST_VISITS) + """
, o AS (SELECT t, region, count(user_id) AS obs_freq FROM ck WHERE t IS NOT NULL AND region IS NOT NULL GROUP BY t, region)
SELECT o.t, o.region, round(coalesce(f.first_visits, 0)::DOUBLE / nullif(o.obs_freq, 0), 6) AS visitor_ratio
FROM o LEFT JOIN fvc f ON o.t = f.t AND o.region = f.region
"""

SQL["densify_grid"] = with_(CHECKINS, GRID) + """
, o AS (SELECT t, region, count(user_id) AS obs_freq FROM ck WHERE t IS NOT NULL AND region IS NOT NULL GROUP BY t, region)
SELECT g.t, g.region, coalesce(o.obs_freq, 0) AS obs_freq FROM grid g LEFT JOIN o ON g.t = o.t AND g.region = o.region
"""

SQL["feature_matrix"] = with_(CHECKINS, CELL_USER, FIRST_VISITS, GRID, FEATURE_MATRIX_BODY) + f"""
SELECT {FM_COLS} FROM fm
"""

_NATION_CHECKINS = """
ck AS (
  SELECT o.o_custkey AS user_id, l.l_suppkey AS venue_id, n.n_name AS region, l.l_shipdate AS ts,
         l.l_orderkey * 8 + l.l_linenumber AS seq,
         time_bucket(INTERVAL '7 days', l.l_shipdate, TIMESTAMP '1970-01-01') AS t
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey
       JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""

SQL["feature_matrix_nations"] = (
    with_(_NATION_CHECKINS, CELL_USER, FIRST_VISITS, GRID.replace("3 hours", "7 days"), FEATURE_MATRIX_BODY)
    + f"SELECT {FM_COLS} FROM fm\n"
)

SQL["low_activity_filter"] = with_(CHECKINS, CELL_USER, FIRST_VISITS, GRID, FEATURE_MATRIX_BODY) + f"""
, kt AS (SELECT t FROM fm GROUP BY t HAVING sum(obs_freq) >= 26),
kr AS (SELECT region FROM fm GROUP BY region HAVING sum(obs_freq) >= 775)
SELECT {FM_COLS} FROM fm WHERE t IN (SELECT t FROM kt) AND region IN (SELECT region FROM kr)
"""

SQL["feature_pivot"] = with_(CHECKINS) + """
, o AS (SELECT t, region, count(user_id) AS obs_freq FROM ck WHERE t IS NOT NULL AND region IS NOT NULL GROUP BY t, region)
SELECT t, """ + ", ".join(f"coalesce(max(CASE WHEN region = 'r{i}' THEN obs_freq END), 0) AS r{i}" for i in range(10)) + """
FROM o GROUP BY t
"""

SQL["region_one_hot"] = with_(CHECKINS) + """
SELECT seq, region, """ + ", ".join(f"CAST(CASE WHEN region = 'r{i}' THEN 1 ELSE 0 END AS INTEGER) AS r{i}" for i in range(10)) + """
FROM ck
"""


# ---------------------------------------------------------------- cleaning & IO

INC_TEXT = """
inc_text AS (
  SELECT event_id AS incident_id,
         CASE WHEN value < 1 THEN '13/13/2012' ELSE strftime(ts, '%m/%d/%Y') END AS date_text,
         CASE WHEN value > 300 THEN '24:00:00' ELSE strftime(ts, '%H:%M:%S') END AS time_text,
         CASE WHEN value > 50 THEN 'GRAND LARCENY' ELSE 'PETIT LARCENY' END AS offense,
         'r' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS region
  FROM events WHERE event_type = 'error'
),
parsed AS (
  SELECT *, CAST(try_strptime(date_text, '%m/%d/%Y') AS DATE) AS d0, try_strptime(time_text, '%H:%M:%S') AS tm
  FROM inc_text
),
inc_clean AS (
  SELECT incident_id, offense, region, d0 AS date,
         strptime(strftime(d0, '%Y-%m-%d') || ' ' || strftime(tm, '%H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts
  FROM parsed
  WHERE d0 IS NOT NULL AND year(d0) BETWEEN 1678 AND 2261 AND tm IS NOT NULL
)"""

SQL["parse_incident_time"] = with_(INC_TEXT) + "SELECT incident_id, ts, offense, region FROM inc_clean\n"

SQL["filter_date_range"] = with_(CHECKINS) + """
SELECT user_id, venue_id, region, ts, seq FROM ck
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
"""

SQL["filter_category"] = with_(INC_TEXT) + "SELECT incident_id, offense, region FROM inc_text WHERE offense = 'GRAND LARCENY'\n"

SQL["load_incidents"] = with_(INC_TEXT) + """
SELECT incident_id, ts, offense, region FROM inc_clean
WHERE offense = 'GRAND LARCENY' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
"""

SQL["load_checkins"] = with_(CHECKINS) + "SELECT user_id, venue_id, region, ts, seq FROM ck\n"
SQL["roundtrip_checkins"] = SQL["load_checkins"]

# ---------------------------------------------------------------- labels

INCIDENTS = """
inc AS (
  SELECT event_id AS incident_id, ts,
         'r' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS region,
         time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') AS t
  FROM events WHERE event_type = 'error' AND value > 50
),
cnt AS (SELECT t, region, count(*) AS n_incidents FROM inc WHERE t IS NOT NULL AND region IS NOT NULL GROUP BY t, region),
lab AS (SELECT t, region, CAST(least(n_incidents, 1) AS INTEGER) AS label FROM cnt)"""

KEPT = """
kt AS (SELECT t FROM fm GROUP BY t HAVING sum(obs_freq) >= 26),
kr AS (SELECT region FROM fm GROUP BY region HAVING sum(obs_freq) >= 775),
kept AS (SELECT * FROM fm WHERE t IN (SELECT t FROM kt) AND region IN (SELECT region FROM kr)),
aligned AS (
  SELECT k.*, coalesce(l.label, 0) AS label
  FROM kept k LEFT JOIN lab l ON k.t = l.t AND k.region = l.region AND l.label > 0
  WHERE k.t IN (SELECT DISTINCT t FROM lab)
)"""

SQL["incident_counts"] = with_(INCIDENTS) + "SELECT t, region, n_incidents FROM cnt\n"
SQL["binary_labels"] = with_(INCIDENTS) + "SELECT t, region, label FROM lab\n"
SQL["roundtrip_labels"] = SQL["binary_labels"]

_FM_ALIGN = with_(CHECKINS, CELL_USER, FIRST_VISITS, GRID, FEATURE_MATRIX_BODY, INCIDENTS, KEPT)

SQL["align_features_labels"] = _FM_ALIGN + f"SELECT {FM_COLS}, label FROM aligned\n"

SQL["percent_labeled"] = _FM_ALIGN + """
, kt2 AS (SELECT DISTINCT t FROM aligned),
nk AS (SELECT count(*) AS n FROM kt2),
pos AS (SELECT region, count(*) AS positives FROM lab WHERE label > 0 AND t IN (SELECT t FROM kt2) GROUP BY region),
regs2 AS (SELECT DISTINCT region FROM lab)
SELECT r.region, coalesce(p.positives, 0) AS positives,
       CAST(floor(coalesce(p.positives, 0) * 100 / nk.n::DOUBLE) AS INTEGER) AS percent,
       round(coalesce(p.positives, 0) * 100 / nk.n::DOUBLE, 6) AS percent_exact
FROM regs2 r LEFT JOIN pos p ON r.region = p.region, nk
"""

SQL["class_frequency"] = _FM_ALIGN + "SELECT region, label, count(*) AS n FROM aligned GROUP BY region, label\n"


# ---------------------------------------------------------------- geo

def _polygons_sql() -> str:
    from regionpulse.sources.testdata import CELL, ORIGIN, SHAPE_TEMPLATES

    vals = ", ".join(
        f"({s}, {r}, {v}, CAST({u!r} AS DOUBLE), CAST({w!r} AS DOUBLE))" for s, r, v, u, w in SHAPE_TEMPLATES
    )
    return f"""
tpl AS (SELECT * FROM (VALUES {vals}) AS v(shape, ring, vertex, u, w)),
verts AS (
  SELECT CAST(n_nationkey AS BIGINT) AS region_id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS county,
         'World' AS city, ring, vertex,
         CAST({ORIGIN!r} AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST({CELL!r} AS DOUBLE) + u * CAST({CELL!r} AS DOUBLE) AS x,
         CAST({ORIGIN!r} AS DOUBLE) + CAST(n_nationkey // 5 AS DOUBLE) * CAST({CELL!r} AS DOUBLE) + w * CAST({CELL!r} AS DOUBLE) AS y
  FROM nation JOIN tpl ON n_nationkey % 4 = shape
),
polys AS (SELECT DISTINCT region_id, name, county, city FROM verts),
nv AS (SELECT region_id, ring, count(*) AS nv FROM verts GROUP BY region_id, ring),
edges AS (
  SELECT a.region_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM verts a JOIN nv ON a.region_id = nv.region_id AND a.ring = nv.ring
       JOIN verts b ON b.region_id = a.region_id AND b.ring = a.ring AND b.vertex = (a.vertex + 1) % nv.nv
)"""


POLYGONS = _polygons_sql()

SQL["assign_region"] = with_(POLYGONS) + """
, pts AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings),
pe AS (
  SELECT p.point_id, e.region_id, e.x1, e.y1, e.x2, e.y2, p.lon, p.lat,
         (e.x2 - e.x1) * (p.lat - e.y1) - (p.lon - e.x1) * (e.y2 - e.y1) AS d
  FROM pts p, edges e
),
tests AS (
  SELECT point_id, region_id,
         sum(CASE WHEN ((y1 > lat) <> (y2 > lat)) AND ((d > 0) = (y2 > y1)) THEN 1 ELSE 0 END) AS crossings,
         bool_or(d = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge
  FROM pe GROUP BY point_id, region_id
),
hit AS (SELECT point_id, min(region_id) AS region_id FROM tests WHERE crossings % 2 = 1 AND NOT on_edge GROUP BY point_id)
SELECT p.point_id, p.lon, p.lat, h.region_id, polys.name AS region
FROM hit h JOIN pts p ON h.point_id = p.point_id JOIN polys ON polys.region_id = h.region_id
"""

SQL["filter_regions"] = with_(POLYGONS) + "SELECT region_id, name, county, city FROM polys WHERE city = 'World' AND county NOT IN ('4')\n"

SQL["apply_region_corrections"] = with_(POLYGONS) + """
SELECT region_id, CASE WHEN name = 'BRAZIL' AND county = '1' THEN 'BRAZIL SOUTH' ELSE name END AS name, county
FROM polys WHERE NOT (name = 'ALGERIA' AND county = '0')
"""

SQL["duplicate_regions"] = with_(POLYGONS) + """
SELECT r.r_name AS name, count(*) AS n FROM polys JOIN region r ON polys.county = CAST(r.r_regionkey AS VARCHAR)
GROUP BY r.r_name HAVING count(*) > 1
"""

SQL["load_regions"] = with_(POLYGONS) + """
, nr AS (SELECT region_id, count(DISTINCT ring) AS n_rings, count(*) AS n_vertices,
                round(sum(x), 6) AS sum_lon, round(sum(y), 6) AS sum_lat FROM verts GROUP BY region_id)
SELECT p.region_id, p.name, p.county, p.city, CAST(n_rings AS INTEGER) AS n_rings, CAST(n_vertices AS INTEGER) AS n_vertices, sum_lon, sum_lat
FROM polys p JOIN nr ON p.region_id = nr.region_id
"""

# ---------------------------------------------------------------- measures

ATTRS = """
attrs AS (
  SELECT DISTINCT 'r' || CAST(k % 10 AS VARCHAR) AS region, 1.0::DOUBLE + CAST(k % 10 AS DOUBLE) AS area,
         CAST(1000 * (k % 10 + 1) AS BIGINT) AS population
  FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
  WHERE k IS NOT NULL
),
venues AS (SELECT DISTINCT venue_id, region, venue_id % 7 AS category FROM ck)"""

DAILY = """
daily AS (SELECT region, CAST(ts AS DATE) AS day, count(*) AS n FROM inc GROUP BY region, CAST(ts AS DATE)),
trail AS (
  SELECT region, day, sum(n) OVER (PARTITION BY region ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS n_window
  FROM daily
)"""

SQL["area_incident_density"] = with_(CHECKINS, ATTRS, INCIDENTS, DAILY) + """
SELECT t.region, CAST(t.day AS TIMESTAMP) AS day, CAST(t.n_window AS BIGINT) AS n_window,
       round(t.n_window / a.area, 6) AS area_incident_density
FROM trail t JOIN attrs a ON t.region = a.region
"""

SQL["population_incident_density"] = with_(CHECKINS, ATTRS, INCIDENTS, DAILY) + """
SELECT t.region, CAST(t.day AS TIMESTAMP) AS day, CAST(t.n_window AS BIGINT) AS n_window,
       round(t.n_window::DOUBLE / a.population, 6) AS population_incident_density
FROM trail t JOIN attrs a ON t.region = a.region
"""

VCC = """
vcc AS (SELECT region, category, count(DISTINCT venue_id) AS n_venues FROM venues GROUP BY region, category),
vshare AS (SELECT region, category, n_venues, n_venues::DOUBLE / sum(n_venues) OVER (PARTITION BY region) AS share FROM vcc)"""

SQL["venue_category_share"] = with_(CHECKINS, ATTRS, VCC) + "SELECT region, category, n_venues, round(share, 6) AS share FROM vshare\n"

SQL["venue_category_density"] = with_(CHECKINS, ATTRS, VCC) + """
SELECT v.region, v.category, v.n_venues, round(v.n_venues / a.area, 6) AS density
FROM vcc v JOIN attrs a ON v.region = a.region
"""

SQL["regional_diversity"] = with_(CHECKINS, ATTRS, VCC) + """
SELECT region, round(sum(-share * ln(share) + 0.0), 6) AS diversity FROM vshare WHERE share > 0 GROUP BY region
"""

SQL["visitor_count_overall"] = with_(CHECKINS) + "SELECT region, count(DISTINCT user_id) AS visitor_count FROM ck WHERE region IS NOT NULL GROUP BY region\n"

SQL["region_cosine"] = with_(CHECKINS) + """
, o AS (SELECT t, region, count(user_id)::DOUBLE AS v FROM ck WHERE t IS NOT NULL AND region IS NOT NULL GROUP BY t, region),
regs AS (SELECT DISTINCT region FROM o),
pairs AS (SELECT region AS region_a, lead(region) OVER (ORDER BY region) AS region_b FROM regs),
norms AS (SELECT region, sqrt(sum(v * v)) AS norm FROM o GROUP BY region),
dots AS (
  SELECT p.region_a, p.region_b, sum(a.v * b.v) AS dot
  FROM pairs p JOIN o a ON a.region = p.region_a JOIN o b ON b.region = p.region_b AND b.t = a.t
  GROUP BY p.region_a, p.region_b
)
SELECT p.region_a, p.region_b, round(coalesce(d.dot, 0.0) / nullif(na.norm * nb.norm, 0.0), 6) AS cosine
FROM pairs p LEFT JOIN dots d ON p.region_a = d.region_a AND p.region_b = d.region_b
     LEFT JOIN norms na ON na.region = p.region_a LEFT JOIN norms nb ON nb.region = p.region_b
WHERE p.region_b IS NOT NULL
"""

SQL["vector_cosine"] = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id,
       round(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0.0), 6) AS cosine
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1
"""


# ---------------------------------------------------------------- factorization

IDS = """
fl AS (
  SELECT t, region, 0 AS fidx, 'visitor_count' AS feature, CAST(visitor_count AS DOUBLE) AS value FROM kept
  UNION ALL SELECT t, region, 1, 'obs_freq', CAST(obs_freq AS DOUBLE) FROM kept
  UNION ALL SELECT t, region, 2, 'visitor_entropy', visitor_entropy FROM kept
  UNION ALL SELECT t, region, 3, 'visitor_ratio', visitor_ratio FROM kept
  UNION ALL SELECT t, region, 4, 'region_popularity', region_popularity FROM kept
),
rids AS (SELECT t, dense_rank() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM kept)),
cids AS (SELECT fidx, feature, region, dense_rank() OVER (ORDER BY fidx, region) - 1 AS j
         FROM (SELECT DISTINCT fidx, feature, region FROM fl)),
coo AS (SELECT r.i, c.j, f.t, f.feature, f.region, f.value
        FROM fl f JOIN rids r ON f.t = r.t JOIN cids c ON c.fidx = f.fidx AND c.region = f.region
        WHERE f.value <> 0),
mu AS (SELECT avg(value) AS mean FROM coo),
pf AS (SELECT i AS id, (i % 5 - 2) / 10.0 AS bias, k, ((i * 7 + k * 3) % 11 - 5) / 10.0 AS f
       FROM rids, generate_series(0, 3) AS g(k)),
qf AS (SELECT j AS id, (j % 3 - 1) / 10.0 AS bias, k, ((j * 5 + k * 2) % 13 - 6) / 10.0 AS f
       FROM cids, generate_series(0, 3) AS g(k)),
pq AS (SELECT p.id AS i, q.id AS j, any_value(p.bias) AS bi, any_value(q.bias) AS bj, sum(p.f * q.f) AS d
       FROM pf p JOIN qf q ON p.k = q.k GROUP BY p.id, q.id)"""

_FM_KEPT = with_(CHECKINS, CELL_USER, FIRST_VISITS, GRID, FEATURE_MATRIX_BODY, KEPT.split(",\naligned AS")[0], IDS)

SQL["sparse_cells"] = _FM_KEPT + "SELECT i, j, t, feature, region, round(value, 6) AS value FROM coo\n"

SQL["nonzero_mean"] = _FM_KEPT + "SELECT round(mean, 6) AS mean FROM mu\n"

SQL["predict_cells"] = _FM_KEPT + """
SELECT c.i, c.j, round(c.value, 6) AS value, round(mu.mean + pq.bi + pq.bj + pq.d, 6) AS prediction
FROM coo c JOIN pq ON c.i = pq.i AND c.j = pq.j, mu
"""

SQL["dense_matrix"] = _FM_KEPT + """
, cells AS (
  SELECT k.t, k.region, c.feature, mu.mean + pq.bi + pq.bj + pq.d AS pred
  FROM kept k JOIN rids r ON k.t = r.t JOIN cids c ON c.region = k.region
       JOIN pq ON pq.i = r.i AND pq.j = c.j, mu
)
SELECT t, region,
       round(max(CASE WHEN feature = 'visitor_count' THEN pred END), 6) AS visitor_count,
       round(max(CASE WHEN feature = 'obs_freq' THEN pred END), 6) AS obs_freq,
       round(max(CASE WHEN feature = 'visitor_entropy' THEN pred END), 6) AS visitor_entropy,
       round(max(CASE WHEN feature = 'visitor_ratio' THEN pred END), 6) AS visitor_ratio,
       round(max(CASE WHEN feature = 'region_popularity' THEN pred END), 6) AS region_popularity
FROM cells GROUP BY t, region
"""

SQL["fit_error"] = _FM_KEPT + """
, e AS (SELECT count(*) AS n, sum(pow(c.value - (mu.mean + pq.bi + pq.bj + pq.d), 2)) AS sse
        FROM coo c JOIN pq ON c.i = pq.i AND c.j = pq.j, mu),
reg AS (SELECT sum(f * f) AS reg FROM (SELECT f FROM pf UNION ALL SELECT f FROM qf))
SELECT n, round(sse, 6) AS sse, round(sqrt(sse / n), 6) AS rmse, round(sqrt(sse), 6) AS root_sse,
       round(sse / 2 + 0.001 / 2 * reg, 6) AS cost
FROM e, reg
"""

# one epoch, cell after cell: the state of a step is the current row's vector and those of all columns,
# each as [bias, f0, ...]; a row's cells follow one another, so its last step has its final vector
def _step(alpha: float, beta: float, scale: float, k: int = 4) -> str:
    p_new = ", ".join(f"p[{f}] + {alpha} * ({scale} * e * q[{f}] - {beta} * p[{f}])" for f in range(2, k + 2))
    q_new = ", ".join(f"q[{f}] + {alpha} * ({scale} * e * pn[{f}] - {beta} * q[{f}])" for f in range(2, k + 2))
    miss = "v - (mean + p[1] + q[1] + " + " + ".join(f"p[{f}] * q[{f}]" for f in range(2, k + 2)) + ")"
    return f"""SELECT n, i, pn AS p, list_transform(qs, lambda x, pos: CASE WHEN pos = j + 1 THEN [q[1] + {alpha} * (e - {beta} * q[1]), {q_new}] ELSE x END) AS qs
  FROM (SELECT *, [p[1] + {alpha} * (e - {beta} * p[1]), {p_new}] AS pn FROM (SELECT *, {miss} AS e FROM
    (SELECT o.n, o.i, o.j, o.v, o.mean, CASE WHEN o.i = st.i THEN st.p ELSE o.p0 END AS p, st.qs[o.j + 1] AS q, st.qs FROM st JOIN ordered o ON o.n = st.n + 1)))"""


_EPOCH = _FM_KEPT.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, p0 AS (SELECT id, list_prepend(any_value(bias)::DOUBLE, list(f::DOUBLE ORDER BY k)) AS p FROM pf GROUP BY id),
q0 AS (SELECT id, list_prepend(any_value(bias)::DOUBLE, list(f::DOUBLE ORDER BY k)) AS q FROM qf GROUP BY id),
ordered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c.i, c.j) AS n, c.i, c.j, c.value AS v, p0.p AS p0, mu.mean FROM coo c JOIN p0 ON p0.id = c.i, mu),
st AS (SELECT 0::BIGINT AS n, -1::BIGINT AS i, NULL::DOUBLE[] AS p, (SELECT list(q ORDER BY id) FROM q0) AS qs
  UNION ALL {_step(0.01, 0.05, 2.0)}),
done AS (SELECT * FROM st),
last_row AS (SELECT i, arg_max(p, n) AS p FROM done WHERE i >= 0 GROUP BY i),
last_q AS (SELECT arg_max(qs, n) AS qs FROM done),
fitted AS (SELECT 'P' AS side, p0.id, coalesce(l.p, p0.p) AS x FROM p0 LEFT JOIN last_row l ON l.i = p0.id
  UNION ALL SELECT 'Q', q0.id, last_q.qs[q0.id + 1] FROM q0, last_q)
"""

SQL["history_given"] = _EPOCH + f"""
, missed AS (SELECT c.value - (mu.mean + p.x[1] + q.x[1] + {' + '.join(f'p.x[{k}] * q.x[{k}]' for k in range(2, 6))}) AS e
  FROM coo c JOIN fitted p ON p.side = 'P' AND p.id = c.i JOIN fitted q ON q.side = 'Q' AND q.id = c.j, mu),
size AS (SELECT sum({' + '.join(f'x[{k}] * x[{k}]' for k in range(2, 6))}) AS reg FROM fitted)
SELECT 0::INT AS epoch, count(*) AS n, round(sum(e * e), 5) AS sse, round(sqrt(sum(e * e) / count(*)), 5) AS rmse, round(sqrt(sum(e * e)), 5) AS root_sse,
       round(sum(e * e) / 2 + 0.05 / 2 * any_value(reg), 5) AS cost FROM missed, size
"""

SQL["sgd_epoch"] = _EPOCH + f"""
SELECT side, id, round(x[1], 6) AS bias, {', '.join(f'round(x[{k + 2}], 6) AS f{k}' for k in range(4))} FROM fitted
"""

SQL["matrix_shape"] = _FM_KEPT + """
SELECT count(DISTINCT t) AS n_rows, count(DISTINCT region) * 5 AS n_columns, 250 AS rank FROM kept
"""

# ---------------------------------------------------------------- sampling & metrics

SAMPLE = """
hs AS (SELECT *, md5(concat_ws(',', '0', 'sample', region, CAST(CAST(epoch(t) AS BIGINT) AS VARCHAR))) AS h FROM aligned),
rk AS (SELECT *, row_number() OVER (PARTITION BY region, label ORDER BY h, t) AS rnk,
              sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY region) AS np,
              sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY region) AS nn FROM hs),
smp AS (SELECT * EXCLUDE (h, rnk, np, nn) FROM rk WHERE rnk <= least(np, nn))"""

_FM_SAMPLE = _FM_ALIGN + ", " + SAMPLE.strip() + "\n"

SQL["undersample"] = _FM_SAMPLE + "SELECT t, region, label FROM smp\n"

SQL["train_test_split"] = _FM_SAMPLE + """
, hs2 AS (SELECT *, md5(concat_ws(',', '0', 'split', region, CAST(CAST(epoch(t) AS BIGINT) AS VARCHAR))) AS h2 FROM smp)
SELECT t, region, label,
       row_number() OVER (PARTITION BY region ORDER BY h2, t) <= ceil(0.3 * count(*) OVER (PARTITION BY region)) AS is_test
FROM hs2
"""

SQL["cv_folds"] = _FM_SAMPLE + """
SELECT t, region, label, CAST(ntile(5) OVER (PARTITION BY region, label ORDER BY t) - 1 AS INTEGER) AS fold FROM smp
"""

SQL["standardize"] = _FM_SAMPLE + "SELECT t, region, " + ", ".join(
    f"round(CASE WHEN stddev_pop({f}) OVER (PARTITION BY region) > 0 "
    f"THEN ({f} - avg({f}) OVER (PARTITION BY region)) / stddev_pop({f}) OVER (PARTITION BY region) ELSE 0.0 END, 6) AS {f}_z"
    for f in ("visitor_count", "obs_freq", "visitor_entropy", "visitor_ratio", "region_popularity")
) + " FROM smp\n"


def _newton(steps: int, features: tuple[str, ...], ridge: float = 1e-9) -> str:
    """``steps`` Newton steps of the L2-regularised logistic regression of every (region, f) in
    ``zs`` (y and z0 = 1, z1, ...): sums by region and fold, then elimination column by column."""
    n = len(features) + 1
    eta = " + ".join(f"b{i} * z{i}" for i in range(n))
    ctes = ["b_0 AS MATERIALIZED (SELECT DISTINCT region, f, " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(n)) + " FROM zs)"]
    for s in range(steps):
        h = ", ".join(f"sum(w * z{i} * z{j})" + ((" + 1.0" if i else f" + {ridge}") if i == j else "") + f" AS m{i}_{j}" for i in range(n) for j in range(n))
        g = ", ".join(f"sum((y - p) * z{i})" + (f" - any_value(b{i})" if i else "") + f" AS m{i}_{n}" for i in range(n))
        keep = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(n))
        ctes.append(f"s_{s} AS MATERIALIZED (SELECT region, f, {keep}, {h}, {g} FROM (SELECT *, p * (1 - p) AS w FROM "
                    f"(SELECT zs.*, b_{s}.* EXCLUDE (region, f), 1 / (1 + exp(-({eta}))) AS p FROM zs JOIN b_{s} USING (region, f))) GROUP BY region, f)")
        last = f"s_{s}"
        for k in range(n):
            cols = ", ".join((f"m{k}_{j} / m{k}_{k}" if i == k else f"m{i}_{j} - m{k}_{j} * m{i}_{k} / m{k}_{k}") + f" AS m{i}_{j}" for i in range(n) for j in range(k + 1, n + 1))
            ctes.append(f"s_{s}_{k} AS MATERIALIZED (SELECT region, f, " + ", ".join(f"b{i}" for i in range(n)) + f", {cols} FROM {last})")
            last = f"s_{s}_{k}"
        ctes.append(f"b_{s + 1} AS MATERIALIZED (SELECT region, f, " + ", ".join(f"b{i} + m{i}_{n} AS b{i}" for i in range(n)) + f" FROM {last})")
    return ",\n".join(ctes)


_FIVE = ("visitor_count", "obs_freq", "visitor_entropy", "visitor_ratio", "region_popularity")
_Z = ", ".join(f"CASE WHEN stddev_pop({f}) OVER fit > 0 THEN ({f} - avg({f}) OVER fit) / stddev_pop({f}) OVER fit ELSE 0.0 END AS z{k}" for k, f in enumerate(_FIVE, 1))
SQL["logistic_regions"] = _FM_SAMPLE + f"""
, hs2 AS (SELECT *, md5(concat_ws(',', '0', 'split', region, CAST(CAST(epoch(t) AS BIGINT) AS VARCHAR))) AS h2 FROM smp),
split AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY h2, t) <= ceil(0.3 * count(*) OVER (PARTITION BY region)) AS is_test,
                 ntile(5) OVER (PARTITION BY region, label ORDER BY t) - 1 AS fold FROM hs2),
tr AS (SELECT * FROM (SELECT *, unnest(range(-1, 5)) AS f FROM split) WHERE CASE WHEN f = -1 THEN NOT is_test ELSE fold <> f END),
zs AS (SELECT region, f, label::DOUBLE AS y, 1.0::DOUBLE AS z0, {_Z} FROM tr WINDOW fit AS (PARTITION BY region, f)),
{_newton(10, _FIVE)}
SELECT region, f::INT AS fold, {', '.join(f'round(b{k}, 5) AS beta{k}' for k in range(6))} FROM b_10
"""

_GIVEN = with_(CHECKINS, CELL_USER, FIRST_VISITS, GRID, FEATURE_MATRIX_BODY, INCIDENTS, KEPT, IDS) + f"""
, dense AS (SELECT k.t, k.region, {', '.join(f"max(CASE WHEN c.feature = '{f}' THEN mu.mean + pq.bi + pq.bj + pq.d END) AS d_{f}" for f in _FIVE)}
  FROM kept k JOIN rids r ON k.t = r.t JOIN cids c ON c.region = k.region JOIN pq ON pq.i = r.i AND pq.j = c.j, mu GROUP BY k.t, k.region),
frame AS (SELECT a.t, a.region, a.label, {', '.join(f'a.{f}::DOUBLE AS s_{f}' for f in _FIVE)}, {', '.join(f'd.d_{f}' for f in _FIVE)}
  FROM aligned a JOIN dense d ON a.t = d.t AND a.region = d.region)
"""
SQL["given_features"] = _GIVEN + "SELECT t, region, label, " + ", ".join(f"round({p}_{f}, 6) AS {p}_{f}" for p in "sd" for f in _FIVE) + " FROM frame\n"
SQL["model_table"] = _GIVEN + "SELECT " + ", ".join(f"round(d_{f}, 6) AS {f}" for f in _FIVE) + ", label::DOUBLE AS label FROM frame\n"
_MEANS = {"cv_mean": "visitor_entropy", "auc": "visitor_ratio", "f1": "region_popularity", "accuracy": "visitor_count"}
SQL["report_given"] = _GIVEN + "SELECT region, 'rule' AS model, FALSE AS scaled, " + ", ".join(
    f"round(avg(s_{f}), 6) AS sparse_{m}, round(avg(d_{f}), 6) AS dynamic_{m}, round(avg(d_{f}) - avg(s_{f}), 6) AS delta_{m}" for m, f in _MEANS.items()) + " FROM frame GROUP BY region\n"

DOCS = """
ds AS (SELECT l.doc_id, l.toxic, l.quality AS label, CAST(d.n_chars AS DOUBLE) AS score
       FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

SQL["roc_auc"] = with_(DOCS) + """
, rr AS (SELECT toxic, label, rank() OVER (PARTITION BY toxic ORDER BY score) AS r0,
                count(*) OVER (PARTITION BY toxic, score) AS nt FROM ds),
ar AS (SELECT toxic, label, r0 + (nt - 1) / 2.0 AS ar FROM rr)
SELECT toxic, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg,
       round((sum(CASE WHEN label = 1 THEN ar ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
             / nullif(sum(label) * (count(*) - sum(label)), 0), 6) AS auc
FROM ar GROUP BY toxic
"""

SQL["threshold_scores"] = with_(DOCS) + "SELECT doc_id, CASE WHEN score > 2000.0 THEN 1 ELSE 0 END AS prediction FROM ds\n"

SQL["f1_accuracy"] = with_(DOCS) + """
, pr AS (SELECT toxic, label, CASE WHEN score > 2000.0 THEN 1 ELSE 0 END AS p FROM ds),
cm AS (SELECT toxic,
              CAST(sum(CASE WHEN p = 1 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
              CAST(sum(CASE WHEN p = 1 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
              CAST(sum(CASE WHEN p = 0 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
              CAST(sum(CASE WHEN p = 0 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM pr GROUP BY toxic)
SELECT toxic, tp, fp, fn, tn,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
       round((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 6) AS accuracy
FROM cm
"""

SQL["region_panel"] = _FM_ALIGN + f"""
SELECT {FM_COLS}, label FROM aligned WHERE region = (SELECT min(region) FROM aligned)
"""

SQL["preview_features"] = with_(CHECKINS, CELL_USER, FIRST_VISITS, GRID, FEATURE_MATRIX_BODY) + f"""
SELECT {FM_COLS} FROM fm ORDER BY t, region LIMIT 5
"""

SQL["streaming_obs_freq"] = SQL["obs_freq"]

SQL["cv_auc"] = """
WITH d AS (SELECT l.toxic, l.quality AS y, o.n_chars::DOUBLE AS s, o.doc_id % 5 AS fold
           FROM labels l JOIN documents o USING (doc_id)
           WHERE l.quality IS NOT NULL AND o.n_chars IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY toxic, fold ORDER BY s)
              + (count(*) OVER (PARTITION BY toxic, fold, s) - 1) / 2.0 AS rk FROM d),
f AS (SELECT toxic, fold, sum(y) AS p, sum(1 - y) AS n, sum(CASE WHEN y = 1 THEN rk END) AS rs FROM r GROUP BY toxic, fold),
a AS (SELECT toxic, CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0) / (p * n) END AS auc FROM f)
SELECT toxic, count(auc) AS folds, round(avg(auc), 6) AS cv_mean, round(2 * stddev_pop(auc), 6) AS cv_std2 FROM a GROUP BY toxic
"""

SQL["load_checkin_points"] = with_(CHECKINS) + """
SELECT seq, user_id, 'v' || venue_id AS venue_id, ts, (venue_id % 10) / 4.0::DOUBLE - 0.5 AS lon, venue_id / 64.0::DOUBLE - 0.75 AS lat FROM ck
"""

# every venue number k has a fixed point; both kinds of events get the region that holds it
_PLACED = POLYGONS + """,
pts AS (SELECT range AS k, (range * 37 % 100)::DOUBLE / 100.0::DOUBLE - 0.497::DOUBLE AS lon, (range * 53 % 100)::DOUBLE / 100.0::DOUBLE - 0.497::DOUBLE AS lat FROM range(100)),
tests AS (
  SELECT k, region_id,
         sum(CASE WHEN ((y1 > lat) <> (y2 > lat)) AND (((x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1) > 0) = (y2 > y1)) THEN 1 ELSE 0 END) AS crossings,
         bool_or((x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge
  FROM pts, edges GROUP BY k, region_id
),
hit AS (SELECT k, min(region_id) AS region_id FROM tests WHERE crossings % 2 = 1 AND NOT on_edge GROUP BY k),
of_k AS (SELECT hit.k, polys.name AS region FROM hit JOIN polys USING (region_id)),
ck AS (
  SELECT user_id, CAST(k AS VARCHAR) AS venue_id, of_k.region, ts, event_id AS seq, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') AS t
  FROM events JOIN of_k ON CAST(json_extract(props, '$.k') AS BIGINT) = of_k.k WHERE event_type <> 'error'
)"""

SQL["raw_to_labels"] = with_(_PLACED, CELL_USER, FIRST_VISITS, GRID, FEATURE_MATRIX_BODY, INC_TEXT) + f"""
, lab AS (
  SELECT time_bucket(INTERVAL '3 hours', i.ts, TIMESTAMP '1970-01-01') AS t, of_k.region, 1 AS label
  FROM inc_clean i JOIN events e ON e.event_id = i.incident_id JOIN of_k ON CAST(json_extract(e.props, '$.k') AS BIGINT) = of_k.k
  WHERE i.offense = 'GRAND LARCENY' AND i.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL
)
SELECT {FM_COLS}, coalesce(label, 0)::INTEGER AS label
FROM (SELECT fm.*, lab.label FROM fm LEFT JOIN lab ON fm.t = lab.t AND fm.region = lab.region WHERE fm.t IN (SELECT t FROM lab))
"""
