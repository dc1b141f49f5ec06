"""DuckDB SQL of the registered queries, written from the definitions and apart from the Spark code."""

from __future__ import annotations

SQL: dict[str, str] = {}

_DATED = """dated AS (
  SELECT *, dayofyear(l_shipdate) - 1 AS place, year(l_shipdate) AS y FROM lineitem),
placed AS (
  SELECT *, CASE WHEN place < 365 THEN CASE WHEN place >= 212 THEN y ELSE y - 1 END END AS season,
    CASE WHEN place < 365 THEN CASE WHEN place >= 212 THEN place - 212 ELSE place + 153 END END AS day FROM dated)"""

#: c: the curves of suppliers as lists s, one for each of six seasons.
_CURVES = f"""{_DATED},
days AS (
  SELECT l_suppkey AS pixel, CAST(season - 1995 AS INT) AS year, CAST(day AS INT) AS day, sum(l_quantity) AS v
  FROM placed WHERE season BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3),
long AS (
  SELECT p.pixel, CAST(y.range AS INT) AS year, CAST(t.range AS INT) AS day, coalesce(d.v, 0.0) AS v
  FROM (SELECT DISTINCT pixel FROM days) p, range(6) y, range(365) t
  LEFT JOIN days d ON d.pixel = p.pixel AND d.year = y.range AND d.day = t.range),
c AS (SELECT pixel, year, list(v ORDER BY day) AS s FROM long GROUP BY 1, 2)"""

_PTS = """pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
_SHARES = f"""{_PTS},
sh AS (SELECT id, list_transform(v, lambda x: x * x / greatest(list_sum(list_transform(v, lambda y: y * y)), 1e-12)) AS p FROM pts),
rt AS (SELECT id, p, list_transform(p, lambda x: sqrt(x)) AS q FROM sh)"""
_HELL = f"""{_SHARES},
hd AS (SELECT a.id AS i, b.id AS j, list_distance(a.q, b.q) / sqrt(2) AS d FROM rt a, rt b WHERE a.id <> b.id)"""
_JS = """ent AS (SELECT id, p, list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END)) AS h FROM sh),
jd AS (SELECT a.id AS i, b.id AS j, sqrt(greatest(list_sum(list_transform(list_zip(a.p, b.p), lambda z: CASE WHEN z[1] + z[2] > 0 THEN -(z[1] + z[2]) / 2 * log2((z[1] + z[2]) / 2) ELSE 0 END)) - (a.h + b.h) / 2, 0)) AS d
  FROM ent a, ent b WHERE a.id <> b.id)"""
_NEAR = f"""{_HELL},
near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM hd),
edge AS (SELECT i AS src, j AS dst FROM near WHERE rank <= 21 UNION SELECT j, i FROM near WHERE rank <= 21)"""
_PLACES = """places AS (
  SELECT vec_id AS id, vec_id // 25 AS r, vec_id % 25 AS c, 40 - 0.25 * (vec_id // 25) AS lat, 73 + 0.25 * (vec_id % 25) AS lon,
    3000.0 + vec_id * 7919 % 3001 AS elev, 60.0 + vec_id * 31 % 211 AS active_days FROM embeddings),
lab AS (SELECT vec_id AS id, CAST(label % 3 AS BIGINT) AS lab FROM embeddings)"""
_GRID = f"""{_PLACES},
grid AS (SELECT a.id AS i, b.id AS j FROM places a, (VALUES (0, 1), (1, -1), (1, 0), (1, 1)) s(dr, dc), places b WHERE b.r = a.r + s.dr AND b.c = a.c + s.dc)"""
_KM = "12742.0 * asin(sqrt(power(sin((b.lat - a.lat) * pi() / 180 / 2), 2) + cos(a.lat * pi() / 180) * cos(b.lat * pi() / 180) * power(sin((b.lon - a.lon) * pi() / 180 / 2), 2)))"
_DEGREES = f"""{_NEAR},
deg AS (SELECT src AS id, count(*) AS degree FROM edge GROUP BY 1),
tri AS (SELECT a.src AS id, count(*) AS t FROM edge a JOIN edge b ON a.src = b.src AND a.dst < b.dst JOIN edge e ON e.src = a.dst AND e.dst = b.dst GROUP BY 1),
cc AS (SELECT id, degree, CASE WHEN degree > 1 THEN coalesce(t, 0) / (degree * (degree - 1) / 2) ELSE 0.0 END AS cc FROM deg LEFT JOIN tri USING (id))"""
_WEIGHTS = f"""{_NEAR},
scale AS (SELECT i, d AS s FROM near WHERE rank = 7),
w AS (SELECT e.src, e.dst, exp(-h.d * h.d / (a.s * b.s)) AS w FROM edge e JOIN hd h ON h.i = e.src AND h.j = e.dst JOIN scale a ON a.i = e.src JOIN scale b ON b.i = e.dst)"""


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _rates(name: str, lags: tuple[int, ...]) -> str:
    lag = " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(lags))
    return f"""{name} AS (
  SELECT pixel, year, lag, t, (s[CAST(least(t + (k + 1) // 2, 364) AS INT) + 1] - s[CAST(greatest(t - k // 2, 0) AS INT) + 1]) / k AS rate
  FROM (SELECT pixel, year, s, CAST(l.range AS INT) AS lag, CASE l.range {lag} END AS k, t.range AS t FROM c, range({len(lags)}) l, range(365) t))"""


def _smooth_rates(name: str) -> str:
    return f"""kern AS (SELECT range AS o, exp(-0.5 * power(range / 2.0, 2)) / (SELECT sum(exp(-0.5 * power(range / 2.0, 2))) FROM range(-6, 7)) AS w FROM range(-6, 7)),
sm AS (SELECT pixel, year, t, sum(w * s[CAST(least(greatest(t + o, 0), 364) AS INT) + 1]) AS x FROM (SELECT pixel, year, s, range AS t FROM c, range(365)), kern GROUP BY 1, 2, 3),
{name} AS (SELECT pixel, year, 0 AS lag, t, 0.5 * (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) AS rate FROM sm WINDOW w AS (PARTITION BY pixel, year ORDER BY t))"""


def _hist(rates: str, cells: int = 24, bins: int = 6) -> str:
    return f"""pos AS (SELECT pixel, year, lag, CAST(t * {cells} // 365 AS INT) AS cell, abs(rate) AS m, least(greatest((atan2(rate, 0.3) + pi() / 2) / pi() * {bins} - 0.5, 0), {bins - 1}) AS p FROM {rates}),
vote AS (SELECT pixel, year, lag, cell, CAST(floor(p) AS INT) AS bin, m * (1 - (p - floor(p))) AS x FROM pos
  UNION ALL SELECT pixel, year, lag, cell, least(CAST(floor(p) AS INT) + 1, {bins - 1}), m * (p - floor(p)) FROM pos),
hist AS (SELECT k.pixel, k.year, k.lag, k.cell, k.bin, coalesce(v.h, 0.0) AS h FROM (
    SELECT a.pixel, a.year, a.lag, CAST(c.range AS INT) AS cell, CAST(b.range AS INT) AS bin FROM (SELECT DISTINCT pixel, year, lag FROM vote) a, range({cells}) c, range({bins}) b) k
  LEFT JOIN (SELECT pixel, year, lag, cell, bin, sum(x) AS h FROM vote GROUP BY ALL) v USING (pixel, year, lag, cell, bin))"""


def _blocks(cells: int = 24, bins: int = 6) -> str:
    return f"""b0 AS (SELECT pixel, year, lag, cell AS block, 0 AS slot, bin, h FROM hist UNION ALL SELECT pixel, year, lag, (cell + {cells - 1}) % {cells}, 1, bin, h FROM hist),
b1 AS (SELECT *, least(h / sqrt(sum(h * h) OVER w + 1), 0.2) AS x FROM b0 WINDOW w AS (PARTITION BY pixel, year, lag, block)),
blk AS (SELECT pixel, year, lag, CAST((block * 2 + slot) * {bins} + bin AS INT) AS f, x / sqrt(sum(x * x) OVER w + 1) AS v FROM b1 WINDOW w AS (PARTITION BY pixel, year, lag, block))"""


def _norm(src: str, keys: str) -> str:
    return f"v / greatest(sum(v) OVER (PARTITION BY {keys}), 1e-12) AS v FROM {src}"


SQL["season_days"] = f"WITH {_DATED} SELECT CAST(l_shipdate AS DATE) AS date, CAST(season AS INT) AS season, CAST(day AS INT) AS day, count(*) AS n FROM placed GROUP BY 1, 2, 3"
SQL["daily_curve"] = f"WITH {_CURVES} SELECT pixel, year, day, v FROM long"
SQL["active_days_mask"] = f"WITH {_CURVES}, a AS (SELECT pixel, sum(CASE WHEN v > 0.5 THEN 1 ELSE 0 END) / 6 AS active_days FROM days GROUP BY 1) SELECT pixel, {_r('active_days')} AS active_days, active_days >= 30 AS over_30, active_days >= 60 AS over_60, active_days >= 90 AS over_90 FROM a"
_CONTRACT = f"""{_CURVES},
twin AS (SELECT pixel, year, s FROM c UNION ALL SELECT pixel + 1000000, year, s FROM c WHERE pixel % 5 = 0),
whole AS (SELECT pixel, list(s ORDER BY year) AS z FROM twin GROUP BY 1),
rep AS (SELECT z, min(pixel) AS rep FROM whole GROUP BY 1),
v AS (SELECT pixel, rep, dense_rank() OVER (ORDER BY rep) - 1 AS vertex FROM whole JOIN rep USING (z))"""
SQL["contract_duplicates"] = f"WITH {_CONTRACT} SELECT pixel, vertex, rep FROM v"
SQL["duplicate_columns"] = f"WITH {_CONTRACT} SELECT DISTINCT CAST(lon AS DOUBLE) AS lon FROM (SELECT vertex, min(73 + 0.25 * (pixel % 25)) AS lon, count(*) AS n FROM v GROUP BY 1) WHERE n > 1"
SQL["vertex_elevation"] = f"WITH {_CONTRACT} SELECT vertex, avg(CASE WHEN pixel % 7 <> 0 THEN CAST(pixel % 97 AS DOUBLE) END) AS v FROM v GROUP BY 1"
SQL["climatology"] = f"WITH {_CURVES} SELECT pixel, day, {_r('avg(v)')} AS v FROM long GROUP BY 1, 2"
SQL["year_subsets"] = f"""WITH {_CURVES}, y AS (SELECT DISTINCT year FROM c),
half(i, list) AS (VALUES (0, [0, 2, 3, 4, 5]), (1, [1, 2, 4, 5]), (2, [4]), (3, [2, 3, 4]), (4, [0, 4, 5])),
m AS (SELECT 'all' AS subset, year FROM y UNION ALL SELECT 'pre', year FROM y WHERE year < 4 UNION ALL SELECT 'post', year FROM y WHERE year >= 4
  UNION ALL SELECT 'split' || i || CASE WHEN list_contains(list, year) THEN 'a' ELSE 'b' END, year FROM half, y)
SELECT subset, year, (1995 + year) || '/' || lpad(CAST((1996 + year) % 100 AS VARCHAR), 2, '0') AS season FROM m"""
SQL["lag_rate"] = f"WITH {_CURVES}, {_rates('r', (7,))} SELECT pixel, year, CAST(t AS INT) AS day, {_r('rate')} AS v FROM r"
SQL["smooth_rate"] = f"WITH {_CURVES}, {_smooth_rates('r')} SELECT pixel, year, CAST(t AS INT) AS day, {_r('rate')} AS v FROM r"
_HOG = f"{_CURVES}, {_smooth_rates('r')}, {_hist('r')}"
SQL["cell_histogram"] = f"WITH {_HOG} SELECT pixel, year, cell, bin, {_r('h')} AS h FROM hist"
SQL["block_norm"] = f"WITH {_HOG}, {_blocks()} SELECT pixel, year, f, {_r('v')} AS v FROM blk"
SQL["yearly_hog"] = f"WITH {_HOG}, {_blocks()}, n AS (SELECT *, sum(v) OVER (PARTITION BY pixel, year) AS z FROM blk) SELECT pixel, year, f, {_r('v / greatest(z, 1e-12)')} AS v, z > 1e-6 AS active FROM n"
_MEAN = "mean AS (SELECT pixel, lag, f, avg(v) AS v FROM blk GROUP BY 1, 2, 3), one AS (SELECT pixel, lag, f, " + _norm("mean", "pixel, lag") + ")"
SQL["temporal_hog"] = f"WITH {_HOG}, {_blocks()}, {_MEAN} SELECT pixel, f, {_r('v')} AS v FROM one"
SQL["lag_hog"] = f"WITH {_CURVES}, {_rates('r', (7,))}, {_hist('r')}, {_blocks()}, {_MEAN} SELECT pixel, f, {_r('v')} AS v FROM one"
_MULTI = f"{_CURVES}, {_rates('r', (1, 7, 15, 31, 61))}, {_hist('r')}, {_blocks()}"
SQL["multiscale_hog"] = f"WITH {_MULTI}, {_MEAN}, two AS (SELECT pixel, lag * 288 + f AS f, {_norm('one', 'pixel')}) SELECT pixel, f, {_r('v')} AS v FROM two"
SQL["yearly_multiscale_hog"] = f"""WITH {_MULTI}, one AS (SELECT pixel, year, lag, f, {_norm('blk', 'pixel, year, lag')}), two AS (SELECT pixel, year, lag * 288 + f AS f, {_norm('one', 'pixel, year')}),
act AS (SELECT pixel, year, sum(abs(v - w)) > 1e-6 AS active FROM (SELECT pixel, year, v, coalesce(lag(v) OVER (PARTITION BY pixel, year ORDER BY day), v) AS w FROM long) GROUP BY 1, 2)
SELECT pixel, year, f, {_r('v')} AS v, active FROM two JOIN act USING (pixel, year)"""
SQL["raw_curve"] = f"WITH {_CURVES}, m AS (SELECT pixel, CAST(day * 24 // 365 AS INT) AS f, avg(v) AS v FROM long GROUP BY 1, 2), n AS (SELECT pixel, f, {_norm('m', 'pixel')}) SELECT pixel, f, {_r('v')} AS v FROM n"
SQL["occurrence"] = f"WITH {_CURVES} SELECT pixel, CAST(day * 24 // 365 AS INT) AS f, {_r('avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)')} AS v FROM long GROUP BY 1, 2"
SQL["count_histogram"] = f"""WITH {_CURVES}, nx AS (SELECT pixel, year, day, v, coalesce(lead(v) OVER (PARTITION BY pixel, year ORDER BY day), v) AS w FROM long),
b AS (SELECT pixel, year, CAST(day * 12 // 365 AS INT) AS cell, CAST(least(greatest(round_even((atan2(w - v, 0.3) + pi() / 2) / pi() * 9 - 0.5, 0), 0), 8) AS INT) AS bin, (v > 0 OR w > 0) AS live FROM nx),
n AS (SELECT k.pixel, k.year, k.cell, CAST(bb.range AS INT) AS bin, sum(CASE WHEN b.live AND b.bin = bb.range THEN 1 ELSE 0 END) AS n FROM (SELECT DISTINCT pixel, year, cell FROM b) k CROSS JOIN range(9) bb JOIN b ON b.pixel = k.pixel AND b.year = k.year AND b.cell = k.cell GROUP BY 1, 2, 3, 4),
s AS (SELECT pixel, year, CAST(cell * 9 + bin AS INT) AS f, n / greatest(sum(n) OVER (PARTITION BY pixel, year, cell), 1) AS v FROM n), m AS (SELECT pixel, f, avg(v) AS v FROM s GROUP BY 1, 2), z AS (SELECT pixel, f, {_norm('m', 'pixel')})
SELECT pixel, f, {_r('v')} AS v FROM z"""
SQL["occurrence_gradient"] = f"""WITH {_CURVES}, pv AS (SELECT pixel, year, day, v, lag(v) OVER (PARTITION BY pixel, year ORDER BY day) AS w FROM long),
b AS (SELECT pixel, CAST(day * 24 // 365 AS INT) AS cell, CASE WHEN w IS NOT NULL AND (v > 0 OR w > 0) THEN CAST(least(greatest(floor((atan2(v - w, 1.0) + pi() / 2) / pi() * 9), 0), 8) AS INT) END AS bin, v FROM pv),
n AS (SELECT k.pixel, k.cell, CAST(bb.range AS INT) AS bin, coalesce(x.n, 0) AS n FROM (SELECT DISTINCT pixel, cell FROM b) k CROSS JOIN range(9) bb LEFT JOIN (SELECT pixel, cell, bin, count(*) AS n FROM b GROUP BY 1, 2, 3) x ON x.pixel = k.pixel AND x.cell = k.cell AND x.bin = bb.range),
kern AS (SELECT range AS o, exp(-0.5 * power(range / 0.5, 2)) / (SELECT sum(exp(-0.5 * power(range / 0.5, 2))) FROM range(-2, 3)) AS w FROM range(-2, 3)),
g AS (SELECT a.pixel, a.cell, a.bin, sum(kern.w * e.n) AS h FROM n a, kern JOIN n e ON e.pixel = a.pixel AND e.bin = a.bin AND e.cell = least(greatest(a.cell + kern.o, 0), 23) GROUP BY 1, 2, 3),
p AS (SELECT pixel, CAST(cell * 9 + bin AS INT) AS f, sqrt(CASE WHEN sum(h) OVER w > 0 THEN h / sum(h) OVER w ELSE 0 END) * sqrt(0.5 / 48) AS v FROM g WINDOW w AS (PARTITION BY pixel, cell)),
o AS (SELECT pixel, CAST(216 + cell AS INT) AS f, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) * sqrt(0.5 / 24) AS v FROM b GROUP BY 1, 2)
SELECT pixel, f, {_r('v')} AS v FROM (SELECT * FROM p UNION ALL SELECT * FROM o)"""
SQL["haar_scalogram"] = f"""WITH {_CURVES}, sc(i, h) AS (VALUES (0, 1), (1, 2), (2, 4), (3, 8), (4, 16), (5, 32)),
d AS (SELECT pixel, year, i, t, (list_sum(list_transform(range(h), lambda k: s[CAST(least(t + k, 364) AS INT) + 1])) - list_sum(list_transform(range(h), lambda k: s[CAST(greatest(t - 1 - k, 0) AS INT) + 1]))) / h AS d FROM (SELECT pixel, year, s, i, h, range AS t FROM c, sc, range(365))),
e AS (SELECT pixel, year, CAST((t * 12 // 365) * 12 + i * 2 + g.range AS INT) AS f, sum(CASE WHEN (g.range = 0 AND d > 0) OR (g.range = 1 AND d < 0) THEN d * d ELSE 0 END) AS v FROM d, range(2) g GROUP BY 1, 2, 3),
y AS (SELECT pixel, year, f, {_norm('e', 'pixel, year')}), m AS (SELECT pixel, f, avg(v) AS v FROM y GROUP BY 1, 2), z AS (SELECT pixel, f, {_norm('m', 'pixel')})
SELECT pixel, f, {_r('v')} AS v FROM z"""
SQL["fourier_harmonics"] = f"""WITH {_CURVES}, dc AS (SELECT pixel, year, sum(v) AS dc FROM long GROUP BY 1, 2 HAVING sum(v) > 1e-6),
x AS (SELECT l.pixel, l.year, CAST(k.range AS INT) AS f, sum(CASE WHEN k.range < 6 THEN l.v * cos(2 * pi() * (k.range + 1) * l.day / 365) ELSE -l.v * sin(2 * pi() * (k.range - 5) * l.day / 365) END) AS v FROM long l, range(12) k GROUP BY 1, 2, 3)
SELECT pixel, f, {_r('avg(v / dc)')} AS v FROM x JOIN dc USING (pixel, year) GROUP BY 1, 2"""
SQL["phenology"] = f"""WITH {_CURVES}, g AS (SELECT *, lag(v) OVER (PARTITION BY pixel, year ORDER BY day) AS w FROM long),
y AS (SELECT pixel, year, min(day) FILTER (v > 0.5) AS onset, max(day) FILTER (v > 0.5) AS melt, count(*) FILTER (v > 0.5) AS days, min(day) FILTER (v = top) AS peak, count(*) FILTER (v > 0.5 AND NOT coalesce(w > 0.5, false)) AS episodes,
  sum(CASE WHEN v - w > 1 THEN v - w ELSE 0 END) / greatest(sum(greatest(v - w, 0)), 1e-6) AS flash FROM (SELECT *, max(v) OVER (PARTITION BY pixel, year) AS top FROM g) GROUP BY 1, 2),
m AS (SELECT pixel, [avg(onset), avg(melt), avg(days), avg(peak), avg(episodes), avg(peak - onset), avg(melt - peak), avg(flash)] AS x FROM y WHERE onset IS NOT NULL GROUP BY 1),
l AS (SELECT pixel, CAST(k.range AS INT) AS f, x[k.range + 1] AS v FROM m, range(8) k), z AS (SELECT f, avg(v) AS a, stddev_pop(v) AS sd, count(*) AS n FROM l GROUP BY 1)
SELECT p.pixel, z.f, CASE WHEN z.n = (SELECT count(DISTINCT pixel) FROM c) THEN {_r('(l.v - z.a) / CASE WHEN z.sd > 0 THEN z.sd ELSE 1 END')} END AS v FROM (SELECT DISTINCT pixel FROM c) p CROSS JOIN z LEFT JOIN l ON l.pixel = p.pixel AND l.f = z.f"""
SQL["euclidean_pairs"] = f"WITH {_PTS} SELECT a.id AS i, b.id AS j, {_r('list_distance(a.v, b.v)')} AS d FROM pts a, pts b WHERE a.id < b.id"
SQL["hellinger_pairs"] = f"WITH {_HELL} SELECT i, j, {_r('d')} AS d FROM hd WHERE i < j"
SQL["js_pairs"] = f"WITH {_SHARES}, {_JS} SELECT i, j, {_r('d')} AS d FROM jd WHERE i < j"
SQL["pairs_within"] = f"WITH {_HELL} SELECT i, j, {_r('d')} AS d FROM hd WHERE i < j AND d <= 0.3"
SQL["distance_summary"] = f"WITH {_HELL} SELECT {_r('min(d)')} AS min, {_r('quantile_cont(d, 0.05)')} AS q05, {_r('quantile_cont(d, 0.5)')} AS median, {_r('quantile_cont(d, 0.95)')} AS q95, {_r('max(d)')} AS max FROM hd WHERE i < j"
_LENGTH = f"{_NEAR}, {_PLACES}, len AS (SELECT e.src, e.dst, {_KM} AS km FROM edge e JOIN places a ON a.id = e.src JOIN places b ON b.id = e.dst WHERE e.src < e.dst)"
SQL["haversine_edges"] = f"WITH {_LENGTH} SELECT src, dst, {_r('km')} AS km FROM len"
SQL["edge_length_stats"] = f"WITH {_LENGTH} SELECT count(*) AS n, {_r('quantile_cont(km, 0.5)')} AS median_km, {_r('avg(CASE WHEN km > 100 THEN 1.0 ELSE 0.0 END)')} AS long_share FROM len"
SQL["long_edges"] = f"WITH {_LENGTH} SELECT {_r('avg(CASE WHEN a.lab = b.lab THEN 1.0 ELSE 0.0 END)')} AS same_region FROM len JOIN lab a ON a.id = src JOIN lab b ON b.id = dst WHERE km > 100"
SQL["knn_edges"] = f"WITH {_NEAR} SELECT src, dst FROM edge"
SQL["knn_mutual_share"] = f"WITH {_NEAR} SELECT {_r('avg(CASE WHEN b.i IS NULL THEN 0.0 ELSE 1.0 END)')} AS mutual_share FROM near a LEFT JOIN near b ON b.i = a.j AND b.j = a.i AND b.rank <= 21 WHERE a.rank <= 21"
SQL["nn_overlap"] = f"WITH {_NEAR}, {_JS}, jn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM jd) SELECT {_r('avg(CASE WHEN b.i IS NULL THEN 0.0 ELSE 1.0 END)')} AS overlap FROM near a LEFT JOIN jn b ON b.i = a.i AND b.j = a.j AND b.rank <= 21 WHERE a.rank <= 21"
_COMP = f"""RECURSIVE {_HELL},
near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM hd),
ks AS (SELECT CAST(range AS INT) AS k FROM range(1, 65) WHERE range <= greatest((SELECT count(*) FROM pts) - 1, 1)),
link AS (SELECT k, i AS a, j AS b FROM near, ks WHERE rank <= k UNION SELECT k, j, i FROM near, ks WHERE rank <= k),
seed AS (SELECT k, id FROM pts, ks EXCEPT SELECT k, a FROM link WHERE b < a),
reach AS (SELECT k, id, id AS comp FROM seed UNION SELECT r.k, l.b, r.comp FROM reach r JOIN link l ON l.k = r.k AND l.a = r.id),
label AS (SELECT k, id, min(comp) AS comp FROM reach GROUP BY 1, 2)"""
SQL["degree_clustering"] = f"WITH {_DEGREES} SELECT id, degree, {_r('cc')} AS cc FROM cc"
SQL["degree_tail"] = f"""WITH {_DEGREES}, n AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS place, count(*) OVER () AS t FROM deg), m AS (SELECT quantile_cont(degree, 0.5) AS med, avg(degree) AS a, stddev_pop(degree) AS sd FROM deg),
x AS (SELECT degree, ln(1 - place / t) AS y FROM n, m WHERE degree >= med)
SELECT (SELECT min(degree) FROM deg) AS deg_min, {_r('(SELECT med FROM m)')} AS deg_median, {_r('(SELECT a FROM m)')} AS deg_mean, (SELECT max(degree) FROM deg) AS deg_max, {_r('(SELECT avg(power(degree - a, 3)) / power(any_value(sd), 3) FROM deg, m)')} AS deg_skew, {_r('regr_r2(y, degree)')} AS r2_exponential, {_r('regr_r2(y, ln(degree))')} AS r2_power FROM x"""
SQL["degree_ccdf"] = f"WITH {_DEGREES} SELECT DISTINCT degree, {_r('(SELECT count(*) FROM deg b WHERE b.degree >= a.degree) / (SELECT count(*) FROM deg)')} AS share FROM deg a"
SQL["colour_limits"] = f"WITH {_DEGREES} SELECT {_r('quantile_cont(cc, 0.02)')} AS low, {_r('quantile_cont(cc, 0.98)')} AS high FROM cc"
SQL["gaussian_weights"] = f"WITH {_WEIGHTS} SELECT src, dst, {_r('w')} AS w FROM w"
SQL["gaussian_weights_fallback"] = SQL["gaussian_weights"]
SQL["laplacian_entries"] = f"WITH {_WEIGHTS}, deg AS (SELECT src, sum(w) AS g FROM w GROUP BY 1) SELECT w.src, w.dst, {_r('-w.w / sqrt(a.g * b.g)')} AS v FROM w JOIN deg a ON a.src = w.src JOIN deg b ON b.src = w.dst UNION ALL SELECT src, src, 1.0 FROM deg"
_TWO = "two AS (SELECT vec_id AS id, label % 3 AS ref, (label % 3 + CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END) % 3 AS lab FROM embeddings)"
_MATCH = f"""{_TWO}, perm(p, x) AS (VALUES (0, [0, 1, 2]), (1, [0, 2, 1]), (2, [1, 0, 2]), (3, [1, 2, 0]), (4, [2, 0, 1]), (5, [2, 1, 0])),
best AS (SELECT x FROM (SELECT p, x, sum(CASE WHEN x[lab + 1] = ref THEN 1 ELSE 0 END) AS n FROM two, perm GROUP BY 1, 2) ORDER BY n DESC, p LIMIT 1)"""
SQL["match_labels"] = f"WITH {_MATCH} SELECT id, CAST(x[lab + 1] AS BIGINT) AS lab FROM two, best"
SQL["label_agreement"] = f"WITH {_MATCH} SELECT {_r('avg(CASE WHEN x[lab + 1] = ref THEN 1.0 ELSE 0.0 END)')} AS agreement FROM two, best"
SQL["ari"] = f"""WITH {_TWO}, x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM two GROUP BY lab, ref)) AS s, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM two GROUP BY lab)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM two GROUP BY ref)) AS sb, (SELECT count(*) * (count(*) - 1) / 2 FROM two) AS t)
SELECT {_r('(s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)')} AS ari FROM x"""
SQL["purity"] = f"WITH {_TWO} SELECT {_r('sum(m) / sum(n)')} AS purity FROM (SELECT lab, max(n) AS m, sum(n) AS n FROM (SELECT lab, ref, count(*) AS n FROM two GROUP BY 1, 2) GROUP BY 1)"
SQL["name_regions"] = f"WITH {_PLACES}, o AS (SELECT lab, row_number() OVER (ORDER BY avg(lon), lab) - 1 AS x FROM lab JOIN places USING (id) GROUP BY lab) SELECT id, x AS lab FROM lab JOIN o USING (lab)"
SQL["grid_edges"] = f"WITH {_GRID} SELECT i, j FROM grid"
SQL["vertex_edges"] = f"WITH {_GRID} SELECT DISTINCT least(i // 2, j // 2) AS i, greatest(i // 2, j // 2) AS j FROM grid WHERE i // 2 <> j // 2"
SQL["contiguity"] = f"WITH {_GRID} SELECT {_r('(SELECT avg(CASE WHEN a.lab = b.lab THEN 1.0 ELSE 0.0 END) FROM grid JOIN lab a ON a.id = i JOIN lab b ON b.id = j)')} AS contiguity, {_r('(SELECT sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) FROM (SELECT count(*) AS n FROM lab GROUP BY lab))')} AS chance"
_OUT = "outside AS (SELECT n_nationkey AS gid, CASE WHEN n_regionkey < 3 THEN n_regionkey END AS grp, 39.9 - 0.2 * n_nationkey AS lat, 73.1 + 0.2 * (n_nationkey * 7 % 25) AS lon FROM nation)"
_CHECK = f"""{_PLACES}, {_OUT}, near AS (SELECT gid, grp, id FROM (SELECT a.gid, a.grp, b.id, row_number() OVER (PARTITION BY a.gid ORDER BY {_KM}, b.id) AS k FROM outside a, places b) WHERE k = 1),
n AS (SELECT grp, lab, count(*) AS n FROM near JOIN lab USING (id) WHERE grp IS NOT NULL GROUP BY 1, 2),
best AS (SELECT grp, lab, n AS hits, sum(n) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY n DESC, lab) AS k FROM n)"""
SQL["nearest_group_check"] = f"WITH {_CHECK} SELECT grp, lab, hits, CAST(n AS BIGINT) AS n FROM best WHERE k = 1"
SQL["nearest_group_scores"] = f"WITH {_CHECK} SELECT count(DISTINCT lab) = count(*) AS recovered, {_r('sum(hits) / sum(n)')} AS purity FROM best WHERE k = 1"
_MAPD = f"{_HELL}, {_GRID}, md AS (SELECT least(g.i, g.j) AS i, greatest(g.i, g.j) AS j, d FROM grid g JOIN hd ON hd.i = g.i AND hd.j = g.j)"
SQL["border_distance"] = f"""WITH {_MAPD}, x AS (SELECT d, a.lab <> b.lab AS k FROM md JOIN lab a ON a.id = i JOIN lab b ON b.id = j)
SELECT {_r('(SELECT quantile_cont(d, 0.5) FROM x WHERE NOT k)')} AS within, {_r('(SELECT quantile_cont(d, 0.5) FROM x WHERE k)')} AS across, {_r('(SELECT avg(CASE WHEN k THEN 1.0 ELSE 0.0 END) FROM x WHERE d >= (SELECT quantile_cont(d, 0.9) FROM x))')} AS top_on_border, {_r('(SELECT avg(CASE WHEN k THEN 1.0 ELSE 0.0 END) FROM x)')} AS border_share"""
SQL["edge_darkness"] = f"WITH {_MAPD} SELECT i, j, {_r('d')} AS d, {_r('least(d / (SELECT quantile_cont(d, 0.98) FROM md), 1.0)')} AS dark FROM md"
_SHARP = f"""{_PLACES}, {_PTS}, q AS (SELECT id, CAST(k.range AS INT) AS k, v[k.range + 1] AS x FROM pts, range(3) k), sd AS (SELECT k, stddev_pop(x) AS sd FROM q GROUP BY 1),
g AS (SELECT p.id, p.r, p.c, q.k, q.x / sd.sd AS x FROM q JOIN sd USING (k) JOIN places p USING (id)),
st AS (SELECT g.id, g.k, CASE WHEN g.r = 0 THEN dn.x - g.x WHEN g.r = 9999 THEN g.x - up.x ELSE (dn.x - up.x) / 2 END AS gr, CASE WHEN g.c = 0 THEN rt.x - g.x WHEN g.c = 24 THEN g.x - lf.x ELSE (rt.x - lf.x) / 2 END AS gc
  FROM g LEFT JOIN g dn ON dn.k = g.k AND dn.r = g.r + 1 AND dn.c = g.c LEFT JOIN g up ON up.k = g.k AND up.r = g.r - 1 AND up.c = g.c LEFT JOIN g rt ON rt.k = g.k AND rt.r = g.r AND rt.c = g.c + 1 LEFT JOIN g lf ON lf.k = g.k AND lf.r = g.r AND lf.c = g.c - 1),
sharp AS (SELECT id, sqrt(sum(coalesce(gr * gr + gc * gc, 0.0))) AS sharp FROM st GROUP BY 1)"""
SQL["border_sharpness"] = f"WITH {_SHARP} SELECT id, {_r('sharp')} AS sharp FROM sharp"
_CLASSES = """touch AS (SELECT DISTINCT t.id, o.lab AS own, n.lab AS other FROM (SELECT i AS id, j AS k FROM grid UNION SELECT j, i FROM grid) t JOIN lab o ON o.id = t.id JOIN lab n ON n.id = t.k WHERE o.lab <> n.lab),
cls AS (SELECT id, least(own, other) || '|' || greatest(own, other) AS border FROM touch UNION ALL SELECT id, 'none' FROM lab WHERE id NOT IN (SELECT id FROM touch))"""
SQL["border_classes"] = f"WITH {_GRID}, {_CLASSES} SELECT id, border FROM cls"
SQL["elevation_eta2"] = f"WITH x AS (SELECT s_nationkey % 3 AS lab, s_acctbal AS x FROM supplier), a AS (SELECT avg(x) AS m, sum(power(x - (SELECT avg(x) FROM x), 2)) AS t FROM x) SELECT {_r('(SELECT sum(n * power(g - m, 2)) / any_value(t) FROM (SELECT count(*) AS n, avg(x) AS g FROM x GROUP BY lab), a)')} AS eta2"
SQL["covariate_corr"] = f"WITH {_PLACES}, {_PTS} SELECT {_r('abs(corr(v[1], lon))')} AS climate FROM pts JOIN places USING (id) WHERE elev BETWEEN 3400 AND 5000"
SQL["kept_years"] = f"""WITH {_PLACES}, y AS (SELECT id, lab, range AS year FROM lab, range(14) WHERE (id + range) % 11 <> 0), k AS (SELECT lab.id, lab.lab, coalesce(sum(CASE WHEN (y.id * 3 + year) % 4 = 0 THEN 0 WHEN year IS NULL THEN 0 ELSE 1 END), 0) AS kept FROM lab LEFT JOIN y ON y.id = lab.id GROUP BY 1, 2)
SELECT lab, {_r('avg(CASE WHEN kept >= 11 THEN 1.0 ELSE 0.0 END)')} AS core, {_r('avg(CASE WHEN kept <= 9 THEN 1.0 ELSE 0.0 END)')} AS transition FROM k GROUP BY 1"""
_INACTIVE = f"{_CURVES}, ina AS (SELECT year, sum(CASE WHEN z > 300 THEN 0 ELSE 1 END) AS inactive FROM (SELECT pixel, year, sum(v) AS z FROM long GROUP BY 1, 2) GROUP BY 1)"
SQL["inactive_years"] = f"WITH {_INACTIVE} SELECT year, CAST(inactive AS BIGINT) AS inactive FROM ina"
SQL["sensor_check"] = f"WITH {_INACTIVE} SELECT {_r('avg(inactive) FILTER (year < 3)')} AS inactive_before, {_r('avg(inactive) FILTER (year >= 3)')} AS inactive_after FROM ina"
SQL["medoids"] = f"WITH {_HELL}, {_PLACES}, m AS (SELECT a.lab, hd.i, avg(d) AS d FROM hd JOIN lab a ON a.id = hd.i JOIN lab b ON b.id = hd.j WHERE a.lab = b.lab GROUP BY 1, 2) SELECT lab, i AS id, {_r('d')} AS d FROM (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY d, i) AS k FROM m) WHERE k = 1"
_MAIN = (1, 7, 15, 31, 61)
SQL["medoid_hog"] = f"""WITH {_CURVES}, {_rates('r', (7,))}, {_hist('r')}, {_blocks()}, {_MEAN},
pd AS (SELECT a.pixel AS i, b.pixel AS j, sqrt(greatest(sum(power(sqrt(a.v) - sqrt(b.v), 2)), 0)) / sqrt(2) AS d FROM one a JOIN one b ON a.f = b.f AND a.pixel % 3 = b.pixel % 3 AND a.pixel <> b.pixel GROUP BY 1, 2),
away AS (SELECT i, avg(d) AS d FROM pd GROUP BY 1),
md AS (SELECT i FROM (SELECT *, row_number() OVER (PARTITION BY i % 3 ORDER BY d, i) AS k FROM away) WHERE k = 1),
cm AS (SELECT pixel, 0 AS year, list(v ORDER BY day) AS s FROM (SELECT pixel, day, avg(v) AS v FROM long WHERE pixel IN (SELECT i FROM md) GROUP BY 1, 2) GROUP BY 1),
slopes AS (SELECT * FROM (WITH {_rates('q', _MAIN).replace('FROM c,', 'FROM cm,')}, {_hist('q')} SELECT pixel, lag, cell, bin, h FROM hist))
SELECT pixel, lag, cell, bin, {_r('h / greatest(max(h) OVER (PARTITION BY pixel, lag), 1e-9)')} AS v FROM slopes"""
SQL["distance_histogram"] = f"WITH {_HELL}, x AS (SELECT {_r('d')} AS d FROM hd WHERE i < j) SELECT CAST(least(floor(d / (1.0 / 80)), 79) AS INT) AS bin, count(*) AS n FROM x WHERE d BETWEEN 0 AND 1 GROUP BY 1"
SQL["distance_sample"] = f"WITH {_HELL}, x AS (SELECT i, j, {_r('d')} AS d, row_number() OVER (ORDER BY i, j) - 1 AS place FROM hd WHERE i < j) SELECT * FROM x WHERE place % 50 = 0"
SQL["degree_histogram"] = f"WITH {_DEGREES} SELECT degree - (degree - (SELECT min(degree) FROM deg)) % 2 AS low, count(*) AS n FROM deg GROUP BY 1"
SQL["clustering_histogram"] = f"WITH {_DEGREES}, x AS (SELECT {_r('cc')} AS cc FROM cc), m AS (SELECT min(cc) AS a, max(cc) AS b FROM x) SELECT CAST(CASE WHEN a = b THEN 0 ELSE least(floor((cc - a) / (b - a) * 50), 49) END AS INT) AS bin, count(*) AS n FROM x, m GROUP BY 1"
SQL["clustering_summary"] = f"WITH {_DEGREES} SELECT {_r('quantile_cont(cc, 0.05)')} AS cc_q05, {_r('quantile_cont(cc, 0.5)')} AS cc_median, {_r('quantile_cont(cc, 0.95)')} AS cc_q95, {_r('avg(cc)')} AS cc_mean, {_r('avg(degree) / (count(*) - 1)')} AS random_graph_cc FROM cc"
SQL["matrix_order"] = f"WITH {_PLACES}, o AS (SELECT id, row_number() OVER (ORDER BY lab, lon, id) - 1 AS n FROM lab JOIN places USING (id)) SELECT id, n // 3 AS place FROM o WHERE n % 3 = 0"
SQL["painted_map"] = f"WITH {_PLACES}, v AS (SELECT id // 2 AS x, avg(id % 9) AS v FROM places GROUP BY 1) SELECT r, c, v FROM places JOIN v ON x = id // 2"
SQL["mark_places"] = f"WITH {_OUT} SELECT grp AS region, {_r('avg(lon)')} AS lon, {_r('avg(lat)')} AS lat FROM outside WHERE grp IS NOT NULL GROUP BY 1"
SQL["components_by_k"] = f"WITH {_COMP} SELECT k, id, comp FROM label"
SQL["first_connected_k"] = f"WITH {_COMP}, n AS (SELECT k, count(DISTINCT comp) AS n_comp FROM label GROUP BY 1) SELECT k, n_comp, k = coalesce((SELECT min(k) FROM n WHERE n_comp = 1), 1) AS first FROM n"
SQL["season_graph_degree"] = f"""WITH {_CURVES}, {_rates('r', (7,))}, {_hist('r')}, {_blocks()}, {_MEAN}, q AS (SELECT pixel AS id, list(sqrt(v) ORDER BY f) AS q FROM one GROUP BY 1),
hd AS (SELECT a.id AS i, b.id AS j, list_distance(a.q, b.q) AS d FROM q a, q b WHERE a.id <> b.id), near AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM hd) WHERE k <= 21)
SELECT src AS id, count(*) AS degree FROM (SELECT i AS src, j AS dst FROM near UNION SELECT j, i FROM near) GROUP BY 1"""
_CLIM = f"{_CURVES}, m AS (SELECT pixel, day, avg(v) AS v FROM long GROUP BY 1, 2)"
SQL["example_rates"] = f"""WITH {_CLIM}, f AS (SELECT min(pixel) AS pixel FROM m GROUP BY pixel % 3), a AS (SELECT pixel, list(v ORDER BY day) AS s FROM m GROUP BY 1)
SELECT pixel, CAST(range AS INT) AS day, {_r('(s[least(range + 4, 364) + 1] - s[greatest(range - 3, 0) + 1]) / 7')} AS lag7, {_r('(s[least(range + 16, 364) + 1] - s[greatest(range - 15, 0) + 1]) / 31')} AS lag31 FROM a JOIN f USING (pixel), range(365)"""
SQL["small_components"] = f"""WITH {_COMP}, {_PLACES}, sz AS (SELECT k, comp, count(*) AS n FROM label GROUP BY 1, 2),
top AS (SELECT k, max(n) AS most, arg_max(comp, n * 1000000000 - comp) AS giant FROM sz GROUP BY 1),
few AS (SELECT k, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS sizes FROM sz JOIN top USING (k) WHERE n < most GROUP BY 1)
SELECT l.k, count(DISTINCT l.comp) AS n_comp, count(*) AS n_vertices, coalesce(any_value(few.sizes), '') AS sizes, CAST(min(lon) AS DOUBLE) AS lon_min, CAST(max(lon) AS DOUBLE) AS lon_max, {_r('avg(CASE WHEN lon > 75 THEN 1.0 ELSE 0.0 END)')} AS share_east, {_r('quantile_cont(CAST(elev AS DOUBLE), 0.5)')} AS elev_median, {_r('quantile_cont(CAST(active_days AS DOUBLE), 0.5)')} AS active_median
FROM label l JOIN top ON top.k = l.k LEFT JOIN few ON few.k = l.k JOIN places p ON p.id = l.id WHERE l.comp <> top.giant GROUP BY l.k"""
_AFTER = lambda text, head: text.replace(head + ",\n", "", 1)
SQL["border_stats"] = f"""WITH {_SHARP}, {_AFTER(_DEGREES, _PTS)}, {_AFTER(_GRID, _PLACES)}, {_CLASSES}
SELECT border, count(*) AS n, {_r(f"quantile_cont({_r('sharp')}, 0.5)")} AS sharp, {_r('avg(CASE WHEN cls.id % 15 <= 7 THEN 1.0 ELSE 0.0 END)')} AS switching, {_r('quantile_cont(cc, 0.5)')} AS cc FROM cls JOIN sharp USING (id) JOIN cc USING (id) GROUP BY border"""
SQL["region_profile"] = f"""WITH {_CLIM}, own AS (SELECT DISTINCT pixel, pixel % 3 AS lab FROM m),
part AS (SELECT lab, pixel, coalesce(min(day) FILTER (v > 0.3 * top), 0) AS a, coalesce(max(day) FILTER (v > 0.3 * top), max(day)) AS b FROM (SELECT *, max(v) OVER (PARTITION BY pixel) AS top FROM m) JOIN own USING (pixel) GROUP BY 1, 2),
span AS (SELECT lab, quantile_cont(a, 0.5) AS "start", quantile_cont(b, 0.5) AS "end" FROM part GROUP BY 1),
curve AS (SELECT lab, day, avg(v) AS v FROM m JOIN own USING (pixel) GROUP BY 1, 2),
peak AS (SELECT lab, max(v) AS peak FROM curve GROUP BY 1),
peaks AS (SELECT lab, any_value(peak) AS peak, min(day) AS peak_day FROM curve JOIN peak USING (lab) WHERE v = peak GROUP BY 1),
mid AS (SELECT lab, count(*) AS n, {_r('avg(73 + 0.25 * (pixel % 25))')} AS lon, {_r('avg(40 - 0.25 * (pixel // 25))')} AS lat, {_r('avg(3000.0 + pixel * 7919 % 3001)')} AS elev, {_r('avg(60.0 + pixel * 31 % 211)')} AS active_days FROM own GROUP BY 1)
SELECT lab, n, lon, lat, elev, active_days, "start", "end", {_r('peak')} AS peak, peak_day FROM mid JOIN span USING (lab) JOIN peaks USING (lab)"""
