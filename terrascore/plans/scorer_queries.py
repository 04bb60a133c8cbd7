"""Queries of the scorers around places and of buildings' records, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascore.operators import buildings, scorers, spatial, stats
from terrascore.operators import surroundings as around
from terrascore.plans.registry import HAV, NEAREST, near_sql, pts, query
from terrascore.sources.views import AS_OF_EVENTS, AS_OF_ORDERS, view, view_sql


def places(spark, d):
    return view(spark, d, "listings").select("id", "lat", "lon")


def dist(left: str, right: str) -> str:
    return HAV(a=f"{left}.lat", b=f"{left}.lon", c=f"{right}.lat", d=f"{right}.lon")


def kernel(left: str, right: str, sigma: float) -> str:
    return f"exp(-pow({dist(left, right)} / {sigma}, 2))"


def age(day: str, as_of: str, half: float = 180.0) -> str:
    return f"CASE WHEN {day} IS NULL THEN 0.5 ELSE pow(0.5, greatest(DATE '{as_of}' - {day}, 0) / {half}) END"


def units_sql(radius: float, name: str = "u") -> str:
    return f"{name} AS (SELECT l.id, greatest(coalesce(sum(t.unitsres * {kernel('l', 't', radius / 2)}), 0), 25) AS units FROM listings l LEFT JOIN lots t ON {near_sql('l', 't', radius)} GROUP BY 1)"


def season_sql(table: str, month: int, name: str = "season") -> str:
    return f"{name} AS (SELECT CASE WHEN count(*) < 10 OR sum(c) < 1000 THEN 1.0 ELSE greatest(0.25, least(4.0, coalesce(max(CASE WHEN m = {month} THEN c END), avg(c)) / avg(c))) END AS factor FROM (SELECT extract(month FROM day) AS m, count(*) AS c FROM {table} WHERE day IS NOT NULL GROUP BY 1))"


def ratio_sql(recent: str, older: str) -> str:
    return f"round(CASE WHEN {older} = 0 THEN CASE WHEN {recent} > 0 THEN 2.0 ELSE 1.0 END ELSE {recent} / {older} END, 3)"


def turn_sql(ratio: str) -> str:
    return f"CASE WHEN {ratio} < 0.85 THEN 'improving' WHEN {ratio} > 1.15 THEN 'worsening' ELSE 'stable' END"


def length_sql() -> str:
    return "sqrt(pow((a2 - a1) * 111320.0, 2) + pow((o2 - o1) * 85000.0, 2))"


def path_sql(pairs: str, to: str, key: str = "id") -> str:
    """CTEs from pairs (key, a1, o1, a2, o2) to to(key, penalty), the runs of samples near streets with a penalty."""
    return f"""{to}_k AS (SELECT *, CAST(floor({length_sql()} / 20) AS BIGINT) AS n FROM {pairs} WHERE {length_sql()} > 40), {to}_s AS (SELECT {key}, a1, o1, a2, o2, n, unnest(range(1, n)) AS i FROM {to}_k),
{to}_p AS (SELECT {key}, i, a1 + (a2 - a1) * (i / n) AS lat, o1 + (o2 - o1) * (i / n) AS lon FROM {to}_s), {to}_g AS (SELECT s.lat, s.lon, s.penalty, floor(s.lat / 0.0003) + x AS gx, floor(s.lon / 0.0003) + y AS gy FROM streets s, (VALUES (-1), (0), (1)) AS vx(x), (VALUES (-1), (0), (1)) AS vy(y) WHERE s.penalty IS NOT NULL),
{to}_h AS (SELECT p.{key}, p.i, max(r.penalty) AS v FROM {to}_p p JOIN {to}_g r ON floor(p.lat / 0.0003) = r.gx AND floor(p.lon / 0.0003) = r.gy AND {near_sql('p', 'r', 22.0)} GROUP BY 1, 2),
{to}_m AS (SELECT p.{key}, p.i, h.v, lag(h.v) OVER (PARTITION BY p.{key} ORDER BY p.i) AS b FROM {to}_p p LEFT JOIN {to}_h h ON p.{key} = h.{key} AND p.i = h.i), {to} AS (SELECT {key}, sum(v) AS penalty FROM {to}_m WHERE v IS NOT NULL AND b IS NULL GROUP BY 1)"""


def rows_sql(pairs: str, to: str) -> str:
    """CTEs from pairs (id, a1, o1, a2, o2) to to(id, n_rows), the rows of tall lots on the way."""
    return f"""{to}_k AS (SELECT *, {length_sql()} AS len, CAST(floor({length_sql()} / 25) AS BIGINT) AS n FROM {pairs} WHERE {length_sql()} > 45), {to}_s AS (SELECT id, a1, o1, a2, o2, len, n, unnest(range(1, n)) AS i FROM {to}_k),
{to}_p AS (SELECT id, i, a1 + (a2 - a1) * (i / n) AS lat, o1 + (o2 - o1) * (i / n) AS lon FROM {to}_s WHERE len * (i / n) >= 20 AND len - len * (i / n) >= 20), {to}_h AS (SELECT DISTINCT p.id, p.i, 1 AS v FROM {to}_p p JOIN lots r ON r.numfloors >= 3 AND {near_sql('p', 'r', 18.0)}),
{to}_m AS (SELECT p.id, p.i, h.v, lag(h.v) OVER (PARTITION BY p.id ORDER BY p.i) AS b FROM {to}_p p LEFT JOIN {to}_h h ON p.id = h.id AND p.i = h.i), {to} AS (SELECT id, count(*) AS n_rows FROM {to}_m WHERE v IS NOT NULL AND b IS NULL GROUP BY 1)"""


def streets(spark, d):
    return view(spark, d, "streets")


def severing(spark, d):
    return streets(spark, d).where("penalty is not null")


@query("jn08_occluding_rows", view_sql("listings", "lots") + f", q AS (SELECT id, lat AS a1, lon AS o1, lat + 0.005 AS a2, lon + 0.004 AS o2 FROM listings), {rows_sql('q', 'x')} SELECT listings.id, coalesce(n_rows, 0) AS n_rows FROM listings LEFT JOIN x USING (id)")
def jn08(spark, d):
    pairs = places(spark, d).select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), (F.col("lat") + 0.005).alias("lat2"), (F.col("lon") + 0.004).alias("lon2"))
    return spatial.occluding_rows(pairs, pts(view(spark, d, "lots").where("numfloors >= 3")), key="id").withColumnRenamed("rows", "n_rows")


@query("jn09_blocked_midpoint", view_sql("listings", "lots") + f", m AS (SELECT id, (lat + (lat + 0.001)) / 2 AS lat, (lon + (lon + 0.001)) / 2 AS lon FROM listings) SELECT DISTINCT m.id, TRUE AS hidden FROM m JOIN lots t ON t.numfloors >= 3 AND {near_sql('m', 't', 18.0)}")
def jn09(spark, d):
    pairs = places(spark, d).withColumns({"r_lat": F.col("lat") + 0.001, "r_lon": F.col("lon") + 0.001})
    return spatial.shielded(pairs, pts(view(spark, d, "lots").where("numfloors >= 3"))).select("id", "hidden")


NOISE_TYPES = ", ".join(f"'{t}'" for t in around.NOISE_CAPS)


@query("sc05_noise", view_sql("listings", "complaints", "licences", "lots") + f""", c AS (SELECT l.id, c.type, round(c.lat, 4) AS a, round(c.lon, 4) AS o, sum({kernel('l', 'c', 75.0)} * {age('c.day', AS_OF_EVENTS)} * CASE WHEN c.type = 'Noise' AND contains(lower(c.descriptor), 'after hours') THEN 1.2 ELSE 1.0 END) AS w, count(*) AS n, count(*) FILTER (c.day >= DATE '{AS_OF_EVENTS}' - 182) AS recent FROM listings l JOIN complaints c ON c.type IN ({NOISE_TYPES}) AND {near_sql('l', 'c', 150.0)} GROUP BY 1, 2, 3, 4),
p AS (SELECT id, sum(n) AS n, sum(recent) AS recent, sum(least(w, CASE type {' '.join(f"WHEN '{t}' THEN {w}" for t, w in around.NOISE_CAPS.items())} END)) AS weighted FROM c GROUP BY 1), lw AS (SELECT *, CASE WHEN contains(lower(description), 'grocery') THEN NULL WHEN contains(lower(description), 'cabaret') OR contains(lower(description), 'tavern') THEN 1.5 WHEN contains(lower(description), 'restaurant') THEN 0.6 ELSE 1.0 END AS lw FROM licences WHERE expires IS NULL OR expires >= DATE '{AS_OF_EVENTS}'),
g AS (SELECT l.id, sum(w.lw * {kernel('l', 'w', 75.0)}) AS nightlife FROM listings l JOIN lw w ON w.lw IS NOT NULL AND {near_sql('l', 'w', 150.0)} GROUP BY 1), {units_sql(150.0)}, {season_sql('complaints', int(AS_OF_EVENTS[5:7]))},
r AS (SELECT l.id, CAST(coalesce(n, 0) AS BIGINT) AS complaints, round(coalesce(weighted, 0), 3) AS weighted, round(coalesce(nightlife, 0), 3) AS nightlife, coalesce(recent, 0) AS recent, u.units, factor FROM listings l LEFT JOIN p USING (id) LEFT JOIN g USING (id) JOIN u USING (id) CROSS JOIN season), t AS (SELECT *, round(1000 * (weighted / factor + 0.3 * nightlife) / greatest(units, 150), 3) AS rate, {ratio_sql('recent', '(complaints - recent)')} AS trend_ratio FROM r), m AS (SELECT CASE WHEN median(rate) = 0 THEN 1.0 ELSE median(rate) END AS med FROM t)
SELECT id, complaints, weighted, nightlife, rate, trend_ratio, {turn_sql('trend_ratio')} AS trend_direction, round(greatest(0, 100 - 50 * rate / med), 4) AS score FROM t, m""")
def sc05(spark, d):
    v = lambda n: view(spark, d, n)
    out = around.score_against(around.noise(places(spark, d), v("complaints"), v("licences"), v("lots"), AS_OF_EVENTS), "rate", None, True, True, around.by_median("rate", "id"))
    return out.withColumn("score", F.round("score", 4))


@query("sc03_transit", view_sql("listings", "entrances", "stations", "stops", "streets") + f""", e AS (SELECT l.id, l.lat AS a1, l.lon AS o1, e.station_id, e.routes, e.lat AS a2, e.lon AS o2, {dist('l', 'e')} AS m FROM listings l JOIN entrances e ON {near_sql('l', 'e', 800.0)}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY floor(m), m, station_id, a2, o2) AS k FROM e) WHERE k = 1), {path_sql('b', 'x')},
sr AS (SELECT unnest(string_split(routes, ' ')) AS route, cbd = 'TRUE' AS c FROM stations), central AS (SELECT route, bool_or(c) AS central FROM sr GROUP BY 1), er AS (SELECT DISTINCT id, unnest(string_split(routes, ' ')) AS route FROM e), rr AS (SELECT er.id, count(*) AS served, count(*) FILTER (CASE WHEN (SELECT bool_or(central) FROM central) THEN coalesce(central, TRUE) ELSE er.route NOT IN ('G', 'SIR') END) AS cbd FROM er LEFT JOIN central USING (route) GROUP BY 1),
s AS (SELECT id, count(DISTINCT station_id) AS stations FROM e GROUP BY 1), ada AS (SELECT DISTINCT e.id, 1 AS ada FROM e JOIN stations t ON t.station_id = e.station_id AND CAST(t.ada AS INT) >= 1), bus AS (SELECT id, count(DISTINCT trim(r)) AS bus FROM (SELECT l.id, unnest(string_split(t.routes, ',')) AS r FROM listings l JOIN stops t ON {near_sql('l', 't', 300.0)}) GROUP BY 1),
f AS (SELECT l.id, coalesce(stations, 0) AS station_count, coalesce(served, 0) AS routes_served, CAST(coalesce(floor(m), 9999) AS INT) AS nearest_m, coalesce(bus, 0) AS bus_routes, coalesce(ada, 0) AS ada_nearby, coalesce(cbd, 0) AS cbd_routes, CAST(coalesce(penalty, 0) AS INT) AS severance_m FROM listings l LEFT JOIN s USING (id) LEFT JOIN rr USING (id) LEFT JOIN b USING (id) LEFT JOIN bus USING (id) LEFT JOIN ada USING (id) LEFT JOIN x USING (id))
SELECT *, round(greatest(0, least(100, 100 * exp(-least(9999, nearest_m + severance_m) / 400) * (0.6 + 0.4 * least(1.0, (cbd_routes + 0.45 * (routes_served - cbd_routes)) / 6)) + least(10.0, 2.0 * bus_routes))), 1) AS score FROM f""")
def sc03(spark, d):
    v = lambda n: view(spark, d, n)
    return around.transit(places(spark, d), v("entrances"), v("stations"), v("stops"), severing(spark, d))


@query("sc03b_transit_simple", view_sql("listings", "stations") + f""", e AS (SELECT l.id, s.station_id, s.routes, {dist('l', 's')} AS m FROM listings l JOIN stations s ON {near_sql('l', 's', 800.0)}), a AS (SELECT id, count(*) AS n, floor(min(m)) AS m FROM e GROUP BY 1), r AS (SELECT id, count(DISTINCT r) AS served FROM (SELECT id, unnest(string_split(routes, ' ')) AS r FROM e) GROUP BY 1)
SELECT l.id, coalesce(n, 0) AS station_count, coalesce(served, 0) AS routes_served, CAST(coalesce(m, 9999) AS INT) AS nearest_m, CAST(least(100, 12 * coalesce(n, 0) + 3 * coalesce(served, 0)) AS DOUBLE) AS score FROM listings l LEFT JOIN a USING (id) LEFT JOIN r USING (id)""")
def sc03b(spark, d):
    return around.transit_simple(places(spark, d), view(spark, d, "stations").withColumn("routes", F.split("routes", " ")))


def squares(spark, d):
    """Parks with their outlines, squares around the centre."""
    p = view(spark, d, "parks")
    at = lambda x, y: F.array(F.col("lon") + x * F.col("size"), F.col("lat") + y * F.col("size"))
    return p, spatial.segments(p.withColumn("ring", F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))), "park_id")


#: The same outlines as edges in SQL.
EDGES = "edges AS (SELECT park_id, lat + size * y1 AS b1, lon + size * x1 AS p1, lat + size * y2 AS b2, lon + size * x2 AS p2 FROM parks, (VALUES (-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1)) AS v(x1, y1, x2, y2))"
FLAT = "(CAST(6371008.8 AS DOUBLE) * 3.141592653589793 / 180)"
SEGMENT = f"(SELECT l.id, p.park_id, min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) AS m FROM (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM (SELECT *, bx - ax AS dx, by_ - ay AS dy FROM (SELECT l.id, p.park_id, (e.p1 - l.lon) * {FLAT} * cos(radians(l.lat)) AS ax, (e.b1 - l.lat) * {FLAT} AS ay, (e.p2 - l.lon) * {FLAT} * cos(radians(l.lat)) AS bx, (e.b2 - l.lat) * {FLAT} AS by_ FROM listings l JOIN parks p ON abs(l.lat - p.lat) <= {{delta}} AND abs(l.lon - p.lon) <= {{delta}} JOIN edges e USING (park_id)))) GROUP BY 1, 2)".replace("SELECT l.id, p.park_id, min", "SELECT id, park_id, min")


@query("jn10_edge_distance", view_sql("listings", "parks") + f", {EDGES}, x AS {SEGMENT.format(delta=0.004)} SELECT id, park_id, round(m, 4) AS edge_m FROM x")
def jn10(spark, d):
    p, edges = squares(spark, d)
    return spatial.per_spot(places(spark, d), lambda at: spatial.edge_distance(at, p, edges, 0.004)).select("id", "park_id", F.round("edge_m", 4).alias("edge_m"))


@query("jn11_contains", view_sql("listings", "parks") + " SELECT l.id, p.park_id, l.lat >= p.lat - p.size AND l.lat < p.lat + p.size AND l.lon >= p.lon - p.size AND l.lon < p.lon + p.size AS inside FROM listings l JOIN parks p ON abs(l.lat - p.lat) <= 0.004 AND abs(l.lon - p.lon) <= 0.004")
def jn11(spark, d):
    p, edges = squares(spark, d)
    return spatial.contains(places(spark, d), p, edges, 0.004)


TIER = lambda at: " ".join(f"WHEN acres >= {t[0]} THEN {float(t[at])}" for t in around.PARK_TIERS)


@query("sc12_parks", view_sql("listings", "parks", "streets") + f""", {EDGES}, x AS {SEGMENT.format(delta=repr(around.PARK_DELTA))}, q AS (SELECT *, CASE {TIER(1)} END AS quality, CASE {TIER(2)} END AS reach, CASE lower(type) {' '.join(f"WHEN '{k}' THEN {w}" for k, w in around.PARK_TYPES.items())} ELSE 1.0 END AS mult FROM parks), c AS (SELECT x.id, x.m, q.*, concat(CAST(x.id AS VARCHAR), '/', CAST(x.park_id AS VARCHAR)) AS pair FROM x JOIN q USING (park_id) WHERE x.m < q.reach),
ways AS (SELECT c.pair, l.lat AS a1, l.lon AS o1, c.lat AS a2, c.lon AS o2 FROM c JOIN listings l USING (id)), {path_sql('ways', 'y', 'pair')}, e AS (SELECT c.*, coalesce(penalty, 0) AS sev FROM c LEFT JOIN y USING (pair)), f AS (SELECT *, (1 - (m + sev) / reach) * quality * mult * 100 AS eff FROM e WHERE m + sev < reach), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY eff DESC, park_id) AS k FROM f)
SELECT l.id, b.name, b.acres, b.type, b.mult AS type_mult, CAST(floor(b.m) AS INT) AS distance_m, round(b.sev, 1) AS severance_m, round(coalesce(b.eff, 0), 4) AS effective FROM listings l LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (id)""")
def sc12(spark, d):
    p, edges = squares(spark, d)
    return around.parks(places(spark, d), p, edges, severing(spark, d)).withColumn("effective", F.round("effective", 4))


DOTS = "dots AS (SELECT l.id, i, l.lat + 200.0 * sqrt((i + 0.5) / 180) * sin(i * (pi() * (3 - sqrt(5.0)))) / 111320.0 AS a, l.lon + 200.0 * sqrt((i + 0.5) / 180) * cos(i * (pi() * (3 - sqrt(5.0)))) / (111320.0 * cos(radians(l.lat))) AS o, l.lat, l.lon FROM listings l, (SELECT unnest(range(0, 180)) AS i))"
FRACTION = f"{DOTS}, frac AS (SELECT t.id, count(DISTINCT t.i) / 180 AS f FROM dots t JOIN parks p ON abs(t.lat - p.lat) <= 0.03 AND abs(t.lon - p.lon) <= 0.03 AND t.a >= p.lat - p.size AND t.a < p.lat + p.size AND t.o >= p.lon - p.size AND t.o < p.lon + p.size GROUP BY 1)"


@query("jn12_park_fraction", view_sql("listings", "parks") + f", {FRACTION} SELECT l.id, round(coalesce(f, 0), 6) AS fraction FROM listings l LEFT JOIN frac USING (id)")
def jn12(spark, d):
    p, edges = squares(spark, d)
    return around.park_fraction(places(spark, d), p, edges).select("id", F.round("fraction", 6).alias("fraction"))


@query("sc13_greenery", view_sql("listings", "parks", "trees", "gardens") + f""", {FRACTION}, t AS (SELECT l.id, count(*) AS n, CAST(sum(least(floor(t.dbh), 36)) AS BIGINT) AS canopy, sum({kernel('l', 't', 100.0)}) AS tw, sum({kernel('l', 't', 100.0)} * least(floor(t.dbh), 36)) AS cw FROM listings l JOIN trees t ON {near_sql('l', 't', 200.0)} GROUP BY 1), g AS (SELECT l.id, count(*) AS n, sum({kernel('l', 'g', 250.0)}) AS gw FROM listings l JOIN gardens g ON {near_sql('l', 'g', 500.0)} GROUP BY 1), p AS (SELECT l.id, count(*) AS n FROM listings l JOIN parks p ON abs(l.lat - p.lat) <= 0.005 AND abs(l.lon - p.lon) <= 0.005 GROUP BY 1),
x AS (SELECT l.id, coalesce(t.n, 0) AS tree_count, coalesce(canopy, 0) AS canopy, coalesce(g.n, 0) AS garden_count, coalesce(p.n, 0) AS park_count, least(coalesce(f, 0), 0.55) AS f, coalesce(tw, 0) AS tw, coalesce(cw, 0) AS cw, coalesce(gw, 0) AS gw FROM listings l LEFT JOIN t USING (id) LEFT JOIN g USING (id) LEFT JOIN p USING (id) LEFT JOIN frac USING (id))
SELECT id, tree_count, canopy, garden_count, park_count, round(f, 3) AS park_fraction, round(tw / (1 - f) / 200 * 40 + cw / (1 - f) / 2000 * 40 + gw / 3 * 20, 3) AS weighted, round(sqrt(least(1.0, tree_count / 200)) * 40 + sqrt(least(1.0, canopy / 2000)) * 40 + sqrt(least(1.0, garden_count / 3)) * 20, 1) AS absolute FROM x""")
def sc13(spark, d):
    v, (p, edges) = (lambda n: view(spark, d, n)), squares(spark, d)
    at = places(spark, d)
    return around.greenery(at, v("trees"), v("gardens"), p, around.park_fraction(at, p, edges))


CATS = list(around.CONVENIENCE)
MOVED = "({k}((m + penalty) / 250.0) - {k}(m / 250.0))"


#: Greenery without parks around places named listings, as m(id, weighted).
UNITS_FREE = f"""gt AS (SELECT l.id, sum({kernel('l', 't', 100.0)}) AS tw, sum({kernel('l', 't', 100.0)} * least(floor(t.dbh), 36)) AS cw FROM listings l JOIN trees t ON {near_sql('l', 't', 200.0)} GROUP BY 1), gg AS (SELECT l.id, sum({kernel('l', 'g', 250.0)}) AS gw FROM listings l JOIN gardens g ON {near_sql('l', 'g', 500.0)} GROUP BY 1), m AS (SELECT l.id, round(coalesce(tw, 0) / 200 * 40 + coalesce(cw, 0) / 2000 * 40 + coalesce(gw, 0) / 3 * 20, 3) AS weighted FROM listings l LEFT JOIN gt USING (id) LEFT JOIN gg USING (id))"""


@query("sc14_convenience", view_sql("listings", "amenities", "supermarkets", "streets") + f""", n AS (SELECT l.id, l.lat AS a1, l.lon AS o1, a.key, a.category, a.lat AS a2, a.lon AS o2, {dist('l', 'a')} AS m FROM listings l JOIN amenities a ON a.category <> 'other' AND {near_sql('l', 'a', 500.0)}), c AS (SELECT id, {', '.join(f"count(*) FILTER (category = '{c}') AS {c}, coalesce(sum(exp(-pow(m / 250, 2))) FILTER (category = '{c}'), 0) AS k_{c}" for c in CATS)} FROM n GROUP BY 1),
gb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, key) AS k FROM n WHERE category = 'grocery') WHERE k = 1), {path_sql('gb', 'gp')}, gm AS (SELECT gb.id, exp(-pow((m + penalty) / 250, 2)) - exp(-pow(m / 250, 2)) AS mv FROM gb JOIN gp USING (id) WHERE penalty > 0),
sm AS (SELECT l.id, l.lat AS a1, l.lon AS o1, s.key, s.lat AS a2, s.lon AS o2, {dist('l', 's')} AS m, CASE WHEN coalesce(s.sqft, 0) >= 6000 THEN 1.5 WHEN coalesce(s.sqft, 0) >= 3000 THEN 1.0 END AS tier FROM listings l JOIN supermarkets s ON {near_sql('l', 's', 500.0)}), sa AS (SELECT id, count(tier) AS n, coalesce(sum(tier * exp(-pow(m / 250, 2))), 0) AS sm, coalesce(sum(CASE WHEN tier IS NULL THEN 0.25 * exp(-pow(m / 250, 2)) END), 0) AS small FROM sm GROUP BY 1),
sb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, key) AS k FROM sm WHERE tier IS NOT NULL) WHERE k = 1), {path_sql('sb', 'sp')}, sn AS (SELECT sb.id, round(m + coalesce(penalty, 0), 1) AS nearest, CASE WHEN penalty > 0 THEN tier * (exp(-pow((m + penalty) / 250, 2)) - exp(-pow(m / 250, 2))) ELSE 0 END AS mv FROM sb LEFT JOIN sp USING (id)),
f AS (SELECT l.id, {', '.join(f'coalesce({c}, 0) AS {c}, coalesce(k_{c}, 0) AS k_{c}' for c in CATS)}, coalesce(gm.mv, 0) + coalesce(small, 0) AS more, coalesce(sa.n, 0) AS sn, greatest(round(coalesce(sm, 0) + coalesce(sn.mv, 0), 3), 0) AS sk, sn.nearest FROM listings l LEFT JOIN c USING (id) LEFT JOIN gm USING (id) LEFT JOIN sa USING (id) LEFT JOIN sn USING (id))
SELECT id, {', '.join(CATS)}, {' + '.join(f'{c} * {around.CONVENIENCE[c][0]}' for c in CATS)} AS total, round({' + '.join(f"sqrt(least(1.0, ({'k_' + c + (' + more' if c == 'grocery' else '')}) / {around.CONVENIENCE[c][1]})) * {15.0 if c == 'grocery' else around.CONVENIENCE[c][2]}" for c in CATS)} + sqrt(least(1.0, sk / 3.0)) * 15, 2) AS weighted, sn AS supermarket_count, nearest AS supermarket_nearest_m,
round({' + '.join(f'sqrt(least(1.0, {c} / {around.CONVENIENCE[c][1]})) * {around.CONVENIENCE[c][2]}' for c in CATS)}, 1) AS absolute FROM f""")
def sc14(spark, d):
    v = lambda n: view(spark, d, n)
    return around.convenience(places(spark, d), v("amenities"), v("supermarkets"), severing(spark, d))


FACILITY_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(upper(coalesce(s.kind, '')), '{w}')''' for w in words)} THEN {k}" for words, k in around.FACILITY) + " ELSE 1.0 END"


@query("sc11_facilities", view_sql("listings", "shelters", "projects", "shootings", "complaints") + f""", s AS (SELECT l.id, s.name, {dist('l', 's')} AS m, {FACILITY_SQL} * {kernel('l', 's', 400.0)} AS w FROM listings l JOIN shelters s ON {near_sql('l', 's', 800.0)}), sa AS (SELECT id, count(*) AS n, sum(w) AS w, min(struct_pack(m := m, name := name)) AS b FROM s GROUP BY 1),
b AS (SELECT l.id, coalesce(p.development, 'unknown') AS dev, p.lat, p.lon, {dist('l', 'p')} AS m FROM listings l JOIN projects p ON {near_sql('l', 'p', 800.0)}), near_b AS (SELECT DISTINCT p.lat, p.lon, s.incident FROM (SELECT DISTINCT lat, lon FROM projects) p JOIN shootings s ON s.day >= DATE '{AS_OF_ORDERS}' - 730 AND {near_sql('p', 's', 150.0)}), v AS (SELECT b.id, b.dev, count(DISTINCT incident) AS n FROM b JOIN near_b n ON n.lat = b.lat AND n.lon = b.lon GROUP BY 1, 2),
dv AS (SELECT b.id, b.dev, min(m) AS m FROM b GROUP BY 1, 2), pa AS (SELECT dv.id, count(*) AS n, sum(CASE WHEN coalesce(v.n, 0) <= 0 THEN 0.4 WHEN v.n <= 2 THEN 1.0 ELSE 1.6 END * exp(-pow(m / 400, 2))) AS w, min(struct_pack(m := m, dev := dv.dev)) AS b FROM dv LEFT JOIN v ON v.id = dv.id AND v.dev = dv.dev GROUP BY 1),
e AS (SELECT l.id, round(c.lat, 4) AS a, round(c.lon, 4) AS o, sum({kernel('l', 'c', 100.0)} * {age('c.day', AS_OF_ORDERS)}) AS w, count(*) AS n FROM listings l JOIN complaints c ON c.type = 'Encampment' AND {near_sql('l', 'c', 200.0)} GROUP BY 1, 2, 3), ea AS (SELECT id, sum(n) AS n, sum(least(w, 6.0)) AS w FROM e GROUP BY 1)
SELECT l.id, coalesce(sa.n, 0) AS shelter_count, CAST(coalesce(floor(sa.b.m), 9999) AS INT) AS shelter_nearest_m, coalesce(sa.b.name, '') AS shelter_nearest_name, round(coalesce(sa.w, 0) + coalesce(pa.w, 0), 3) AS weighted_total, coalesce(pa.n, 0) AS project_count, CAST(coalesce(floor(pa.b.m), 9999) AS INT) AS project_nearest_m, coalesce(pa.b.dev, '') AS project_nearest_name, CAST(coalesce(ea.n, 0) AS BIGINT) AS encampment_count, round(coalesce(ea.w, 0), 3) AS encampment_weighted, round(0.5 * (coalesce(sa.w, 0) + coalesce(pa.w, 0)) + 0.5 * coalesce(ea.w, 0) / 6, 3) AS exposure FROM listings l LEFT JOIN sa USING (id) LEFT JOIN pa USING (id) LEFT JOIN ea USING (id)""")
def sc11(spark, d):
    v = lambda n: view(spark, d, n)
    return around.facilities(places(spark, d), v("shelters"), v("projects"), v("shootings"), v("complaints").where("type = 'Encampment'"), AS_OF_ORDERS)


@query("sc15_schools", view_sql("listings", "school_sites") + """, r AS (SELECT *, round((coalesce(CASE WHEN attendance > 0 THEN attendance END, 0) + coalesce(CASE WHEN safe > 0 THEN safe END, 0)) / nullif(CAST(coalesce(attendance > 0, FALSE) AS INT) + CAST(coalesce(safe > 0, FALSE) AS INT), 0) * 100, 1) AS rating FROM school_sites), b AS (SELECT l.id, r.name, r.rating, row_number() OVER (PARTITION BY l.id ORDER BY r.rating DESC, r.name) AS k FROM listings l JOIN r ON r.rating > 0 AND abs(l.lat - r.lat) <= 0.014 AND abs(l.lon - r.lon) <= 0.014)
SELECT l.id, coalesce(b.name, '') AS school, coalesce(b.rating, 0) AS rating FROM listings l LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (id)""")
def sc15(spark, d):
    return around.schools(places(spark, d), view(spark, d, "school_sites"))


NEAR_LOT = f"nl AS (SELECT * FROM (SELECT l.id, t.lot_id, t.cd, row_number() OVER (PARTITION BY l.id ORDER BY {dist('l', 't')}, t.lot_id) AS k FROM listings l JOIN lots t ON abs(l.lat - t.lat) <= 0.0015 AND abs(l.lon - t.lon) <= 0.0015) WHERE k = 1)"


@query("sc16_air_quality", view_sql("listings", "lots", "readings", "scores") + f""", {NEAR_LOT}, c AS (SELECT l.id, CASE WHEN cd BETWEEN 101 AND 599 THEN cd END AS cd FROM listings l LEFT JOIN nl USING (id)), v AS (SELECT cd, name, value, row_number() OVER (PARTITION BY cd, name ORDER BY CAST(starts_with(lower(period), 'annual') AS INT) DESC, start DESC, value DESC) AS k FROM readings WHERE value IS NOT NULL), w AS (SELECT cd, round(max(CASE WHEN name LIKE 'Fine%' THEN value END), 3) AS pm25, round(max(CASE WHEN name LIKE 'Nitro%' THEN value END), 3) AS no2 FROM v WHERE k = 1 GROUP BY 1),
x AS (SELECT c.id, c.cd, pm25, no2, d0 / 10 AS road FROM c LEFT JOIN w USING (cd) LEFT JOIN scores s ON s.id = c.id), mean AS (SELECT cd, round(avg(road), 4) AS m FROM x WHERE cd IS NOT NULL AND road IS NOT NULL GROUP BY 1), y AS (SELECT x.*, CASE WHEN no2 IS NOT NULL AND road IS NOT NULL AND m IS NOT NULL THEN round_even(greatest(-3.0, least(3.0, 0.15 * (road - m))) * 1000, 0) / 1000 END AS road_adj FROM x LEFT JOIN mean USING (cd)), z AS (SELECT *, round_even((no2 + coalesce(road_adj, 0)) * 1000, 0) / 1000 AS no2_local FROM y), i AS (SELECT *, round_even((pm25 + CASE WHEN no2_local IS NOT NULL THEN 0.3 * no2_local ELSE 0 END) * 1000, 0) / 1000 AS air_index FROM z)
SELECT id, pm25, no2, no2_local, road_adj, air_index, CASE WHEN air_index IS NOT NULL THEN round(22 + greatest(0.0, least(1.0, (20 - air_index) / 12)) * 70, 1) END AS score FROM i""")
def sc16(spark, d):
    roads = view(spark, d, "scores").select("id", (F.col("d0") / 10).alias("road_exposure"))
    return around.air_quality(places(spark, d), view(spark, d, "lots"), view(spark, d, "readings"), roads)


LEFT = "CASE WHEN coalesce({r}, 0) <= 0 THEN 1.0 WHEN {r} = 1 THEN 0.45 ELSE 0.2 END"


@query("sc17_road_exposure", view_sql("listings", "streets", "lots", "trucks", "stations", "stops", "firehouses") + f""", o AS (SELECT * FROM streets WHERE NOT tunnel), h AS (SELECT * FROM (SELECT l.id, l.lat AS a1, l.lon AS o1, r.lat AS a2, r.lon AS o2, r.bridge, {dist('l', 'r')} AS m, row_number() OVER (PARTITION BY l.id ORDER BY {dist('l', 'r')}, r.way_id) AS k FROM listings l JOIN o r ON r.road_class IN ('motorway', 'trunk') AND {near_sql('l', 'r', 1000.0)}) WHERE k = 1), hb AS (SELECT * FROM h WHERE NOT bridge), {rows_sql('hb', 'hr')}, hx AS (SELECT h.id, m, CASE WHEN bridge THEN 0 ELSE coalesce(n_rows, 0) END AS r FROM h LEFT JOIN hr USING (id)),
ar AS (SELECT l.id, r.way_id, r.road_class, r.bridge, (l.lat + r.lat) / 2 AS lat, (l.lon + r.lon) / 2 AS lon, {dist('l', 'r')} AS m FROM listings l JOIN o r ON r.road_class IN ('primary', 'secondary', 'tertiary') AND {near_sql('l', 'r', 150.0)}), hid AS (SELECT DISTINCT a.id, a.way_id FROM ar a JOIN lots t ON a.m > 60 AND NOT a.bridge AND t.numfloors >= 3 AND {near_sql('a', 't', 18.0)}), aa AS (SELECT ar.id, sum(CASE road_class WHEN 'primary' THEN 5.0 WHEN 'secondary' THEN 3.0 ELSE 1.5 END * exp(-pow(m / 75, 2)) * CASE WHEN hid.id IS NOT NULL THEN 0.35 ELSE 1.0 END) / 2 AS v FROM ar LEFT JOIN hid ON hid.id = ar.id AND hid.way_id = ar.way_id GROUP BY 1),
tr AS (SELECT l.id, 3 * exp(-min({dist('l', 't')}) / 60) AS v FROM listings l JOIN trucks t ON {near_sql('l', 't', 100.0)} GROUP BY 1), el AS (SELECT * FROM (SELECT l.id, l.lat AS a1, l.lon AS o1, s.lat AS a2, s.lon AS o2, {dist('l', 's')} AS m, row_number() OVER (PARTITION BY l.id ORDER BY {dist('l', 's')}, s.lat, s.lon) AS k FROM listings l JOIN stations s ON s.structure = 'Elevated' AND {near_sql('l', 's', 800.0)}) WHERE k = 1), {rows_sql('el', 'er')}, ex AS (SELECT el.id, m, 6 * exp(-m / 300) * {LEFT.format(r='n_rows')} AS v FROM el LEFT JOIN er USING (id)),
bs AS (SELECT id, least(4.0, 0.35 * rc) * exp(-pow(m / 60, 2)) AS v FROM (SELECT l.id, t.route_count AS rc, {dist('l', 't')} AS m, row_number() OVER (PARTITION BY l.id ORDER BY {dist('l', 't')}, t.stop_id) AS k FROM listings l JOIN stops t ON {near_sql('l', 't', 120.0)}) WHERE k = 1), fh AS (SELECT l.id, min({dist('l', 'f')}) AS m FROM listings l JOIN firehouses f ON {near_sql('l', 'f', 150.0)} GROUP BY 1)
SELECT l.id, round(hx.m, 1) AS hwy_dist_m, CAST(coalesce(hx.r, 0) AS BIGINT) AS shield_rows, round(coalesce(aa.v, 0), 4) AS arterial, round(coalesce(tr.v, 0), 4) AS truck, round(ex.m, 1) AS el_dist_m, round(coalesce(ex.v, 0), 4) AS el, round(coalesce(bs.v, 0), 4) AS bus, round(fh.m, 1) AS firehouse_m, round(coalesce(10 * exp(-hx.m / 250) * {LEFT.format(r='hx.r')}, 0) + coalesce(aa.v, 0) + coalesce(tr.v, 0) + coalesce(ex.v, 0) + coalesce(bs.v, 0) + coalesce(2.5 * exp(-fh.m / 80), 0), 4) AS road_index
FROM listings l LEFT JOIN hx USING (id) LEFT JOIN aa USING (id) LEFT JOIN tr USING (id) LEFT JOIN ex USING (id) LEFT JOIN bs USING (id) LEFT JOIN fh USING (id)""")
def sc17(spark, d):
    v = lambda n: view(spark, d, n)
    return around.road_exposure(places(spark, d), streets(spark, d), v("trucks"), v("lots"), v("stations"), v("stops"), v("firehouses"))


ROAD = "CASE WHEN coalesce(trim(name), '') <> '' THEN concat('n:', trim(name)) ELSE concat('c:', road_class) END AS road"


@query("sc10_street_danger", view_sql("listings", "crashes", "streets", "lots") + f""", j AS (SELECT *, {ROAD} FROM streets WHERE road_class IN ('motorway', 'trunk', 'primary')), hurt AS (SELECT *, coalesce(killed, 0) AS dead FROM crashes WHERE injured > 0 OR coalesce(killed, 0) > 0), g AS (SELECT c.crash_id, r.way_id, r.road, sqrt(pow((r.lat - c.lat) * 111320.0, 2) + pow((r.lon - c.lon) * 85000.0, 2)) AS m FROM hurt c JOIN j r ON abs(r.lat - c.lat) <= {30.0 / 85000.0!r} AND abs(r.lon - c.lon) <= {30.0 / 85000.0!r}), og AS (SELECT crash_id, road FROM (SELECT *, row_number() OVER (PARTITION BY crash_id ORDER BY m, way_id) AS k FROM g WHERE m <= 30) WHERE k = 1),
fr AS (SELECT DISTINCT l.id, r.road FROM listings l JOIN j r ON {near_sql('l', 'r', 40.0)}), w AS (SELECT l.id, c.crash_id, c.injured, c.dead, c.hour, (c.injured + 10 * c.dead) * {kernel('l', 'c', 150.0)} * {age('c.day', AS_OF_EVENTS)} AS w FROM listings l JOIN hurt c ON {near_sql('l', 'c', 300.0)}), x AS (SELECT w.*, og.road, fr.id IS NOT NULL AS fronts FROM w LEFT JOIN og USING (crash_id) LEFT JOIN fr ON fr.id = w.id AND fr.road = og.road),
a AS (SELECT id, CAST(sum(injured) AS BIGINT) AS injuries, CAST(sum(dead) AS BIGINT) AS deaths, sum(w) AS weighted, sum(CASE WHEN road IS NULL THEN 1.3 * w ELSE 0 END) AS side, sum(CASE WHEN road IS NOT NULL THEN CASE WHEN fronts THEN 1.0 ELSE 0.45 END * w ELSE 0 END) AS main, count(*) FILTER (hour BETWEEN 0 AND 23) AS timed, count(*) FILTER (hour IN (7, 8, 14, 15, 16)) AS school FROM x GROUP BY 1), {units_sql(300.0)}
SELECT l.id, coalesce(injuries, 0) AS injuries, coalesce(deaths, 0) AS deaths, round(coalesce(weighted, 0), 4) AS weighted, round(coalesce(side, 0), 4) AS frontage_weighted, round(coalesce(main, 0), 4) AS arterial_weighted, round(1000 * (coalesce(side, 0) + coalesce(main, 0)) / u.units, 4) AS rate, round(school / nullif(timed, 0), 4) AS school_hours_share FROM listings l LEFT JOIN a USING (id) JOIN u USING (id)""")
def sc10(spark, d):
    v = lambda n: view(spark, d, n)
    return around.street_danger(places(spark, d), v("crashes"), streets(spark, d), v("lots"), AS_OF_EVENTS)


# the nearest lot's facts


@query("sc18_flood_risk", view_sql("listings", "lots") + f", {NEAREST} SELECT l.id, b.lot_id AS match, coalesce(t.firm07, '') AS firm07, coalesce(t.pfirm15, '') AS pfirm15, CASE WHEN coalesce(t.firm07, '') <> '' OR coalesce(t.pfirm15, '') <> '' THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS score FROM listings l LEFT JOIN (SELECT * FROM b WHERE n = 1) b ON l.id = b.id LEFT JOIN lots t ON t.lot_id = b.lot_id")
def sc18(spark, d):
    return scorers.flood_risk(view(spark, d, "listings"), view(spark, d, "lots"))


STABILIZED = "t.yearbuilt > 0 AND t.yearbuilt < 1974 AND t.unitsres >= 6"


@query("sc19_rent_stabilized", view_sql("listings", "lots") + f", {NEAREST} SELECT l.id, coalesce(t.yearbuilt, 0) AS building_year, CASE WHEN {STABILIZED} THEN 1 ELSE 0 END AS rent_stabilized, CASE WHEN {STABILIZED} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM listings l LEFT JOIN (SELECT * FROM b WHERE n = 1) b ON l.id = b.id LEFT JOIN lots t ON t.lot_id = b.lot_id")
def sc19(spark, d):
    return scorers.rent_stabilized(view(spark, d, "listings"), view(spark, d, "lots"))


# buildings: records are joined to lots by key

KEYED = "k AS (SELECT lot_id, bbl FROM lots)"
MATCH = f"mt AS (SELECT l.id, x.lot_id, x.bbl, x.units, x.ownername, x.new, x.lat, x.lon FROM listings l LEFT JOIN (SELECT * FROM (SELECT l.id, t.lot_id, t.bbl, greatest(t.unitsres, 1) AS units, t.ownername, t.yearbuilt >= 1998 AS new, t.lat, t.lon, {dist('l', 't')} AS m, row_number() OVER (PARTITION BY l.id ORDER BY {dist('l', 't')}, t.bbl) AS k FROM listings l JOIN lots t ON abs(l.lat - t.lat) <= 0.0015 AND abs(l.lon - t.lon) <= 0.0015) WHERE k = 1 AND m <= 40) x USING (id))"


def keyed(spark, d, name):
    """Rows of a record table with the key of their lot."""
    return view(spark, d, name).join(view(spark, d, "lots").select("lot_id", "bbl"), "lot_id")


def prior_of(spark, d):
    """A baseline's mean and median, from the frozen grid of a tenth of a scored dimension."""
    return stats.baseline_prior(stats.quantiles(view(spark, d, "scores").withColumn("v", F.col("d0") / 100), "v"))


PRIOR = "pf AS (SELECT d0 / 100 AS v, row_number() OVER (ORDER BY d0) - 1 AS r, count(*) OVER () AS n FROM scores WHERE d0 IS NOT NULL), pg AS (SELECT i, least(n - 1, CAST(round_even(i * (n - 1) / 1000, 0) AS BIGINT)) AS at FROM (SELECT unnest(range(0, 1001)) AS i), (SELECT max(n) AS n FROM pf)), pq AS (SELECT i, pf.v AS q FROM pg JOIN pf ON pf.r = pg.at), pr AS (SELECT avg(q) AS mean, max(CASE WHEN i = 500 THEN q END) AS prior FROM pq)"


@query("nm04_baseline_prior", view_sql("scores") + f", {PRIOR} SELECT round(mean, 6) AS mean, prior AS median FROM pr")
def nm04(spark, d):
    return prior_of(spark, d).select(F.round("mean", 6).alias("mean"), "median")


def rate_sql(weight: str, units: str, k: float = 10.0) -> str:
    return f"(({weight}) + {k} * prior) / (greatest({units}, 1) + {k}) - 1e-6 * ln(1 + greatest({units}, 1))"


@query("sc06_violations", view_sql("listings", "lots", "notices", "cases", "scores") + f""", {MATCH}, {PRIOR}, w AS (SELECT *, CASE upper(trim(string_split(type, '-')[1])) WHEN 'LL6291' THEN 0.15 WHEN 'UB' THEN 2.0 WHEN 'C' THEN 1.5 WHEN 'EGNCY' THEN 1.8 ELSE 1.0 END AS dw, status = 'Open' AS op, coalesce(day <= DATE '{AS_OF_ORDERS}' - 1095, FALSE) AS old FROM notices), dn AS (SELECT lot_id, count(*) AS n, round(sum(dw), 3) AS w FROM w WHERE notice_id % 2 = 0 GROUP BY 1),
hn AS (SELECT lot_id, {', '.join(f"count(*) FILTER (op AND class = '{c}') AS {c.lower()}" for c in 'ABCI')}, round(sum(CASE WHEN op THEN CASE class WHEN 'A' THEN 1.0 WHEN 'B' THEN 2.0 WHEN 'C' THEN 5.0 ELSE 2.0 * CASE WHEN contains(upper(description), '2107') THEN 0.2 WHEN contains(upper(description), 'VACAT') THEN 3.0 ELSE 1.0 END END * CASE WHEN old THEN 1.5 ELSE 1.0 END ELSE 0 END), 3) AS w, count(*) FILTER (day >= DATE '{AS_OF_ORDERS}' - 365) AS opened, count(*) FILTER (certified >= DATE '{AS_OF_ORDERS}' - 365) AS cured, count(*) FILTER (op AND old) AS old3 FROM w GROUP BY 1), pm AS (SELECT lot_id, count(*) AS n FROM cases WHERE kind = 'permit' GROUP BY 1),
x AS (SELECT mt.id, mt.bbl, coalesce(mt.new, FALSE) AS new, coalesce(units, 1) AS units, coalesce(dn.n, 0) AS dob_count, coalesce(a, 0) AS class_a, coalesce(b, 0) AS class_b, coalesce(c, 0) AS class_c, coalesce(i, 0) AS class_i, coalesce(opened, 0) AS opened_12mo, coalesce(cured, 0) AS cured_12mo, coalesce(old3, 0) AS open_3yr, coalesce(pm.n, 0) AS active_permits, coalesce(dn.w, 0) AS dob_weighted, coalesce(hn.w, 0) AS hpd_weighted FROM mt LEFT JOIN dn USING (lot_id) LEFT JOIN hn USING (lot_id) LEFT JOIN pm USING (lot_id)), y AS (SELECT *, {ratio_sql('opened_12mo', 'cured_12mo')} AS ratio, new AND dob_count + class_a + class_b + class_c + class_i = 0 AS fresh FROM x)
SELECT id, dob_count, class_a, class_b, class_c, class_i, opened_12mo, cured_12mo, open_3yr, active_permits, CAST(units AS INT) AS units, dob_weighted, hpd_weighted, CASE WHEN bbl IS NOT NULL THEN ratio END AS trajectory_ratio, CAST(bbl IS NULL AS INT) AS match_uncertain, CAST(fresh AS INT) AS new_building, CASE WHEN bbl IS NOT NULL AND NOT fresh THEN round({rate_sql('(dob_weighted + hpd_weighted) * CASE WHEN opened_12mo + cured_12mo < 4 THEN 1.0 WHEN ratio > 1.15 THEN 1.3 WHEN ratio < 0.85 THEN 0.8 ELSE 1.0 END', 'units')}, 7) END AS per_unit FROM y, pr""")
def sc06_full(spark, d):
    n = view(spark, d, "notices")
    hpd = n.select("lot_id", "class", F.col("day").alias("inspected"), "certified", "status", "description")
    return buildings.violations(places(spark, d), view(spark, d, "lots"), n.where("notice_id % 2 = 0").select("lot_id", "type"), hpd, view(spark, d, "cases").where("kind = 'permit'"), AS_OF_ORDERS, prior_of(spark, d))


@query("sc07_management", view_sql("listings", "lots", "notices", "cases", "complaints", "scores") + f""", {MATCH}, {PRIOR}, known AS (SELECT n.* FROM notices n JOIN lots USING (lot_id)), {season_sql('known', int(AS_OF_ORDERS[5:7]))}, w AS (SELECT *, {age('day', AS_OF_ORDERS)} AS g, category = 'HEAT/HOT WATER' AND coalesce(extract(month FROM day) IN (10, 11, 12, 1, 2, 3, 4, 5), TRUE) AS cold FROM notices), c AS (SELECT lot_id, count(*) AS n, sum(g) AS w, count(*) FILTER (category = 'HEAT/HOT WATER') AS heat, count(*) FILTER (category = 'PLUMBING') AS plumbing, count(*) FILTER (category = 'PAINT/PLASTER') AS paint, count(*) FILTER (category = 'SAFETY') AS safety, count(*) FILTER (cold) AS bh, coalesce(sum(g) FILTER (cold), 0) AS hw FROM w GROUP BY 1),
e AS (SELECT lot_id, count(*) AS n, sum({age('day', AS_OF_ORDERS)}) AS w FROM cases WHERE kind = 'eviction' GROUP BY 1), g AS (SELECT lot_id, count(*) AS n FROM cases WHERE kind = 'litigation' GROUP BY 1), o AS (SELECT ownername, count(*) AS b, sum(unitsres) AS u, coalesce(sum(c.n), 0) AS n, coalesce(sum(heat), 0) AS heat, coalesce(sum(plumbing), 0) AS plumbing, coalesce(sum(paint), 0) AS paint, coalesce(sum(safety), 0) AS safety, coalesce(sum(c.w), 0) AS w, coalesce(sum(e.n), 0) AS en, coalesce(sum(e.w), 0) AS ew FROM lots LEFT JOIN c USING (lot_id) LEFT JOIN e USING (lot_id) GROUP BY 1), hn AS (SELECT l.id, count(*) AS n FROM listings l JOIN complaints c ON c.type = 'HEAT/HOT WATER' AND {near_sql('l', 'c', 200.0)} GROUP BY 1),
x AS (SELECT mt.id, mt.bbl, coalesce(mt.new, FALSE) AS new, coalesce(mt.units, 1) AS bu, coalesce(mt.ownername, '') AS owner, coalesce(o.b, 0) AS owner_buildings, coalesce(o.u, 0) AS owner_units, coalesce(o.n, 0) AS complaints, coalesce(o.heat, 0) AS heat, coalesce(o.plumbing, 0) AS plumbing, coalesce(o.paint, 0) AS paint, coalesce(o.safety, 0) AS safety, coalesce(hn.n, 0) AS heat_near, coalesce(c.bh, 0) AS bldg_heat, coalesce(c.hw, 0) / factor / coalesce(mt.units, 1) / 8 AS hr, coalesce(g.n, 0) AS litigations, coalesce(e.n, 0) AS evictions, coalesce(o.en, 0) AS portfolio_evictions, coalesce(o.w, 0) / factor AS w, coalesce(e.w, 0) AS ew, coalesce(o.ew, 0) AS pw FROM mt LEFT JOIN o USING (ownername) LEFT JOIN c USING (lot_id) LEFT JOIN e USING (lot_id) LEFT JOIN g USING (lot_id) LEFT JOIN hn ON hn.id = mt.id CROSS JOIN season),
y AS (SELECT *, w + 10 * hr * greatest(owner_units, 1) + 10 * litigations + 5 * ew + 0.2 * pw AS weight, new AND complaints + litigations + evictions + bldg_heat = 0 AS fresh FROM x)
SELECT id, owner, owner_buildings, CAST(owner_units AS BIGINT) AS owner_units, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('complaints', 'heat', 'plumbing', 'paint', 'safety'))}, heat_near, bldg_heat, CASE WHEN bbl IS NOT NULL THEN round(hr, 7) END AS bldg_heat_rate, litigations, evictions, CAST(portfolio_evictions AS BIGINT) AS portfolio_evictions, round(100 * portfolio_evictions / greatest(owner_units, 1), 2) AS eviction_rate, round(weight, 3) AS weighted, CASE WHEN bbl IS NOT NULL AND NOT fresh THEN round({rate_sql('weight', 'owner_units')}, 7) END AS per_unit, CAST(bbl IS NULL AS INT) AS match_uncertain, CAST(fresh AS INT) AS new_building FROM y, pr""")
def sc07(spark, d):
    n, c = keyed(spark, d, "notices"), keyed(spark, d, "cases")
    return buildings.management(places(spark, d), view(spark, d, "lots"), n.select("lot_id", "category", "day"), c.where("kind = 'litigation'").select("lot_id"), c.where("kind = 'eviction'").select("lot_id", "day"), view(spark, d, "complaints"), AS_OF_ORDERS, prior_of(spark, d))


@query("sc08_pest", view_sql("listings", "lots", "notices", "complaints", "inspections", "scores") + f""", {MATCH}, {PRIOR}, {units_sql(100.0)}, r AS (SELECT l.id, count(*) AS n, sum({kernel('l', 'c', 50.0)} * {age('c.day', AS_OF_EVENTS)}) AS w FROM listings l JOIN complaints c ON c.type = 'Rodent' AND {near_sql('l', 'c', 100.0)} GROUP BY 1), b AS (SELECT lot_id, count(*) AS n FROM notices WHERE category = 'UNSANITARY CONDITION' AND minor = 'PESTS' GROUP BY 1),
i AS (SELECT l.id, coalesce(contains(i.result, 'Failed') OR contains(i.result, 'Rat Activity'), FALSE) AS bad, {kernel('l', 'i', 50.0)} * {age('i.day', AS_OF_EVENTS)} AS w FROM listings l JOIN inspections i ON i.type IN ('Initial', 'Compliance') AND {near_sql('l', 'i', 100.0)}), ia AS (SELECT id, count(*) AS n, count(*) FILTER (bad) AS f, round(coalesce(sum(w) FILTER (bad), 0) / greatest(sum(w), 3), 7) AS rate FROM i GROUP BY 1),
x AS (SELECT mt.id, mt.bbl, mt.units, coalesce(mt.new, FALSE) AND coalesce(b.n, 0) = 0 AS fresh, CASE WHEN mt.bbl IS NOT NULL THEN coalesce(b.n, 0) END AS hpd_count, coalesce(r.n, 0) AS rodent_count, round(CASE WHEN mt.bbl IS NOT NULL THEN coalesce(b.n, 0) END + round(coalesce(r.w, 0), 7), 7) AS weighted, round(1000 * coalesce(r.w, 0) / u.units, 4) AS rodent_rate, coalesce(ia.n, 0) AS insp_total, coalesce(ia.f, 0) AS insp_failed, coalesce(ia.rate, 0) AS insp_fail_rate FROM mt LEFT JOIN b USING (lot_id) LEFT JOIN r ON r.id = mt.id JOIN u ON u.id = mt.id LEFT JOIN ia ON ia.id = mt.id), y AS (SELECT x.*, prior, CASE WHEN bbl IS NOT NULL AND NOT fresh THEN round({rate_sql('hpd_count', 'units')}, 7) END AS per_unit FROM x, pr)
SELECT id, hpd_count, rodent_count, hpd_count + rodent_count AS total, CASE WHEN bbl IS NOT NULL THEN CAST(units AS INT) END AS units, weighted, per_unit, rodent_rate, insp_total, insp_failed, insp_fail_rate, round_even((0.5 * insp_fail_rate + (0.3 * rodent_rate / 1000 + 0.2 * coalesce(per_unit, prior, 0))) * 10000000, 0) / 10000000 AS rate, CAST(bbl IS NULL AS INT) AS match_uncertain, CAST(fresh AS INT) AS new_building FROM y""")
def sc08(spark, d):
    n = view(spark, d, "notices").select("lot_id", "category", "minor")
    return buildings.pest(places(spark, d), view(spark, d, "lots"), n, view(spark, d, "complaints"), view(spark, d, "inspections"), AS_OF_EVENTS, prior_of(spark, d))


def filed(spark, d):
    return view(spark, d, "notices").where("notice_id % 3 = 0").select("lot_id", F.col("n_units").alias("units"), "infested", "reinfested", "day")


BLOCK6 = "substr(lpad({}, 10, '0'), 1, 6)".format


@query("sc09_bedbug", view_sql("listings", "lots", "notices", "scores") + f""", {MATCH}, {PRIOR}, f AS (SELECT t.lot_id, t.bbl, t.lat, t.lon, n.n_units, n.infested, n.reinfested, {age('n.day', AS_OF_ORDERS, 730.0)} AS g FROM notices n JOIN lots t USING (lot_id) WHERE n.notice_id % 3 = 0), a AS (SELECT bbl, count(*) AS n, sum(infested) AS inf, sum(reinfested) AS re, sum((infested + 2 * reinfested) * g) AS w, max(n_units) AS u FROM f GROUP BY 1), spot AS (SELECT DISTINCT bbl, lat, lon FROM mt WHERE bbl IS NOT NULL), j AS (SELECT spot.bbl, sum(f.infested * f.g) AS v FROM spot JOIN f ON {BLOCK6('spot.bbl')} = {BLOCK6('f.bbl')} AND spot.bbl <> f.bbl AND f.infested > 0 AND {dist('spot', 'f')} <= 30 GROUP BY 1),
x AS (SELECT mt.id, mt.bbl, a.n, inf, re, w, coalesce(j.v, 0) AS v, coalesce(mt.new, FALSE) AS new, CAST(CASE WHEN coalesce(a.u, 0) > 0 THEN a.u ELSE mt.units END AS DOUBLE) AS units FROM mt LEFT JOIN a USING (bbl) LEFT JOIN j USING (bbl)), y AS (SELECT *, bbl IS NOT NULL AND n IS NULL AND new AS fresh, bbl IS NOT NULL AND NOT (n IS NULL AND new) AND n IS NULL AND units < 3 AS small FROM x), z AS (SELECT *, bbl IS NOT NULL AND NOT fresh AND NOT small AS usual FROM y)
SELECT id, CASE WHEN bbl IS NOT NULL THEN coalesce(n, 0) END AS filings, CASE WHEN bbl IS NOT NULL THEN round(coalesce(inf, 0), 1) END AS infested, CASE WHEN bbl IS NOT NULL THEN round(coalesce(re, 0), 1) END AS reinfested, CASE WHEN usual OR small THEN round(v, 7) END AS adjacent, CASE WHEN usual THEN round({rate_sql('coalesce(w, 0) + 0.3 * v', 'units')}, 7) END AS rate, CASE WHEN usual THEN CAST(n IS NULL AND units >= 5 AS INT) END AS never_filed, CAST(small AS INT) AS not_required, CAST(bbl IS NULL AS INT) AS match_uncertain, CAST(fresh AS INT) AS new_building FROM z, pr""")
def sc09(spark, d):
    return buildings.bedbug(places(spark, d), view(spark, d, "lots"), filed(spark, d), AS_OF_ORDERS, prior_of(spark, d))


@query("sc20_new_building", view_sql("lots") + f" SELECT lot_id, yearbuilt >= {int(AS_OF_ORDERS[:4]) - 3} AS is_new FROM lots")
def sc20(spark, d):
    return view(spark, d, "lots").select("lot_id", buildings.is_new(F.col("yearbuilt"), AS_OF_ORDERS).alias("is_new"))


@query("jn04_keyed_join", view_sql("lots") + ", o AS (SELECT c_custkey AS k, CAST(1 + c_custkey % 5 AS VARCHAR) AS b, CAST(1 + CAST(floor(c_custkey / 5) AS BIGINT) % 300 AS VARCHAR) AS bl, CAST(c_custkey % 10000 AS VARCHAR) AS lo FROM customer WHERE c_custkey % 3 = 0) SELECT lots.lot_id, o.k AS match FROM lots LEFT JOIN o ON o.b = CAST(boro AS VARCHAR) AND o.bl = CAST(block AS VARCHAR) AND o.lo = CAST(lot AS VARCHAR)")
def jn04(spark, d):
    lots = view(spark, d, "lots")
    other = lots.where("lot_id % 3 = 0").select(F.col("lot_id").alias("match"), F.concat(F.lit(" "), F.col("boro").cast("string"), F.lit(".00")).alias("b"), F.lpad(F.col("block").cast("string"), 5, "0").alias("bl"), F.col("lot").cast("double").alias("lo"))
    return spatial.keyed_join(lots, other, [F.col("boro"), F.col("block"), F.col("lot")], [F.col("b"), F.col("bl"), F.col("lo")]).select("lot_id", "match")


@query("jn15_landlord_portfolio", view_sql("lots", "notices") + """, reg AS (SELECT lot_id AS reg_id, bbl FROM lots), con AS (SELECT lot_id AS reg_id, concat('HOLDING ', CAST(lot_id % 90 AS VARCHAR)) AS corp, concat('ANN LEE', CAST(lot_id % 70 AS VARCHAR)) AS full_, concat('ROAD ', CAST(lot_id % 30 AS VARCHAR)) AS address FROM lots WHERE lot_id % 11 <> 0), named AS (SELECT reg_id, address, concat('c:', corp) AS name FROM con UNION ALL SELECT reg_id, address, concat('o:', full_) FROM con), lo AS (SELECT DISTINCT n.address, n.name, r.bbl FROM named n JOIN reg r USING (reg_id)), mine AS (SELECT DISTINCT n.reg_id, lo.bbl FROM named n JOIN lo ON lo.address = n.address AND lo.name = n.name),
ov AS (SELECT t.bbl, count(*) AS n FROM notices x JOIN lots t USING (lot_id) WHERE x.status = 'Open' GROUP BY 1) SELECT m.reg_id, count(*) AS buildings, CAST(sum(coalesce(t.unitsres, 0)) AS BIGINT) AS units, CAST(coalesce(sum(ov.n), 0) AS BIGINT) AS open_violations FROM mine m JOIN lots t USING (bbl) LEFT JOIN ov USING (bbl) GROUP BY 1""")
def jn15(spark, d):
    lots = view(spark, d, "lots")
    c = lots.where("lot_id % 11 <> 0")
    text = lambda p, n: F.concat(F.lit(p), (F.col("lot_id") % n).cast("string"))
    who = lambda role, corp: c.select((F.col("lot_id") * 2 + int(role == "HeadOfficer")).alias("contact_id"), F.col("lot_id").alias("reg_id"), F.lit(role).alias("role"), (text("Holding ", 90) if corp else F.lit(None).cast("string")).alias("corporation"), (F.lit(None).cast("string") if corp else F.lit("Ann")).alias("first"), (F.lit(None).cast("string") if corp else text("Lee", 70)).alias("last"), text("Road ", 30).alias("address"))
    contacts = who("CorporateOwner", True).unionByName(who("HeadOfficer", False))
    open_ = keyed(spark, d, "notices").where("status = 'Open'").groupBy("bbl").agg(F.count("*").alias("n"))
    return buildings.landlords(lots.select(F.col("lot_id").alias("reg_id"), "bbl"), contacts, lots, open_)
