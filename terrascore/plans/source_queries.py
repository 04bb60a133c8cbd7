"""Queries of feeds, map extracts, repairs, ingest, grids and validation, with SQL of the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrascore.functions import geo
from terrascore.operators import grid
from terrascore.plans.registry import HAV, query
from terrascore.sources import clean, ingest, versions, views
from terrascore.sources.store import shared_folder
from terrascore.sources.views import view, view_sql


def feed_tables(spark, d):
    """Stops, trips and stop times of a transit feed from suppliers, orders and line items."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    at = lambda a: (F.lit(40.7) + (F.col("s_suppkey") * a) % 4000 / 100000).cast("string")
    stops = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("stop_id"), F.col("s_name").alias("stop_name"), F.when(F.col("s_suppkey") % 20 == 0, "x").otherwise(at(31)).alias("stop_lat"), at(17).alias("stop_lon"), F.when(F.col("s_suppkey") % 4 == 0, "1").when(F.col("s_suppkey") % 4 == 1, "").otherwise("0").alias("location_type"), F.when(F.col("s_suppkey") % 4 >= 2, F.concat(F.lit("S"), (F.floor(F.col("s_suppkey") / 4) * 4).cast("string"))).alias("parent_station"))
    trips = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("trip_id"), F.concat(F.lit(" R"), (F.col("o_custkey") % 9).cast("string")).alias("route_id"))
    times = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("trip_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("stop_id"))
    return stops, trips, times


@query("src04_gtfs_stations", "WITH st AS (SELECT s_suppkey AS k, s_name FROM supplier WHERE s_suppkey % 4 IN (0, 1) AND s_suppkey % 20 <> 0), r AS (SELECT DISTINCT CASE WHEN l_suppkey % 4 >= 2 THEN CAST(floor(l_suppkey / 4) * 4 AS BIGINT) ELSE l_suppkey END AS k, concat('R', CAST(o_custkey % 9 AS VARCHAR)) AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT concat('S', CAST(st.k AS VARCHAR)) AS station_id, s_name AS name, round(40.7 + (st.k * 31) % 4000 / 100000, 6) AS lat, coalesce(string_agg(r.r, ',' ORDER BY r.r), '') AS routes FROM st LEFT JOIN r USING (k) GROUP BY 1, 2, 3")
def src04(spark, d):
    return views.gtfs_stations(*feed_tables(spark, d)).select("station_id", "name", F.round("lat", 6).alias("lat"), F.array_join("routes", ",").alias("routes"))


@query("src05_osm_categories", "SELECT o_orderkey AS osm_id, CASE o_orderkey % 7 WHEN 0 THEN 'grocery' WHEN 1 THEN 'grocery' WHEN 2 THEN 'pharmacy' WHEN 3 THEN 'gym' WHEN 4 THEN 'laundry' WHEN 5 THEN 'dining' END AS category FROM orders WHERE o_orderkey % 7 <> 6")
def src05(spark, d):
    k = F.col("o_orderkey") % 7
    pair = lambda a, b: F.create_map(F.lit(a), F.lit(b))
    tags = F.when(k == 0, pair("shop", "supermarket")).when(k == 1, pair("shop", "convenience")).when(k == 2, pair("amenity", "pharmacy")).when(k == 3, pair("leisure", "fitness_centre")).when(k == 4, pair("shop", "laundry")).when(k == 5, pair("amenity", "cafe")).otherwise(pair("shop", "shoes"))
    return views.osm_categories(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("osm_id"), tags.alias("tags"))).select("osm_id", "category")


@query("src06_road_points", view_sql("roads") + """, w AS (SELECT way_id, lat AS a1, lon AS o1, lat + 0.01 AS a2, lon + 0.005 AS o2 FROM roads WHERE way_id % 3 <> 2), l AS (SELECT *, sqrt(pow((a2 - a1) * 6371008.8::DOUBLE * 3.141592653589793 / 180, 2) + pow((o2 - o1) * 6371008.8::DOUBLE * 3.141592653589793 / 180 * cos(radians((a1 + a2) / 2)), 2)) AS len FROM w), k AS (SELECT *, unnest(range(0, CAST(floor(len / 50) AS BIGINT) + 1)) AS k FROM l)
SELECT way_id, CASE WHEN way_id % 3 = 0 THEN 'motorway' ELSE 'primary' END AS road_class, CASE WHEN way_id % 3 = 0 THEN 2 END AS lanes, way_id % 3 = 0 AS tunnel, FALSE AS bridge, round(a1 + (a2 - a1) * (k * 50) / len, 8) AS lat, round(o1 + (o2 - o1) * (k * 50) / len, 8) AS lon FROM k""")
def src06(spark, d):
    r = view(spark, d, "roads")
    p = lambda a, o: F.struct(a.alias("lat"), o.alias("lon"))
    tags = F.when(F.col("way_id") % 3 == 0, F.create_map(*map(F.lit, ("highway", "motorway", "lanes", "2;3", "tunnel", "yes", "bridge", "no")))).when(F.col("way_id") % 3 == 1, F.create_map(*map(F.lit, ("highway", "primary", "lanes", "x")))).otherwise(F.create_map(F.lit("highway"), F.lit("footway")))
    ways = r.select("way_id", tags.alias("tags"), F.array(p(F.col("lat"), F.col("lon")), p(F.col("lat") + 0.01, F.col("lon") + 0.005)).alias("points"))
    return views.road_points(ways.union(ways)).select("way_id", "road_class", "lanes", "tunnel", "bridge", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@query("trf04_point_from_geojson", view_sql("lots") + " SELECT lot_id, CASE WHEN lot_id % 10 <> 0 THEN lat END AS lat, CASE WHEN lot_id % 10 <> 0 THEN lon END AS lon FROM lots")
def trf04(spark, d):
    text = F.when(F.col("lot_id") % 10 != 0, F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))).otherwise("no point")
    return clean.point_from_geojson(view(spark, d, "lots").select("lot_id", text.alias("g")), "g").select("lot_id", "lat", "lon")


@query("trf09_mean_vertex", view_sql("lots") + " SELECT lot_id, round((lat + lat + 0.003 + lat + 0.003 + lat + lat + 0.001 + lat + 0.002) / 6, 9) AS lat, round((lon + lon + lon + 0.004 + lon + lon + 0.001 + lon + 0.001) / 6, 9) AS lon FROM lots")
def trf09(spark, d):
    p = lambda x, y: F.array(F.col("lon") + x, F.col("lat") + y)
    rings = F.array(F.array(p(0.0, 0.0), p(0.0, 0.003), p(0.004, 0.003), p(0.0, 0.0)), F.array(p(0.001, 0.001), p(0.001, 0.002)))
    return clean.mean_vertex(view(spark, d, "lots").select("lot_id", rings.alias("r")), "lot_id", "r").select("lot_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("trf11_repair_outlines", view_sql("parks") + """, o AS (SELECT park_id + 100000 AS cand_id, CASE WHEN park_id % 3 = 0 THEN concat('The Garden ', CAST(park_id AS VARCHAR)) ELSE concat('Green ', CAST(park_id % 7 AS VARCHAR)) END AS cand_name, acres * (1 + park_id % 7) AS cand_acres, lat + 0.001 AS r_lat, lon AS r_lon, park_id % 2 = 0 AS holds, park_id FROM parks), p AS (SELECT park_id, concat('Garden ', CAST(park_id AS VARCHAR)) AS name, acres, lat, lon FROM parks WHERE acres > 1 AND park_id % 12 < 11),
n AS (SELECT p.park_id, o.cand_id, sqrt(pow((p.lat - o.r_lat) * 111320.0, 2) + pow((p.lon - o.r_lon) * 111320.0 * cos(radians((p.lat + o.r_lat) / 2)), 2)) AS d, o.holds AND o.park_id = p.park_id AS holds, CASE WHEN o.park_id = p.park_id AND o.park_id % 3 = 0 THEN 1.0 WHEN o.park_id % 3 = 0 OR CAST(o.park_id % 7 AS VARCHAR) = CAST(p.park_id AS VARCHAR) THEN 0.5 ELSE 0.0 END AS sim FROM p JOIN o ON abs(p.lat - o.r_lat) <= 0.006 AND abs(p.lon - o.r_lon) <= 0.006 AND (o.cand_acres <= 0 OR o.cand_acres / p.acres BETWEEN 0.2 AND 5)), s AS (SELECT *, CAST(holds AS INT) * 2.0 + 1.5 * sim + (1 - d / 500) AS score FROM n WHERE d <= 500), b AS (SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY score DESC, cand_id) AS k FROM s) SELECT park_id, cand_id, round(score, 6) AS score FROM b WHERE k = 1 AND (holds OR (sim >= 0.5 AND d < 300))""")
def trf11(spark, d):
    p = view(spark, d, "parks")
    key = F.col("park_id").cast("string")
    parks = p.select("park_id", F.concat(F.lit("Garden "), key).alias("name"), "acres", (F.col("park_id") % 12 + 1).alias("vertices"), "lat", "lon")
    name = F.when(F.col("park_id") % 3 == 0, F.concat(F.lit("The Garden "), key)).otherwise(F.concat(F.lit("Green "), (F.col("park_id") % 7).cast("string")))
    other = p.select((F.col("park_id") + 100000).alias("cand_id"), name.alias("cand_name"), (F.col("acres") * (1 + F.col("park_id") % 7)).alias("cand_acres"), (F.col("lat") + 0.001).alias("r_lat"), F.col("lon").alias("r_lon"))
    inside = p.where("park_id % 2 = 0").select("park_id", (F.col("park_id") + 100000).alias("cand_id"))
    return clean.repair_outlines(parks, other, inside).select("park_id", "cand_id", F.round("score", 6).alias("score"))


@query("trf12_repair_geocodes", view_sql("lots") + f""", g AS (SELECT lot_id, boro, CASE WHEN lot_id % 4 = 0 THEN concat(CAST(lot_id AS VARCHAR), '-', CAST(lot_id + 2 AS VARCHAR)) ELSE CAST(lot_id AS VARCHAR) END AS num, lat, lon FROM lots), q AS (SELECT lot_id AS id, lat + CASE WHEN lot_id % 3 = 0 THEN 0.01 ELSE 0.0001 END AS lat, lon, boro, lot_id % 5 + 1 AS b FROM lots WHERE lot_id % 2 = 0), own AS (SELECT q.id, g.lat AS la, g.lon AS lo FROM q JOIN g ON g.lot_id = q.id AND g.lot_id % 4 <> 0), range_ AS (SELECT q.id, g.lat AS la, g.lon AS lo FROM q JOIN g ON g.lot_id = q.id AND g.lot_id % 4 = 0), hit AS (SELECT * FROM own UNION ALL SELECT * FROM range_)
SELECT q.id, round(CASE WHEN {HAV(a='q.lat', b='q.lon', c='h.la', d='h.lo')} > 80 THEN h.la ELSE q.lat END, 8) AS lat, round(CASE WHEN {HAV(a='q.lat', b='q.lon', c='h.la', d='h.lo')} > 80 THEN h.lo ELSE q.lon END, 8) AS lon, CAST(coalesce({HAV(a='q.lat', b='q.lon', c='h.la', d='h.lo')} > 80, FALSE) AS INT) AS geocode_fixed FROM q LEFT JOIN hit h USING (id)""")
def trf12(spark, d):
    lots = view(spark, d, "lots")
    text = lambda c: c.cast("string")
    key, street = F.col("lot_id"), F.concat(F.lit(" West Main Street "), (F.col("lot_id") % 5).cast("string"))
    number = F.when(key % 4 == 0, F.concat_ws("-", text(key), text(key + 2))).otherwise(text(key))
    known = lots.select("bbl", F.concat(number, street).alias("address"), "lat", "lon")
    names = F.create_map(*(F.lit(x) for name, code in clean.BOROUGH.items() for x in (code, name)))
    x = lots.where("lot_id % 2 = 0").select(key.alias("id"), F.concat(text(key), F.lit(" W. Main St "), text(key % 5)).alias("address"), names[text(F.col("boro"))].alias("borough"), (F.col("lat") + F.when(key % 3 == 0, 0.01).otherwise(0.0001)).alias("lat"), "lon")
    return clean.repair_geocodes(x, known).select("id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "geocode_fixed")


@query("ing02_normalise", "SELECT CAST(p_partkey AS VARCHAR) AS source_id, concat('[\"', replace(p_name, ' ', '\",\"'), '\"]') AS words, CAST(p_size > 20 AS INT) AS large FROM part")
def ing02(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return ingest.normalise(p.select(F.col("p_partkey").alias("source_id"), F.split("p_name", " ").alias("words"), (F.col("p_size") > 20).alias("large")))


@query("ing06_audit_rows", "SELECT 'a' AS source, count(*) FILTER (o_orderkey % 3 <> 1) AS seen, count(*) FILTER (o_orderkey % 3 = 0) AS inserted, count(*) FILTER (o_orderkey % 3 = 2) AS updated, count(*) FILTER (o_orderkey % 3 = 1) AS deactivated, 'ok' AS status FROM orders UNION ALL SELECT 'none', 0, 0, 0, 0, 'failed'")
def ing06(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    key, t = F.col("o_orderkey").cast("string"), F.lit("2024-01-01").cast("timestamp")
    cur = o.where("o_orderkey % 3 <> 0").select(key.alias("id"), F.lit("a").alias("source"), key.alias("source_id"), F.lit("ACTIVE").alias("status"), t.alias("first_seen_at"), t.alias("last_seen_at"), F.col("o_totalprice").alias("price"))
    ingest.register_source("a", lambda s: o.where("o_orderkey % 3 <> 1").select(key.alias("source_id"), F.lit(40.7).alias("lat"), F.lit(-73.9).alias("lon"), F.col("o_totalprice").alias("price"), F.lit(1).alias("beds")))
    fields = {"source_id", "lat", "lon", "price", "beds"}
    _, ok = ingest.run_sync(spark, cur, "a", "2024-02-01", fields)
    _, bad = ingest.run_sync(spark, cur, "none", "2024-02-01", fields)
    return ok.unionByName(bad).select("source", "seen", "inserted", "updated", "deactivated", "status")


@query("ag05_shrunk_rate", view_sql("lots", "filings") + ", f AS (SELECT lot_id, count(*) AS n FROM filings GROUP BY 1) SELECT lot_id, round(coalesce(n, 0) / greatest(unitsres, 1) - 1e-6 * ln(1 + greatest(unitsres, 1)), 9) AS raw, round((coalesce(n, 0) + 10 * 0.25) / (greatest(unitsres, 1) + 10) - 1e-6 * ln(1 + greatest(unitsres, 1)), 9) AS shrunk FROM lots LEFT JOIN f USING (lot_id)")
def ag05(spark, d):
    n = view(spark, d, "filings").groupBy("lot_id").agg(F.count("*").alias("n"))
    x = view(spark, d, "lots").join(n, "lot_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    u = F.col("unitsres").cast("double")
    return x.select("lot_id", F.round(geo.eb_rate(F.col("n"), u, F.lit(None).cast("double"), 10.0), 9).alias("raw"), F.round(geo.eb_rate(F.col("n"), u, F.lit(0.25), 10.0), 9).alias("shrunk"))


def cells(spark, d):
    """A grid layer of 40 columns from listings, with holes."""
    x = view(spark, d, "listings").where("id < 1200")
    return x.select(F.floor(F.col("id") / 40).alias("r"), (F.col("id") % 40).alias("c"), F.when(F.col("id") % 9 != 0, F.col("price").cast("double")).alias("value"))


CELLS = ", g AS (SELECT CAST(floor(id / 40) AS BIGINT) AS r, id % 40 AS c, CASE WHEN id % 9 <> 0 THEN CAST(price AS DOUBLE) END AS value FROM listings WHERE id < 1200)"


@query("snk02_layer_bounds", view_sql("listings") + CELLS + " SELECT min(r) AS r_min, max(r) AS r_max, min(c) AS c_min, max(c) AS c_max, max(r) - min(r) + 1 AS n_rows, max(c) - min(c) + 1 AS n_cols, CAST(0.0036 AS DOUBLE) AS lat_step, CAST(0.0048 AS DOUBLE) AS lon_step, count(value) AS filled FROM g")
def snk02(spark, d):
    return grid.layer_bounds(cells(spark, d))


@query("gr03_green_blend", view_sql("scores") + " SELECT id, round(CASE WHEN d0 IS NULL OR d1 IS NULL THEN coalesce(d0, d1) ELSE 0.65 * greatest(d0, d1) + 0.35 * least(d0, d1) END, 6) AS green FROM scores")
def gr03(spark, d):
    return view(spark, d, "scores").select("id", F.round(grid.green_blend(F.col("d0"), F.col("d1")), 6).alias("green"))


@query("gr04_bilinear", view_sql("listings", "scores") + CELLS + """, n AS (SELECT max(r) + 1 AS rows, max(c) + 1 AS cols FROM g), p AS (SELECT id, coalesce(d0, 0) / 100 * (rows + 2) - 1.25 AS row, coalesce(d1, 0) / 100 * (cols + 2) - 1.25 AS col, rows, cols FROM scores, n), k AS (SELECT *, floor(row) AS r0, floor(col) AS c0, row - floor(row) AS tr, col - floor(col) AS tc FROM p WHERE row >= -0.5 AND row <= rows - 0.5 AND col >= -0.5 AND col <= cols - 0.5),
x AS (SELECT id, least(greatest(r0 + a, 0), rows - 1) AS r, least(greatest(c0 + b, 0), cols - 1) AS c, CASE WHEN a = 1 THEN tr ELSE 1 - tr END * CASE WHEN b = 1 THEN tc ELSE 1 - tc END AS w FROM k, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS v(a, b)), y AS (SELECT x.id, count(*) AS n, sum(g.value * x.w) AS b, avg(g.value) AS m FROM x JOIN g ON g.r = x.r AND g.c = x.c AND g.value IS NOT NULL GROUP BY 1) SELECT p.id, round(CASE WHEN n = 4 THEN b ELSE m END, 4) AS value FROM p LEFT JOIN y USING (id)""")
def gr04(spark, d):
    g = cells(spark, d)
    size = g.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    rows, cols = size["r"] + 1, size["c"] + 1
    at = lambda c, n: F.coalesce(c, F.lit(0.0)) / 100 * (n + 2) - 1.25
    p = view(spark, d, "scores").select("id", at(F.col("d0"), rows).alias("row"), at(F.col("d1"), cols).alias("col"))
    return grid.sample_grid(p, g, rows, cols).select("id", F.round("value", 4).alias("value"))


@query("gr05_view_range", view_sql("listings") + CELLS + ", b AS (SELECT n_nationkey AS box, n_nationkey AS r_min, n_nationkey + 5 AS r_max, n_nationkey AS c_min, n_nationkey + n_regionkey * 3 AS c_max FROM nation), i AS (SELECT b.box, value, row_number() OVER (PARTITION BY b.box ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY b.box) AS n FROM g JOIN b ON r BETWEEN r_min AND r_max AND c BETWEEN c_min AND c_max WHERE value IS NOT NULL), p AS (SELECT box, n, max(CASE WHEN k = floor(0.05 * (n - 1)) THEN value END) AS lo, max(CASE WHEN k = ceil(0.95 * (n - 1)) THEN value END) AS hi FROM i GROUP BY 1, 2) SELECT box, lo, hi FROM p WHERE n >= 4 AND hi - lo >= 1e-6")
def gr05(spark, d):
    n = F.col("n_nationkey")
    boxes = spark.read.parquet(f"{d}/nation.parquet").select(n.alias("box"), n.alias("r_min"), (n + 5).alias("r_max"), n.alias("c_min"), (n + F.col("n_regionkey") * 3).alias("c_max"))
    return grid.view_range(cells(spark, d), boxes)


@query("vl02_gates", view_sql("scores") + ", l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS dim, {x} AS v FROM scores WHERE {x} IS NOT NULL" for x, n in (("d0", "crime"), ("d1 / 20 + 45", "noise"), ("d2 / 20 + 45", "air_quality"), ("d3", "composite"))) + "), r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY dim) AS n FROM l), s AS (SELECT dim, stddev_pop(v) AS sd, avg(CASE WHEN v BETWEEN 45 AND 55 THEN 1.0 ELSE 0 END) AS mid, max(CASE WHEN k = least(n - 1, floor(n * 0.05)) THEN v END) AS p5, max(CASE WHEN k = least(n - 1, floor(n * 0.95)) THEN v END) AS p95 FROM r GROUP BY 1) SELECT dim, CASE dim WHEN 'air_quality' THEN TRUE WHEN 'composite' THEN p95 - p5 >= 70 AND sd >= 20 ELSE sd >= 12 AND p95 - p5 >= 35 AND mid <= 0.45 END AS passes FROM s")
def vl02(spark, d):
    s = view(spark, d, "scores").select(F.col("d0").alias("crime"), (F.col("d1") / 20 + 45).alias("noise"), (F.col("d2") / 20 + 45).alias("air_quality"), F.col("d3").alias("composite"))
    return grid.gates(grid.spread(s, ["crime", "noise", "air_quality", "composite"])).select("dim", "passes")


@query("vl03_ground_truth", view_sql("scores") + ", p AS (SELECT CASE id % 2 WHEN 0 THEN 'd0' ELSE 'd1' END AS dim, id AS higher, id + 1 AS lower FROM scores WHERE id % 5 = 0), s AS (SELECT id, 'd0' AS dim, d0 AS score FROM scores UNION ALL SELECT id, 'd1', d1 FROM scores) SELECT p.dim, p.higher, p.lower, a.score AS score_higher, b.score AS score_lower, round(a.score - b.score, 1) AS margin, coalesce(a.score - b.score > 5, FALSE) AS passes FROM p LEFT JOIN s a ON a.dim = p.dim AND a.id = p.higher LEFT JOIN s b ON b.dim = p.dim AND b.id = p.lower")
def vl03(spark, d):
    s = view(spark, d, "scores")
    probes = s.where("id % 5 = 0").select(F.when(F.col("id") % 2 == 0, "d0").otherwise("d1").alias("dim"), F.col("id").alias("higher"), (F.col("id") + 1).alias("lower"))
    each = lambda x: s.select("id", F.lit(x).alias("dim"), F.col(x).alias("score"))
    return grid.ground_truth(probes, each("d0").union(each("d1")))


@query("vl06_admin_filter", view_sql("scores") + " SELECT id FROM scores WHERE (d0 BETWEEN 20 AND 80 OR d0 IS NULL) AND (d1 BETWEEN 0 AND 60 OR d1 IS NULL) AND coalesce(CASE WHEN d2 > 50 THEN 100 WHEN d2 <= 50 THEN 0 END, 0) = 0 AND CASE WHEN d3 > 30 THEN 100 WHEN d3 <= 30 THEN 0 END = 100")
def vl06(spark, d):
    flag = lambda c, at: F.when(F.col(c) > at, 100.0).when(F.col(c) <= at, 0.0)
    s = view(spark, d, "scores").withColumns({"flood": flag("d2", 50), "stab": flag("d3", 30)})
    return grid.admin_filter(s, {"d0": (20, 80), "d1": (0, 60)}, {"flood": False, "stab": True}).select("id")


@query("jn13_degrade", view_sql("listings", "stations") + " SELECT l.id, 0 AS bus_routes, 0 AS severance_m, 0 AS ada_nearby FROM listings l")
def jn13(spark, d):
    """A scorer whose tables of stops, roads and stations are missing: those parts are zero, the plan never asks for them."""
    from terrascore.operators import surroundings

    out = surroundings.transit(view(spark, d, "listings").select("id", "lat", "lon"), view(spark, d, "entrances"), None, None, None)
    return out.select("id", "bus_routes", "severance_m", "ada_nearby")




@query("src02_versions", view_sql("lots") + " SELECT version, count(*) AS n, CAST(sum(unitsres) AS BIGINT) AS units FROM lots, (VALUES (2), (3), (4)) AS v(version) WHERE lot_id % 5 < version GROUP BY 1")
def src02(spark, d):
    """A table published four times, three versions kept, each read by its number."""
    path, lots = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}", view(spark, d, "lots").select("lot_id", "unitsres")
    for k in range(1, 5):
        versions.publish(lots.where(F.col("lot_id") % 5 < k), path, expect=k - 1, keep=3)
    out = None
    for v in versions.versions(spark, path):
        one = versions.published(spark, path, v.number).agg(F.count("*").alias("n"), F.sum("unitsres").alias("units")).select(F.lit(v.number).alias("version"), "n", "units")
        out = one if out is None else out.unionByName(one)
    return out
