"""Queries of feeds, composites, comparisons, the scorer engine and baselines from populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.functions import geo
from terrascore.operators import engine, rank, stats
from terrascore.plans.listing_queries import AMENITIES, amenity_array, history_of
from terrascore.plans.registry import COMPOSITE, DIMS, GROUPED, GROUPS, HAV, composed, query
from terrascore.plans.scorer_queries import UNITS_FREE, filed, keyed, severing, squares
from terrascore.sources.views import AS_OF_EVENTS, view, view_sql


def listed(spark: SparkSession, d: str) -> DataFrame:
    """Listings with their dimensions, groups, composite and coverage."""
    c = rank.coverage(composed(spark, d), DIMS).select("id", *DIMS, *GROUPS, "composite", "coverage")
    return view(spark, d, "listings").withColumn("amenities", amenity_array()).join(c, "id")


COVER = "(" + " + ".join(f"CAST({x} IS NOT NULL AS INT)" for x in DIMS) + ")"
LISTED = f"{GROUPED}, {COMPOSITE}, lc AS (SELECT l.*, {AMENITIES} AS am, c.* EXCLUDE (id, neighborhood, beds), {COVER} / 10 AS coverage FROM listings l JOIN c USING (id))"
ACTIVE = "upper(status) = 'ACTIVE' AND lat IS NOT NULL AND lon IS NOT NULL"


@query("rk04_composite_percentile", view_sql("listings", "scores") + f", {LISTED}, f AS (SELECT composite AS v, row_number() OVER (ORDER BY composite) - 1 AS r, count(*) OVER () AS n FROM lc WHERE status = 'ACTIVE'), gr AS (SELECT i, least(n - 1, CAST(round_even(i * (n - 1) / 1000, 0) AS BIGINT)) AS at FROM (SELECT unnest(range(0, 1001)) AS i), (SELECT max(n) AS n FROM f)), q AS (SELECT i, f.v AS q FROM gr JOIN f ON f.r = gr.at), u AS (SELECT DISTINCT composite AS v FROM lc), k AS (SELECT u.v, count(*) FILTER (q.q < u.v) AS lo, count(*) FILTER (q.q <= u.v) AS hi FROM u CROSS JOIN q GROUP BY 1) SELECT id, composite, CASE WHEN hi = 0 THEN 0.0 WHEN lo = 1001 THEN 100.0 ELSE least(100.0, round_even((lo + hi) / 20.0, 1)) END AS composite_percentile FROM lc JOIN k ON k.v = lc.composite")
def rk04(spark, d):
    return rank.composite_percentile(listed(spark, d)).select("id", "composite", "composite_percentile")


@query("rk06_feed", view_sql("listings", "scores") + f", {LISTED} SELECT id, price, composite, count(*) OVER () AS total FROM lc WHERE {ACTIVE} AND beds IN (1, 2, 3) AND price >= 2700 AND price <= 5400 AND lower(neighborhood) IN ('brand#1', 'brand#2', 'brand#3', 'brand#4', 'brand#5', 'brand#12', 'brand#7') AND rent_stabilized = 0 AND sqft >= 350 AND available_at <= DATE '2024-03-20' AND composite >= 20 AND {COVER} >= 8")
def rk06(spark, d):
    hoods = [" Brand#1", "BRAND#12", "brand#2", "brand#3", "brand#4", "brand#5", "brand#7 "]
    f = rank.feed(listed(spark, d), [1, 2, 3], (2700, 5400), hoods, False, 20, 350, "2024-03-20", None, 0.75, DIMS)
    return f.select("id", "price", "composite").crossJoin(F.broadcast(f.agg(F.count("*").alias("total"))))


@query("rk06_feed_amenities", view_sql("listings", "scores") + f", {LISTED} SELECT id FROM lc WHERE {ACTIVE} AND list_contains(am, 'Doorman') AND list_contains(am, 'Bike Storage')")
def rk06_amenities(spark, d):
    return rank.feed(listed(spark, d), amenities=["Doorman", " Bike Storage"]).select("id")


@query("rk07_page", view_sql("listings", "scores") + f", {LISTED} SELECT id, composite, coverage FROM lc WHERE {ACTIVE} ORDER BY composite DESC NULLS LAST, coverage DESC, id LIMIT 50 OFFSET 50")
def rk07(spark, d):
    f = rank.feed(listed(spark, d))
    return rank.page(f, rank.sort_column("composite", DIMS, GROUPS), 2, 50).select("id", "composite", "coverage")


NO_D8 = "(coalesce(d9, 0)) / nullif(CAST(d9 IS NOT NULL AS INT), 0)"


@query("rk07_sort_excluded", view_sql("listings", "scores") + f", {LISTED} SELECT id, round({NO_D8}, 6) AS sorted_by FROM lc WHERE {ACTIVE} ORDER BY {NO_D8} DESC NULLS LAST, coverage DESC, id LIMIT 40")
def rk07_excluded(spark, d):
    by = rank.sort_column("d8", DIMS, GROUPS, frozenset({"d8"}))
    return rank.page(rank.feed(listed(spark, d)), by, 1, 40).select("id", F.round(by, 6).alias("sorted_by"))


@query("rk07_every_dimension", view_sql("listings", "scores") + f", {LISTED} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{x}' AS sort, id FROM lc WHERE {ACTIVE} ORDER BY {x} DESC NULLS LAST, coverage DESC, id LIMIT 3)" for x in [*DIMS, *GROUPS, "price"]))
def rk07_every(spark, d):
    f, out = rank.feed(listed(spark, d)), None
    for x in [*DIMS, *GROUPS, "price"]:
        p = rank.page(f, rank.sort_column(x, DIMS, GROUPS), 1, 3).select(F.lit(x).alias("sort"), "id")
        out = p if out is None else out.union(p)
    return out


def comparables(spark: SparkSession, d: str) -> DataFrame:
    """(id, other, km, price_ratio, a, b): candidates with both sides' group scores."""
    x = listed(spark, d).select("id", "lat", "lon", "price", F.array(*GROUPS).alias("v"))
    other = x.select(F.col("id").alias("other"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("price").alias("o_price"), F.col("v").alias("b"))
    c = rank.candidates(view(spark, d, "listings")).select("id", "other").join(x, "id").join(other, "other")
    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) / 1000
    return c.select("id", "other", km.alias("km"), (F.abs(F.col("o_price") - F.col("price")) / F.col("price")).alias("price_ratio"), F.col("v").alias("a"), "b")


CAND = "abs(a.lat - b.lat) + abs(a.lon - b.lon)"
CAND_ON = "a.beds = b.beds AND a.id <> b.id AND b.price BETWEEN a.price * 0.5 AND a.price * 1.5"
FIFTY = ", ".join(f"CASE WHEN coalesce({{t}}.{g}, 0) = 0 THEN 50.0 ELSE {{t}}.{g} END" for g in GROUPS)
CANDIDATES = f"""act AS (SELECT * FROM listings WHERE status = 'ACTIVE'), h AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY {CAND}, b.id) AS rank FROM act a JOIN act b ON {CAND_ON} AND a.neighborhood = b.neighborhood), h2 AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM h WHERE rank <= 50), e AS (SELECT DISTINCT id FROM h2 WHERE n >= 12), w AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY {CAND}, b.id) AS rank FROM act a JOIN act b ON {CAND_ON} AND a.borough = b.borough AND abs(a.lat - b.lat) <= 0.03 AND abs(a.lon - b.lon) <= 0.03 WHERE a.id NOT IN (SELECT id FROM e)), w2 AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM w WHERE rank <= 50),
cand AS (SELECT id, other FROM h2 WHERE id IN (SELECT id FROM e) AND n >= 3 UNION ALL SELECT id, other FROM w2 WHERE n >= 3), pr AS (SELECT cand.id, cand.other, {HAV(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} / 1000 AS km, abs(b.price - a.price) / a.price AS ratio, [{FIFTY.format(t='a')}] AS av, [{FIFTY.format(t='b')}] AS bv FROM cand JOIN lc a ON a.id = cand.id JOIN lc b ON b.id = cand.other)"""


@query("rk10_similar", view_sql("listings", "scores") + f", {LISTED}, {CANDIDATES}, sc AS (SELECT *, list_cosine_similarity(av, bv) / ((1 + 3 * km) * (1 + 2 * ratio)) AS s FROM pr), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS k FROM sc) SELECT id, CAST(k AS INT) AS rank, round(s, 4) AS score FROM r WHERE k <= 5")
def rk10(spark, d):
    return rank.similar(comparables(spark, d)).select("id", "rank", F.round("score", 4).alias("score"))


@query("rk11_also_consider")
def rk11(spark, d):
    return rank.also_consider(comparables(spark, d), list(GROUPS))


CHOSEN = [3, 17, 42, 64, 101, 150]


@query("rk12_compare", view_sql("scores") + f", {GROUPED}, {COMPOSITE}, l AS (" + " UNION ALL ".join(f"SELECT id, '{x}' AS \"column\", {x} AS value FROM c WHERE {x} IS NOT NULL AND id IN {tuple(CHOSEN)}" for x in [*GROUPS, "composite"]) + "), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY value DESC, id) AS rank, value - avg(value) OVER (PARTITION BY \"column\") AS vs, count(*) OVER (PARTITION BY \"column\") AS n FROM l) SELECT id, \"column\", round(value, 6) AS value, CAST(rank AS INT) AS rank, round(vs, 6) AS vs_mean, rank = 1 AS is_winner, CASE WHEN rank = 1 AND vs > 5 THEN 'best' WHEN rank = n AND vs < -5 THEN 'lowest' END AS flag FROM r")
def rk12(spark, d):
    c = rank.compare(composed(spark, d), [*GROUPS, "composite"], CHOSEN)
    return c.withColumns({x: F.round(x, 6) for x in ("value", "vs_mean")})


@query("rk12_strengths", view_sql("scores") + f", {GROUPED}, l AS (" + " UNION ALL ".join(f"SELECT id, '{x}' AS c, {x} AS value FROM g WHERE {x} IS NOT NULL AND id IN {tuple(CHOSEN)}" for x in GROUPS) + "), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY value DESC, id) AS rank, value - avg(value) OVER (PARTITION BY c) AS vs, count(*) OVER (PARTITION BY c) AS n FROM l) SELECT id, coalesce(string_agg(CASE WHEN rank = 1 AND vs > 5 THEN c END, ',' ORDER BY c), '') AS strengths, coalesce(string_agg(CASE WHEN rank = n AND vs < -5 THEN c END, ',' ORDER BY c), '') AS weaknesses FROM r GROUP BY 1")
def rk12_strengths(spark, d):
    s = rank.strengths(rank.compare(composed(spark, d), list(GROUPS), CHOSEN))
    return s.select("id", F.array_join("strengths", ",").alias("strengths"), F.array_join("weaknesses", ",").alias("weaknesses"))


@query("rk14_components", view_sql("scores") + " " + " UNION ALL ".join(f"SELECT id, '{g}' AS dim, concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN concat('{c}=', CAST(round(CAST({c} * 10 AS BIGINT)) AS VARCHAR)) END" for c in cols) + f") AS components FROM scores" for g, cols in GROUPS.items()))
def rk14(spark, d):
    s = view(spark, d, "scores").select("id", *((F.col(c) * 10).cast("decimal(20,0)").alias(c) for c in DIMS))
    m = rank.component_map(s, GROUPS)
    return m.select("id", "dim", F.array_join(F.transform(F.map_entries("components"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("components"))


# the engine


def tables_of(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Every table that the scorers read, by the name they ask for."""
    names = ["incidents", "complaints", "licences", "lots", "entrances", "stations", "stops", "streets", "amenities", "supermarkets", "trees", "gardens", "school_sites", "shelters", "projects", "crashes", "trucks", "firehouses", "readings", "inspections"]
    out = {n: view(spark, d, n) for n in names}
    parks, edges = squares(spark, d)
    notices, cases = keyed(spark, d, "notices"), keyed(spark, d, "cases")
    out |= {"parks": parks, "park_edges": edges, "severing": severing(spark, d), "shootings": view(spark, d, "shootings"), "encampments": view(spark, d, "complaints").where("type = 'Encampment'")}
    out |= {"notices": notices.select("lot_id", "category", "minor", "day"), "dob": notices.where("notice_id % 2 = 0").select("lot_id", "type"), "hpd": notices.select("lot_id", "class", F.col("day").alias("inspected"), "certified", "status", "description")}
    out |= {"permits": cases.where("kind = 'permit'"), "litigations": cases.where("kind = 'litigation'").select("lot_id"), "evictions": cases.where("kind = 'eviction'").select("lot_id", "day"), "bedbug_filings": filed(spark, d)}
    return out


def to_score(spark: SparkSession, d: str) -> DataFrame:
    x = view(spark, d, "listings").withColumn("amenities", amenity_array())
    return x.join(history_of(spark, d), F.col("id") == F.col("listing_id"), "left").drop("listing_id")


CELL8 = "floor((l.lon + 180) / 360 * 1048576) * 1048576 + floor((l.lat + 90) / 180 * 1048576)"


@query("sc21_schools_by_cell", view_sql("listings", "school_sites") + f""", a AS (SELECT l.*, {CELL8} AS cell FROM listings l WHERE status = 'ACTIVE'), f AS (SELECT cell, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon FROM a GROUP BY 1), r AS (SELECT *, round((coalesce(CASE WHEN attendance > 0 THEN attendance END, 0) + coalesce(CASE WHEN safe > 0 THEN safe END, 0)) / nullif(CAST(coalesce(attendance > 0, FALSE) AS INT) + CAST(coalesce(safe > 0, FALSE) AS INT), 0) * 100, 1) AS rating FROM school_sites), b AS (SELECT f.cell, max(r.rating) AS rating FROM f JOIN r ON r.rating > 0 AND abs(f.lat - r.lat) <= 0.014 AND abs(f.lon - r.lon) <= 0.014 GROUP BY 1)
SELECT l.id, CASE WHEN l.status = 'ACTIVE' THEN coalesce(b.rating, 0) END AS schools_score FROM listings l LEFT JOIN a ON a.id = l.id LEFT JOIN b ON b.cell = a.cell""")
def sc21_schools(spark, d):
    x = view(spark, d, "listings")
    return engine.write_back(x, engine.run(x, {"school_sites": view(spark, d, "school_sites")}, AS_OF_EVENTS, ["schools"])).select("id", "schools_score")


@query("snk01_write_back", view_sql("listings", "scores") + " SELECT l.id, CASE WHEN s.id IS NOT NULL AND s.id % 2 = 0 THEN s.d0 ELSE l.price / 1000 END AS deal_score FROM listings l LEFT JOIN scores s USING (id)")
def snk01(spark, d):
    x = view(spark, d, "listings").select("id", (F.col("price") / 1000).alias("deal_score"))
    return engine.write_back(x, {"deal": view(spark, d, "scores").where("id % 2 = 0").select("id", F.col("d0").alias("score"))})


FROZEN = "f AS (SELECT {v} AS v, row_number() OVER (ORDER BY {v}) - 1 AS r, count(*) OVER () AS n FROM {t}), g AS (SELECT i, least(n - 1, CAST(round_even(i * (n - 1) / 1000, 0) AS BIGINT)) AS at FROM (SELECT unnest(range(0, 1001)) AS i), (SELECT max(n) AS n FROM f)) SELECT i, round(f.v, 3) AS q FROM g JOIN f ON f.r = g.at"
CELL7 = "floor((lon + 180) / 360 * 262144) * 131072 + floor((lat + 90) / 180 * 131072)"


@query("nm09_baseline_from_cells", view_sql("lots", "trees", "gardens") + f""", home AS (SELECT *, {CELL7} AS cell FROM lots WHERE unitsres > 0), listings AS (SELECT cell AS id, arg_min(lat, lot_id) AS lat, arg_min(lon, lot_id) AS lon FROM home GROUP BY 1), {UNITS_FREE}, {FROZEN.format(v='weighted', t='m')}""")
def nm09(spark, d):
    parks, edges = squares(spark, d)
    tables = {"trees": view(spark, d, "trees"), "gardens": view(spark, d, "gardens"), "parks": parks.where("false"), "park_edges": edges.where("false")}
    q = engine.baseline_from_cells(engine.SCORERS["greenery"], view(spark, d, "lots"), tables, AS_OF_EVENTS, 1_000_000)
    return q.select(F.posexplode("q").alias("i", "q")).select(F.col("i").cast("long").alias("i"), F.round("q", 3).alias("q"))


@query("nm10_baseline_from_listings", view_sql("listings") + f", a AS (SELECT CAST(price AS DOUBLE) AS v FROM listings WHERE status = 'ACTIVE' AND price IS NOT NULL), {FROZEN.format(v='v', t='a')}")
def nm10(spark, d):
    q = engine.baseline_from_listings(view(spark, d, "listings").withColumn("component", F.col("price").cast("double")), "component")
    return q.select(F.posexplode("q").alias("i", "q")).select(F.col("i").cast("long").alias("i"), F.round("q", 3).alias("q"))


@query("ag08_trend_guard", view_sql("incidents") + ", m AS (SELECT max(day) AS m FROM incidents) SELECT k AS as_of, (k - m) <= 30 AS fresh, greatest(0, least(1, (182 - (k - m)) / 182)) >= 0.7 AS covered FROM m, (VALUES (DATE '2024-01-31'), (DATE '2024-03-01'), (DATE '2024-03-20'), (DATE '2024-06-01')) AS v(k)")
def ag08(spark, d):
    out = None
    for day in ("2024-01-31", "2024-03-01", "2024-03-20", "2024-06-01"):
        x = view(spark, d, "incidents")
        row = stats.trend_guard(x, "day", day, lag_days=30).withColumnRenamed("usable", "fresh").crossJoin(stats.trend_guard(x, "day", day, coverage=0.7).withColumnRenamed("usable", "covered"))
        row = row.select(F.lit(day).cast("date").alias("as_of"), "fresh", "covered")
        out = row if out is None else out.union(row)
    return out
