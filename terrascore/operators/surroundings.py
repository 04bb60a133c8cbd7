"""Scorers of what lies around a place: noise, transit, parks, greenery, convenience, facilities, schools, air, roads, crashes.

Each takes places (id, lat, lon), the tables it reads, and an explicit day where ages count; it returns one row a place with
its components and raw metric. ``score_against`` turns a metric into 0-100 by a frozen baseline or a fallback. A table
that is missing (None) degrades the part that reads it, decided when the plan is built.

Places of the same coordinates are worked out once, and rows of the same coordinates are summed, or cut to those that can
count, before they meet places: work and memory go by pairs of spots, not by pairs of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.functions.geo import LAT_M, LON_M, decay, gauss, half_even
from terrascore.sources.store import cut

from .scorers import lookup, right_points
from .polygons import dots_inside
from .spatial import at_spots, box_join, edge_distance, nearest_join, nearest_rows, occluding_rows, path_length, path_penalty, per_spot, radius_join, shielded, within
from .stats import baseline_score, kernel_units, median_inverse, seasonal_factor, trend, trend_direction, trend_guard

#: Noise complaint types and what one location may add to each; weights of licence classes by words.
NOISE_CAPS = {"Noise - Residential": 6.0, "Noise - Street/Sidewalk": 6.0, "Noise - Commercial": 20.0, "Noise - Vehicle": 10.0, "Noise - Park": 10.0, "Noise": 10.0}
LICENCE_OFF = ("grocery", "liquor store", "wine store", "drug store", "wholesale", "importer", "winemaker")
LICENCE_BAR = ("bar", "club", "cabaret", "tavern")
LICENCE_RESTAURANT = ("restaurant", "eating", "catering", "food & beverage")
#: Routes that never reach the centre, for stations without that column.
OUTER_ROUTES = ("G", "SIR")
#: Park tiers (least acres, quality, reach in metres) and multipliers of park types.
PARK_TIERS = ((100.0, 1.00, 2000), (15.0, 0.95, 1200), (3.0, 0.85, 800), (0.5, 0.70, 500), (0.0, 0.55, 300))
PARK_TYPES = {
    "triangle/plaza": 0.1, "triangle": 0.1, "plaza": 0.1, "mall": 0.1, "strip": 0.1, "parkway": 0.1, "cemetery": 0.1,
    "playground": 0.7, "jointly operated playground": 0.7, "neighborhood park": 1.0, "community park": 1.0, "flagship park": 1.0, "nature area": 0.9,
}
#: Paths up to this length aren't severed, see path_penalty; how far apart centres of parks close by are; and of all.
PATH_LEAST_M = 40.0
CLOSE_DELTA = 0.003
PARK_DELTA = 2000 / 111_320 * 1.5
#: Categories with their weight in the count, the cap and the weight in the metric.
CONVENIENCE = {"grocery": (3, 8.0, 30.0), "pharmacy": (3, 4.0, 20.0), "gym": (2, 4.0, 15.0), "laundry": (2, 3.0, 15.0), "dining": (1, 30.0, 20.0)}
#: Facility weights by words, the first that fits.
FACILITY = ((("DROP-IN", "INTAKE", "OUTREACH"), 1.5), (("SHELTER",), 1.2), (("SUPPORTED", "SUPPORTIVE", "SRO"), 0.4), (("HOMEBASE",), 0.2))
#: Road classes: highways, those that crashes are told by, and weights of the others.
HIGHWAYS = ("motorway", "motorway_link", "trunk", "trunk_link")
MAJOR = (*HIGHWAYS, "primary")
ROAD_WEIGHT = {"primary": 5.0, "secondary": 3.0, "tertiary": 1.5}
OCCLUSION = (1.0, 0.45, 0.2)
SCHOOL_HOURS = (7, 8, 14, 15, 16)
#: Pollutants.
PM25, NO2 = "Fine particles (PM 2.5)", "Nitrogen dioxide (NO2)"


def _once_a_spot(scorer: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A scorer of coordinates alone, run over the distinct spots of places."""

    @wraps(scorer)
    def over(places: DataFrame, *tables, **more) -> DataFrame:
        return per_spot(places, lambda spots: scorer(spots, *tables, **more))

    return over


def score_against(df: DataFrame, metric: str, quantiles: DataFrame | None, reverse: bool, zero_is_perfect: bool, fallback) -> DataFrame:
    """df with score, to one decimal: by the baseline's quantiles (one row, array q), or fallback(df) where there is none."""
    if quantiles is None:
        return fallback(df)
    return df.crossJoin(F.broadcast(quantiles)).withColumn("score", F.round(baseline_score(F.col("q"), F.col(metric), reverse, zero_is_perfect), 1)).drop("q")


def _near(places: DataFrame, right: DataFrame, radius_m: float, *columns: str) -> DataFrame:
    return radius_join(places.select("id", "lat", "lon"), right_points(right, *columns), radius_m)


def _nearest(places: DataFrame, right: DataFrame, radius_m: float, *columns: str) -> DataFrame:
    """(id, b): the nearest row of right (lat, lon, columns), a struct of dist_m, the columns and r_lat and r_lon, by which ties go."""
    near = nearest_rows(places.select("id", "lat", "lon"), right_points(right, *columns), radius_m)
    return near.groupBy("id").agg(F.min(F.struct("dist_m", *columns, "r_lat", "r_lon")).alias("b"))


def _with(places: DataFrame, *parts: DataFrame) -> DataFrame:
    out = places.select("id")
    for p in parts:
        out = out.join(p, "id", "left")
    return out


def _or(column: str, value) -> Column:
    return F.coalesce(F.col(column), F.lit(value)).alias(column)


def has_words(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.greatest(*(F.contains(text, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(text, F.lit(words[0])), F.lit(False))


def licence_weight(description: Column) -> Column:
    """Weight of a licence: bars 1.5, restaurants 0.6, others 1; null if drink leaves the premises."""
    d = F.lower(F.coalesce(description, F.lit("")))
    return F.when(has_words(d, LICENCE_OFF), None).when(has_words(d, LICENCE_BAR), 1.5).when(has_words(d, LICENCE_RESTAURANT), 0.6).otherwise(1.0)


@_once_a_spot
def noise(places: DataFrame, complaints: DataFrame, licences: DataFrame | None, lots: DataFrame, as_of: str, radius_m: float = 150.0, unit_floor: float = 150.0) -> DataFrame:
    """(id, complaints, weighted, nightlife, rate, trend_ratio, trend_direction).

    complaints: (lat, lon, type, descriptor, day); licences: (lat, lon, description, expires). Weights are kernel times
    recency, summed and capped for each location and type; the rate is per 1000 weighted units, over the season's factor."""
    today = F.lit(as_of).cast("date")
    known = complaints.where(F.col("type").isin(*NOISE_CAPS))
    after = F.when((F.col("type") == "Noise") & has_words(F.lower("descriptor"), ("after hours",)), 1.2).otherwise(1.0)
    late = F.coalesce(F.col("day") >= F.date_sub(today, 182), F.lit(False))
    at = at_spots(known, F.sum(decay(F.col("day"), today) * after).alias("w"), F.count("*").alias("n"), F.count_if(late).alias("recent"), by=("type",))
    near = _near(places, at, radius_m, "type", "w", "n", "recent").withColumn("w", gauss(F.col("dist_m"), radius_m / 2) * F.col("w"))
    per = near.groupBy("id", F.round("r_lat", 4).alias("a"), F.round("r_lon", 4).alias("o"), "type").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.sum("recent").alias("recent"))
    per = per.groupBy("id").agg(F.sum("n").alias("complaints"), F.sum(F.least("w", lookup(NOISE_CAPS, F.col("type")))).alias("weighted"), F.sum("recent").alias("recent"))
    parts = [per]
    if licences is not None:
        lic = licences.withColumn("lw", licence_weight(F.col("description"))).where("lw is not null").where(F.col("expires").isNull() | (F.col("expires") >= today))
        parts.append(_near(places, at_spots(lic, F.sum("lw").alias("lw")), radius_m, "lw").groupBy("id").agg(F.sum(F.col("lw") * gauss(F.col("dist_m"), radius_m / 2)).alias("nightlife")))
    out = _with(places, *parts, kernel_units(places, lots, radius_m)).crossJoin(F.broadcast(seasonal_factor(complaints, "day", int(as_of[5:7])))).crossJoin(F.broadcast(trend_guard(complaints, "day", as_of, lag_days=30)))
    night = F.coalesce("nightlife", F.lit(0.0)) if licences is not None else F.lit(0.0)
    out = out.withColumn("nightlife", F.round(night, 3)).withColumn("weighted", F.round(F.coalesce("weighted", F.lit(0.0)), 3))
    rate = 1000 * (F.col("weighted") / F.col("factor") + 0.3 * F.col("nightlife")) / F.greatest("units", F.lit(unit_floor))
    recent, n = F.coalesce("recent", F.lit(0)), F.coalesce("complaints", F.lit(0))
    ratio = F.when(F.col("usable"), trend(recent, n - recent)).otherwise(1.0)
    return out.select("id", n.alias("complaints"), "weighted", "nightlife", F.round(rate, 3).alias("rate"), ratio.alias("trend_ratio"), trend_direction(ratio).alias("trend_direction"))


#: Entrances of a station up to which each knows those before it.
SIBLINGS = 32


def _stations(places: DataFrame, entrances: DataFrame, radius_m: float) -> DataFrame:
    """(id, station_count): distinct stations of the entrances (lat, lon, station_id) within the radius.

    An entrance counts where none of its station's earlier ones is within the radius too, so that pairs are summed and not
    shuffled. Entrances of stations that have very many are told apart by pairs of place and station."""
    e = at_spots(entrances.where("station_id is not null"), by=("station_id",))
    size = e.groupBy("station_id").agg(F.count("*").alias("n"))
    few = e.join(size.where(F.col("n") <= SIBLINGS), "station_id").groupBy("station_id").agg(F.array_sort(F.collect_list(F.struct("lat", "lon"))).alias("all"))
    few = few.select("all", F.posexplode("all").alias("i", "p")).select("p.lat", "p.lon", F.expr("slice(all, 1, i)").alias("before"))
    seen = F.exists("before", lambda x: within(F.col("lat"), F.col("lon"), x["lat"], x["lon"], radius_m))
    first = _near(places, few, radius_m, "before").where(~seen).groupBy("id").agg(F.count("*").alias("n"))
    many = _near(places, e.join(size.where(F.col("n") > SIBLINGS), "station_id", "left_semi"), radius_m, "station_id").select("id", "station_id").distinct().groupBy("id").agg(F.count("*").alias("n"))
    return first.unionByName(many).groupBy("id").agg(F.sum("n").alias("station_count"))


@_once_a_spot
def transit(places: DataFrame, entrances: DataFrame, stations: DataFrame | None, stops: DataFrame | None, roads: DataFrame | None) -> DataFrame:
    """(id, station_count, routes_served, nearest_m, bus_routes, ada_nearby, cbd_routes, severance_m, score), absolute.

    entrances: (lat, lon, station_id, routes by spaces); stations: (station_id, routes, cbd, ada); stops: (lat, lon, routes by
    commas); roads: (lat, lon, penalty). The nearest entrance's distance is cut to whole metres; without any it is 9999."""
    known = at_spots(entrances, F.min("station_id").alias("station_id"))
    best = _nearest(places, known, 800.0, "station_id").select("id", F.struct(F.floor("b.dist_m").cast("int").alias("m"), "b.r_lat", "b.r_lon").alias("best"))
    route = at_spots(entrances.select("lat", "lon", F.explode(F.split("routes", " ")).alias("route")).where("route <> ''"), by=("route",))
    routes = _near(places, route, 800.0, "route").select("id", "route").distinct()
    if stations is not None:
        each = stations.select(F.explode(F.split("routes", " ")).alias("route"), F.upper(F.trim(F.col("cbd").cast("string"))).isin("1", "TRUE", "T", "Y", "YES").alias("c"))
        centre = each.where("route <> ''").groupBy("route").agg(F.coalesce(F.max("c"), F.lit(False)).alias("central"))
        known = F.broadcast(centre.agg(F.coalesce(F.max("central"), F.lit(False)).alias("known")))
        # a route that no station names isn't in the list of outer ones, so it counts as central
        central = F.when(F.col("known"), F.coalesce("central", F.lit(True))).otherwise(~F.col("route").isin(*OUTER_ROUTES))
        routes = routes.join(F.broadcast(centre), "route", "left").crossJoin(known).withColumn("central", central)
    else:
        routes = routes.withColumn("central", ~F.col("route").isin(*OUTER_ROUTES))
    served = routes.groupBy("id").agg(F.count("*").alias("routes_served"), F.count_if("central").alias("cbd_routes"))
    parts = [_stations(places, entrances, 800.0), best, served]
    if stations is not None:
        ada = stations.where(F.col("ada").cast("string").try_cast("double") >= 1).select("station_id").distinct()
        parts.append(_near(places, at_spots(entrances.join(ada, "station_id", "left_semi")), 800.0).select("id").distinct().withColumn("ada_nearby", F.lit(1)))
    if stops is not None:
        bus = at_spots(stops.select("lat", "lon", F.explode(F.split("routes", ",")).alias("r")).withColumn("r", F.trim("r")).where("r <> ''"), by=("r",))
        parts.append(_near(places, bus, 300.0, "r").select("id", "r").distinct().groupBy("id").agg(F.count_distinct("r").alias("bus_routes")))
    if roads is not None:
        pairs = best.join(places.select("id", "lat", "lon"), "id").select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("best.r_lat").alias("lat2"), F.col("best.r_lon").alias("lon2"))
        parts.append(path_penalty(pairs, right_points(roads, "penalty"), key="id"))
    out = _with(places, *parts)
    for c in ("ada_nearby", "bus_routes", "penalty"):
        out = out if c in out.columns else out.withColumn(c, F.lit(None).cast("int"))
    nearest = F.coalesce("best.m", F.lit(9999))
    sev = F.rint(F.coalesce(F.col("penalty").cast("double"), F.lit(0.0))).cast("int")
    out = out.select("id", _or("station_count", 0), _or("routes_served", 0), nearest.alias("nearest_m"), _or("bus_routes", 0), _or("ada_nearby", 0), _or("cbd_routes", 0), sev.alias("severance_m"))
    way = F.least(F.lit(9999.0), F.col("nearest_m") + F.col("severance_m"))
    weighted = F.col("cbd_routes") + 0.45 * (F.col("routes_served") - F.col("cbd_routes"))
    subway = 100 * F.exp(-way / 400) * (0.6 + 0.4 * F.least(F.lit(1.0), weighted / 6))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), subway + F.least(F.lit(10.0), 2.0 * F.col("bus_routes"))))
    return out.withColumn("score", F.round(score, 1))


@_once_a_spot
def transit_simple(places: DataFrame, stations: DataFrame) -> DataFrame:
    """(id, station_count, routes_served, nearest_m, score): 12 a station and 3 a route within 800 m, from feed stations (lat, lon, station_id, routes array)."""
    near = _near(places, stations, 800.0, "station_id", "routes")
    agg = near.groupBy("id").agg(F.count("*").alias("station_count"), F.floor(F.min("dist_m")).cast("int").alias("nearest_m"))
    routes = near.select("id", F.explode("routes").alias("r")).groupBy("id").agg(F.count_distinct("r").alias("routes_served"))
    out = _with(places, agg, routes).select("id", _or("station_count", 0), _or("routes_served", 0), _or("nearest_m", 9999))
    return out.withColumn("score", F.least(F.lit(100.0), (12 * F.col("station_count") + 3 * F.col("routes_served")).cast("double")))


def _tier(acres: Column, which: int) -> Column:
    out = F.lit(float(PARK_TIERS[-1][which]))
    for tier in reversed(PARK_TIERS[:-1]):
        out = F.when(acres >= tier[0], F.lit(float(tier[which]))).otherwise(out)
    return out


@_once_a_spot
def parks(places: DataFrame, green: DataFrame, edges: DataFrame, roads: DataFrame | None) -> DataFrame:
    """(id, name, acres, type, type_mult, distance_m, severance_m, effective): the park of the best effective score.

    green: (park_id, name, acres, type, lat, lon of the centre); edges: see spatial.segments. Effective is quality times type
    multiplier times (1 - way / reach) * 100; the way is the distance to the outline and the severance towards the centre."""
    p = green.select("park_id", "lat", "lon", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), _tier(F.col("acres"), 1).alias("quality"), _tier(F.col("acres"), 2).alias("reach"), lookup(PARK_TYPES, F.lower(F.trim("type"))).alias("type_mult"))
    p = p.where("type_mult > 0")
    own = ("a_lat", "a_lon", "b_lat", "b_lon", "quality", "reach", "type_mult")
    gain = lambda way: (1 - way / F.col("reach")) * F.col("quality") * F.col("type_mult") * 100

    def seen(at: DataFrame, delta: float, least: str | None = None) -> DataFrame:
        """Pairs of a place and a park within its reach, centres within delta, with what the park is worth without severance; with least, those worth as much as that."""
        at = at.withColumns({"a_lat": F.col("lat"), "a_lon": F.col("lon")})
        test = lambda d: (d < F.col("reach")) & (gain(d) >= F.col(least)) if least else d < F.col("reach")
        c = edge_distance(at, p, edges, delta, asked=test, keep=(*own, least) if least else own).where(test(F.col("edge_m"))).withColumn("gain", gain(F.col("edge_m")))
        return c.withColumnsRenamed({"a_lat": "lat1", "a_lon": "lon1", "b_lat": "lat2", "b_lon": "lon2"})

    def severed(c: DataFrame) -> DataFrame:
        """(id, park_id, ..., severance_m, effective) of pairs that severance leaves within reach."""
        c = cut(c, "park-paths").withColumn("pair", F.struct("id", "park_id"))
        c = c.join(path_penalty(c.select("pair", "lat1", "lon1", "lat2", "lon2"), right_points(roads, "penalty")), "pair", "left").withColumn("severance_m", F.coalesce("penalty", F.lit(0.0)))
        return c.where(F.col("edge_m") + F.col("severance_m") < F.col("reach")).withColumn("effective", gain(F.col("edge_m") + F.col("severance_m")))

    if roads is None:
        c = seen(places, PARK_DELTA).withColumns({"severance_m": F.lit(0.0), "effective": F.col("gain")})
    else:
        # severance only takes away: a park worth less without it than another with it can't be the best, so its path isn't walked.
        # What the parks close by are worth is found first; a place without any has nothing to go by, and all its parks are walked to
        close = seen(places, CLOSE_DELTA)
        top = cut(close.groupBy("id").agg(F.max("gain").alias("most"), F.max(F.when(path_length() <= PATH_LEAST_M, F.col("gain"))).alias("free")), "park-gains")
        found = severed(seen(places.join(top, "id"), CLOSE_DELTA, "most")).groupBy("id").agg(F.max("effective").alias("found"))
        bound = top.join(found, "id", "left").select("id", F.greatest("free", "found").alias("least"))
        c = severed(seen(places.join(bound, "id", "left").fillna(0.0, ["least"]), PARK_DELTA, "least"))
    best = c.groupBy("id").agg(F.max_by(F.struct("park_id", "type_mult", F.floor("edge_m").cast("int").alias("distance_m"), F.round("severance_m", 1).alias("severance_m"), "effective"), F.struct("effective", -F.col("park_id"))).alias("b"))
    best = best.select("id", "b.*").join(green.select("park_id", "name", "acres", "type"), "park_id")
    return _with(places, best).select("id", "name", "acres", "type", "type_mult", "distance_m", "severance_m", F.coalesce("effective", F.lit(0.0)).alias("effective"))


@_once_a_spot
def park_fraction(places: DataFrame, rings: DataFrame, edges: DataFrame, radius_m: float = 200.0, points: int = 180, delta: float = 0.03) -> DataFrame:
    """(id, fraction): share of a disc that lies in any of the rings, by points in a sunflower pattern.

    rings: (park_id, lat, lon of the centre); edges of the same ids. Rings count whose centre lies within delta of the place; a place
    without such rings has 0. Points are made once a place and meet the cells of a cover of the rings, see polygons.cover."""
    i = F.col("i")
    r, t = F.lit(radius_m) * F.sqrt((i + 0.5) / points), i * (math.pi * (3 - math.sqrt(5)))
    dots = places.select("id", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    dots = dots.withColumn("plat", F.col("lat") + r * F.sin(t) / 111_320.0).withColumn("plon", F.col("lon") + r * F.cos(t) / (111_320.0 * F.cos(F.radians("lat"))))
    share = dots_inside(dots, rings, edges, delta).groupBy("id").agg((F.count("*") / points).alias("fraction"))
    return _with(places, share).select("id", _or("fraction", 0.0))


def greenery(places: DataFrame, trees: DataFrame, gardens: DataFrame, green: DataFrame, fraction: DataFrame) -> DataFrame:
    """(id, tree_count, canopy, garden_count, park_count, park_fraction, weighted, absolute).

    trees: (lat, lon, dbh); green: park centres; fraction: see park_fraction. Street trees count for the part of the disc that
    isn't park; ``absolute`` is the fallback score."""
    dbh = F.least(F.floor(F.coalesce("dbh", F.lit(0.0))), F.lit(36))
    k = gauss(F.col("dist_m"), 100.0)

    def around(spots: DataFrame) -> DataFrame:
        t = _near(spots, at_spots(trees, F.count("*").alias("n"), F.sum(dbh).alias("d")), 200.0, "n", "d").groupBy("id").agg(F.sum("n").alias("tree_count"), F.sum("d").alias("canopy"), F.sum(F.col("n") * k).alias("tw"), F.sum(k * F.col("d")).alias("cw"))
        g = _near(spots, at_spots(gardens, F.count("*").alias("n")), 500.0, "n").groupBy("id").agg(F.sum("n").alias("garden_count"), F.sum(F.col("n") * gauss(F.col("dist_m"), 250.0)).alias("gw"))
        p = box_join(spots, right_points(at_spots(green, F.count("*").alias("n")), "n"), 0.005).groupBy("id").agg(F.sum("n").alias("park_count"))
        return _with(spots, t, g, p)

    out = per_spot(places, around).join(fraction, "id", "left")
    out = out.select("id", _or("tree_count", 0), _or("canopy", 0), _or("garden_count", 0), _or("park_count", 0), F.least(F.coalesce("fraction", F.lit(0.0)), F.lit(0.55)).alias("f"), *(_or(c, 0.0) for c in ("tw", "cw", "gw")))
    again = 1 / (1 - F.col("f"))
    weighted = F.col("tw") * again / 200 * 40 + F.col("cw") * again / 2000 * 40 + F.col("gw") / 3 * 20
    root = lambda c, cap, w: F.sqrt(F.least(F.lit(1.0), F.col(c) / cap)) * w
    absolute = root("tree_count", 200, 40) + root("canopy", 2000, 40) + root("garden_count", 3, 20)
    return out.select("id", "tree_count", "canopy", "garden_count", "park_count", F.round("f", 3).alias("park_fraction"), F.round(weighted, 3).alias("weighted"), F.round(absolute, 1).alias("absolute"))


def _severed(places: DataFrame, nearest: DataFrame, roads: DataFrame | None) -> DataFrame:
    """nearest (id, r_lat, r_lon, ...) with penalty, that of the path there."""
    if roads is None:
        return nearest.withColumn("penalty", F.lit(0.0))
    pairs = nearest.join(places.select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), "id").select("id", "lat1", "lon1", F.col("r_lat").alias("lat2"), F.col("r_lon").alias("lon2"))
    return nearest.join(path_penalty(pairs, right_points(roads, "penalty"), key="id"), "id", "left")


@_once_a_spot
def convenience(places: DataFrame, amenities: DataFrame, supermarkets: DataFrame | None, roads: DataFrame | None, radius_m: float = 500.0) -> DataFrame:
    """(id, a count for each category, total, weighted, supermarket_count, supermarket_nearest_m, absolute).

    amenities: (lat, lon, category, key); supermarkets: (lat, lon, sqft, key). Kernels per category saturate by square roots.
    The nearest grocery and supermarket count at their distance with the severance on the way. Small supermarkets add a
    quarter to groceries; with supermarkets at hand groceries weigh half."""
    kernel = lambda d: gauss(d, radius_m / 2)
    cat = lambda c: F.col("category") == c
    kinds = at_spots(amenities.where(F.col("category").isin(*CONVENIENCE)), *(F.count_if(cat(c)).alias(c) for c in CONVENIENCE))
    agg = _near(places, kinds, radius_m, *CONVENIENCE).groupBy("id").agg(*(F.sum(c).alias(c) for c in CONVENIENCE), *(F.sum(F.col(c) * kernel(F.col("dist_m"))).alias(f"k_{c}") for c in CONVENIENCE))
    moved = lambda w: w * (kernel(F.col("dist_m") + F.col("penalty")) - kernel(F.col("dist_m")))
    first = _nearest(places, at_spots(amenities.where(cat("grocery")), F.min("key").alias("key")), radius_m, "key").select("id", "b.dist_m", "b.r_lat", "b.r_lon")
    grocery = _severed(places, first, roads).select("id", F.when(F.col("penalty") > 0, moved(F.lit(1.0))).otherwise(0.0).alias("g_move"))
    parts = [agg, grocery]
    if supermarkets is not None:
        size = F.coalesce(F.col("sqft"), F.lit(0.0))
        tier = F.when(size >= 6000, 1.5).when(size >= 3000, 1.0)
        shops = supermarkets.withColumn("tier", tier)
        sm = _near(places, at_spots(shops, F.count("tier").alias("n"), F.sum("tier").alias("t"), F.count_if(F.col("tier").isNull()).alias("small")), radius_m, "n", "t", "small")
        parts.append(sm.groupBy("id").agg(F.sum("n").alias("sm_count"), F.coalesce(F.sum(F.col("t") * kernel(F.col("dist_m"))), F.lit(0.0)).alias("sm"), F.sum(F.col("small") * 0.25 * kernel(F.col("dist_m"))).alias("g_small")))
        big = at_spots(shops.where("tier is not null"), F.min(F.struct("key", "tier")).alias("shop"))
        b = _nearest(places, big, radius_m, "shop").select("id", "b.dist_m", "b.r_lat", "b.r_lon", "b.shop.tier")
        parts.append(_severed(places, b, roads).select("id", F.round(F.col("dist_m") + F.col("penalty"), 1).alias("sm_nearest"), F.when(F.col("penalty") > 0, moved(F.col("tier"))).otherwise(0.0).alias("sm_move")))
    out = _with(places, *parts)
    with_sm = supermarkets is not None
    for c in ("sm_count", "sm", "g_small", "sm_nearest", "sm_move"):
        out = out if c in out.columns else out.withColumn(c, F.lit(None).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    groceries = zero("k_grocery") + zero("g_move") + zero("g_small")
    amount = {c: groceries if c == "grocery" else zero(f"k_{c}") for c in CONVENIENCE}
    root = lambda x, cap, w: F.sqrt(F.least(F.lit(1.0), x / cap)) * w
    weighted = sum((root(amount[c], cap, 15.0 if c == "grocery" and with_sm else w) for c, (_, cap, w) in CONVENIENCE.items()), F.lit(0.0))
    if with_sm:
        weighted = weighted + root(F.greatest(F.round(zero("sm") + zero("sm_move"), 3), F.lit(0.0)), 3.0, 15.0)
    n = {c: F.coalesce(c, F.lit(0)) for c in CONVENIENCE}
    total = sum((n[c] * w for c, (w, _, _) in CONVENIENCE.items()), F.lit(0))
    absolute = sum((root(n[c], cap, w) for c, (_, cap, w) in CONVENIENCE.items()), F.lit(0.0))
    count = F.coalesce("sm_count", F.lit(0)) if with_sm else F.col("sm_count")
    return out.select("id", *(x.alias(c) for c, x in n.items()), total.alias("total"), F.round(weighted, 2).alias("weighted"), count.alias("supermarket_count"), F.col("sm_nearest").alias("supermarket_nearest_m"), F.round(absolute, 1).alias("absolute"))


def facility_weight(kind: Column) -> Column:
    k, out = F.upper(F.coalesce(kind, F.lit(""))), F.lit(1.0)
    for words, w in reversed(FACILITY):
        out = F.when(has_words(k, words), w).otherwise(out)
    return out


@_once_a_spot
def facilities(places: DataFrame, shelters: DataFrame, projects: DataFrame, shootings: DataFrame | None, encampments: DataFrame | None, as_of: str) -> DataFrame:
    """(id, shelter_count, shelter_nearest_m, shelter_nearest_name, weighted_total, project_count, project_nearest_m,
    project_nearest_name, encampment_count, encampment_weighted, exposure).

    shelters: (lat, lon, name, kind); projects: (lat, lon, development), a row a building; shootings: (lat, lon, incident,
    day); encampments: (lat, lon, day). A development counts at its nearest building, times a factor by the distinct incidents
    of two years within 150 m of its buildings near the place. Encampments are capped at 6 for each location."""
    today, radius = F.lit(as_of).cast("date"), 800.0
    at = at_spots(shelters.where("lat <> 0 and lon <> 0"), F.count("*").alias("n"), F.sum(facility_weight(F.col("kind"))).alias("w"), F.min("name").alias("name"))
    s = _near(places, at, radius, "n", "w").groupBy("id").agg(F.sum("n").alias("s_count"), F.sum(F.col("w") * gauss(F.col("dist_m"), radius / 2)).alias("s_w"))
    s = s.join(_nearest(places, at, radius, "name").select("id", F.col("b").alias("s_best")), "id")
    named = at_spots(projects.where("lat <> 0 and lon <> 0").withColumn("development", F.coalesce("development", F.lit("unknown"))), by=("development",))
    if shootings is None:
        dev = _near(places, named, radius, "development").groupBy("id", "development").agg(F.min("dist_m").alias("d"))
        mult = F.lit(1.0)
    else:
        # buildings and incidents meet once for each building, whatever places see it; more than two are as good as three, so three
        # different ones of a spot, and of a building, tell whether there are none, up to two, or more
        recent = at_spots(shootings.where((F.col("day") >= F.date_sub(today, 730)) & F.col("incident").isNotNull()), by=("incident",))
        least = lambda df, *spot: df.withColumn("__k", F.row_number().over(Window.partitionBy(*spot).orderBy("incident"))).where("__k <= 3").drop("__k")
        hit = radius_join(named.select("lat", "lon").distinct(), right_points(least(recent, "lat", "lon"), "incident"), 150.0).select("lat", "lon", "incident").distinct()
        hit = least(hit, "lat", "lon").groupBy("lat", "lon").agg(F.collect_list("incident").alias("seen"))
        named = named.join(hit, ["lat", "lon"], "left").withColumn("full", F.coalesce(F.size("seen") >= 3, F.lit(False)).cast("int"))
        dev = _near(places, named, radius, "development", "full").groupBy("id", "development").agg(F.min("dist_m").alias("d"), F.max("full").alias("full"))
        some = _near(places, named.where("full = 0 and seen is not null"), radius, "development", "seen").select("id", "development", F.explode("seen").alias("incident")).distinct()
        dev = dev.join(some.groupBy("id", "development").agg(F.count("*").alias("n")), ["id", "development"], "left")
        n = F.when(F.col("full") > 0, 3).otherwise(F.coalesce("n", F.lit(0)))
        mult = F.when(n <= 0, 0.4).when(n <= 2, 1.0).otherwise(1.6)
    p = dev.groupBy("id").agg(F.count("*").alias("p_count"), F.sum(mult * gauss(F.col("d"), radius / 2)).alias("p_w"), F.min(F.struct("d", "development")).alias("p_best"))
    parts = [s, p]
    if encampments is not None:
        e = at_spots(encampments, F.count("*").alias("n"), F.sum(decay(F.col("day"), today)).alias("w"))
        e = _near(places, e, 200.0, "n", "w").withColumn("w", gauss(F.col("dist_m"), 100.0) * F.col("w"))
        e = e.groupBy("id", F.round("r_lat", 4).alias("a"), F.round("r_lon", 4).alias("o")).agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        parts.append(e.groupBy("id").agg(F.sum("n").alias("e_count"), F.sum(F.least("w", F.lit(6.0))).alias("e_w")))
    out = _with(places, *parts)
    for c in ("e_count", "e_w"):
        out = out if c in out.columns else out.withColumn(c, F.lit(None).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = zero("s_w") + zero("p_w")
    whole = lambda c: F.coalesce(F.floor(c).cast("int"), F.lit(9999))
    return out.select(
        "id", F.coalesce("s_count", F.lit(0)).alias("shelter_count"), whole("s_best.dist_m").alias("shelter_nearest_m"), F.coalesce("s_best.name", F.lit("")).alias("shelter_nearest_name"), F.round(both, 3).alias("weighted_total"),
        F.coalesce("p_count", F.lit(0)).alias("project_count"), whole("p_best.d").alias("project_nearest_m"), F.coalesce("p_best.development", F.lit("")).alias("project_nearest_name"),
        F.coalesce(F.col("e_count").cast("long"), F.lit(0)).alias("encampment_count"), F.round(zero("e_w"), 3).alias("encampment_weighted"), F.round(0.5 * both + 0.5 * zero("e_w") / 6, 3).alias("exposure"),
    )


@_once_a_spot
def schools(places: DataFrame, all_schools: DataFrame, delta: float = 0.014) -> DataFrame:
    """(id, school, rating): the best of the schools (lat, lon, name, attendance, safe) within the box; the mean of what is above 0, in percent; none gives 0."""
    a, s = (F.when(F.col(c) > 0, F.col(c)) for c in ("attendance", "safe"))
    n = a.isNotNull().cast("int") + s.isNotNull().cast("int")
    rated = all_schools.withColumn("rating", F.round((F.coalesce(a, F.lit(0.0)) + F.coalesce(s, F.lit(0.0))) / F.nullif(n, F.lit(0)) * 100, 1)).where("rating > 0")
    # the best rating of a spot first, its least name then; the best of a place is found by numbers alone, its name among the equals
    at = right_points(at_spots(rated, F.min(F.struct(-F.col("rating"), F.col("name"))).alias("b")).select("lat", "lon", F.col("b.name").alias("name"), (-F.col("b.col1")).alias("r_rating")), "name", "r_rating")
    top = box_join(places, at.drop("name"), delta).groupBy("id").agg(F.max("r_rating").alias("rating"))
    best = box_join(places.join(top, "id"), at, delta).where("rating = r_rating").groupBy("id", "rating").agg(F.min(F.struct("name")).alias("b"))
    return _with(places, best).select("id", F.coalesce("b.name", F.lit("")).alias("school"), _or("rating", 0.0))


def air_quality(places: DataFrame, lots: DataFrame, readings: DataFrame, roads: DataFrame | None) -> DataFrame:
    """(id, pm25, no2, no2_local, road_adj, air_index, score), absolute.

    readings: (cd, name, period, start, value); annual periods are preferred, then the newest start. roads: (id,
    road_exposure), results of an earlier run; NO2 moves by 0.15 of a place's difference from its district's mean, 3 at most."""
    lot = nearest_join(places.select("id", "lat", "lon"), right_points(lots, "lot_id"), "id", "lot_id").select("id", F.col("match").alias("lot_id"))
    cd = lot.join(lots.select("lot_id", "cd"), "lot_id", "left").select("id", F.when(F.col("cd").between(101, 599), F.col("cd")).alias("cd"))
    order = F.struct(F.startswith(F.lower("period"), F.lit("annual")).cast("int"), "start", "value")
    latest = readings.where("value is not null").groupBy("cd").agg(*(F.round(F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, order)), 3).alias(c) for n, c in ((PM25, "pm25"), (NO2, "no2"))))
    out = cd.join(latest, "cd", "left")
    adj = F.lit(None).cast("double")
    if roads is not None:
        out = out.join(roads.select("id", "road_exposure"), "id", "left")
        mean = out.where("cd is not null and road_exposure is not null").groupBy("cd").agg(F.round(F.avg("road_exposure"), 4).alias("cd_mean"))
        out = out.join(mean, "cd", "left")
        adj = F.when(F.col("no2").isNotNull(), half_even(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), 0.15 * (F.col("road_exposure") - F.col("cd_mean")))), 3))
        adj = F.when(F.col("road_exposure").isNotNull() & F.col("cd_mean").isNotNull(), adj)
    out = out.withColumn("road_adj", adj).withColumn("no2_local", half_even(F.col("no2") + F.coalesce("road_adj", F.lit(0.0)), 3))
    index = half_even(F.col("pm25") + F.when(F.col("no2_local").isNotNull(), 0.3 * F.col("no2_local")).otherwise(0.0), 3)
    score = F.round(22 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (20 - F.col("air_index")) / 12)) * 70, 1)
    return out.withColumn("air_index", index).select("id", "pm25", "no2", "no2_local", "road_adj", "air_index", F.when(F.col("air_index").isNotNull(), score).alias("score"))


@_once_a_spot
def road_exposure(places: DataFrame, roads: DataFrame, trucks: DataFrame, lots: DataFrame, stations: DataFrame | None, stops: DataFrame | None, firehouses: DataFrame | None) -> DataFrame:
    """(id, hwy_dist_m, shield_rows, arterial, truck, el_dist_m, el, bus, firehouse_m, road_index).

    roads: (lat, lon, way_id, road_class, tunnel, bridge), points of ways; lots: (lat, lon, lot_id, numfloors); stations: (lat,
    lon, structure); stops: (lat, lon, stop_id, route_count). Tunnels don't count. Highways and elevated lines weaken with
    the rows of buildings before them; arterials beyond 60 m behind one building weaken too; bridges never do."""
    open_ = roads.where("not coalesce(tunnel, false)").withColumn("bridge", F.coalesce("bridge", F.lit(False)))
    tall = right_points(at_spots(lots.where("numfloors >= 3")))
    start = places.select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))

    def seen(best: DataFrame) -> DataFrame:
        pairs = best.join(start, "id").select("id", "lat1", "lon1", F.col("r_lat").alias("lat2"), F.col("r_lon").alias("lon2"))
        return best.join(occluding_rows(pairs, tall, key="id"), "id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))

    left = lambda rows: F.when(rows <= 0, OCCLUSION[0]).when(rows == 1, OCCLUSION[1]).otherwise(OCCLUSION[2])
    way = at_spots(open_.where(F.col("road_class").isin(*HIGHWAYS)), F.min(F.struct("way_id", "bridge")).alias("way"))
    hwy = _nearest(places, way, 1000.0, "way").select("id", "b.dist_m", "b.r_lat", "b.r_lon", "b.way.bridge")
    free = hwy.where("bridge").withColumn("rows", F.lit(0))
    hwy = seen(hwy.where("not bridge")).select("id", "dist_m", "rows").unionByName(free.select("id", "dist_m", "rows"))
    hwy = hwy.select("id", F.col("dist_m").alias("hwy"), F.col("rows").alias("shield_rows"), (10 * F.exp(-F.col("dist_m") / 250) * left(F.col("rows"))).alias("x_hwy"))
    art = _near(places, at_spots(open_.where(F.col("road_class").isin(*ROAD_WEIGHT)), F.count("*").alias("n"), by=("road_class", "bridge")), 150.0, "road_class", "bridge", "n")
    k = lookup(ROAD_WEIGHT, F.col("road_class")) * gauss(F.col("dist_m"), 75.0) * F.col("n")
    hid = shielded(art.where("dist_m > 60 and not bridge").select("id", "lat", "lon", "r_lat", "r_lon").distinct(), tall)
    art = art.join(hid, ["id", "r_lat", "r_lon"], "left").withColumn("w", k * F.when(F.col("hidden") & ~F.col("bridge"), 0.35).otherwise(1.0))
    art = art.groupBy("id").agg((F.sum("w") / 2).alias("arterial"))
    truck = _near(places, at_spots(trucks), 100.0).groupBy("id").agg((3 * F.exp(-F.min("dist_m") / 60)).alias("truck"))
    parts = [hwy, art, truck]
    if stations is not None:
        el = _nearest(places, at_spots(stations.where("structure = 'Elevated'")), 800.0).select("id", "b.*")
        parts.append(seen(el).select("id", F.col("dist_m").alias("el_m"), (6 * F.exp(-F.col("dist_m") / 300) * left(F.col("rows"))).alias("el")))
    if stops is not None:
        bus = _nearest(places, at_spots(stops, F.min(F.struct("stop_id", "route_count")).alias("stop")), 120.0, "stop")
        parts.append(bus.select("id", (F.least(F.lit(4.0), 0.35 * F.coalesce("b.stop.route_count", F.lit(0))) * gauss(F.col("b.dist_m"), 60.0)).alias("bus")))
    if firehouses is not None:
        parts.append(_near(places, at_spots(firehouses), 150.0).groupBy("id").agg(F.min("dist_m").alias("fire_m")))
    out = _with(places, *parts)
    for c in ("el_m", "el", "bus", "fire_m"):
        out = out if c in out.columns else out.withColumn(c, F.lit(None).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    fire = zero(2.5 * F.exp(-F.col("fire_m") / 80))
    index = zero("x_hwy") + zero("arterial") + zero("truck") + zero("el") + zero("bus") + fire
    return out.select(
        "id", F.round("hwy", 1).alias("hwy_dist_m"), F.coalesce("shield_rows", F.lit(0)).cast("long").alias("shield_rows"), F.round(zero("arterial"), 4).alias("arterial"), F.round(zero("truck"), 4).alias("truck"), F.round("el_m", 1).alias("el_dist_m"),
        F.round(zero("el"), 4).alias("el"), F.round(zero("bus"), 4).alias("bus"), F.round("fire_m", 1).alias("firehouse_m"), F.round(index, 4).alias("road_index"),
    )


@_once_a_spot
def street_danger(places: DataFrame, crashes: DataFrame, roads: DataFrame | None, lots: DataFrame, as_of: str) -> DataFrame:
    """(id, injuries, deaths, weighted, frontage_weighted, arterial_weighted, rate, school_hours_share).

    crashes: (lat, lon, crash_id, injured, killed, day, hour); roads: (lat, lon, way_id, name, road_class). A crash within 30 m
    of a major road counts in full if the place fronts that road (within 40 m, by name or else class) and 0.45 if not; others
    count 1.3. The road of a crash is found once, whatever places see it."""
    hurt = crashes.withColumn("injured", F.coalesce("injured", F.lit(0.0))).withColumn("killed", F.coalesce("killed", F.lit(0.0))).where("injured > 0 or killed > 0")
    timed, school = F.col("hour").between(0, 23), F.col("hour").isin(*SCHOOL_HOURS)
    weight = (F.col("injured") + 10 * F.col("killed")) * decay(F.col("day"), F.lit(as_of).cast("date"))
    at = at_spots(hurt, F.sum("injured").alias("injured"), F.sum("killed").alias("killed"), F.sum(weight).alias("w"), F.count_if(timed).alias("timed"), F.count_if(school).alias("school"))
    near = _near(places, at, 300.0, "injured", "killed", "w", "timed", "school").withColumn("w", F.col("w") * gauss(F.col("dist_m"), 150.0))
    if roads is not None:
        major = roads.where(F.col("road_class").isin(*MAJOR)).withColumn("name", F.trim(F.coalesce("name", F.lit(""))))
        named = F.when(F.col("name") != "", F.concat(F.lit("n:"), "name")).otherwise(F.concat(F.lit("c:"), "road_class"))
        points = at_spots(major.withColumn("road", named), F.min(F.struct("way_id", "road")).alias("way"))
        box = box_join(at.select("lat", "lon"), right_points(points, "way"), 30.0 / LON_M)
        flat = F.hypot((F.col("r_lat") - F.col("lat")) * LAT_M, (F.col("r_lon") - F.col("lon")) * LON_M)
        on = box.withColumn("d", flat).where("d <= 30").groupBy("lat", "lon").agg(F.min(F.struct("d", "way")).alias("b")).select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "b.way.road")
        fronts = _near(places, at_spots(major.withColumn("road", named), by=("road",)), 40.0, "road").select("id", "road", F.lit(True).alias("fronts")).distinct()
        near = near.join(on, ["r_lat", "r_lon"], "left").join(fronts, ["id", "road"], "left")
        side = F.when(F.col("road").isNull(), 1.3 * F.col("w")).otherwise(0.0)
        main = F.when(F.col("road").isNotNull(), F.when(F.col("fronts"), 1.0).otherwise(0.45) * F.col("w")).otherwise(0.0)
    else:
        side, main = F.col("w"), F.lit(0.0)
    agg = near.groupBy("id").agg(F.sum("injured").cast("long").alias("injuries"), F.sum("killed").cast("long").alias("deaths"), F.sum("w").alias("weighted"), F.sum(side).alias("side"), F.sum(main).alias("main"), F.sum("timed").alias("timed"), F.sum("school").alias("school"))
    out = _with(places, agg, kernel_units(places, lots, 300.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rate = 1000 * (zero("side") + zero("main")) / F.col("units")
    return out.select("id", _or("injuries", 0), _or("deaths", 0), F.round(zero("weighted"), 4).alias("weighted"), F.round(zero("side"), 4).alias("frontage_weighted"), F.round(zero("main"), 4).alias("arterial_weighted"), F.round(rate, 4).alias("rate"), F.round(F.col("school") / F.nullif("timed", F.lit(0)), 4).alias("school_hours_share"))


def by_median(metric: str, cell: str):
    """The fallback of metrics that count bad things: the median of the cells is 50."""
    return lambda df: median_inverse(df, metric, cell)
