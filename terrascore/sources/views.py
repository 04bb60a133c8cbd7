"""Readers, and the domain tables seen through the driver's star schema.

Each view is one table with column expressions that Spark and DuckDB read alike, so queries and their SQL share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import publish, published  # noqa: F401

_D = "CAST({} AS DOUBLE)".format
_AT = lambda key, a, b: {"lat": f"{_D('40.70')} + {_D(f'({key} * {a}) % 4000')} / {_D('100000')}", "lon": f"{_D('-73.98')} + {_D(f'({key} * {b}) % 5000')} / {_D('100000')}"}

AS_OF_EVENTS, AS_OF_ORDERS = "2024-01-31", "2001-11-05"

#: view: (table, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "listings": (
        "part",
        {
            "id": "p_partkey", "beds": "p_size % 5", "neighborhood": "p_brand", "borough": "concat('B', CAST(p_partkey % 5 AS VARCHAR(9)))",
            "price": "CAST(floor(p_retailprice * 3) AS BIGINT)", **_AT("p_partkey", 6007, 9973),
            "sqft": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 300 + (p_partkey * 13) % 1200 END",
            "net_effective": "CASE WHEN p_partkey % 3 = 0 THEN CAST(floor(p_retailprice * 3) AS BIGINT) - 100 ELSE NULL END",
            "status": "CASE WHEN p_partkey % 11 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END", "amenity_text": "p_name", "rent_stabilized": "CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 7 = 0 THEN NULL ELSE 0 END",
            "available_at": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(p_partkey % 90 AS INT) END", "price_delta": "CASE p_partkey % 4 WHEN 0 THEN CAST(-150 AS DOUBLE) WHEN 1 THEN CAST(80 AS DOUBLE) ELSE NULL END", "price_changed": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE DATE '2024-01-31' - CAST(p_partkey % 50 AS INT) END",
            "months_free": "CASE WHEN p_partkey % 9 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", "first_seen": "DATE '2024-02-05' - CAST(p_partkey % 120 AS INT)",
            "year": "CAST(1890 + (p_partkey * 37) % 112 AS INT)", "units": "CAST(1 + p_partkey % 60 AS INT)",
        },
    ),
    "lots": (
        "customer",
        {
            "lot_id": "c_custkey", **_AT("c_custkey", 7919, 104729), "unitsres": "CAST(1 + c_custkey % 60 AS INT)", "numfloors": "CAST(1 + c_custkey % 12 AS INT)",
            "yearbuilt": "CAST(1890 + (c_custkey * 37) % 112 AS INT)", "ownername": "concat('OWNER ', CAST(c_custkey % 40 AS VARCHAR(9)))",
            "boro": "CAST(1 + c_custkey % 5 AS INT)", "block": "CAST(1 + CAST(floor(c_custkey / 5) AS BIGINT) % 300 AS INT)", "lot": "CAST(c_custkey % 10000 AS INT)",
            "bbl": "concat(CAST(1 + c_custkey % 5 AS VARCHAR(9)), lpad(CAST(1 + CAST(floor(c_custkey / 5) AS BIGINT) % 300 AS VARCHAR(9)), 5, '0'), lpad(CAST(c_custkey % 10000 AS VARCHAR(9)), 4, '0'))",
            "cd": "CAST(100 * (1 + c_custkey % 5) + c_custkey % 12 + 1 AS INT)", "firm07": "CASE WHEN c_custkey % 9 = 0 THEN '1' ELSE NULL END", "pfirm15": "CASE WHEN c_custkey % 7 = 0 THEN '1' ELSE NULL END",
        },
    ),
    "incidents": (
        "events",
        {
            "event_id": "event_id", "ts": "ts", "day": "CAST(ts AS DATE)", "hour": "CAST(extract(hour FROM ts) AS INT)", "event_type": "event_type", "value": "value",
            "severity": "CASE event_type WHEN 'error' THEN 'FELONY' WHEN 'purchase' THEN 'MISDEMEANOR' WHEN 'click' THEN 'VIOLATION' ELSE NULL END",
            "premise": "CASE event_id % 4 WHEN 0 THEN 'CHAIN STORE' WHEN 1 THEN 'STREET' WHEN 2 THEN 'RESIDENCE - APT' ELSE NULL END", "offence": "CASE event_id % 5 WHEN 0 THEN 'PETIT LARCENY' WHEN 1 THEN 'ROBBERY' WHEN 2 THEN 'FELONY ASSAULT' WHEN 3 THEN NULL ELSE 'FRAUD' END", **_AT("event_id", 7127, 5381),
        },
    ),
    "filings": (
        "lineitem",
        {
            "orderkey": "l_orderkey", "line": "l_linenumber", "partkey": "l_partkey", "suppkey": "l_suppkey", "class": "CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END",
            "is_open": "l_linestatus = 'O'", "inspected": "CAST(l_shipdate AS DATE)", "amount": "l_extendedprice", "lot_id": "l_partkey % 1500",
        },
    ),
    "history": ("orders", {"order_id": "o_orderkey", "listing_id": "o_custkey", "listed_at": "CAST(o_orderdate AS DATE)", "price": "o_totalprice", "status": "o_orderstatus"}),
    "roads": ("supplier", {"way_id": "s_suppkey", **_AT("s_suppkey", 3571, 2897), "road_class": "CASE s_suppkey % 4 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' ELSE 'residential' END", "penalty": "CAST(50 * (1 + s_suppkey % 4) AS DOUBLE)"}),
    "streets": (
        "customer",
        {
            "way_id": "c_custkey", **_AT("c_custkey", 3571, 2897), "road_class": "CASE c_custkey % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'tertiary' WHEN 4 THEN 'trunk' ELSE 'residential' END",
            "name": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('Road ', CAST(c_custkey % 40 AS VARCHAR(9))) END", "tunnel": "c_custkey % 13 = 0", "bridge": "c_custkey % 7 = 0",
            "penalty": "CASE c_custkey % 6 WHEN 0 THEN CAST(250 AS DOUBLE) WHEN 1 THEN CAST(120 AS DOUBLE) WHEN 2 THEN CAST(60 AS DOUBLE) WHEN 4 THEN CAST(250 AS DOUBLE) ELSE NULL END",
        },
    ),
    "complaints": (
        "events",
        {
            "event_id": "event_id", **_AT("event_id", 6151, 8663), "day": "CAST(ts AS DATE)", "descriptor": "CASE WHEN event_id % 3 = 0 THEN 'Construction After Hours' ELSE 'Loud' END",
            "type": "CASE event_id % 9 WHEN 0 THEN 'Noise - Residential' WHEN 1 THEN 'Noise - Street/Sidewalk' WHEN 2 THEN 'Noise - Commercial' WHEN 3 THEN 'Noise - Vehicle' WHEN 4 THEN 'Noise - Park' WHEN 5 THEN 'Noise' WHEN 6 THEN 'Rodent' WHEN 7 THEN 'HEAT/HOT WATER' ELSE 'Encampment' END",
        },
    ),
    "licences": (
        "customer",
        {
            "licence_id": "c_custkey", **_AT("c_custkey", 4111, 7001), "expires": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE DATE '2024-01-10' + CAST(c_custkey % 60 AS INT) END",
            "description": "CASE c_custkey % 5 WHEN 0 THEN 'Grocery Store' WHEN 1 THEN 'Cabaret Liquor' WHEN 2 THEN 'Restaurant Wine' WHEN 3 THEN 'Hotel' ELSE 'Tavern' END",
        },
    ),
    "entrances": (
        "supplier",
        {
            "entrance_id": "s_suppkey", **_AT("s_suppkey", 5023, 6421), "station_id": "concat('S', CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS VARCHAR(9)))",
            "routes": "CASE s_suppkey % 4 WHEN 0 THEN 'A C' WHEN 1 THEN 'G' WHEN 2 THEN 'B D F' ELSE 'SIR' END",
        },
    ),
    "stations": (
        "supplier",
        {
            "station_id": "concat('S', CAST(s_suppkey AS VARCHAR(9)))", **_AT("s_suppkey", 5039, 6421), "routes": "CASE s_suppkey % 4 WHEN 0 THEN 'A C' WHEN 1 THEN 'G' WHEN 2 THEN 'B D F' ELSE 'SIR' END",
            "cbd": "CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'TRUE' ELSE 'false' END", "ada": "CAST(s_suppkey % 3 AS VARCHAR(9))", "structure": "CASE WHEN s_suppkey % 3 = 0 THEN 'Elevated' ELSE 'Subway' END",
        },
    ),
    "stops": ("customer", {"stop_id": "c_custkey", **_AT("c_custkey", 8111, 3433), "routes": "concat('M', CAST(c_custkey % 9 AS VARCHAR(9)), ', B', CAST(c_custkey % 4 AS VARCHAR(9)))", "route_count": "CAST(1 + c_custkey % 14 AS INT)"}),
    "amenities": ("orders", {"key": "o_orderkey", **_AT("o_orderkey", 6577, 7307), "category": "CASE o_orderkey % 6 WHEN 0 THEN 'grocery' WHEN 1 THEN 'pharmacy' WHEN 2 THEN 'gym' WHEN 3 THEN 'laundry' WHEN 4 THEN 'dining' ELSE 'other' END"}),
    "supermarkets": ("customer", {"key": "c_custkey", **_AT("c_custkey", 2389, 9127), "sqft": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST((c_custkey * 977) % 9000 AS DOUBLE) END"}),
    "trees": ("lineitem", {"tree_id": "l_orderkey * 10 + l_linenumber", **_AT("(l_orderkey * 10 + l_linenumber)", 6871, 5717), "dbh": "l_quantity"}),
    "gardens": ("supplier", {"garden_id": "s_suppkey", **_AT("s_suppkey", 7727, 2663)}),
    "parks": (
        "supplier",
        {
            "park_id": "s_suppkey", "name": "concat('Park ', CAST(s_suppkey AS VARCHAR(9)))", **_AT("s_suppkey", 6607, 4231), "acres": "CAST((s_suppkey * 37) % 1200 AS DOUBLE) / CAST(10 AS DOUBLE)", "size": "CAST(10 + s_suppkey % 30 AS DOUBLE) / CAST(20000 AS DOUBLE)",
            "type": "CASE s_suppkey % 5 WHEN 0 THEN 'Playground' WHEN 1 THEN 'Triangle/Plaza' WHEN 2 THEN 'Community Park' WHEN 3 THEN 'Nature Area' ELSE NULL END",
        },
    ),
    "school_sites": ("supplier", {"school_id": "s_suppkey", "name": "concat('School ', CAST(s_suppkey AS VARCHAR(9)))", **_AT("s_suppkey", 3701, 8537), "attendance": "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST((s_suppkey * 29) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END", "safe": "CAST((s_suppkey * 31) % 90 AS DOUBLE) / CAST(100 AS DOUBLE)"}),
    "shelters": ("supplier", {"shelter_id": "s_suppkey", "name": "concat('Facility ', CAST(s_suppkey AS VARCHAR(9)))", **_AT("s_suppkey", 9041, 4799), "kind": "CASE s_suppkey % 6 WHEN 0 THEN 'Drop-in center' WHEN 1 THEN 'Family shelter' WHEN 2 THEN 'Supportive SRO' WHEN 3 THEN 'Homebase' WHEN 4 THEN NULL ELSE 'Other' END"}),
    "projects": ("customer", {"building_id": "c_custkey", **_AT("c_custkey", 9463, 5351), "development": "CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE concat('Houses ', CAST(c_custkey % 97 AS VARCHAR(9))) END"}),
    "shootings": ("orders", {"incident": "CAST(floor(o_orderkey / 2) AS BIGINT)", **_AT("o_orderkey", 7529, 6803), "day": "CAST(o_orderdate AS DATE)"}),
    "crashes": ("events", {"crash_id": "event_id", **_AT("event_id", 9283, 3049), "day": "CAST(ts AS DATE)", "hour": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(extract(hour FROM ts) AS INT) END", "injured": "CAST(event_id % 3 AS DOUBLE)", "killed": "CASE WHEN event_id % 60 = 1 THEN CAST(1 AS DOUBLE) ELSE NULL END"}),
    "trucks": ("supplier", {"route_id": "s_suppkey", **_AT("s_suppkey", 8753, 2111)}),
    "firehouses": ("supplier", {"house_id": "s_suppkey", **_AT("s_suppkey", 2311, 8377)}),
    "readings": (
        "customer",
        {
            "cd": "CAST(100 * (1 + c_custkey % 5) + CAST(floor(c_custkey / 5) AS BIGINT) % 13 AS INT)", "name": "CASE WHEN c_custkey % 2 = 0 THEN 'Fine particles (PM 2.5)' ELSE 'Nitrogen dioxide (NO2)' END",
            "period": "CASE c_custkey % 3 WHEN 0 THEN 'Annual Average' WHEN 1 THEN 'Summer' ELSE 'Winter' END", "start": "DATE '2015-01-01' + CAST(c_custkey % 3000 AS INT)",
            "value": "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN CAST(60 + c_custkey % 90 AS DOUBLE) / CAST(10 AS DOUBLE) ELSE CAST(100 + c_custkey % 200 AS DOUBLE) / CAST(10 AS DOUBLE) END",
        },
    ),
    "notices": (
        "lineitem",
        {
            "notice_id": "l_orderkey * 10 + l_linenumber", "lot_id": "(l_partkey * 7 + l_suppkey) % 1500", "day": "CAST(l_shipdate AS DATE)",
            "category": "CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'HEAT/HOT WATER' WHEN 1 THEN 'PLUMBING' WHEN 2 THEN 'UNSANITARY CONDITION' WHEN 3 THEN 'SAFETY' ELSE 'GENERAL' END", "minor": "CASE WHEN l_orderkey % 2 = 0 THEN 'PESTS' ELSE 'MOLD' END",
            "type": "CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'LL6291 - LOCAL LAW' WHEN 1 THEN 'ub-UNSAFE' WHEN 2 THEN 'C-CONSTRUCTION' WHEN 3 THEN 'EGNCY' ELSE 'OTHER' END",
            "class": "CASE l_linenumber % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'I' END", "status": "CASE l_linestatus WHEN 'O' THEN 'Open' ELSE 'Close' END", "certified": "CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) + CAST(200 AS INT) ELSE NULL END",
            "description": "CASE l_orderkey % 3 WHEN 0 THEN 'file registration 2107' WHEN 1 THEN 'order to vacate' ELSE 'repair' END", "infested": "CASE WHEN l_orderkey % 7 = 0 THEN CAST(l_linenumber AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", "reinfested": "CASE WHEN l_orderkey % 21 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", "n_units": "CAST(l_quantity AS INT)",
        },
    ),
    "cases": ("orders", {"case_id": "o_orderkey", "lot_id": "o_custkey", "day": "CAST(o_orderdate AS DATE)", "kind": "CASE o_orderstatus WHEN 'F' THEN 'eviction' WHEN 'O' THEN 'litigation' ELSE 'permit' END", "amount": "o_totalprice", "priority": "o_orderpriority"}),
    "inspections": (
        "events",
        {"inspection_id": "event_id", **_AT("event_id", 4597, 6949), "day": "CAST(ts AS DATE)", "type": "CASE event_id % 3 WHEN 0 THEN 'Initial' WHEN 1 THEN 'Compliance' ELSE 'Baiting' END", "result": "CASE event_id % 4 WHEN 0 THEN 'Rat Activity' WHEN 1 THEN 'Failed for Other R' WHEN 2 THEN 'Passed' ELSE NULL END"},
    ),
    "scores": (
        "part",
        {"id": "p_partkey", "neighborhood": "p_brand", "beds": "p_size % 5", **{f"d{k}": f"CASE WHEN (p_partkey + {k}) % 7 = 0 THEN NULL ELSE {_D(f'(p_partkey * {p}) % 1001')} / {_D('10')} END" for k, p in enumerate((7, 11, 13, 17, 19, 23, 29, 31, 37, 41))}},
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view; only the columns used are read."""
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def view_sql(*names: str) -> str:
    """The same views as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in VIEWS[n][1].items())} FROM {VIEWS[n][0]})" for n in names)


def load(spark: SparkSession, path: str, columns: list[str], where: str | None = None, reals: tuple[str, ...] = (), fmt: str = "parquet", **options: str) -> DataFrame:
    """A dataset cut to its columns and predicate (both reach the scan), with text columns made numbers; junk becomes null."""
    df = spark.read.format(fmt).options(**options).load(path)
    df = df.where(where) if where else df
    return df.select(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast("double").alias(c) if c in reals else F.col(c) for c in columns))


def freshness(registry: DataFrame, meta: DataFrame, as_of: str) -> DataFrame:
    """(dataset, row_count, refreshed_at, cadence, stale): unknown tables are stale with 0 rows."""
    out = registry.join(meta, "dataset", "left")
    old = F.coalesce(F.datediff(F.lit(as_of).cast("date"), "refreshed_at") >= F.col("cadence"), F.lit(True))
    return out.select("dataset", F.coalesce("row_count", F.lit(0)).alias("row_count"), "refreshed_at", "cadence", old.alias("stale"))


def gtfs_stations(stops: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """(station_id, name, lat, lon, routes): parent stations of a transit feed with the sorted distinct routes that stop there.

    A station is a stop of location type 1, or of no type 0 without a parent; other stops count for their parent. Stations
    without numbers as coordinates are left out; those that no trip serves have no routes. Without any station the stops of
    distinct names take their place, the least id of each. The stop times are cut to stop and route pairs before anything
    else is joined."""
    t = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    s = stops.select(t("stop_id").alias("stop_id"), t("stop_name").alias("name"), F.col("stop_lat").cast("string").try_cast("double").alias("lat"), F.col("stop_lon").cast("string").try_cast("double").alias("lon"), t("location_type").alias("kind"), t("parent_station").alias("parent")).where("stop_id <> ''")
    s = s.withColumn("is_station", (F.col("kind") == "1") | ((F.col("kind") != "0") & (F.col("parent") == "")))
    station = s.where("is_station and lat is not null and lon is not null")
    child = s.where("not is_station").select("stop_id", F.when(F.col("parent") != "", F.col("parent")).otherwise(F.col("stop_id")).alias("station_id")).unionByName(s.where("is_station").select("stop_id", F.col("stop_id").alias("station_id")))
    routes = stop_times.select(t("stop_id").alias("stop_id"), t("trip_id").alias("trip_id")).distinct().join(trips.select(t("trip_id").alias("trip_id"), t("route_id").alias("route_id")).where("trip_id <> '' and route_id <> ''"), "trip_id").select("stop_id", "route_id").distinct()
    served = routes.join(child, "stop_id").groupBy("station_id").agg(F.array_sort(F.collect_set("route_id")).alias("routes"))
    named = s.where("lat is not null and lon is not null").groupBy("name").agg(F.min(F.struct("stop_id", "lat", "lon")).alias("x")).select("x.stop_id", "name", "x.lat", "x.lon")
    any_station = F.broadcast(station.agg((F.count("*") > 0).alias("__any")))
    both = station.select("stop_id", "name", "lat", "lon", F.lit(True).alias("__real")).unionByName(named.withColumn("__real", F.lit(False))).crossJoin(any_station).where("__real = __any")
    return both.join(served, both["stop_id"] == served["station_id"], "left").select(F.col("stop_id").alias("station_id"), "name", "lat", "lon", F.coalesce("routes", F.expr("cast(array() as array<string>)")).alias("routes"))


def osm_categories(elements: DataFrame, tags: str = "tags") -> DataFrame:
    """elements with category by their tags (a map); those of no category are left out."""
    tag = lambda k: F.coalesce(F.col(tags)[k], F.lit(""))
    kind = F.when(tag("shop").isin("supermarket", "convenience"), "grocery").when(tag("amenity") == "pharmacy", "pharmacy").when(tag("leisure") == "fitness_centre", "gym").when(tag("shop") == "laundry", "laundry").when(tag("amenity").isin("cafe", "restaurant"), "dining")
    return elements.withColumn("category", kind).where("category is not null")


#: The road classes that are kept.
ROAD_CLASSES = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "secondary", "tertiary")


def road_points(ways: DataFrame, step_m: float = 50.0) -> DataFrame:
    """(way_id, road_class, name, lanes, tunnel, bridge, lat, lon) of points along ways (way_id, tags map, points array of (lat, lon)).

    Ways of other classes are left out; of lanes like 2;3 the first counts; a tunnel or bridge is any value but no. A way
    that occurs in several extracts gives each point once, told by five decimals."""
    tag = lambda k: F.col("tags")[k]
    yes = lambda k: F.coalesce(F.nullif(tag(k), F.lit("")), F.lit("no")) != "no"
    w = ways.where(tag("highway").isin(*ROAD_CLASSES)).withColumn("__part", F.xxhash64(F.col("points").cast("string")))
    w = w.withColumn("__key", F.struct("way_id", "__part"))
    facts = w.select("way_id", tag("highway").alias("road_class"), F.coalesce(tag("name"), F.lit("")).alias("name"), F.split(tag("lanes"), ";")[0].try_cast("int").alias("lanes"), yes("tunnel").alias("tunnel"), yes("bridge").alias("bridge")).dropDuplicates(["way_id"])
    from terrascore.operators.spatial import sample_polyline

    points = sample_polyline(w.dropDuplicates(["way_id", "__part"]).select("__key", "points"), step_m, "__key")
    points = points.select("__key.way_id", "lat", "lon").withColumns({"__a": F.round("lat", 5), "__o": F.round("lon", 5)})
    once = points.groupBy("way_id", "__a", "__o").agg(F.min(F.struct("lat", "lon")).alias("p")).select("way_id", "p.lat", "p.lon")
    return once.join(facts, "way_id").select("way_id", "road_class", "name", "lanes", "tunnel", "bridge", "lat", "lon")
