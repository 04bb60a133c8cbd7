"""Repairs that run after a dataset is loaded; each takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.functions.geo import bbl, geohash, haversine


def null_zero_coordinates(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    bad = F.abs(F.col(lat)) < 1
    return df.withColumns({lat: F.when(~F.coalesce(bad, F.lit(False)), F.col(lat)), lon: F.when(~F.coalesce(bad, F.lit(False)), F.col(lon))})


def fix_swapped_coordinates(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    swap = F.coalesce(F.col(lat) < 0, F.lit(False))
    return df.withColumns({lat: F.when(swap, F.col(lon)).otherwise(F.col(lat)), lon: F.when(swap, F.col(lat)).otherwise(F.col(lon))})


def fill_bbl(df: DataFrame, borough: str, block: str, lot: str, to: str = "bbl") -> DataFrame:
    made = bbl(F.col(borough), F.col(block), F.col(lot))
    return df.withColumn(to, F.coalesce(F.nullif(F.col(to), F.lit("")), made) if to in df.columns else made)


def point_from_geojson(df: DataFrame, column: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    p = F.from_json(F.col(column), "struct<coordinates:array<double>>")["coordinates"]
    return df.withColumns({lat: F.get(p, F.lit(1)), lon: F.get(p, F.lit(0))})


def dedupe_stops(df: DataFrame, key: str, name: str, lat: str, lon: str, route: str) -> DataFrame:
    """Stop and route rows to stops: least name and place, sorted distinct routes and their number."""
    return df.groupBy(key).agg(F.min(name).alias(name), F.min(lat).alias(lat), F.min(lon).alias(lon), F.array_join(F.array_sort(F.collect_set(route)), ",").alias("routes"), F.count_distinct(route).alias("route_count"))


def keep_latest(df: DataFrame, year: str) -> DataFrame:
    """Rows of the latest year; rows without a year stay."""
    top = df.agg(F.max(year).alias("__top"))
    return df.crossJoin(F.broadcast(top)).where(F.col(year).isNull() | (F.col(year) == F.col("__top"))).drop("__top")


def merge_first_wins(first: DataFrame, second: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Union with one row a key; rows of the first table win, then the order of columns. Null keys go."""
    both = first.withColumn("__p", F.lit(0)).unionByName(second.withColumn("__p", F.lit(1))).where(F.col(key).isNotNull())
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__p", *order))).where("__n = 1").drop("__p", "__n")


def overlay(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns replaced where patch has its key, and patch's other rows added."""
    p = patch.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    kept = base.join(p, base[key] == p["__k"], "left").select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(base[c]).alias(c) if c in columns else base[c] for c in base.columns))
    return kept.unionByName(patch.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def assign_cells(df: DataFrame, key: str, precision: int = 8, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(cell, rep, n): geohash cells, the least key in each, and the number of rows."""
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(geohash(F.col(lat), F.col(lon), precision).alias("cell")).agg(F.min(key).alias("rep"), F.count("*").alias("n"))


def tag_cells(df: DataFrame, key: str, precision: int = 8, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with cell and is_rep: every row's geohash cell, and whether it is the cell's row of the least key. Rows without coordinates have neither."""
    tagged = df.withColumn("cell", geohash(F.col(lat), F.col(lon), precision))
    rep = tagged.where("cell is not null").groupBy("cell").agg(F.min(key).alias("__rep"))
    return tagged.join(rep, "cell", "left").withColumn("is_rep", F.col(key) == F.col("__rep")).drop("__rep")


def mean_vertex(df: DataFrame, key: str, rings: str) -> DataFrame:
    """(key, lat, lon): mean of all vertices of rings of [lon, lat], holes and closing points included."""
    p = df.select(key, F.explode(F.flatten(rings)).alias("p"))
    return p.groupBy(key).agg(F.avg(F.get("p", F.lit(1))).alias("lat"), F.avg(F.get("p", F.lit(0))).alias("lon"))


#: Street words and their short forms, borough codes, metres beyond which an address wins over coordinates.
SUFFIX = {"STREET": "ST", "AVENUE": "AVE", "PLACE": "PL", "ROAD": "RD", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN", "COURT": "CT", "TERRACE": "TER", "PARKWAY": "PKWY", "EAST": "E", "WEST": "W", "NORTH": "N", "SOUTH": "S"}
BOROUGH = {"manhattan": "1", "bronx": "2", "brooklyn": "3", "queens": "4", "staten-island": "5"}
REPAIR_M = 80.0


def address(text: Column) -> Column:
    """(number, street) of an address: leading digits and dashes, then a street in capitals with short words; null if it is no such text."""
    number, rest = F.regexp_extract(text, r"^\s*([0-9][0-9-]*)\s+(.+)$", 1), F.regexp_extract(text, r"^\s*([0-9][0-9-]*)\s+(.+)$", 2)
    words = F.split(F.trim(F.regexp_replace(F.upper(rest), "[^A-Z0-9 ]", "")), " +")
    short = F.create_map(*(F.lit(x) for pair in SUFFIX.items() for x in pair))
    street = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")
    return F.when(number != "", F.struct(number.alias("number"), street.alias("street")))


def repair_geocodes(listings: DataFrame, lots: DataFrame) -> DataFrame:
    """listings (id, address, borough, lat, lon, ...) with geocode_fixed, and the lot's coordinates where theirs lie more than 80 m
    from the lot of their address. lots: (bbl, address, lat, lon). Both ends of a range like 352-354 are known too, but never
    take the place of a lot of that very number; of several lots of an address the largest key counts."""
    at = lots.where("lat is not null").select("bbl", "lat", "lon", F.substring(F.col("bbl").cast("string"), 1, 1).alias("b"), address(F.col("address")).alias("a")).where("a is not null")
    number = F.col("a.number")
    ends = F.when(F.contains(number, F.lit("-")), F.filter(F.split(number, "-"), lambda e: e != "")).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array(F.struct(F.lit(1).alias("own"), number.alias("number"))), F.transform(ends, lambda e: F.struct(F.lit(0).alias("own"), e.alias("number"))))
    book = at.select("b", F.col("a.street").alias("street"), "bbl", "lat", "lon", F.explode(keys).alias("k"))
    book = book.groupBy("b", "street", F.col("k.number").alias("number")).agg(F.max_by(F.struct("lat", "lon"), F.struct("k.own", F.when(F.col("k.own") == 1, F.col("bbl")), -F.col("bbl").cast("double"))).alias("p"))
    code = F.create_map(*(F.lit(x) for pair in BOROUGH.items() for x in pair))
    x = listings.withColumn("__a", address(F.col("address"))).withColumn("__b", F.try_element_at(code, F.coalesce("borough", F.lit(""))))
    x = x.join(book, (x["__b"] == book["b"]) & (x["__a.street"] == book["street"]) & (x["__a.number"] == book["number"]), "left")
    off = F.coalesce(haversine(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon")) > REPAIR_M, F.lit(False))
    new = {"geocode_fixed": off.cast("int"), "lat": F.when(off, F.col("p.lat")).otherwise(F.col("lat")), "lon": F.when(off, F.col("p.lon")).otherwise(F.col("lon"))}
    return x.withColumns(new).select(*listings.columns, "geocode_fixed")


#: Words that don't tell parks apart.
PARK_WORDS = ("park", "the", "playground", "of", "and")


def name_likeness(a: Column, b: Column) -> Column:
    """Shared words over the fewer words of two names, without common ones; 0 if either has none."""
    words = lambda t: F.array_except(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]+", " ")), " +")), F.array(F.lit(""), *map(F.lit, PARK_WORDS)))
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)


def repair_outlines(parks: DataFrame, candidates: DataFrame, inside: DataFrame) -> DataFrame:
    """(park_id, cand_id, score): for each park whose outline is too coarse (more than an acre, fewer than 12 vertices) the best
    outline of another source, if it is sure.

    parks: (park_id, name, acres, vertices, lat, lon); candidates: (cand_id, cand_name, cand_acres, r_lat, r_lon); inside: (park_id,
    cand_id) where a candidate holds the park's centre. Centres lie within 500 m, areas within a fifth and five times; the
    score is 2 for holding the centre, 1.5 times the likeness of names, and nearness. Sure: it holds the centre, or half the
    words agree within 300 m."""
    from terrascore.operators.spatial import box_join

    poor = parks.where("acres > 1 and vertices >= 0 and vertices < 12")
    near = box_join(poor, candidates, 500.0 / 84_000.0)
    flat = F.hypot((F.col("lat") - F.col("r_lat")) * 111_320.0, (F.col("lon") - F.col("r_lon")) * 111_320.0 * F.cos(F.radians((F.col("lat") + F.col("r_lat")) / 2)))
    near = near.withColumn("d", flat).where("d <= 500").where("cand_acres <= 0 or cand_acres / acres between 0.2 and 5")
    near = near.join(inside.select("park_id", "cand_id", F.lit(True).alias("holds")), ["park_id", "cand_id"], "left").withColumn("holds", F.coalesce("holds", F.lit(False)))
    near = near.withColumn("sim", name_likeness(F.col("name"), F.col("cand_name"))).withColumn("score", F.col("holds").cast("int") * 2.0 + 1.5 * F.col("sim") + (1 - F.col("d") / 500))
    best = near.groupBy("park_id").agg(F.max_by(F.struct("cand_id", "score", "holds", "sim", "d"), F.struct("score", -F.col("cand_id"))).alias("b")).select("park_id", "b.*")
    return best.where("holds or (sim >= 0.5 and d < 300)").select("park_id", "cand_id", "score")
