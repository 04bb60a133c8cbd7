"""What a listing's page shows beside its scores: neighborhoods near by, points of interest, stations, amenities, pets, days on market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scorers import right_points
from .spatial import nearest_rows, per_spot


def nearby_neighborhoods(listings: DataFrame, delta: float = 0.02, most: int = 5) -> DataFrame:
    """(id, neighborhoods): other neighborhoods with active listings within the box, the nearest by |dlat| + |dlon| first, ties by name.

    Active listings are first cut down to a row for each neighborhood and spot."""
    spots = listings.where((F.upper("status") == "ACTIVE") & F.col("neighborhood").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col("neighborhood").alias("hood"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).distinct()
    cell = lambda c: F.floor(F.col(c) / delta)
    # listings of one neighborhood and spot have the same neighbours
    of = listings.select("id", F.struct("neighborhood", "lat", "lon").alias("spot"))
    a = of.select("spot").distinct().select("spot", "spot.*").withColumn("x", F.explode(F.sequence(cell("lat") - 1, cell("lat") + 1))).withColumn("y", F.explode(F.sequence(cell("lon") - 1, cell("lon") + 1)))
    near = a.join(spots.withColumns({"x": cell("r_lat"), "y": cell("r_lon")}).hint("merge"), ["x", "y"])
    da, do = F.abs(F.col("lat") - F.col("r_lat")), F.abs(F.col("lon") - F.col("r_lon"))
    near = near.where((da < delta) & (do < delta) & (F.lower("hood") != F.lower(F.coalesce("neighborhood", F.lit("")))))
    best = near.groupBy("spot", "hood").agg(F.min(da + do).alias("d")).withColumn("k", F.row_number().over(Window.partitionBy("spot").orderBy("d", "hood"))).where(F.col("k") <= most)
    best = best.groupBy("spot").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "hood"))), lambda x: x["hood"]).alias("neighborhoods"))
    return of.join(best, "spot").select("id", "neighborhoods")


def points_of_interest(df: DataFrame) -> DataFrame:
    """(id, pois): an array of (name, category, distance_m) from the component columns of parks, schools, gardens and shops."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    poi = lambda name, kind, m: F.struct(name.alias("name"), F.lit(kind).alias("category"), m.cast("int").alias("distance_m"))
    acres, rating, gardens = has("parks_acres"), has("school_rating"), has("greenery_garden_count")
    park = F.concat(has("parks_name").cast("string"), F.when(acres >= 1, F.format_string(" (%.0f acres)", acres)).when(acres > 0, F.format_string(" (%.1f acres)", acres)).otherwise(""))
    school = F.concat(has("school_name").cast("string"), F.when(rating != 0, F.format_string(" (rating: %.1f)", rating)).otherwise(""))
    out = [
        F.when((has("parks_name").cast("string") != "") & has("parks_distance_m").isNotNull(), poi(park, "park", has("parks_distance_m"))),
        F.when(has("school_name").cast("string") != "", poi(school, "school", F.lit(0))),
        F.when(gardens > 0, poi(F.concat(gardens.cast("int").cast("string"), F.lit(" community garden"), F.when(gardens > 1, "s").otherwise(""), F.lit(" within 500m")), "garden", F.lit(500))),
    ]
    for kind, column, text in (("grocery", "grocery", "grocery/convenience stores"), ("pharmacy", "pharmacy", "pharmacies"), ("gym", "gym", "gyms/fitness centers"), ("laundry", "laundry", "laundromats"), ("restaurant", "dining", "restaurants & cafes")):
        n = has(f"convenience_{column}")
        out.append(F.when(n > 0, poi(F.concat(n.cast("int").cast("string"), F.lit(f" {text} within 500m")), kind, F.lit(500))))
    return df.select("id", F.array_compact(F.array(*out)).alias("pois"))


def stations_near(places: DataFrame, stations: DataFrame, radius_m: float = 800.0, most: int = 8, routes: int = 12) -> DataFrame:
    """(id, stations): the nearest stations (lat, lon, station_id, name, routes array) with whole metres and their first routes."""
    # of the stations of one spot no more can be among the nearest than the least by id
    least = Window.partitionBy("lat", "lon").orderBy("station_id")
    held = stations.where("lat is not null and lon is not null").withColumn("__k", F.row_number().over(least)).where(F.col("__k") <= most)
    item = F.struct("k", "name", F.floor("dist_m").cast("int").alias("distance_m"), F.slice("routes", 1, routes).alias("routes"))

    def nearest(spots: DataFrame) -> DataFrame:
        near = nearest_rows(spots, right_points(held, "station_id", "name", "routes"), radius_m, most)
        near = near.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("dist_m", "station_id"))).where(F.col("k") <= most)
        return near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["name"].alias("name"), x["distance_m"].alias("distance_m"), x["routes"].alias("routes"))).alias("stations"))

    return per_spot(places, nearest)


def categorised(listings: DataFrame, keywords: DataFrame, amenities: str = "amenities") -> DataFrame:
    """(id, categories): a map from category to the amenities in it, each once, in their order.

    keywords: (place, keyword, category), a small table. An amenity goes by its exact keyword, or else by the first keyword
    it contains; others are left out. The table is broadcast as one sorted array and folded over, without a join of amenities."""
    table = keywords.agg(F.array_sort(F.collect_list(F.struct("place", "keyword", "category"))).alias("__k"))

    def category(a: Column) -> Column:
        low = F.lower(F.trim(a))
        exact = F.get(F.filter("__k", lambda k: k["keyword"] == low), F.lit(0))
        part = F.get(F.filter("__k", lambda k: F.contains(low, k["keyword"])), F.lit(0))
        return F.coalesce(exact["category"], part["category"])

    x = listings.crossJoin(F.broadcast(table))
    pairs = F.filter(F.transform(F.array_distinct(amenities), lambda a: F.struct(category(a).alias("category"), a.alias("amenity"))), lambda p: p["category"].isNotNull())
    x = x.select("id", pairs.alias("__p"))
    names = F.array_sort(F.array_distinct(F.transform("__p", lambda p: p["category"])))
    of = lambda c: F.transform(F.filter("__p", lambda p: p["category"] == c), lambda p: p["amenity"])
    return x.select("id", F.map_from_entries(F.transform(names, lambda c: F.struct(c.alias("k"), of(c).alias("v")))).alias("categories"))


def pet_policy(amenities: Column) -> Column:
    """What a listing's amenities say of pets: none, both, dogs, cats, or pets; an amenity that names one kind doesn't count as another."""
    low = lambda a: F.lower(F.trim(a))
    says = lambda a, w: F.contains(low(a), F.lit(w))
    no = F.exists(amenities, lambda a: says(a, "no pet"))
    dog = F.exists(amenities, lambda a: ~says(a, "no pet") & says(a, "dog"))
    cat = F.exists(amenities, lambda a: ~says(a, "no pet") & ~says(a, "dog") & says(a, "cat"))
    pet = F.exists(amenities, lambda a: ~says(a, "no pet") & ~says(a, "dog") & ~says(a, "cat") & says(a, "pet"))
    return F.when(no, "No pets allowed").when(dog & cat, "Cats and dogs allowed").when(dog, "Dogs allowed").when(cat, "Cats allowed").when(pet, "Pets allowed")


def days_on_market(first_seen: Column, as_of: Column) -> Column:
    """Whole days since a listing was first seen, never below 0."""
    return F.greatest(F.lit(0), F.floor((as_of.cast("timestamp").cast("double") - first_seen.cast("timestamp").cast("double")) / 86_400)).cast("int")


def described(listings: DataFrame, descriptions: DataFrame) -> DataFrame:
    """listings with the description of their neighborhood, from a small table (neighborhood, description) of the caller's."""
    return listings.join(F.broadcast(descriptions.select("neighborhood", "description")), "neighborhood", "left")


def details(listings: DataFrame, parts: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """One nested row a listing: each part (key, one or more columns) as a struct or, with one column, as that column. Listings without a part have null there.

    A part has a row a listing, so none is broadcast, however small the files that it is made from."""
    out = listings
    for name, df in parts.items():
        rest = [c for c in df.columns if c != key]
        value = F.col(rest[0]) if len(rest) == 1 else F.struct(*rest)
        out = out.join(df.select(key, value.alias(f"__{name}")).hint("merge"), key, "left").withColumnRenamed(f"__{name}", name)
    return out
