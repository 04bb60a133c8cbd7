"""Hand-made cases of the place operators."""

import datetime as dt
import math
import uuid

import pytest
from pyspark.sql import functions as F

from terrascore.functions import geo
from terrascore.operators import rank, scorers, spatial, stats
from terrascore.sources import clean, ingest


def hash_by_bisection(lat, lon, n):
    lo, hi, out, bit, value, even = [-90.0, -180.0], [90.0, 180.0], "", 0, 0, True
    while len(out) < n:
        k, v = (1, lon) if even else (0, lat)
        mid = (lo[k] + hi[k]) / 2
        value = value * 2 + (v >= mid)
        (lo if v >= mid else hi)[k] = mid
        even, bit = not even, bit + 1
        if bit == 5:
            out, bit, value = out + geo.BASE32[value], 0, 0
    return out


def test_geohash_and_uuid(spark):
    rows = [(40.7 + i * 0.00137, -73.98 + i * 0.00211, f"places:a:{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "lat double, lon double, s string")
    got = df.select("*", geo.geohash(F.col("lat"), F.col("lon"), 8).alias("h"), geo.uuid5(F.col("s")).alias("u")).collect()
    assert all(r.h == hash_by_bisection(r.lat, r.lon, 8) and r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.s)) for r in got)


def test_decay_and_rates(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(day,), (day + dt.timedelta(days=900),), (None,), (day - dt.timedelta(days=180),)], "d date")
    got = [r[0] for r in df.select(geo.decay(F.col("d"), F.lit(day))).collect()]
    assert got == [1.0, 1.0, 0.5, 0.5]
    r = spark.range(1).select(geo.eb_rate(F.lit(0.0), F.lit(10.0), F.lit(None).cast("double"), 10.0), geo.eb_rate(F.lit(2.0), F.lit(10.0), F.lit(0.1), 10.0)).first()
    assert r[0] == pytest.approx(-1e-6 * math.log1p(10)) and r[1] == pytest.approx(3 / 20 - 1e-6 * math.log1p(10))


def test_circle_join_equals_all_pairs(spark):
    left = spark.createDataFrame([(i, 40.7 + i * 0.0011, -73.9 + (i * 7 % 13) * 0.002) for i in range(40)] + [(99, None, -73.9)], "id int, lat double, lon double")
    right = left.select(F.col("id").alias("other"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    got = {(r.id, r.other) for r in spatial.radius_join(left, right, 600.0).collect()}
    h = geo.half_width(600.0)
    every = left.crossJoin(right).where((F.abs(F.col("lat") - F.col("r_lat")) <= h) & (F.abs(F.col("lon") - F.col("r_lon")) <= h) & (geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= 600))
    assert got == {(r.id, r.other) for r in every.collect()} and len(got) > 40


def test_polygon_edges(spark):
    square = spark.createDataFrame([(1, 40.705, -73.975, [[-73.98, 40.70], [-73.97, 40.70], [-73.97, 40.71], [-73.98, 40.71]])], "park_id int, lat double, lon double, ring array<array<double>>")
    points = spark.createDataFrame([(1, 40.705, -73.975), (2, 40.705, -73.965), (3, 40.7001, -73.975)], "id int, lat double, lon double")
    edges = spatial.segments(square, "park_id")
    inside = {r.id: r.inside for r in spatial.contains(points, square, edges).collect()}
    assert inside == {1: True, 2: False, 3: True}
    d = {r.id: r.edge_m for r in spatial.edge_distance(points, square, edges).collect()}
    assert d[3] == pytest.approx(0.0001 * math.pi / 180 * geo.EARTH_M, rel=1e-3) and d[1] > 300 and d[2] == pytest.approx(0.005 * 84300, rel=0.01)


def test_tenure_clusters_by_first_day(spark):
    d = dt.date(2020, 1, 1)
    days = [0, 60, 120, 400, 440]  # 120 is more than 90 days after the cluster's first day
    listed = lambda ds: [("Listed", d_.isoformat()) for d_ in ds] + [("Delisted", "2019-01-01"), ("Listed", "no date")]
    rows = [(1, listed(d + dt.timedelta(days=x) for x in days)), (2, None), (3, listed([d])), (4, listed([d, d + dt.timedelta(days=30)]))]
    df = spark.createDataFrame(rows, "listing_id int, price_history array<struct<event:string,date:string>>")
    got = {r.listing_id: (r.tenure_cycles, r.tenure_months) for r in scorers.tenure_of(df, "price_history").collect()}
    assert got == {1: (3, round(((120 - 30) / 30.44 + (280 - 30) / 30.44) / 2, 1)), 2: (0, None), 3: (0, None), 4: (1, None)}


def test_sync_keeps_isolates_and_deactivates(spark):
    cur = spark.createDataFrame([("x1", "a", "1", "ACTIVE", None, None, 5, 1990), ("x2", "a", "2", "ACTIVE", None, None, 6, None), ("x3", "b", "1", "ACTIVE", None, None, 7, None)], "id string, source string, source_id string, status string, first_seen_at timestamp, last_seen_at timestamp, price int, building_year int")
    snap = spark.createDataFrame([("1", None, None), ("3", 9, 2000)], "source_id string, price int, building_year int")
    out = ingest.sync(cur, snap, "a", "2024-01-01")
    got = {(r.source, r.source_id): (r.status, r.price, r.building_year, r.action) for r in out.collect()}
    assert got == {("a", "1"): ("ACTIVE", None, 1990, "updated"), ("a", "2"): ("INACTIVE", 6, None, "deactivated"), ("b", "1"): ("ACTIVE", 7, None, "kept"), ("a", "3"): ("ACTIVE", 9, 2000, "inserted")}
    log = ingest.sync_log(out, "a", "2024-01-01").first()
    assert (log.seen, log.inserted, log.updated, log.deactivated) == (2, 1, 1, 1)
    again = ingest.sync(out.drop("action"), snap, "a", "2024-01-02")
    assert {r.action for r in again.where("source = 'a' and status = 'ACTIVE'").collect()} == {"updated"}


def test_validate_refuses_bad_batches(spark):
    canonical = {"source_id", "lat", "lon", "price", "beds"}
    good = spark.createDataFrame([("1", 1.0, 2.0, 3, 1)], "source_id string, lat double, lon double, price int, beds int")
    ingest.validate(good, canonical)
    for bad in (good.withColumn("x", F.lit(1)), good.drop("beds"), good.union(good), good.withColumn("price", F.lit(None).cast("int"))):
        with pytest.raises(ValueError):
            ingest.validate(bad, canonical)


def test_cleaning(spark):
    df = spark.createDataFrame([("1", "12", "7", None), ("1", "x", "7", ""), ("1", "3", "4", "kept")], "b string, k string, l string, bbl string")
    assert [r.bbl for r in clean.fill_bbl(df, "b", "k", "l").collect()] == ["1000120007", None, "kept"]
    t = spark.createDataFrame([("2024-02-03T10:00",), ("20240203",), ("2/3/2024",), ("junk",), (None,)], "t string")
    assert [r[0] for r in t.select(geo.parse_day(F.col("t"))).collect()] == [dt.date(2024, 2, 3)] * 3 + [None] * 2
    p = spark.createDataFrame([('{"type":"Point","coordinates":[-73.9,40.7]}',), (None,)], "g string")
    assert [(r.lat, r.lon) for r in clean.point_from_geojson(p, "g").collect()] == [(40.7, -73.9), (None, None)]


def test_baseline_and_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(200)], "v double")
    q = [r.q for r in stats.freeze(df, "v").orderBy("i").collect()]
    assert q == [float(min(199, round(i * 199 / 1000))) for i in range(1001)]
    with pytest.raises(ValueError):
        stats.freeze(df.limit(99), "v")
    one = stats.percentile_scores(df.limit(1), "v").first()
    assert one.score == 50.0
    s = {r.v: r.score for r in stats.percentile_scores(df, "v", reverse=True, zero_is_perfect=True).collect()}
    assert s[0.0] == 100.0 and s[199.0] == 0.0


def test_composite_ignores_nulls(spark):
    df = spark.createDataFrame([(1, 10.0, None, 40.0), (2, None, None, None)], "id int, a double, b double, c double")
    got = {r.id: r.composite for r in rank.composite(df, ["a", "b", "c"], boosts=("c",)).collect()}
    assert got == {1: 30.0, 2: 0.0}
