"""The join by growing rings and the index of edges, against plain versions on odd shapes."""

import math
import random

from pyspark.sql import functions as F

from terrascore.operators import polygons, rank, spatial, surroundings

LAT, LON = 40.7, -73.9


def plain_candidates(rows, most=50, few=12):
    act = [r for r in rows if r[5] == "ACTIVE"]

    def top(a, same, reach):
        found = sorted((abs(a[6] - b[6]) + abs(a[7] - b[7]), b[0]) for b in act if b[0] != a[0] and b[1] == a[1] and same(a, b) and a[4] * 0.5 <= b[4] <= a[4] * 1.5 and (reach is None or (abs(a[6] - b[6]) <= reach and abs(a[7] - b[7]) <= reach)))
        return [i for _, i in found[:most]]

    out = set()
    for a in act:
        hood = top(a, lambda p, q: p[2] == q[2], None)
        scope, got = ("neighborhood", hood) if len(hood) >= few else ("borough", top(a, lambda p, q: p[3] == q[3], 0.03))
        out |= {(a[0], other, k + 1, scope) for k, other in enumerate(got)} if len(got) >= 3 else set()
    return out


def test_rings_find_all_candidates(spark):
    rnd, rows = random.Random(4), []
    for i in range(900):
        place = i % 3
        at = (LAT, LON) if place == 0 and i % 2 else (LAT + rnd.random() * 0.02, LON + rnd.random() * 0.02) if place < 2 else (LAT + rnd.gauss(0, 0.05), LON + rnd.gauss(0, 0.3))
        rows.append((i, i % 2, f"n{place}", "b", 1000 + rnd.randint(0, 3000), "ACTIVE" if i % 13 else "INACTIVE", *at))
    rows += [(2000 + k, 5, "far", "b", 1000, "ACTIVE", LAT + k * 0.009, LON) for k in range(9)] + [(3000, 0, "n0", "b", 2000, "ACTIVE", None, LON)]
    df = spark.createDataFrame(rows, "id int, beds int, neighborhood string, borough string, price int, status string, lat double, lon double")
    got = {(r.id, r.other, r["rank"], r.scope) for r in rank.candidates(df).collect()}
    assert got == plain_candidates([r for r in rows if r[6] is not None])


def test_rings_of_lone_and_of_equal_points(spark):
    left = spark.createDataFrame([(1, "g", LAT, LON), (2, "g", LAT + 3.0, LON), (3, "h", LAT, LON)], "id int, g string, lat double, lon double")
    right = spark.createDataFrame([(k, "g", LAT, LON) for k in range(10, 40)] + [(50, "g", LAT + 0.5, LON)], "other int, g string, r_lat double, r_lon double")
    got = sorted((r.id, r.other) for r in spatial.nearest_k(left, right, "id", "other", 3, ["g"], F.lit(True)).collect())
    assert got == [(1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (2, 50)]


def inside(lat, lon, edges):
    return sum((a > lat) != (c > lat) and lon < (d - b) * (lat - a) / (c - a) + b for a, b, c, d in edges) % 2 == 1


def shapes():
    """{id: (outlines)} of a star, a square with a hole, a comb, and a ring of 3,000 edges."""
    star = [(LAT + (0.004 if k % 2 else 0.0015) * math.sin(k * math.pi / 7), LON + (0.004 if k % 2 else 0.0015) * math.cos(k * math.pi / 7)) for k in range(14)]
    box = lambda s, y=0.0: [(LAT + y - s, LON - s), (LAT + y - s, LON + s), (LAT + y + s, LON + s), (LAT + y + s, LON - s)]
    comb = [(LAT + 0.01 + (0.003 if k % 4 in (1, 2) else 0.0), LON + 0.0005 * k) for k in range(20)] + [(LAT + 0.009, LON + 0.01), (LAT + 0.009, LON)]
    ring = [(LAT - 0.01 + (0.006 + 0.0005 * math.sin(40 * t)) * math.sin(t), LON + (0.006 + 0.0005 * math.sin(40 * t)) * math.cos(t)) for t in (2 * math.pi * k / 3000 for k in range(3000))]
    return {1: [star], 2: [box(0.003, 0.01), box(0.001, 0.01)], 3: [comb], 4: [ring]}


def frames(spark):
    edges = {p: [(*a, *b) for o in outlines for a, b in zip(o, o[1:] + o[:1], strict=True)] for p, outlines in shapes().items()}
    polys = [(p, sum(e[0] for e in es) / len(es), sum(e[1] for e in es) / len(es)) for p, es in edges.items()]
    e = spark.createDataFrame([(p, *x) for p, es in edges.items() for x in es], "park_id int, lat1 double, lon1 double, lat2 double, lon2 double")
    return edges, polys, e, spark.createDataFrame(polys, "park_id int, lat double, lon double")


def test_points_in_polygons(spark):
    rnd = random.Random(9)
    edges, polys, e, p = frames(spark)
    pts = [(i, LAT + rnd.uniform(-0.02, 0.02), LON + rnd.uniform(-0.012, 0.012)) for i in range(1500)]
    pts += [(5000 + k, lat, lon) for k, (lat, lon) in enumerate([(LAT + 0.007, LON), (LAT + 0.013, LON), (LAT + 0.01, LON - 0.003), (LAT + 0.01, LON + 0.003), (LAT + 0.009, LON + 0.001), (LAT + 0.01, LON + 0.0005)])]  # on borders and corners
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    want = {(i, q): inside(lat, lon, edges[q]) for i, lat, lon in pts for q, a, o in polys if abs(lat - a) <= 0.027 and abs(lon - o) <= 0.027}
    for side in (0.001, 0.0003, 0.02):
        assert {(r.id, r.park_id): r.inside for r in spatial.contains(df, p, e, 0.027, side=side).collect()} == want
    plan = spatial.contains(df, p, e, 0.027)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_distance_to_outlines(spark):
    rnd = random.Random(10)
    edges, polys, e, p = frames(spark)
    pts = [(i, LAT + rnd.uniform(-0.02, 0.02), LON + rnd.uniform(-0.02, 0.02)) for i in range(300)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")

    def metres(lat, lon, x):
        k = 6_371_008.8 * math.pi / 180
        kx = k * math.cos(math.radians(lat))
        ax, ay, bx, by = (x[1] - lon) * kx, (x[0] - lat) * k, (x[3] - lon) * kx, (x[2] - lat) * k
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, -(ax * (bx - ax) + ay * (by - ay)) / n)) if n else 0.0
        return math.hypot(ax + t * (bx - ax), ay + t * (by - ay))

    got = {(r.id, r.park_id): r.edge_m for r in spatial.edge_distance(df, p, e, 0.027).collect()}
    want = {(i, q): min(metres(lat, lon, x) for x in edges[q]) for i, lat, lon in pts for q, a, o in polys if abs(lat - a) <= 0.027 and abs(lon - o) <= 0.027}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_cover_and_share_of_a_disc(spark):
    edges, polys, e, p = frames(spark)
    cells = {(r.park_id, r.x, r.y): r.corner for r in polygons.cover(e, "park_id", 0.0005).collect()}
    for (q, x, y), corner in cells.items():
        if corner is None:  # all four corners and the middle of a cell without edges are inside
            for f, g in ((0.01, 0.01), (0.99, 0.01), (0.01, 0.99), (0.99, 0.99), (0.5, 0.5)):
                assert inside((y + f) * 0.0005 + polygons.ORIGIN, (x + g) * 0.0005 + polygons.ORIGIN, edges[q])
    assert sum(c is None for c in cells.values()) > 300
    at = [(i, LAT - 0.012 + 0.0015 * i, LON + 0.001 * (i % 5)) for i in range(18)]
    got = {r.id: r.fraction for r in surroundings.park_fraction(spark.createDataFrame(at, "id int, lat double, lon double"), p, e).collect()}

    def share(lat, lon):
        n = 0
        for i in range(180):
            r, t = 200.0 * math.sqrt((i + 0.5) / 180), i * (math.pi * (3 - math.sqrt(5)))
            a, o = lat + r * math.sin(t) / 111_320.0, lon + r * math.cos(t) / (111_320.0 * math.cos(math.radians(lat)))
            n += any(inside(a, o, es) for es in edges.values())
        return n / 180

    assert all(abs(got[i] - share(lat, lon)) < 1e-9 for i, lat, lon in at)


def test_no_polygons_and_null_coordinates(spark):
    _, _, e, p = frames(spark)
    df = spark.createDataFrame([(1, LAT, LON), (2, None, LON)], "id int, lat double, lon double")
    assert spatial.contains(df, p, e.where("false"), 0.02).where("inside").count() == 0
    assert {r.id for r in spatial.contains(df, p, e, 0.02).collect()} == {1}
    assert surroundings.park_fraction(df, p.where("false"), e).agg(F.sum("fraction")).first()[0] == 0.0


def test_dense_cells_are_split(spark):
    rnd = random.Random(1)
    right = [(i, LAT, LON) for i in range(4000)] + [(4000 + i, LAT + rnd.random() * 0.002, LON + rnd.random() * 0.002) for i in range(4000)] + [(8000 + i, LAT + rnd.uniform(-0.02, 0.02), LON + rnd.uniform(-0.02, 0.02)) for i in range(4000)] + [(20000, None, LON)]
    left = [(i, LAT + rnd.uniform(-0.01, 0.01), LON + rnd.uniform(-0.01, 0.01)) for i in range(60)] + [(99, None, None)]
    a = spark.createDataFrame(left, "id int, lat double, lon double")
    b = spark.createDataFrame(right, "key int, r_lat double, r_lon double")
    plain = spatial.radius_join(a, b, 300.0).groupBy("id").agg(F.count("*").alias("n"), F.sum("key").alias("s"), F.count_distinct("key").alias("k"))
    for rows in (100, 500, 3000, 10**6):
        split = spatial.radius_join(a, b, 300.0, dense_rows=rows).groupBy("id").agg(F.count("*").alias("n"), F.sum("key").alias("s"), F.count_distinct("key").alias("k"))
        assert sorted(split.collect()) == sorted(plain.collect())
    # no key of the join holds many more rows than asked for, though half of all lie in one cell and a third on one point
    side = spatial.half_width(300.0)
    at = spatial._cells(b, "r_lat", "r_lon", side, side, False)
    cells = spatial.split_cells(at, "r_lat", "r_lon", side, side, 500)
    dealt = spatial.spread_right(at, cells, "r_lat", "r_lon", side, side)
    keys = dealt.where("r_lat is not null").groupBy("__x", "__y", "__cx", "__cy", "__salt").count()
    assert dealt.count() == len(right) and keys.agg(F.max("count")).first()[0] <= 1000
    assert at.groupBy("__x", "__y").count().agg(F.max("count")).first()[0] > 5000


def test_paths_meet_points_beside_them(spark):
    rnd = random.Random(8)
    at = lambda: (LAT + rnd.uniform(-0.006, 0.006), LON + rnd.uniform(-0.006, 0.006))
    paths = [(i, *at(), *at()) for i in range(60)] + [(100, LAT, LON, LAT, LON + 0.005), (101, LAT, LON, LAT + 0.005, LON), (102, LAT, LON, LAT, LON), (103, LAT, LON, LAT + 0.0003, LON), (104, None, LON, LAT, LON)]
    roads = [(*at(), float(rnd.randint(1, 5))) for _ in range(1500)] + [(LAT, LON + 0.002, 9.0), (LAT, None, 3.0)]
    hav = lambda a, b, c, d: 2 * 6_371_008.8 * math.asin(math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2))

    def plain(p, step, ends, near, least):
        if None in p:
            return []
        _, a, b, c, d = p
        size = math.hypot((c - a) * 111_320.0, (d - b) * 85_000.0)
        n, h, out = int(size // step), near / 85_000.0, []
        for i in range(1, n) if size > least and n >= 2 else ():
            t = i / n
            lat, lon = a + (c - a) * t, b + (d - b) * t
            ok = size * t >= ends and size - size * t >= ends
            hit = [v for x, y, v in roads if y is not None and ok and abs(x - lat) <= h and abs(y - lon) <= h and hav(lat, lon, x, y) <= near]
            out.append(max(hit) if hit else None)
        return [v for k, v in enumerate(out) if v is not None and (k == 0 or out[k - 1] is None)]

    p = spark.createDataFrame(paths, "pair int, lat1 double, lon1 double, lat2 double, lon2 double")
    r = spark.createDataFrame(roads, "r_lat double, r_lon double, penalty double")
    got = {x.pair: x.penalty for x in spatial.path_penalty(p, r).collect()}
    assert got == {x[0]: sum(plain(x, 20.0, 0.0, 22.0, 40.0)) for x in paths} and sum(got.values()) > 100
    rows = {x.pair: x.rows for x in spatial.occluding_rows(p, r).collect()}
    assert rows == {x[0]: len(plain(x, 25.0, 20.0, 18.0, 45.0)) for x in paths}
    # a path is repeated for its cells, far less often than for nine cells of each of its points
    long_ = p.where("pair < 60").withColumn("n", F.floor(spatial.path_length() / 20))
    assert spatial.path_cells(long_, 0.0003).count() * 5 < long_.agg(F.sum("n")).first()[0] * 9
