"""Hand-made cases of the scorers, records, flags, sentences, repairs and the engine."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from terrascore.functions import geo
from terrascore.operators import buildings, detail, engine, explain, flags, grid, rank, records, scorers, spatial, stats, surroundings
from terrascore.sources import clean, ingest, views
from terrascore.streaming import sync_batches

DAY = "2024-01-31"
LAT, LON = 40.7, -73.95
STEP = 1 / 111_195.0  # degrees of latitude in a metre, about


def at(spark, rows, schema):
    """Rows whose first value is metres north of the place."""
    return spark.createDataFrame([(LAT + r[0] * STEP, LON, *r[1:]) for r in rows], f"lat double, lon double, {schema}" if schema else "lat double, lon double")


@pytest.fixture(scope="module")
def place(spark):
    return spark.createDataFrame([("a", LAT, LON)], "id string, lat double, lon double")


@pytest.fixture(scope="module")
def lots(spark):
    return spark.createDataFrame([(1, "1000010001", LAT, LON, 10, 1950, "OWNER ", 5, 101), (2, "1000010002", LAT + 20 * STEP, LON, 4, 1990, "OWNER ", 2, 101), (3, "1000020001", LAT + 500 * STEP, LON, 0, 2023, None, 1, 101)], "lot_id int, bbl string, lat double, lon double, unitsres int, yearbuilt int, ownername string, numfloors int, cd int")


def test_seasonal_factor_of_a_month_without_rows(spark):
    days = [(dt.date(2023, m, 1 + i % 28),) for m in range(1, 12) for i in range(100 + m)]
    df = spark.createDataFrame(days, "day date")
    assert stats.seasonal_factor(df, "day", 12).first().factor == 1.0
    mean = sum(100 + m for m in range(1, 12)) / 11
    assert stats.seasonal_factor(df, "day", 3).first().factor == pytest.approx(103 / mean)
    assert stats.seasonal_factor(df.where("month(day) < 9"), "day", 3).first().factor == 1.0
    assert stats.seasonal_factor(df.limit(0), "day", 3).first().factor == 1.0


def test_median_inverse_of_a_zero_median_and_ranked_medians(spark):
    df = spark.createDataFrame([(1, "x", 0.0), (2, "y", 0.0), (3, "z", 0.5), (4, "x", None)], "id int, cell string, v double")
    got = {r.id: r.score for r in stats.median_inverse(df, "v", "cell").collect()}
    assert got == {1: 100.0, 2: 100.0, 3: 75.0, 4: None}
    for n in (1, 2, 7, 500):
        values = [((i * 37) % 101 * 1.0,) for i in range(n)]
        s = sorted(v[0] for v in values)
        assert stats.median(spark.createDataFrame(values, "v double"), "v").first()[0] == (s[(n - 1) // 2] + s[n // 2]) / 2
    assert stats.median(df.limit(0), "v").first()[0] is None


def test_ranked_counts_below(spark):
    rows = [(float((i * 7919) % 1000),) for i in range(3000)] + [(None,)]
    got = {r.v: (r.n_eq, r.n_below, r.n) for r in stats.ranked(spark.createDataFrame(rows, "v double"), "v").collect()}
    assert got == {float(k): (3, 3 * k, 3000) for k in range(1000)}


def test_peer_percentile_is_a_whole_number_halves_to_even(spark):
    df = spark.createDataFrame([(i, "h", float(i)) for i in range(20)], "id int, hood string, d double")
    got = {r.id: r.percentile for r in rank.peer_context(df, "hood", ["d"]).collect()}
    assert got == {i: round(100 * (i + 0.5) / 20) for i in range(20)}


def test_page_ties_by_coverage(spark):
    df = spark.createDataFrame([(1, 50.0, 0.5), (2, 50.0, 0.9), (3, None, 1.0), (4, 70.0, 0.1)], "id int, composite double, coverage double")
    assert [r.id for r in rank.page(df, F.col("composite"), 1, 10).collect()] == [4, 2, 1, 3]


def test_noise_caps_locations_and_skips_other_types(spark, place, lots):
    day = dt.date(2024, 1, 31)
    rows = [(0, "Noise - Residential", "x", day)] * 9 + [(0, "Noise", "After Hours work", day), (0, "Rodent", "x", day), (400, "Noise", "x", day)]
    licences = at(spark, [(0, "Tavern", None), (0, "Grocery Store", None), (0, "Restaurant", dt.date(2020, 1, 1))], "description string, expires date")
    got = surroundings.noise(place, at(spark, rows, "type string, descriptor string, day date"), licences, lots, DAY).first()
    assert (got.complaints, got.weighted, got.nightlife) == (10, 7.2, 1.5)
    assert got.rate == pytest.approx(round(1000 * (7.2 + 0.3 * 1.5) / 150, 3)) and got.trend_ratio == 2.0 and got.trend_direction == "worsening"


def test_transit_formula_and_missing_tables(spark, place):
    entrances = at(spark, [(200, "S1", "A G"), (300, "S2", "A")], "station_id string, routes string")
    stations = at(spark, [(200, "S1", "A G", "TRUE", "0"), (300, "S2", "G", "false", "1")], "station_id string, routes string, cbd string, ada string")
    got = surroundings.transit(place, entrances, stations, None, None).first()
    assert (got.station_count, got.routes_served, got.nearest_m, got.ada_nearby, got.cbd_routes) == (2, 2, 200, 1, 2)
    assert got.score == round(100 * math.exp(-200 / 400) * (0.6 + 0.4 * 2 / 6), 1)
    none = surroundings.transit(place, entrances.limit(0), None, None, None).first()
    assert none.nearest_m == 9999 and none.score == 0.0


def test_road_exposure_weakens_behind_buildings(spark, place, lots):
    roads = at(spark, [(200, 1, "motorway", False, False)], "way_id int, road_class string, tunnel boolean, bridge boolean")
    empty = at(spark, [], "x int")
    tall = at(spark, [(100, 9, 6)], "lot_id int, numfloors int")
    score = lambda lots_, roads_: surroundings.road_exposure(place, roads_, empty, lots_, None, None, None).first()
    clear, hidden = score(tall.limit(0), roads), score(tall, roads)
    assert (clear.shield_rows, hidden.shield_rows) == (0, 1) and clear.road_index == pytest.approx(10 * math.exp(-200 / 250), abs=1e-3) and hidden.road_index == pytest.approx(0.45 * clear.road_index, abs=1e-3)
    assert score(tall, roads.withColumn("bridge", F.lit(True))).shield_rows == 0 and score(tall, roads.withColumn("tunnel", F.lit(True))).hwy_dist_m is None


def test_parks_take_the_best_and_holes_count(spark, place):
    sq = lambda y, s: [[LON - s, LAT + y - s], [LON + s, LAT + y - s], [LON + s, LAT + y + s], [LON - s, LAT + y + s]]
    parks = spark.createDataFrame([(1, "Small", 0.2, "Triangle", LAT, LON), (2, "Big", 20.0, "Community Park", LAT + 0.004, LON)], "park_id int, name string, acres double, type string, lat double, lon double")
    edges = spatial.segments(spark.createDataFrame([(1, sq(0.0, 0.0005)), (2, sq(0.004, 0.002))], "park_id int, ring array<array<double>>"), "park_id")
    got = surroundings.parks(place, parks, edges, None).first()
    assert got.name == "Big" and got.distance_m == pytest.approx(222, abs=1) and got.effective == pytest.approx((1 - 222.4 / 1200) * 95, abs=0.2)
    geo_json = '{"type": "MultiPolygon", "coordinates": [[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]],[[[9,9],[10,9],[10,10],[9,9]]]]}'
    r = spatial.rings(spark.createDataFrame([(7, geo_json), (8, '{"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}')], "park_id int, g string"), "park_id", "g").collect()
    assert sorted((x.park_id, x.part, x.hole, len(x.ring)) for x in r) == [(7, 0, False, 5), (7, 0, True, 4), (7, 1, False, 4), (8, 0, False, 4)]


def test_violations_of_new_and_unmatched_buildings(spark, lots):
    places = spark.createDataFrame([("old", LAT, LON), ("new", LAT + 500 * STEP, LON), ("far", LAT + 5000 * STEP, LON)], "id string, lat double, lon double")
    dob = spark.createDataFrame([("1000010001", "LL6291-x"), ("1000010001", "UB - unsafe"), ("1000010001", None)], "bbl string, type string")
    hpd = spark.createDataFrame([("1000010001", "C", dt.date(2020, 1, 1), None, "Open", None), ("1000010001", "I", dt.date(2024, 1, 1), None, None, "order to VACATE"), ("1000010001", "B", None, None, "Close", None)], "bbl string, class string, inspected date, certified date, status string, description string")
    got = {r.id: r for r in buildings.violations(places, lots, dob, hpd, dob.select("bbl").limit(0), DAY).collect()}
    old = got["old"]
    assert (old.dob_count, old.class_c, old.class_i, old.class_b, old.open_3yr) == (3, 1, 1, 0, 1) and old.dob_weighted == 3.15 and old.hpd_weighted == 7.5 + 6.0
    assert old.per_unit == pytest.approx((3.15 + 13.5) / 10 - 1e-6 * math.log1p(10), abs=1e-7)
    assert got["new"].new_building == 1 and got["new"].per_unit is None and got["far"].match_uncertain == 1 and got["far"].per_unit is None


def test_bedbug_adjacency_stays_within_the_block(spark, place, lots):
    day = dt.date(2024, 1, 31)
    filings = spark.createDataFrame([("1000010002", LAT + 20 * STEP, LON, 4, 2.0, 0.0, day), ("1000020001", LAT + 10 * STEP, LON, 4, 5.0, 0.0, day)], "bbl string, lat double, lon double, units int, infested double, reinfested double, day date")
    got = buildings.bedbug(place, lots, filings, DAY).first()
    assert got.adjacent == 2.0 and got.filings == 0 and got.never_filed == 1 and got.rate == pytest.approx(0.6 / 10 - 1e-6 * math.log1p(10), abs=1e-7)


def test_deal_needs_three_and_null_keys_are_equal(spark):
    schema = "id int, neighborhood string, beds int, price int, net_effective int, sqft int, status string, rent_stabilized int, price_history array<struct<event:string,date:string>>, price_delta double, price_changed date, months_free double"
    rows = [(i, None, 1, 1000 + 100 * i, None, None, "ACTIVE", 1, None, None, None, None) for i in range(3)] + [(9, "x", 1, 900, None, None, "ACTIVE", 0, None, None, None, None), (4, None, 1, 1000, None, None, "INACTIVE", None, [("Listed", "1/1/20"), ("Listed", "2021-03-01"), ("Delisted", "2022-01-01")], -500.0, dt.date(2024, 1, 20), 2.0)]
    got = {r.id: r for r in scorers.deal(spark.createDataFrame(rows, schema), DAY).collect()}
    assert set(got) == {0, 1, 2, 4} and got[0].comp_set_size == 3 and got[0].deviation == round(100 / 1100, 4) and got[0].stabilized_below_median == 1 and got[1].stabilized_below_median == 0
    months = round((425 - 30) / 30.44, 1)
    assert got[4].tenure_months == months and got[4].tenure_cycles == 2 and got[4].cut_frac == round(500 / 1500, 4) and got[4].cut_recency_days == 11
    assert got[4].deviation == round(0.9 * (100 / 1100) + 0.1 * (months - 12) / 24 + 0.25 * 500 / 1500, 4)


def test_amenity_keywords_count_once_and_tables_are_the_callers(spark):
    df = spark.createDataFrame([(1, ["Washer/Dryer", "Washer in unit", "Roof Deck"]), (2, []), (3, None), (4, ["nothing"])], "id int, amenities array<string>")
    got = {r.id: (r.premium, r.standard, r.total) for r in scorers.unit_amenities(df).collect()}
    assert got == {1: (3, 0, 8), 2: (None, None, None), 3: (None, None, None), 4: (0, 0, 0)}
    assert scorers.unit_amenities(df, premium={"deck": 5}, standard={}).first().total == 5


def test_landlords_share_an_address_and_a_name(spark):
    reg = spark.createDataFrame([(1, "100.0"), (2, "200"), (3, "300"), (4, "400")], "reg_id int, bbl string")
    con = [(1, 1, "CorporateOwner", "A.B. Corp", None, None, "1 Main St."), (2, 2, "Agent", "ab corp", None, None, "1 MAIN ST"), (3, 3, "CorporateOwner", "AB Corp", None, None, "2 Main St"), (4, 2, "HeadOfficer", None, "Ann", "Lee", "9 Road")]
    contacts = spark.createDataFrame(con, "contact_id int, reg_id int, role string, corporation string, first string, last string, address string")
    lots = spark.createDataFrame([("100", 5), ("200", 7), ("300", 1)], "bbl string, unitsres int")
    open_ = spark.createDataFrame([("200", 3)], "bbl string, n int")
    got = {r.reg_id: (r.buildings, r.units, r.open_violations) for r in buildings.landlords(reg, contacts, lots, open_).collect()}
    assert got == {1: (2, 12, 3), 2: (1, 7, 3), 3: (1, 1, 0)}


def test_records_zero_facts_and_missing_topics(spark):
    lots = spark.createDataFrame([("1",), ("2",)], "bbl string")
    liens = records.tax_liens(spark.createDataFrame([("1", dt.date(2020, 1, 1), "a", "yes"), ("1", dt.date(2022, 1, 1), "b", "Y")], "bbl string, month date, cycle string, water string"))
    shed = records.sheds(spark.createDataFrame([("1", "Issued", dt.date(2020, 1, 1), dt.date(2021, 1, 1), None), ("1", "REVOKED", dt.date(2019, 1, 1), None, None)], "bbl string, status string, approved date, issued date, expires date"), DAY)
    facts = records.assemble(lots, {"liens": liens, "shed": shed})
    got = {r.bbl: r for r in facts.collect()}
    assert [e.cycle for e in got["1"].liens.entries] == ["b", "a"] and got["1"].liens.all_water and got["2"].liens.entry_count == 0 and got["1"].vacate is None
    assert got["1"].shed.age_days == (dt.date(2024, 1, 31) - dt.date(2019, 1, 1)).days and got["2"].shed.has_active is False
    f = {r.bbl: [(x.rule, x.type) for x in r.flags] for r in flags.record_flags(facts).collect()}
    assert f == {"1": [("liens", "yellow"), ("shed", "yellow")], "2": []}


def test_sheds_and_penalties_go_by_building_number(spark):
    reg = spark.createDataFrame([("1", "B1"), ("2", " B2 "), ("3", " "), ("4", "B1")], "bbl string, bin string")
    numbers = records.building_numbers(reg)
    day = dt.date(2024, 1, 1)
    permits = [("1", "B1", "Issued", day, day, None), ("1", "B2", "Issued", day, day, None), ("3", None, "Issued", day, day, None), (None, "B2", "Issued", day, day, None), ("9", "B9", "Issued", day, day, None)]
    schema = "bbl string, bin string, status string, approved date, issued date, expires date"
    got = {r.bbl: r.permit_count for r in records.sheds(spark.createDataFrame(permits, schema), DAY, numbers).where("bbl is not null").collect()}
    assert got == {"1": 2, "2": 2, "3": 1, "4": 1, "9": 1}  # one permit of lot 1 and number B1 counts once for lot 1
    fines = [("1", "B2", "Active", 10.0), ("2", None, "Active", 20.0), ("3", "B1", "Resolved", 40.0), ("9", "B1", "Active", 80.0), ("9", "B7", None, None)]
    got = {r.bbl: (r.open_count, r.total_count, r.balance_due) for r in records.penalties(spark.createDataFrame(fines, "bbl string, bin string, status string, balance double"), numbers).collect()}
    assert got == {"1": (1, 2, 80.0), "2": (1, 1, 10.0), "3": (0, 1, 0.0), "4": (1, 2, 80.0), "9": (2, 2, 80.0)}


def test_without_a_lot_there_is_no_flood_zone_and_no_stabilised_building(spark):
    at = spark.createDataFrame([(1, LAT, LON), (2, LAT + 1, LON)], "id int, lat double, lon double")
    lots = spark.createDataFrame([(7, LAT, LON, None, " 1", 1950, 6)], "lot_id int, lat double, lon double, firm07 string, pfirm15 string, yearbuilt int, unitsres int")
    got = {r.id: (r.match, r.firm07, r.pfirm15, r.score) for r in scorers.flood_risk(at, lots).collect()}
    assert got == {1: (7, "", " 1", 0.0), 2: (None, "", "", 100.0)}
    got = {r.id: (r.building_year, r.rent_stabilized, r.score) for r in scorers.rent_stabilized(at, lots).collect()}
    assert got == {1: (1950, 1, 100.0), 2: (0, 0, 0.0)}


def test_flags_of_sparse_rows_and_thresholds(spark):
    df = spark.createDataFrame([(1, 0.7, "improving", 20.0, 25, 50), (2, 1.3, "worsening", 80.0, 2, 0), (3, None, None, None, None, None)], "id int, crime_trend_ratio double, crime_trend_direction string, crime_score double, building_violation_count int, building_unitsres int")
    got = {r.id: [(x.rule, x.type, x.text) for x in r.flags] for r in flags.listing_flags(df).collect()}
    assert got[1] == [("crime_trend", "yellow", "High crime area, but down 30% over 6 months"), ("violations", "red", "25 open DOB violations (0.50/unit)")]
    assert got[2] == [("crime_trend", "yellow", "Crime up 30% over 6 months (still low overall)"), ("violations", "yellow", "2 open DOB violation(s)")] and got[3] == []


def test_sentences(spark):
    df = spark.createDataFrame([(1, "Chelsea", 60.0, 2700, 3000, 88.0, 1200, 2, 1, 40.0, 1, 1500, 90.0, 0, 30.0, 0.004, "ACME LLC", 3, 40)], "id int, neighborhood string, deal_score double, price int, comp_median int, transit_score double, transit_nearest_m int, transit_station_count int, transit_routes_served int, crime_score double, crime_felony_count int, crime_misdemeanor_count int, bedbug_score double, bedbug_filings int, management_score double, mgmt_complaints_per_unit double, mgmt_owner string, mgmt_owner_buildings int, mgmt_owner_units int")
    df = df.withColumn("bedbug_never_filed", F.lit(1)).withColumn("pest_score", F.lit(77.0))
    peers = spark.createDataFrame([(1, "deal", 90), (1, "crime", 50), (1, "bedbug", 5), (1, "transit", 3)], "id int, dim string, percentile int")
    got = {r.dim: r.sentence for r in explain.explanations(df, peers).collect()}
    assert got["deal"] == "Priced 10% below the neighborhood median of $3,000 for comparable units — a better deal than 60% of NYC, and among the best in Chelsea for this."
    assert got["transit"] == "Nearest subway station 1.2 km away; 2 stations and 1 route within a 10-minute walk — ranks in Chelsea's bottom tier for this."
    assert got["crime"] == "1 felony and 1,500 misdemeanors within ~4 blocks in the last year — more than 60% of NYC, but mid-pack for Chelsea."
    assert got["bedbug"] == "No bedbug filings on record for this building." and got["pest"] == "Scores better than 77% of NYC listings for pest."
    assert got["management"] == "Acme LLC's portfolio (3 buildings, 40 units) averages under 0.01 HPD complaints per unit — worse than 70% of NYC landlords."


def test_details(spark):
    x = spark.createDataFrame([(1, "A", "ACTIVE", LAT, LON), (2, "B", "ACTIVE", LAT + 0.001, LON), (3, "C", "ACTIVE", LAT + 0.002, LON), (4, "D", "INACTIVE", LAT, LON), (5, None, "ACTIVE", None, None)], "id int, neighborhood string, status string, lat double, lon double")
    near = {r.id: r.neighborhoods for r in detail.nearby_neighborhoods(x).collect()}
    assert near[1] == ["B", "C"] and near[3] == ["B", "A"] and 5 not in near
    row = detail.details(x, {"nearby": detail.nearby_neighborhoods(x)}).where("id = 5").first()
    assert row.nearby is None
    p = spark.createDataFrame([(["No Pets", "dogs ok"],), (["Dogs OK", "cats allowed"],), (["pet friendly"],), (None,)], "a array<string>")
    assert [r[0] for r in p.select(detail.pet_policy(F.col("a"))).collect()] == ["No pets allowed", "Cats and dogs allowed", "Pets allowed", None]


def test_also_consider_takes_each_candidate_once(spark):
    rows = [(1, 10, 0.1, 0.0, [50.0, 50.0, 50.0], [60.0, 60.0, 50.0]), (1, 11, 0.5, 0.0, [50.0, 50.0, 50.0], [40.0, 61.0, 50.0]), (1, 12, 0.2, 0.0, [50.0, 50.0, 50.0], [40.0, 40.0, 40.0])]
    df = spark.createDataFrame(rows, "id int, other int, km double, price_ratio double, a array<double>, b array<double>")
    got = {r.group: r.other for r in rank.also_consider(df, ["x", "y", "z"]).collect()}
    assert got == {"x": 10, "y": 11}


def test_engine_orders_writes_back_and_takes_user_scorers(spark, lots):
    x = spark.createDataFrame([("a", "ACTIVE", LAT, LON), ("b", "ACTIVE", LAT, LON), ("c", "INACTIVE", LAT, LON), ("d", "ACTIVE", None, None)], "id string, status string, lat double, lon double")
    names = [s.name for s in engine.order(["air_quality", "deal", "road_exposure", "rent_stabilized"])]
    assert names.index("road_exposure") < names.index("air_quality") and names.index("rent_stabilized") < names.index("deal")
    mine = engine.register(engine.Scorer("northing", "m", lambda c: c.places.select("id", F.col("lat").alias("m")), fallback=lambda df: df.withColumn("score", F.lit(7.0))))
    try:
        out = engine.write_back(x, engine.run(x, {"lots": lots}, DAY, ["northing", "rent_stabilized", "schools"]))
        got = {r.id: (r.northing_score, r.rent_stabilized_score) for r in out.collect()}
        assert got == {"a": (7.0, 100.0), "b": (7.0, 100.0), "c": (None, None), "d": (None, None)} and "schools_score" not in out.columns
        again = engine.write_back(out.withColumn("northing_score", F.lit(1.0)), engine.run(x, {}, DAY, ["northing"], ids=["a"]))
        assert {r.id: r.northing_score for r in again.collect()} == {"a": 7.0, "b": 1.0, "c": 1.0, "d": 1.0}
    finally:
        engine.SCORERS.pop(mine.name)


def test_baselines_of_cells_are_seeded(spark):
    lots = spark.createDataFrame([(i, LAT + i * 0.003, LON, i % 3) for i in range(60)], "lot_id int, lat double, lon double, unitsres int")
    one, same, other = (sorted(r.id for r in engine.sample_cells(lots, 10, s).collect()) for s in (1, 1, 2))
    assert one == same and one != other and len(one) == 10


def test_publish_swaps_and_may_read_itself(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert views.publish(df, path) and not views.publish(df.limit(0), path)
    assert views.publish(views.published(spark, path).withColumn("x", F.col("x") + 1), path)
    assert sorted(r.x for r in views.published(spark, path).collect()) == [2, 3]


def test_stream_of_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/listings"
    first = spark.createDataFrame([("k", "a", "1", "ACTIVE", None, None, 5)], "id string, source string, source_id string, status string, first_seen_at timestamp, last_seen_at timestamp, price int")
    views.publish(first, path)
    spark.createDataFrame([("2", 7)], "source_id string, price int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("source_id string, price int").parquet(f"{tmp_path}/in")
    logs = []
    q = stream.writeStream.foreachBatch(sync_batches(path, "a", lambda n: f"2024-02-0{n + 1}", lambda log: logs.append(log.first()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.source_id, r.status) for r in views.published(spark, path).collect()} == {("1", "INACTIVE"), ("2", "ACTIVE")} and logs[0].inserted == 1


def test_failed_syncs_leave_listings_and_a_row(spark):
    cur = spark.createDataFrame([("x", "a", "1", "ACTIVE", None, None, 5)], "id string, source string, source_id string, status string, first_seen_at timestamp, last_seen_at timestamp, price int")
    same, log = ingest.run_sync(spark, cur, "nobody", "2024-01-01", {"source_id"})
    assert same is cur and log.first().status == "failed" and "nobody" in log.first().error


def test_repairs(spark):
    lots = spark.createDataFrame([("1000010001", "352-354 MAIN STREET", LAT, LON), ("1000010002", "354 Main St.", LAT + 0.01, LON), ("3000010001", "354 Main St", LAT, LON)], "bbl string, address string, lat double, lon double")
    x = spark.createDataFrame([(1, "352 main street", "manhattan", LAT + 0.005, LON), (2, " 354 Main St", "manhattan", LAT, LON), (3, "354 Main St", "bronx", LAT, LON), (4, "Main St", "manhattan", LAT, LON), (5, "352 Main St", "manhattan", LAT + 0.0001, LON)], "id int, address string, borough string, lat double, lon double")
    got = {r.id: (round(r.lat - LAT, 6), r.geocode_fixed) for r in clean.repair_geocodes(x, lots).collect()}
    assert got == {1: (0.0, 1), 2: (0.01, 1), 3: (0.0, 0), 4: (0.0, 0), 5: (0.0001, 0)}
    sim = spark.range(1).select(clean.name_likeness(F.lit("The McCarren Park"), F.lit("mccarren field")), clean.name_likeness(F.lit("Park"), F.lit("Park"))).first()
    assert sim[0] == 1.0 and sim[1] == 0.0


def test_feed_without_stations_uses_distinct_names(spark):
    stops = spark.createDataFrame([("s2", "A", "1.0", "2.0", "0", "p"), ("s1", "A", "1.0", "2.0", "0", "p"), ("s3", "B", "x", "2.0", "0", "p")], "stop_id string, stop_name string, stop_lat string, stop_lon string, location_type string, parent_station string")
    none = spark.createDataFrame([], "trip_id string, route_id string, stop_id string")
    assert [(r.station_id, r.routes) for r in views.gtfs_stations(stops, none, none).collect()] == [("s1", [])]


def test_grid_edges(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (1, 1, 5.0)], "r int, c int, value double")
    points = spark.createDataFrame([(1, -0.4, 0.5), (2, 0.5, 0.5), (3, -0.6, 0.0), (4, 1.4, 1.4)], "id int, row double, col double")
    got = {r.id: r.value for r in grid.sample_grid(points, cells, 2, 2).collect()}
    assert got == {1: 2.0, 2: 3.0, 3: None, 4: 5.0}


def test_keys_of_any_form_join(spark):
    a = spark.createDataFrame([("1000010001",), ("1000010001.00",), (" 12 ",), (None,), ("",)], "k string")
    b = spark.createDataFrame([(1000010001.0, "x"), (12.0, "y"), (None, "z")], "q double, v string")
    assert sorted((r.v or "") for r in spatial.keyed_join(a, b, [F.col("k")], [F.col("q")]).collect()) == ["", "", "x", "x", "y"]
    assert geo.clean_name(F.lit("x")) is not None
