"""Queries of building records, flags, explanations and detail pages, with SQL of the same result where it stays readable."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascore.operators import detail, explain, flags, rank, records
from terrascore.plans.listing_queries import AMENITIES, amenity_array
from terrascore.plans.registry import DIMS, near_sql, query
from terrascore.plans.scorer_queries import dist, keyed, places
from terrascore.sources.views import AS_OF_EVENTS, AS_OF_ORDERS, view, view_sql

K = ", k AS (SELECT n.*, t.bbl FROM notices n JOIN lots t USING (lot_id))"
C = ", c AS (SELECT x.*, t.bbl FROM cases x JOIN lots t USING (lot_id))"


@query("bf01_resolve_lot", view_sql("listings", "lots") + " SELECT id, arg_min(bbl, struct_pack(d := d, b := bbl)) AS bbl FROM (SELECT l.id, t.bbl, (t.lat - l.lat) * (t.lat - l.lat) + ((t.lon - l.lon) * 0.7635) * ((t.lon - l.lon) * 0.7635) AS d FROM listings l JOIN lots t ON abs(l.lat - t.lat) <= 0.0015 AND abs(l.lon - t.lon) <= 0.0015) GROUP BY 1")
def bf01(spark, d):
    return records.resolve_lot(places(spark, d), view(spark, d, "lots"))


def vacate_rows(spark, d):
    n = keyed(spark, d, "notices").where("notice_id % 4 = 0")
    return n.select("bbl", F.col("description").alias("reason"), F.col("class").alias("kind"), F.col("day").alias("effective"), F.col("certified").alias("rescinded"), F.col("n_units").alias("units"))


@query("bf02_vacate_orders", view_sql("lots", "notices") + K + ", v AS (SELECT *, row_number() OVER (PARTITION BY bbl, certified IS NULL ORDER BY day DESC, description DESC, class DESC, n_units DESC) AS r FROM k WHERE notice_id % 4 = 0) SELECT bbl, count(*) FILTER (certified IS NULL) > 0 AS has_active, count(*) FILTER (certified IS NULL) AS active_count, count(*) AS total_orders, max(CASE WHEN r = 1 AND certified IS NULL THEN description END) AS reason, max(CASE WHEN r = 1 AND certified IS NULL THEN class END) AS kind, max(CASE WHEN r = 1 AND certified IS NULL THEN day END) AS effective, max(CASE WHEN r = 1 AND certified IS NULL THEN n_units END) AS units FROM v GROUP BY 1")
def bf02(spark, d):
    return records.vacate_orders(vacate_rows(spark, d))


def enforcement_rows(spark, d):
    return keyed(spark, d, "cases").select("bbl", F.when(F.col("kind") == "eviction", "Discharged").otherwise("AEP Active").alias("status"), F.col("priority").alias("round"), F.col("day").alias("start"))


@query("bf03_enforcement", view_sql("lots", "cases") + C + ", v AS (SELECT bbl, CASE WHEN kind = 'eviction' THEN 'Discharged' ELSE 'AEP Active' END AS status, priority AS \"round\", day AS start FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY bbl ORDER BY start DESC, status DESC, \"round\" DESC) AS k FROM v) SELECT bbl, NOT starts_with(upper(status), 'DISCHARGE') AS in_program, status, \"round\", start FROM r WHERE k = 1")
def bf03(spark, d):
    return records.enforcement(enforcement_rows(spark, d))


@query("bf04_bedbugs", view_sql("lots", "notices") + K + " SELECT bbl, count(*) AS filings, CAST(sum(floor(infested)) AS BIGINT) AS total_infested, CAST(sum(floor(reinfested)) AS BIGINT) AS total_reinfested, max(CASE WHEN infested > 0 THEN day END) AS last_infested FROM k GROUP BY 1")
def bf04(spark, d):
    return records.bedbugs(keyed(spark, d, "notices"))


def deeds(spark, d):
    return keyed(spark, d, "cases").where("case_id % 3 = 0").select("bbl", F.col("priority").alias("grantee"), F.col("day").alias("deed"), F.col("amount").alias("price"))


@query("bf05_speculation", view_sql("lots", "cases") + C + ", r AS (SELECT *, row_number() OVER (PARTITION BY bbl ORDER BY day DESC, priority DESC, amount DESC) AS k FROM c WHERE case_id % 3 = 0) SELECT bbl, TRUE AS on_list, priority AS grantee, day AS deed, amount AS price FROM r WHERE k = 1")
def bf05(spark, d):
    return records.speculation(deeds(spark, d))


def lien_rows(spark, d):
    return keyed(spark, d, "cases").where("case_id % 5 = 0").select("bbl", F.col("day").alias("month"), F.col("priority").alias("cycle"), F.when(F.col("kind") == "eviction", "No").otherwise(" yes").alias("water"))


@query("bf06_tax_liens", view_sql("lots", "cases") + C + " SELECT bbl, count(*) AS entry_count, bool_and(kind <> 'eviction') AS all_water, string_agg(concat(CAST(day AS VARCHAR), '/', priority), ',' ORDER BY day DESC, priority DESC, kind <> 'eviction' DESC) AS entries FROM c WHERE case_id % 5 = 0 GROUP BY 1")
def bf06(spark, d):
    x = records.tax_liens(lien_rows(spark, d))
    return x.select("bbl", "entry_count", "all_water", F.array_join(F.transform("entries", lambda e: F.concat_ws("/", e["month"].cast("string"), e["cycle"])), ",").alias("entries"))


def shed_rows(spark, d):
    n = keyed(spark, d, "notices").where("notice_id % 5 = 0")
    status = F.when(F.col("class") == "A", "Revoked").when(F.col("class") == "B", "WITHDRAWN").otherwise("Issued")
    return n.select("bbl", F.expr(SHED_BIN.replace("VARCHAR", "STRING")).alias("bin"), status.alias("status"), F.date_sub("day", 30).alias("approved"), F.col("day").alias("issued"), F.when(F.col("n_units") % 3 != 0, F.date_add("day", 900)).alias("expires"))


def numbers(spark, d):
    return records.building_numbers(records.registrations(*registered(spark, d), AS_OF_ORDERS))


#: Lots with the building number of their latest registration, which some lack.
OWN = ", own AS (SELECT t.bbl, g.bin FROM lots t LEFT JOIN (SELECT bbl, CASE WHEN lot_id % 4 <> 0 THEN concat('B', CAST(lot_id AS VARCHAR)) END AS bin FROM (SELECT *, row_number() OVER (PARTITION BY bbl ORDER BY day DESC, case_id DESC) AS k FROM c) WHERE k = 1) g USING (bbl))"
SHED_BIN = "CASE notice_id % 4 WHEN 0 THEN concat('B', CAST(lot_id + 1 AS VARCHAR)) WHEN 2 THEN concat('B', CAST(lot_id AS VARCHAR)) END"
CASE_BIN = "CASE case_id % 3 WHEN 1 THEN concat('B', CAST(lot_id AS VARCHAR)) WHEN 2 THEN concat('B', CAST(lot_id + 1 AS VARCHAR)) END"
PENALTIES = f"SELECT o.bbl, count(*) FILTER (kind <> 'permit') AS open_count, count(*) AS total_count, round(coalesce(sum(floor(amount / 20)) FILTER (kind <> 'permit'), 0), 2) AS balance_due FROM own o JOIN (SELECT *, {CASE_BIN} AS bin FROM c) x ON CASE WHEN o.bin IS NOT NULL THEN x.bin = o.bin ELSE x.bbl = o.bbl END GROUP BY 1"


@query("bf07_sidewalk_sheds", view_sql("lots", "notices", "cases") + K + C + OWN + f", v AS (SELECT bbl, {SHED_BIN} AS bin, CASE class WHEN 'A' THEN 'Revoked' WHEN 'B' THEN 'WITHDRAWN' ELSE 'Issued' END AS status, day - 30 AS approved, day AS issued, CASE WHEN n_units % 3 <> 0 THEN day + 900 END AS expires, class IN ('C', 'I') AND (n_units % 3 = 0 OR day + 900 >= DATE '{AS_OF_ORDERS}') AS live FROM k WHERE notice_id % 5 = 0), u AS (SELECT v.* REPLACE (o.bbl AS bbl) FROM own o JOIN v ON v.bbl = o.bbl OR v.bin = o.bin), r AS (SELECT *, row_number() OVER (PARTITION BY bbl, live ORDER BY issued DESC, status DESC, expires DESC NULLS LAST) AS n FROM u) SELECT bbl, count(*) FILTER (live) > 0 AS has_active, max(CASE WHEN live AND n = 1 THEN status END) AS status, max(CASE WHEN live AND n = 1 THEN expires END) AS expires, CASE WHEN count(*) FILTER (live) > 0 THEN min(approved) END AS first_approved, CASE WHEN count(*) FILTER (live) > 0 THEN CAST(DATE '{AS_OF_ORDERS}' - min(approved) AS INT) END AS age_days, count(*) AS permit_count FROM r GROUP BY 1")
def bf07(spark, d):
    return records.sheds(shed_rows(spark, d), AS_OF_ORDERS, numbers(spark, d), view(spark, d, "lots"))


def lift_rows(spark, d):
    n = keyed(spark, d, "notices").where("notice_id % 3 = 1")
    return n.select("bbl", F.when(F.col("n_units") % 7 == 0, " ").otherwise(F.concat(F.lit("D"), (F.col("n_units") % 6).cast("string"))).alias("device"), "class", F.when(F.col("status") == "Open", F.lit(None).cast("string")).when(F.col("class") == "C", "active").otherwise("Removed").alias("status")).withColumnRenamed("class", "kind")


@query("bf08_elevators", view_sql("lots", "notices") + K + " SELECT bbl, count(DISTINCT CASE WHEN n_units % 7 <> 0 THEN n_units % 6 END) + count(*) FILTER (n_units % 7 = 0) AS active_devices, string_agg(DISTINCT class, ',' ORDER BY class) AS kinds FROM k WHERE notice_id % 3 = 1 AND (status = 'Open' OR class = 'C') GROUP BY 1")
def bf08(spark, d):
    return records.elevators(lift_rows(spark, d)).withColumn("kinds", F.array_join("kinds", ","))


def penalty_rows(spark, d):
    return keyed(spark, d, "cases").select("bbl", F.expr(CASE_BIN.replace("VARCHAR", "STRING")).alias("bin"), F.when(F.col("kind") == "permit", "Resolved - paid").otherwise("Active").alias("status"), F.floor(F.col("amount") / 20).cast("double").alias("balance"))


@query("bf09_penalties", view_sql("lots", "cases") + C + OWN + " " + PENALTIES)
def bf09(spark, d):
    return records.penalties(penalty_rows(spark, d), numbers(spark, d), view(spark, d, "lots"))


@query("bf10_repair_orders", view_sql("lots", "cases") + C + " SELECT bbl, count(*) AS order_count, round(sum(amount), 2) AS total_awarded FROM c WHERE case_id % 7 = 0 GROUP BY 1")
def bf10(spark, d):
    return records.repairs(keyed(spark, d, "cases").where("case_id % 7 = 0"))


def registered(spark, d):
    rows = keyed(spark, d, "cases").select("bbl", F.col("case_id").alias("reg_id"), F.when(F.col("lot_id") % 4 != 0, F.concat(F.lit("B"), F.col("lot_id").cast("string"))).alias("bin"), F.col("day").alias("registered"), F.date_add("day", 500).alias("ends"))
    c = view(spark, d, "cases")
    text = lambda p: F.concat(F.lit(p), (F.col("case_id") % 50).cast("string"))
    officer = c.where("case_id % 2 = 0").select((F.col("case_id") * 2).alias("contact_id"), F.col("case_id").alias("reg_id"), F.lit("Head Officer").alias("role"), F.lit(None).cast("string").alias("corporation"), F.lit("Ann").alias("first"), text("Lee").alias("last"), text("Road ").alias("address"))
    owner = c.where("case_id % 3 <> 0").select((F.col("case_id") * 2 + 1).alias("contact_id"), F.col("case_id").alias("reg_id"), F.lit("CorporateOwner").alias("role"), text("Holding ").alias("corporation"), F.lit(" ").alias("first"), F.lit(None).cast("string").alias("last"), text("Mall ").alias("address"))
    return rows, officer.unionByName(owner)


@query("bf11_registrations", view_sql("lots", "cases") + C + f", r AS (SELECT *, row_number() OVER (PARTITION BY bbl ORDER BY day DESC, case_id DESC) AS k FROM c) SELECT bbl, case_id AS reg_id, CASE WHEN lot_id % 4 <> 0 THEN concat('B', CAST(lot_id AS VARCHAR)) END AS bin, day AS registered, day + 500 AS ends, CASE WHEN case_id % 2 = 0 THEN concat('Ann Lee', CAST(case_id % 50 AS VARCHAR)) END AS head_officer, CASE WHEN case_id % 3 <> 0 THEN concat('Holding ', CAST(case_id % 50 AS VARCHAR)) END AS corporation, CASE WHEN case_id % 2 = 0 THEN concat('Road ', CAST(case_id % 50 AS VARCHAR)) WHEN case_id % 3 <> 0 THEN concat('Mall ', CAST(case_id % 50 AS VARCHAR)) END AS business_address, day + 500 < DATE '{AS_OF_ORDERS}' AS expired FROM r WHERE k = 1")
def bf11(spark, d):
    return records.registrations(*registered(spark, d), AS_OF_ORDERS)


def facts(spark, d):
    """All topics of every lot."""
    registration = records.registrations(*registered(spark, d), AS_OF_ORDERS)
    own, lots = records.building_numbers(registration), view(spark, d, "lots")
    topics = {
        "vacate": records.vacate_orders(vacate_rows(spark, d)), "enforcement": records.enforcement(enforcement_rows(spark, d)), "bedbugs": records.bedbugs(keyed(spark, d, "notices").where("notice_id % 9 = 0")), "speculation": records.speculation(deeds(spark, d)), "liens": records.tax_liens(lien_rows(spark, d)),
        "shed": records.sheds(shed_rows(spark, d), AS_OF_ORDERS, own, lots), "elevators": None, "penalties": records.penalties(penalty_rows(spark, d), own, lots), "repairs": records.repairs(keyed(spark, d, "cases").where("case_id % 7 = 0")), "registration": registration,
    }
    return records.assemble(lots, topics)


@query("bf12_assemble", view_sql("lots", "notices", "cases") + K + C + OWN + f" SELECT t.bbl, coalesce(v.n, 0) AS vacate_orders, coalesce(b.n, 0) AS bedbug_filings, coalesce(l.n, 0) AS liens, coalesce(l.w, FALSE) AS all_water, coalesce(p.balance_due, 0) AS balance_due, coalesce(r.n, 0) AS repair_orders, TRUE AS no_elevators FROM lots t LEFT JOIN (SELECT bbl, count(*) AS n FROM k WHERE notice_id % 4 = 0 GROUP BY 1) v USING (bbl) LEFT JOIN (SELECT bbl, count(*) AS n FROM k WHERE notice_id % 9 = 0 GROUP BY 1) b USING (bbl) LEFT JOIN (SELECT bbl, count(*) AS n, bool_and(kind <> 'eviction') AS w FROM c WHERE case_id % 5 = 0 GROUP BY 1) l USING (bbl) LEFT JOIN ({PENALTIES}) p USING (bbl) LEFT JOIN (SELECT bbl, count(*) AS n FROM c WHERE case_id % 7 = 0 GROUP BY 1) r USING (bbl)")
def bf12(spark, d):
    return facts(spark, d).select("bbl", F.col("vacate.total_orders").alias("vacate_orders"), F.col("bedbugs.filings").alias("bedbug_filings"), F.col("liens.entry_count").alias("liens"), "liens.all_water", "penalties.balance_due", F.col("repairs.order_count").alias("repair_orders"), F.col("elevators").isNull().alias("no_elevators"))


@query("fl02_record_flags")
def fl02(spark, d):
    return flags.record_flags(facts(spark, d))


#: Component columns of listings, made from their keys, for the rules and sentences.
MADE = {
    "crime_trend_ratio": "CAST(60 + id % 90 AS DOUBLE) / CAST(100 AS DOUBLE)", "crime_trend_direction": "CASE WHEN 60 + id % 90 < 85 THEN 'improving' WHEN 60 + id % 90 > 115 THEN 'worsening' ELSE 'stable' END", "crime_score": "CASE WHEN id % 10 = 0 THEN NULL ELSE CAST((id * 7) % 101 AS DOUBLE) END",
    "rent_stabilized": "id % 2", "bedbug_new_building": "CASE WHEN id % 19 = 0 THEN 1 ELSE 0 END", "pest_match_uncertain": "CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END", "bedbug_never_filed": "CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END", "building_unitsres": "CASE WHEN id % 23 = 0 THEN NULL ELSE (id * 3) % 120 END",
    "deal_price_cut_pct": "CAST(id % 5 AS DOUBLE)", "deal_cut_recency_days": "(id * 11) % 60", "transit_station_count": "CASE WHEN id % 13 = 0 THEN NULL ELSE id % 7 END", "building_violation_count": "CASE WHEN id % 29 = 0 THEN NULL ELSE (id * 5) % 40 END", "building_hpd_class_c": "id % 6", "mgmt_complaints": "CASE WHEN id % 31 = 0 THEN NULL ELSE (id * 13) % 35 END",
    "mgmt_owner_units": "(id * 17) % 150", "mgmt_litigations": "CASE WHEN id % 8 = 0 THEN 2 ELSE 0 END", "mgmt_evictions": "id % 9", "flood_risk_score": "CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(100 * (id % 2) AS DOUBLE) END", "deal_score": "CAST((id * 37) % 101 AS DOUBLE)", "relist_count": "id % 5", "tenure_median_months": "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST((id * 7) % 40 AS DOUBLE) END",
    "pest_hpd_count": "CASE WHEN id % 4 = 1 THEN NULL ELSE id % 8 END", "pest_rodent_count": "CASE WHEN id % 4 = 1 THEN NULL ELSE (id * 3) % 14 END", "pest_units": "(id * 7) % 100", "road_exposure_hwy_dist_m": "CASE WHEN id % 5 = 0 THEN NULL ELSE CAST((id * 19) % 600 AS DOUBLE) END", "road_exposure_truck": "CAST(id % 4 AS DOUBLE) / CAST(2 AS DOUBLE)",
    "transit_nearest_m": "(id * 97) % 1500", "transit_routes_served": "id % 4", "transit_score": "CAST((id * 3) % 101 AS DOUBLE)", "greenery_score": "CAST((id * 11) % 101 AS DOUBLE)", "greenery_tree_count": "(id * 41) % 1400", "greenery_garden_count": "id % 3", "crime_felony_count": "id % 3", "crime_misdemeanor_count": "CASE WHEN id % 7 = 0 THEN NULL ELSE (id * 31) % 1300 END",
}


def made(spark, d):
    return view(spark, d, "listings").select("id", "neighborhood", "price").selectExpr("id", "neighborhood", "price", *(f"{e} AS {c}" for c, e in MADE.items()))


MADE_SQL = ", f AS (SELECT id, neighborhood, price, " + ", ".join(f"{e} AS {c}" for c, e in MADE.items()) + " FROM listings)"
PCT = "abs(round_even((1 - crime_trend_ratio) * 100, 0))"
BU, MU = "greatest(coalesce(nullif(building_unitsres, 0), 1), 1)", "greatest(coalesce(nullif(mgmt_owner_units, 0), 1), 1)"
EU = "greatest(coalesce(nullif(building_unitsres, 0), nullif(mgmt_owner_units, 0), 1), 1)"
PU = "greatest(coalesce(nullif(pest_units, 0), nullif(building_unitsres, 0), 1), 1)"
H, R = "coalesce(pest_hpd_count, 0)", "coalesce(pest_rodent_count, 0)"
#: The rules in SQL, each giving its colour, in order.
RULES = {
    "crime_trend": f"CASE WHEN {PCT} >= 5 THEN CASE WHEN crime_trend_direction = 'improving' THEN CASE WHEN crime_score < 30 THEN 'yellow' ELSE 'green' END WHEN crime_trend_direction = 'worsening' THEN CASE WHEN crime_score >= 70 THEN 'yellow' ELSE 'red' END END END",
    "rent_stabilized": "CASE WHEN rent_stabilized <> 0 THEN 'green' END", "building_data_states": "CASE WHEN bedbug_new_building > 0 OR pest_match_uncertain > 0 THEN 'yellow' END", "bedbug_never_filed": "CASE WHEN bedbug_never_filed <> 0 AND building_unitsres >= 5 THEN 'yellow' END",
    "price_cut_leverage": "CASE WHEN deal_price_cut_pct >= 2 AND deal_cut_recency_days <= 30 THEN 'green' END", "transit": "CASE WHEN transit_station_count >= 4 THEN 'green' WHEN transit_station_count = 0 THEN 'red' END",
    "violations": f"CASE WHEN building_violation_count IS NOT NULL THEN CASE WHEN building_violation_count = 0 THEN 'green' WHEN {BU} >= 20 THEN CASE WHEN building_violation_count / {BU} >= 0.5 THEN 'red' WHEN building_violation_count / {BU} >= 0.2 THEN 'yellow' END WHEN building_violation_count >= 3 THEN 'red' ELSE 'yellow' END END",
    "hpd_class_c": f"CASE WHEN building_hpd_class_c > 0 THEN CASE WHEN {BU} >= 50 THEN CASE WHEN building_hpd_class_c / {BU} >= 0.02 THEN 'red' WHEN building_hpd_class_c / {BU} >= 0.005 THEN 'yellow' END WHEN building_hpd_class_c >= 3 THEN 'red' ELSE 'yellow' END END",
    "management": f"CASE WHEN mgmt_complaints IS NOT NULL THEN CASE WHEN mgmt_complaints = 0 THEN 'green' WHEN {MU} >= 50 THEN CASE WHEN mgmt_complaints / {MU} >= 0.3 THEN 'red' WHEN mgmt_complaints / {MU} >= 0.1 THEN 'yellow' END WHEN mgmt_complaints >= 10 THEN 'red' WHEN mgmt_complaints >= 5 THEN 'yellow' END END",
    "litigations": "CASE WHEN mgmt_litigations >= 1 THEN 'red' END", "evictions": f"CASE WHEN mgmt_evictions > 0 THEN CASE WHEN {EU} >= 50 THEN CASE WHEN mgmt_evictions / {EU} >= 0.05 THEN 'red' WHEN mgmt_evictions / {EU} >= 0.02 THEN 'yellow' END WHEN mgmt_evictions >= 5 THEN 'red' WHEN mgmt_evictions >= 2 THEN 'yellow' END END",
    "flood_risk": "CASE WHEN coalesce(flood_risk_score, 100) < 30 THEN 'red' END", "deal": "CASE WHEN deal_score >= 80 THEN 'green' WHEN deal_score <= 20 THEN 'red' END",
    "relist": "CASE WHEN tenure_median_months > 0 THEN CASE WHEN tenure_median_months <= 6 THEN 'red' WHEN tenure_median_months <= 9 THEN 'yellow' WHEN tenure_median_months >= 24 THEN 'green' END WHEN relist_count >= 3 THEN 'red' WHEN relist_count = 2 THEN 'yellow' END",
    "pest": f"CASE WHEN pest_hpd_count IS NOT NULL OR pest_rodent_count IS NOT NULL THEN CASE WHEN {H} + {R} = 0 THEN 'green' WHEN {PU} >= 50 THEN CASE WHEN {H} / {PU} >= 0.05 THEN 'red' WHEN {H} / {PU} >= 0.02 THEN 'yellow' WHEN {R} >= 10 THEN 'yellow' END WHEN {H} >= 5 THEN 'red' WHEN {H} + {R} >= 10 THEN 'red' WHEN {H} + {R} >= 3 THEN 'yellow' END END",
    "highway_adjacent": "CASE WHEN road_exposure_hwy_dist_m <= 150 THEN 'red' END", "truck_route": "CASE WHEN road_exposure_truck >= 1.5 THEN 'yellow' END",
}


@query("fl01_listing_flags", view_sql("listings") + MADE_SQL + " SELECT id, concat_ws(',', " + ", ".join(f"'{n}:' || ({c})" for n, c in RULES.items()) + ") AS flags FROM f")
def fl01(spark, d):
    f = flags.listing_flags(made(spark, d))
    return f.select("id", F.array_join(F.transform("flags", lambda x: F.concat_ws(":", x["rule"], x["type"])), ",").alias("flags"))


@query("fl01_flag_texts", view_sql("listings") + MADE_SQL + f" SELECT id, CASE WHEN building_violation_count > 0 AND {BU} >= 20 AND building_violation_count / {BU} >= 0.2 THEN printf('%d open DOB violations (%.2f/unit)', building_violation_count, building_violation_count / {BU}) END AS violations, CASE WHEN transit_station_count >= 4 THEN printf('%d subway stations within walking distance', transit_station_count) WHEN transit_station_count = 0 THEN 'No subway stations nearby' END AS transit FROM f WHERE id % 8 <> 5")
def fl01_texts(spark, d):
    r = flags.rules(flags.Row(x := made(spark, d)))
    long_ = F.when(F.contains(r["violations"]["text"], F.lit("/unit")), r["violations"]["text"])
    return x.where("id % 8 <> 5").select("id", long_.alias("violations"), r["transit"]["text"].alias("transit"))


@query("fl03_dealbreakers", view_sql("scores") + " SELECT id, concat_ws(';', CASE WHEN d4 <= 12 THEN 'Dealbreaker: d4 is in the bottom tier citywide (caps overall score)' END, CASE WHEN d6 <= 12 THEN 'Dealbreaker: d6 is in the bottom tier citywide (caps overall score)' END) AS chips FROM scores")
def fl03(spark, d):
    s = rank.dealbreaker(view(spark, d, "scores").withColumn("composite", F.lit(50.0)), "composite", ["d4", "d5", "d6"])
    chips = flags.dealbreaker_chips(F.expr("cast(array() as array<struct<rule:string,type:string,text:string>>)"), F.col("dealbreakers"), frozenset({"d5"}))
    return s.select("id", F.array_join(F.transform(chips, lambda c: c["text"]), ";").alias("chips"))


@query("ex01_explanations")
def ex01(spark, d):
    x = made(spark, d)
    peers = rank.peer_context(x, "neighborhood", ["crime_score", "deal_score", "transit_score", "greenery_score"]).withColumn("dim", F.regexp_replace("dim", "_score$", ""))
    return explain.explanations(x, peers)


TRANSIT = "CASE WHEN transit_nearest_m >= 1000 THEN concat(regexp_replace(printf('%.1f', transit_nearest_m / 1000.0), '\\.0$', ''), ' km') ELSE concat(CAST(transit_nearest_m AS VARCHAR), ' m') END"
REACH = "concat_ws(' and ', CASE WHEN transit_station_count IS NOT NULL THEN concat(CAST(transit_station_count AS VARCHAR), CASE WHEN transit_station_count = 1 THEN ' station' ELSE ' stations' END) END, CASE WHEN transit_routes_served = 1 THEN '1 route' ELSE concat(CAST(transit_routes_served AS VARCHAR), ' unique routes') END)"
GREEN = "CASE WHEN greenery_score >= 75 THEN 'greener than most of NYC' WHEN greenery_score >= 50 THEN 'more greenery than the city average' WHEN greenery_score >= 25 THEN 'less green than most of NYC' ELSE 'one of the least green blocks in the city' END"
GROUPED = "CASE WHEN {n} >= 1000 THEN concat(CAST({n} // 1000 AS VARCHAR), ',', lpad(CAST({n} % 1000 AS VARCHAR), 3, '0')) ELSE CAST({n} AS VARCHAR) END".format


@query("ex01_sentences", view_sql("listings") + MADE_SQL + f""", s AS (SELECT id, 'transit' AS dim, concat('Nearest subway station ', {TRANSIT}, ' away; ', {REACH}, ' within a 10-minute walk.') AS sentence FROM f WHERE transit_nearest_m % 100 <> 50 UNION ALL
SELECT id, 'greenery', concat({GROUPED(n='greenery_tree_count')}, CASE WHEN greenery_tree_count = 1 THEN ' street tree' ELSE ' street trees' END, ' within ~2 blocks', CASE WHEN greenery_garden_count > 0 THEN concat(' and ', CAST(greenery_garden_count AS VARCHAR), CASE WHEN greenery_garden_count = 1 THEN ' community garden' ELSE ' community gardens' END, ' nearby') ELSE '' END, ' — ', {GREEN}, '.') FROM f WHERE transit_nearest_m % 100 <> 50) SELECT * FROM s""")
def ex01_sentences(spark, d):
    return explain.explanations(made(spark, d).where("transit_nearest_m % 100 <> 50")).where("dim in ('transit', 'greenery')")


@query("ex02_peer_tail", view_sql("scores") + " SELECT id, CASE WHEN d0 IS NULL THEN '' ELSE concat(CASE WHEN d1 IS NULL THEN ' — ' WHEN d0 >= 45 AND d0 < 55 THEN CASE WHEN d1 >= 50 THEN ', though ' ELSE ', but ' END WHEN (d1 >= 50) <> (d0 >= 55) THEN ', but ' ELSE ', and ' END, CASE WHEN d0 >= 80 THEN concat('among the best in ', neighborhood, ' for this') WHEN d0 >= 55 THEN concat('better than most ', neighborhood, ' listings') WHEN d0 >= 45 THEN concat('mid-pack for ', neighborhood) WHEN d0 >= 10 THEN concat('ranks below most ', neighborhood, ' listings here') ELSE concat('ranks in ', neighborhood, '''s bottom tier for this') END) END AS tail FROM scores")
def ex02(spark, d):
    return view(spark, d, "scores").select("id", explain.peer_tail(F.col("d0"), F.col("neighborhood"), F.col("d1") >= 50).alias("tail"))


# detail pages


@query("nb02_nearby_neighborhoods", view_sql("listings") + ", n AS (SELECT a.id, b.neighborhood AS hood, min(abs(a.lat - b.lat) + abs(a.lon - b.lon)) AS d FROM listings a JOIN listings b ON b.status = 'ACTIVE' AND lower(b.neighborhood) <> lower(a.neighborhood) AND abs(a.lat - b.lat) < 0.004 AND abs(a.lon - b.lon) < 0.004 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, hood) AS k FROM n) SELECT id, string_agg(hood, ',' ORDER BY k) AS neighborhoods FROM r WHERE k <= 5 GROUP BY 1")
def nb02(spark, d):
    return detail.nearby_neighborhoods(view(spark, d, "listings"), 0.004).select("id", F.array_join("neighborhoods", ",").alias("neighborhoods"))


@query("nb03_points_of_interest", view_sql("listings") + MADE_SQL + " SELECT id, concat_ws(',', CASE WHEN greenery_garden_count > 0 THEN concat(CAST(greenery_garden_count AS VARCHAR), ' community garden', CASE WHEN greenery_garden_count > 1 THEN 's' ELSE '' END, ' within 500m') END, CASE WHEN building_hpd_class_c > 0 THEN concat(CAST(building_hpd_class_c AS VARCHAR), ' gyms/fitness centers within 500m') END, CASE WHEN mgmt_evictions > 0 THEN concat(CAST(mgmt_evictions AS VARCHAR), ' restaurants & cafes within 500m') END) AS pois FROM f")
def nb03(spark, d):
    x = made(spark, d).withColumns({"convenience_gym": F.col("building_hpd_class_c"), "convenience_dining": F.col("mgmt_evictions")})
    return detail.points_of_interest(x).select("id", F.array_join(F.transform("pois", lambda p: p["name"]), ",").alias("pois"))


@query("nb04_stations_near", view_sql("listings", "stations") + f", e AS (SELECT l.id, s.station_id, s.routes, {dist('l', 's')} AS m FROM listings l JOIN stations s ON {near_sql('l', 's', 800.0)}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, station_id) AS k FROM e) SELECT id, string_agg(concat(station_id, '/', CAST(CAST(floor(m) AS INT) AS VARCHAR), '/', replace(routes, ' ', '+')), ',' ORDER BY k) AS stations FROM r WHERE k <= 8 GROUP BY 1")
def nb04(spark, d):
    s = view(spark, d, "stations").withColumn("name", F.col("station_id")).withColumn("routes", F.split("routes", " "))
    near = detail.stations_near(places(spark, d), s)
    return near.select("id", F.array_join(F.transform("stations", lambda x: F.concat_ws("/", x["name"], x["distance_m"].cast("string"), F.array_join(x["routes"], "+"))), ",").alias("stations"))


KEYWORDS = [(0, "doorman", "services"), (1, "fitness center", "wellness"), (2, "roof deck", "outdoor"), (3, "garden", "outdoor"), (4, "bike storage", "convenience"), (5, "storage", "convenience"), (6, "washer/dryer", "unit_features"), (7, "private outdoor space", "unit_features")]


@query("nb05_amenity_categories", view_sql("listings") + f", a AS (SELECT id, {AMENITIES} AS am FROM listings), u AS (SELECT id, unnest(am) AS x, unnest(range(0, len(am))) AS i FROM a), c AS (SELECT *, CASE WHEN x = 'Doorman' THEN 'services' WHEN x = 'Fitness Center' THEN 'wellness' WHEN x IN ('Roof Deck', 'Community Garden') THEN 'outdoor' WHEN x = 'Bike Storage' THEN 'convenience' WHEN x IN ('In-unit Washer/Dryer', 'Private Outdoor Space') THEN 'unit_features' END AS cat FROM u) SELECT id, cat AS category, string_agg(x, ',' ORDER BY i) AS amenities FROM c WHERE cat IS NOT NULL GROUP BY 1, 2")
def nb05(spark, d):
    words = spark.createDataFrame(KEYWORDS, "place int, keyword string, category string")
    c = detail.categorised(view(spark, d, "listings").select("id", amenity_array().alias("amenities")), words)
    return c.select("id", F.explode("categories").alias("category", "x")).select("id", "category", F.array_join("x", ",").alias("amenities"))


@query("nb06_pet_policy", view_sql("listings") + " SELECT id, CASE WHEN contains(amenity_text, 'gear') THEN 'No pets allowed' WHEN contains(amenity_text, 'red') AND contains(amenity_text, 'ring') THEN 'Cats and dogs allowed' WHEN contains(amenity_text, 'red') THEN 'Dogs allowed' WHEN contains(amenity_text, 'ring') THEN 'Cats allowed' WHEN contains(amenity_text, 'small') THEN 'Pets allowed' END AS policy FROM listings")
def nb06(spark, d):
    has = lambda w: F.contains("amenity_text", F.lit(w))
    a = F.array_compact(F.array(F.when(has("gear"), "No Pets"), F.when(has("red"), "Dogs OK "), F.when(has("ring"), "cats allowed"), F.when(has("small"), "Pet friendly")))
    return view(spark, d, "listings").select("id", detail.pet_policy(a).alias("policy"))


@query("nb07_days_on_market", view_sql("listings") + f" SELECT id, CAST(greatest(0, DATE '{AS_OF_EVENTS}' - first_seen) AS INT) AS days FROM listings")
def nb07(spark, d):
    return view(spark, d, "listings").select("id", detail.days_on_market(F.col("first_seen"), F.lit(AS_OF_EVENTS)).alias("days"))


@query("nb08_descriptions", view_sql("listings") + " SELECT l.id, CASE WHEN n.n_nationkey IS NOT NULL THEN concat('About ', n.n_name) END AS description FROM listings l LEFT JOIN nation n ON l.neighborhood = concat('Brand#', CAST(n.n_nationkey AS VARCHAR))")
def nb08(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("neighborhood"), F.concat(F.lit("About "), "n_name").alias("description"))
    return detail.described(view(spark, d, "listings"), n).select("id", "description")


@query("nb09_detail")
def nb09(spark, d):
    """One nested row a listing: flags, days, pets, neighborhoods and stations near by, peers."""
    x = view(spark, d, "listings").select("id", "neighborhood", "status", "lat", "lon", "price", "first_seen", amenity_array().alias("amenities"))
    s = view(spark, d, "stations").withColumn("name", F.col("station_id")).withColumn("routes", F.split("routes", " "))
    peers = rank.peer_context(view(spark, d, "scores"), "neighborhood", DIMS).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", "percentile")))).alias("peers"))
    facts_ = x.select("id", detail.days_on_market(F.col("first_seen"), F.lit(AS_OF_EVENTS)).alias("days_on_market"), detail.pet_policy(F.col("amenities")).alias("pet_policy"))
    return detail.details(x, {"facts": facts_, "flags": flags.listing_flags(made(spark, d)), "nearby": detail.nearby_neighborhoods(x, 0.004), "stations": detail.stations_near(x, s), "peers": peers})
