"""Queries of the scorers that read listings and incidents: deals, tenure, amenities, crime."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascore.operators import scorers
from terrascore.plans.registry import near_sql, query
from terrascore.plans.scorer_queries import age, kernel, ratio_sql, season_sql, turn_sql, units_sql
from terrascore.sources.views import AS_OF_EVENTS, view, view_sql

#: Words of part names as the amenities that the keyword table knows.
WORDS = {"small": "In-unit Washer/Dryer", "large": "Private Outdoor Space", "red": "Roof Deck", "blue": "Doorman", "green": "Community Garden", "ring": "Bike Storage", "widget": "Fitness Center", "gear": "No Pets"}


def amenity_array():
    """A listing's amenities from the words of its name, in the order of the table above."""
    return F.array_compact(F.array(*(F.when(F.contains("amenity_text", F.lit(w)), F.lit(a)) for w, a in WORDS.items())))


AMENITIES = "list_filter([" + ", ".join(f"CASE WHEN contains(amenity_text, '{w}') THEN '{a}' END" for w, a in WORDS.items()) + "], lambda x: x IS NOT NULL)"
FOUND = lambda k: f"CAST(len(list_filter(am, lambda x: contains(lower(x), '{k}'))) > 0 AS INT)"


@query("sc02_unit_amenities", view_sql("listings") + f", a AS (SELECT id, {AMENITIES} AS am FROM listings) SELECT id, " + ", ".join(f"CASE WHEN len(am) > 0 THEN {' + '.join(FOUND(k) for k in t)} END AS {n}" for n, t in (("premium", scorers.PREMIUM), ("standard", scorers.STANDARD))) + ", CASE WHEN len(am) > 0 THEN " + " + ".join(f"{FOUND(k)} * {w}" for k, w in {**scorers.PREMIUM, **scorers.STANDARD}.items()) + " END AS total FROM a")
def sc02(spark, d):
    return scorers.unit_amenities(view(spark, d, "listings").select("id", amenity_array().alias("amenities")))


def history_of(spark, d):
    """(listing_id, price_history): events of orders as the arrays that listings carry, with dates in three formats."""
    h = view(spark, d, "history")
    k = F.col("order_id") % 3
    text = F.when(k == 0, F.date_format("listed_at", "yyyy-MM-dd")).when(k == 1, F.date_format("listed_at", "M/d/yyyy")).otherwise(F.date_format("listed_at", "M/d/yyyy"))
    event = F.when(F.col("status") == "F", "Listed by agent").when(F.col("status") == "O", "Re-Listed").otherwise("Delisted")
    return h.groupBy("listing_id").agg(F.collect_list(F.struct(event.alias("event"), text.alias("date"))).alias("price_history"))


#: Clusters by a recursive step: the first day more than 90 days after the last cluster's first.
TENURE = """, h AS (SELECT DISTINCT listing_id AS k, listed_at AS d FROM history WHERE status <> 'P'), n2 AS (SELECT listing_id AS k, count(*) AS n FROM history WHERE status <> 'P' GROUP BY 1), rec AS (SELECT k, min(d) AS d FROM h GROUP BY 1 UNION ALL SELECT rec.k, (SELECT min(h.d) FROM h WHERE h.k = rec.k AND h.d > rec.d + 90) AS d FROM rec WHERE EXISTS (SELECT 1 FROM h WHERE h.k = rec.k AND h.d > rec.d + 90)),
gaps AS (SELECT k, d, greatest(date_diff('day', lag(d) OVER (PARTITION BY k ORDER BY d), d) - 30, 0) / 30.44 AS g0, lag(d) OVER (PARTITION BY k ORDER BY d) AS before FROM rec), tn AS (SELECT k, round(median(CASE WHEN before IS NOT NULL THEN g0 END), 1) AS months, count(*) AS cycles FROM gaps GROUP BY 1)"""


@query("sc01b_tenure", view_sql("history").replace("WITH ", "WITH RECURSIVE ", 1) + TENURE + " SELECT l.listing_id, tn.months AS tenure_months, CAST(CASE WHEN coalesce(n2.n, 0) < 2 THEN 0 ELSE tn.cycles END AS INT) AS tenure_cycles FROM (SELECT DISTINCT listing_id FROM history) l LEFT JOIN n2 ON n2.k = l.listing_id LEFT JOIN tn ON tn.k = l.listing_id")
def sc01b(spark, d):
    return scorers.tenure_of(history_of(spark, d), "price_history").select("listing_id", "tenure_months", "tenure_cycles")


LEVERAGE = f"""CASE WHEN price_delta < 0 AND price > 0 AND price - price_delta > 0 THEN least(0.5, -price_delta / (price - price_delta)) END AS cut_frac, CASE WHEN price_delta < 0 AND price > 0 AND price_changed IS NOT NULL THEN CAST(greatest(0, DATE '{AS_OF_EVENTS}' - price_changed) AS INT) END AS cut_recency_days, CASE WHEN months_free > 0 THEN round(months_free, 2) END AS free"""


@query("sc01c_leverage", view_sql("listings") + f", x AS (SELECT id, {LEVERAGE} FROM listings) SELECT id, round(cut_frac, 6) AS cut_frac, cut_recency_days, free AS months_free FROM x")
def sc01c(spark, d):
    return scorers.leverage(view(spark, d, "listings"), AS_OF_EVENTS).select("id", F.round("cut_frac", 6).alias("cut_frac"), "cut_recency_days", "months_free")


@query("sc01_deal", view_sql("listings", "history").replace("WITH ", "WITH RECURSIVE ", 1) + TENURE + f""", c AS (SELECT *, CAST(CASE WHEN net_effective > 0 THEN net_effective ELSE price END AS DOUBLE) AS cost, {LEVERAGE} FROM listings), p AS (SELECT *, CASE WHEN sqft > 0 THEN cost / sqft END AS psf FROM c), g AS (SELECT neighborhood, beds, median(cost) AS cm, count(cost) AS n, median(sqft) AS sm, median(psf) AS pm, count(psf) AS ns FROM p WHERE status = 'ACTIVE' GROUP BY 1, 2),
j AS (SELECT p.*, cm, g.n, sm, pm, sqft > 0 AND ns >= 3 AS fullrow, tn.months, CASE WHEN coalesce(n2.n, 0) < 2 THEN 0 ELSE tn.cycles END AS cycles FROM p JOIN g USING (neighborhood, beds) LEFT JOIN tn ON tn.k = p.id LEFT JOIN n2 ON n2.k = p.id WHERE g.n >= 3), d1 AS (SELECT *, CASE WHEN fullrow THEN 0.4 * (cm - cost) / cm + 0.3 * (pm - psf) / pm + 0.3 * (sqft - sm) / sm ELSE (cm - cost) / cm END AS d FROM j), d2 AS (SELECT *, CASE WHEN months IS NOT NULL THEN 0.9 * d + 0.1 * greatest(-0.5, least(1.0, (months - 12) / 24)) ELSE d END + CASE WHEN cut_recency_days <= 21 THEN coalesce(0.25 * cut_frac, 0) ELSE 0 END AS dev FROM d1)
SELECT id, CAST(floor(cm) AS INT) AS comp_median, n AS comp_set_size, 'neighborhood' AS comp_scope, CASE WHEN fullrow THEN CAST(floor(sm) AS INT) END AS sqft_median, CASE WHEN fullrow THEN round(psf, 2) END AS price_per_sqft, months AS tenure_months, CAST(cycles AS INT) AS tenure_cycles, round(cut_frac, 4) AS cut_frac, free AS months_free, cut_recency_days, round(dev, 4) AS deviation, CAST(rent_stabilized <> 0 AND dev > 0.05 AS INT) AS stabilized_below_median FROM d2""")
def sc01(spark, d):
    x = view(spark, d, "listings").join(history_of(spark, d), F.col("id") == F.col("listing_id"), "left").drop("listing_id")
    return scorers.deal(x, AS_OF_EVENTS)


CONTEXT = "CASE WHEN i.offence = 'PETIT LARCENY' THEN 0.4 WHEN i.offence IN ('ROBBERY', 'FELONY ASSAULT') THEN 1.5 ELSE 1.0 END * CASE i.premise WHEN 'CHAIN STORE' THEN 0.4 WHEN 'STREET' THEN 1.2 WHEN 'RESIDENCE - APT' THEN 1.1 ELSE 1.0 END * CASE WHEN i.hour >= 20 OR i.hour <= 4 THEN 1.5 ELSE 1.0 END"
SEV = "CASE i.severity WHEN 'FELONY' THEN 3.0 WHEN 'MISDEMEANOR' THEN 1.5 ELSE 1.0 END"


@query("sc04_crime", view_sql("listings", "incidents", "lots", "crashes") + f""", w AS (SELECT l.id, i.severity, CAST({SEV} AS DOUBLE) AS sev, i.day, {SEV} * {CONTEXT} * {kernel('l', 'i', 200.0)} * {age('i.day', AS_OF_EVENTS)} AS w FROM listings l JOIN incidents i ON i.severity IS NOT NULL AND {near_sql('l', 'i', 400.0)}), a AS (SELECT id, {', '.join(f"count(*) FILTER (severity = '{k}') AS {n}" for k, n in (('FELONY', 'felonies'), ('MISDEMEANOR', 'misdemeanors'), ('VIOLATION', 'violations')))}, sum(sev) AS total, sum(w) AS decayed, coalesce(sum(sev) FILTER (day >= DATE '{AS_OF_EVENTS}' - 182), 0) AS recent FROM w GROUP BY 1),
sh AS (SELECT l.id, count(*) AS n, sum(24.0 * {kernel('l', 'c', 200.0)} * {age('c.day', AS_OF_EVENTS)}) AS w FROM listings l JOIN crashes c ON c.killed > 0 AND (DATE '{AS_OF_EVENTS}' - c.day) <= 730 AND {near_sql('l', 'c', 400.0)} GROUP BY 1), {units_sql(400.0)}, {season_sql('incidents', int(AS_OF_EVENTS[5:7]))}, guard AS (SELECT greatest(0, least(1, (182 - (DATE '{AS_OF_EVENTS}' - max(day))) / 182)) >= 0.7 AS usable FROM incidents),
r AS (SELECT l.id, coalesce(felonies, 0) AS felonies, coalesce(misdemeanors, 0) AS misdemeanors, coalesce(violations, 0) AS violations, coalesce(total, 0) AS weighted_total, round(coalesce(decayed, 0), 3) AS decayed, coalesce(recent, 0) AS recent, coalesce(sh.n, 0) AS shootings, round(coalesce(sh.w, 0), 3) AS shootings_weighted, round(u.units, 1) AS units, factor, usable FROM listings l LEFT JOIN a USING (id) LEFT JOIN sh USING (id) JOIN u USING (id) CROSS JOIN season CROSS JOIN guard), s AS (SELECT *, round(1000 * ((decayed + shootings_weighted) / factor) / greatest(units, 1), 3) AS rate, CASE WHEN usable THEN {ratio_sql('recent', '(weighted_total - recent)')} ELSE 1.0 END AS trend_ratio FROM r), m AS (SELECT CASE WHEN median(rate) = 0 THEN 1.0 ELSE median(rate) END AS med FROM s)
SELECT id, felonies, misdemeanors, violations, weighted_total, decayed, shootings, shootings_weighted, units, rate, trend_ratio, {turn_sql('trend_ratio')} AS trend_direction, round(greatest(0, 100 - 50 * rate / med), 4) AS score FROM s, m""")
def sc04(spark, d):
    shot = view(spark, d, "crashes").where("killed > 0")
    return scorers.crime(view(spark, d, "listings"), view(spark, d, "incidents"), view(spark, d, "lots"), AS_OF_EVENTS, shot).withColumn("score", F.round("score", 4))
