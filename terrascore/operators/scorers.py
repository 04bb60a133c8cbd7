"""Scorers: each takes the tables it reads and returns one row a listing with its score and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.functions.geo import decay, gauss

from .spatial import DENSE_ROWS, at_spots, nearest_join, per_spot, radius_join
from .stats import kernel_units, median_inverse, seasonal_factor, trend, trend_direction, trend_guard

#: Severity and context weights of incidents, and half lives.
SEVERITY = {"FELONY": 3.0, "MISDEMEANOR": 1.5, "VIOLATION": 1.0}
STORES = ("CHAIN STORE", "DEPARTMENT STORE", "GROCERY", "SUPERMARKET")
VIOLENT = ("ROBBERY", "FELONY ASSAULT", "BURGLARY", "GRAND LARCENY OF MOTOR VEHICLE", "RAPE", "MURDER", "WEAPONS")
#: Unit amenities by tier, each keyword with its weight.
PREMIUM = {"washer": 3, "dryer": 3, "dishwasher": 3, "private outdoor": 3, "balcony": 3, "terrace": 3, "roof": 2, "central a/c": 2, "central air": 2}
STANDARD = {
    "doorman": 2, "concierge": 2, "elevator": 2, "gym": 2, "fitness": 2, "pool": 2, "garage": 1, "parking": 1, "bike": 1, "storage": 1, "laundry": 1, "pet": 1, "lounge": 1, "courtyard": 1, "garden": 1,
}


def lookup(weights: dict[str, float], key: Column, other: float = 1.0) -> Column:
    out = F.lit(other)
    for k, w in weights.items():
        out = F.when(key == k, F.lit(w)).otherwise(out)
    return out


def right_points(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), *columns)


def context(offence: Column, premise: Column, hour: Column) -> Column:
    """How much an incident matters to those who live near: by offence, premise and hour; what is unknown counts as 1."""
    o, p = F.upper(F.coalesce(offence, F.lit(""))), F.upper(F.coalesce(premise, F.lit("")))
    some = lambda text, words: F.greatest(*(F.contains(text, F.lit(w)) for w in words))
    kind = F.when(F.contains(o, F.lit("PETIT LARCENY")), 0.4).when(some(o, VIOLENT), 1.5).otherwise(1.0)
    place = F.when(some(p, STORES), 0.4).when(F.contains(p, F.lit("STREET")), 1.2).when(F.contains(p, F.lit("RESIDENCE")), 1.1).otherwise(1.0)
    return kind * place * F.when((hour >= 20) | (hour <= 4), 1.5).otherwise(1.0)


def crime(listings: DataFrame, incidents: DataFrame, lots: DataFrame, as_of: str, shootings: DataFrame | None = None, radius_m: float = 400.0) -> DataFrame:
    """(id, felonies, misdemeanors, violations, weighted_total, decayed, shootings, shootings_weighted, units, rate, trend_ratio,
    trend_direction, score).

    incidents: (lat, lon, severity, offence, premise, hour, day); shootings: (lat, lon, day). Severity x context x kernel x
    recency around each listing, with shootings of two years at 24 each, over the season's factor and per 1000 weighted units;
    scored against the median. Unknown severities are left out. The trend needs records that cover 0.7 of the last half year."""
    today = F.lit(as_of).cast("date")
    # what depends on the incident alone is worked out once for each and summed for each spot, before it meets the places
    sev = lookup(SEVERITY, F.col("severity"))
    late = F.coalesce(F.col("day") >= F.date_sub(today, 182), F.lit(False))
    n = lambda s: F.count_if(F.col("severity") == s)
    known = at_spots(
        incidents.where(F.col("severity").isin(*SEVERITY)), n("FELONY").alias("felonies"), n("MISDEMEANOR").alias("misdemeanors"), n("VIOLATION").alias("violations"), F.sum(sev).alias("sev"),
        F.sum(sev * context(F.col("offence"), F.col("premise"), F.col("hour")) * decay(F.col("day"), today)).alias("base"), F.sum(F.when(late, sev).otherwise(0.0)).alias("late_sev"),
    )
    total = lambda *columns: [F.sum(c).alias(c) for c in columns]

    def around(spots: DataFrame) -> DataFrame:
        near = radius_join(spots, right_points(known, "felonies", "misdemeanors", "violations", "sev", "base", "late_sev"), radius_m, dense_rows=DENSE_ROWS)
        near = near.groupBy("id").agg(*total("felonies", "misdemeanors", "violations"), F.sum("sev").alias("weighted_total"), F.sum(F.col("base") * gauss(F.col("dist_m"), radius_m / 2)).alias("decayed"), F.sum("late_sev").alias("recent"))
        got = spots.select("id").join(near, "id", "left").join(kernel_units(spots, lots, radius_m), "id")
        if shootings is None:
            return got.withColumns({"shootings": F.lit(0).cast("long"), "shootings_weighted": F.lit(0.0)})
        shot = at_spots(shootings.where(F.col("day").isNull() | (F.datediff(today, "day") <= 730)), F.count("*").alias("shootings"), F.sum(24.0 * decay(F.col("day"), today)).alias("w"))
        s = radius_join(spots, right_points(shot, "shootings", "w"), radius_m).groupBy("id").agg(*total("shootings"), F.sum(F.col("w") * gauss(F.col("dist_m"), 200.0)).alias("shootings_weighted"))
        return got.join(s, "id", "left")

    out = per_spot(listings, around)
    counts, sums = ("felonies", "misdemeanors", "violations", "shootings"), ("weighted_total", "decayed", "recent", "shootings_weighted")
    out = out.fillna(0, list(counts)).fillna(0.0, list(sums)).withColumns({c: F.round(c, 3) for c in ("decayed", "shootings_weighted")}).withColumn("units", F.round("units", 1))
    out = out.crossJoin(F.broadcast(seasonal_factor(incidents, "day", int(as_of[5:7])))).crossJoin(F.broadcast(trend_guard(incidents, "day", as_of, coverage=0.7)))
    out = out.withColumn("rate", F.round(1000 * ((F.col("decayed") + F.col("shootings_weighted")) / F.col("factor")) / F.greatest("units", F.lit(1.0)), 3))
    ratio = F.when(F.col("usable"), trend(F.col("recent"), F.col("weighted_total") - F.col("recent"))).otherwise(1.0)
    out = median_inverse(out.withColumn("trend_ratio", ratio), "rate", "id")
    return out.select("id", "felonies", "misdemeanors", "violations", "weighted_total", "decayed", "shootings", "shootings_weighted", "units", "rate", "trend_ratio", trend_direction(F.col("trend_ratio")).alias("trend_direction"), "score")


def flood_risk(listings: DataFrame, lots: DataFrame) -> DataFrame:
    """(id, match, firm07, pfirm15, score): 0 if the nearest lot has either flood flag, 100 if not or without a lot; flags are text, blank for none."""
    out = nearest_join(listings.select("id", "lat", "lon"), right_points(lots, "lot_id", "firm07", "pfirm15"), "id", "lot_id", facts=("firm07", "pfirm15"))
    firm07, pfirm15 = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("firm07", "pfirm15"))
    return out.select("id", "match", firm07.alias("firm07"), pfirm15.alias("pfirm15"), F.when((firm07 != "") | (pfirm15 != ""), 0.0).otherwise(100.0).alias("score"))


def rent_stabilized(listings: DataFrame, lots: DataFrame) -> DataFrame:
    """(id, building_year, rent_stabilized, score): built before 1974 with six units or more, by the nearest lot; year and flag are 0 without one."""
    near = nearest_join(listings.select("id", "lat", "lon"), right_points(lots, "lot_id", "yearbuilt", "unitsres"), "id", "lot_id", facts=("yearbuilt", "unitsres"))
    yes = (F.col("yearbuilt") > 0) & (F.col("yearbuilt") < 1974) & (F.col("unitsres") >= 6)
    flag = F.coalesce(yes.cast("int"), F.lit(0))
    return near.select("id", F.coalesce("yearbuilt", F.lit(0)).alias("building_year"), flag.alias("rent_stabilized"), (flag * 100.0).alias("score"))


def unit_amenities(listings: DataFrame, amenities: str = "amenities", premium: dict[str, int] = PREMIUM, standard: dict[str, int] = STANDARD) -> DataFrame:
    """(id, premium, standard, total): keywords found within any of a listing's amenities (an array), each counted once; null
    for listings without amenities. The keyword tables may be the caller's own."""
    found = lambda k: F.exists(amenities, lambda a: F.contains(F.lower(a), F.lit(k))).cast("int")
    some = F.size(amenities) > 0
    count = lambda table: F.when(some, sum((F.coalesce(found(k), F.lit(0)) for k in table), F.lit(0)))
    total = sum((F.coalesce(found(k), F.lit(0)) * w for k, w in {**premium, **standard}.items()), F.lit(0))
    return listings.select("id", count(premium).alias("premium"), count(standard).alias("standard"), F.when(some, total).alias("total"))


def true_cost(price: str = "price", net: str = "net_effective") -> Column:
    return F.when(F.col(net) > 0, F.col(net)).otherwise(F.col(price)).cast("double")


def deal(listings: DataFrame, as_of: str) -> DataFrame:
    """(id, comp_median, comp_set_size, comp_scope, sqft_median, price_per_sqft, tenure_months, tenure_cycles, cut_frac, months_free,
    cut_recency_days, deviation, stabilized_below_median).

    listings: (id, neighborhood, beds, price, net_effective, sqft, status, rent_stabilized, price_history array of (event, date),
    price_delta, price_changed, months_free). The cost is held against the median of active listings of equal neighborhood and
    beds, nulls being equal to each other; three of these are needed. With floor area, and three that have it, price a foot and
    area count too. Tenure moves a tenth of the deviation, a price cut of the last three weeks adds a quarter of itself.
    Medians are aggregated a group and joined back."""
    x = listings.withColumn("cost", true_cost()).withColumn("psf", F.when(F.col("sqft") > 0, F.col("cost") / F.col("sqft")))
    active = x.where((F.upper("status") == "ACTIVE") & F.col("price").isNotNull())
    size = F.when(F.col("sqft") > 0, F.col("sqft"))
    comps = active.groupBy(F.col("neighborhood").alias("c_n"), F.col("beds").alias("c_b")).agg(F.percentile("cost", 0.5).alias("cm"), F.count("cost").alias("n"), F.percentile(size, 0.5).alias("sm"), F.percentile("psf", 0.5).alias("pm"), F.count("psf").alias("ns"))
    j = x.join(comps, x["neighborhood"].eqNullSafe(comps["c_n"]) & x["beds"].eqNullSafe(comps["c_b"])).where("n >= 3 and cm <> 0 and cost is not null")
    j = leverage(tenure_of(j, "price_history"), as_of)
    price = (F.col("cm") - F.col("cost")) / F.col("cm")
    full = (F.col("sqft") > 0) & (F.col("ns") >= 3)
    rel = lambda v, m: F.when(F.col(m) == 0, 0.0).otherwise(v / F.col(m))
    dev = F.when(full, 0.4 * price + 0.3 * rel(F.col("pm") - F.col("psf"), "pm") + 0.3 * rel(F.col("sqft") - F.col("sm"), "sm")).otherwise(price)
    stay = F.greatest(F.lit(-0.5), F.least(F.lit(1.0), (F.col("tenure_months") - 12) / 24))
    dev = F.when(F.col("tenure_months").isNotNull(), 0.9 * dev + 0.1 * stay).otherwise(dev)
    dev = dev + F.when(F.col("cut_recency_days") <= 21, F.coalesce(0.25 * F.col("cut_frac"), F.lit(0.0))).otherwise(0.0)
    out = j.withColumn("deviation", dev)
    below = ((F.col("rent_stabilized") != 0) & (F.col("deviation") > 0.05)).cast("int")
    return out.select(
        "id", F.floor("cm").cast("int").alias("comp_median"), F.col("n").alias("comp_set_size"), F.lit("neighborhood").alias("comp_scope"), F.when(full, F.floor("sm").cast("int")).alias("sqft_median"), F.when(full, F.round("psf", 2)).alias("price_per_sqft"),
        "tenure_months", "tenure_cycles", F.round("cut_frac", 4).alias("cut_frac"), "months_free", "cut_recency_days", F.round("deviation", 4).alias("deviation"), below.alias("stabilized_below_median"),
    )


def tenure_of(df: DataFrame, history: str) -> DataFrame:
    """df with tenure_months and tenure_cycles from an array of (event, date) structs of text.

    Listing days (events that say listed but not delisted; dates as m/d/yy, m/d/Y or ISO) are sorted; a day joins a cluster
    within 90 days of the cluster's first. The gaps between first days, less 30 days and 0 at least, in months of 30.44 days:
    their median, to one decimal. Fewer than two days give no cycle, one cluster gives one and no tenure. A fold over each
    row's own array."""
    e = lambda x: F.lower(F.coalesce(x["event"], F.lit("")))
    day = lambda t: F.coalesce(F.try_to_date(F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), t), "M/d/yy"), F.try_to_date(F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), t), "M/d/yyyy"), F.try_to_date(F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t), "yyyy-M-d"))
    listed = F.filter(history, lambda x: F.contains(e(x), F.lit("listed")) & ~F.contains(e(x), F.lit("delisted")))
    days = F.array_sort(F.filter(F.transform(listed, lambda x: day(x["date"])), lambda d: d.isNotNull()))
    out = df.withColumn("__d", F.coalesce(days, F.expr("cast(array() as array<date>)")))
    firsts = F.aggregate("__d", F.expr("cast(array() as array<date>)"), lambda a, x: F.when((F.size(a) == 0) | (F.datediff(x, F.element_at(a, -1)) > 90), F.concat(a, F.array(x))).otherwise(a))
    out = out.withColumn("__f", firsts)
    out = out.withColumn("__g", F.expr("array_sort(transform(slice(__f, 2, greatest(size(__f) - 1, 0)), (x, i) -> greatest(datediff(x, __f[i]) - 30, 0) / 30.44D))"))
    n = F.size("__g")
    mid = (F.get("__g", F.floor((n - 1) / 2).cast("int")) + F.get("__g", F.floor(n / 2).cast("int"))) / 2
    return out.withColumn("tenure_months", F.when(n > 0, F.round(mid, 1))).withColumn("tenure_cycles", F.when(F.size("__d") < 2, 0).otherwise(F.size("__f"))).drop("__d", "__f", "__g")


def leverage(df: DataFrame, as_of: str) -> DataFrame:
    """df with cut_frac (a price cut's share of the former price, half at most), cut_recency_days and months_free (above 0 only)."""
    delta, price = F.col("price_delta").cast("double"), F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    cut = (delta < 0) & (price > 0)
    frac = F.when(cut & (price - delta > 0), F.least(F.lit(0.5), -delta / (price - delta)))
    recency = F.when(cut, F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.col("price_changed").cast("date"))))
    free = F.round(F.col("months_free").cast("double"), 2)
    return df.withColumn("cut_frac", frac).withColumn("cut_recency_days", F.when(F.col("price_changed").isNotNull(), recency)).withColumn("months_free", F.when(F.col("months_free").cast("double") > 0, free))


def portfolio(lots: DataFrame, filings: DataFrame) -> DataFrame:
    """(lot_id, owner_lots, owner_units, owner_filings): filings are counted per lot, then per owner, then joined back."""
    per_lot = filings.groupBy("lot_id").agg(F.count("*").alias("n"))
    per = lots.join(per_lot, "lot_id", "left").groupBy("ownername").agg(F.count("*").alias("owner_lots"), F.sum("unitsres").alias("owner_units"), F.coalesce(F.sum("n"), F.lit(0)).alias("owner_filings"))
    return lots.select("lot_id", "ownername").join(per, "ownername").select("lot_id", "owner_lots", "owner_units", "owner_filings")
