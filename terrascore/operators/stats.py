"""Aggregates, baselines and normalisation to 0-100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.functions.geo import gauss

from .spatial import at_spots, radius_join


def kernel_units(places: DataFrame, lots: DataFrame, radius_m: float, key: str = "id", floor: float = 25.0) -> DataFrame:
    """(key, units): residential units around each place, weighted by a kernel of sigma = radius / 2; at least ``floor``. Lots of the same coordinates are summed before they are joined."""
    near = radius_join(places, at_spots(lots, F.sum("unitsres").alias("unitsres")).withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"}), radius_m)
    got = near.groupBy(key).agg(F.sum(F.col("unitsres") * gauss(F.col("dist_m"), radius_m / 2)).alias("u"))
    return places.select(key).join(got, key, "left").select(key, F.greatest(F.coalesce("u", F.lit(0.0)), F.lit(floor)).alias("units"))


def capped_sum(pairs: DataFrame, key: str, where: list[str], weight: str, cap: Column) -> DataFrame:
    """(key, total): weights summed for each location, capped there, then summed. Rows of unknown location aren't merged."""
    known = pairs.where(" and ".join(f"{c} is not null" for c in where)).groupBy(key, *where).agg(F.sum(weight).alias("w"), F.first(cap).alias("c")).select(key, F.least("w", "c").alias("w"))
    single = pairs.where(" or ".join(f"{c} is null" for c in where)).select(key, F.least(F.col(weight), cap).alias("w"))
    return known.union(single).groupBy(key).agg(F.sum("w").alias("total"))


def seasonal_factor(rows: DataFrame, day: str, month: int) -> DataFrame:
    """One row: the month's rows over the mean of the months that have any, within 0.25 and 4; 1 for a month without rows, and
    with fewer than 10 months or 1000 rows."""
    months = rows.where(F.col(day).isNotNull()).groupBy(F.month(day).alias("m")).count()
    agg = months.agg(F.count("*").alias("months"), F.sum("count").alias("n"), F.avg("count").alias("mean"), F.sum(F.when(F.col("m") == month, F.col("count"))).alias("own"))
    ratio = F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.coalesce("own", "mean") / F.col("mean")))
    return agg.select(F.when((F.col("months") < 10) | (F.coalesce("n", F.lit(0)) < 1000), 1.0).otherwise(ratio).alias("factor"))


def trend_guard(rows: DataFrame, day: str, as_of: str, lag_days: int | None = None, coverage: float | None = None, window: int = 182) -> DataFrame:
    """One row: whether trends are usable. The newest day must lie at most lag_days back, or cover that share of the window before as_of."""
    lag = F.datediff(F.lit(as_of).cast("date"), F.max(F.col(day).cast("date")))
    fresh = lag <= lag_days if lag_days is not None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (window - lag) / window)) >= coverage
    return rows.agg(F.coalesce(fresh, F.lit(False)).alias("usable"))


def trend(recent: Column, older: Column) -> Column:
    return F.round(F.when(older == 0, F.when(recent > 0, 2.0).otherwise(1.0)).otherwise(recent / older), 3)


def trend_direction(ratio: Column) -> Column:
    return F.when(ratio < 0.85, "improving").when(ratio > 1.15, "worsening").otherwise("stable")


def fail_fraction(weight: Column, failed: Column, least: float = 3.0) -> Column:
    """Aggregate: weighted share of failures, over at least ``least`` of weight."""
    return F.coalesce(F.sum(F.when(failed, weight)), F.lit(0.0)) / F.greatest(F.sum(weight), F.lit(least))


def saturated(parts: dict[str, tuple[float, float]]) -> Column:
    """Sum of weight * sqrt(min(1, x / cap)) over columns: {column: (cap, weight)}."""
    return sum((F.sqrt(F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0)) / cap)) * w for c, (cap, w) in parts.items()), F.lit(0.0))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.when(F.col(value).isNotNull(), F.col(value) * F.col(weight))) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))


#: Values that a group's ranges are told apart by, at most.
PICKS = 256


def ranked(values: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, value, n_eq, n_below, n): counts below each distinct value of a number within its group, from counts per value; no
    window over the rows themselves, none over a whole group either. Null groups are groups.

    A group's distinct values are cut into ranges by a sample of themselves: of those whose hashes share a remainder the one
    of the least hash, so at most PICKS, the same ones whatever the partitions, and about as many values in each
    range however they are spread. Each range is summed up on its own, and the totals of the ranges before it are added."""
    groups = groups or []
    per = values.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n_eq"))
    h = F.xxhash64(F.col(value).cast("double"))
    picked = per.groupBy(*groups, F.pmod(h, F.lit(PICKS)).alias("__h")).agg(F.min_by(value, h).alias("__v"))
    bounds = picked.groupBy(*groups).agg(F.array_sort(F.collect_list("__v")).alias("__bounds"))
    parts = _beside(per, bounds, groups, len(groups) == 0).withColumn("__part", _count(F.col("__bounds"), F.col(value), False)).drop("__bounds")
    totals = parts.groupBy(*groups, "__part").agg(F.sum("n_eq").alias("t"))
    group = Window.partitionBy(*groups)
    before = totals.select(*groups, "__part", F.coalesce(F.sum("t").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("t").over(group).alias("n"))
    own = F.sum("n_eq").over(Window.partitionBy(*groups, "__part").orderBy(value)) - F.col("n_eq")
    both = _beside(parts.withColumn("__own", own), before, [*groups, "__part"], len(groups) == 0)
    return both.select(*groups, value, "n_eq", (F.col("__own") + F.col("__before")).alias("n_below"), "n")


def _beside(left: DataFrame, right: DataFrame, on: list[str], small: bool) -> DataFrame:
    """left with the right side's columns for equal keys, null being equal to null; small: the right side has at most PICKS + 1 rows."""
    names = {c: f"__r_{c}" for c in on}
    other = right.select(*(F.col(c).alias(names[c]) for c in on), *(c for c in right.columns if c not in names))
    test = F.lit(True)
    for c, r in names.items():
        test = test & left[c].eqNullSafe(other[r])
    return left.join(F.broadcast(other) if small else other, test).drop(*names.values())


def at_place(value: str, k: Column) -> Column:
    """Aggregate over ranked()'s rows: the value at place k (from 0) of the sorted values."""
    return F.max(F.when((F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n_eq")), F.col(value)))


def between_places(value: str, share: float) -> Column:
    """Aggregate over ranked()'s rows: the value at a share of the way from the first to the last place, between neighbours by their distance."""
    at = (F.col("n") - 1) * share
    low, high = at_place(value, F.floor(at)), at_place(value, F.ceil(at))
    return low + (high - low) * (F.max("n") - 1) * share - (high - low) * F.floor((F.max("n") - 1) * share)


def median(values: DataFrame, value: str, to: str = "median", groups: list[str] | None = None) -> DataFrame:
    """(groups, median): the median of a column, the mean of the middle two; null without values. From counts per value, never in one buffer."""
    r = ranked(values, value, groups)
    return r.groupBy(*(groups or [])).agg(((at_place(value, F.floor((F.col("n") - 1) / 2)) + at_place(value, F.floor(F.col("n") / 2))) / 2).alias(to))


def freeze(values: DataFrame, value: str, points: int = 1001, least: int = 100) -> DataFrame:
    """(i, q): nearest-rank picks of the sorted values, number min(n - 1, round_half_even(i * (n - 1) / 1000)); fewer than 100 values fail.

    Each distinct value finds the picks that fall on it from its own place in the order; picks are of a fixed number."""
    step = (F.col("n") - 1) / (points - 1)
    if values.where(F.col(value).isNotNull()).limit(least).count() < least:
        raise ValueError(f"a baseline needs {least} values")
    counts = ranked(values, value)
    lo = F.greatest(F.lit(0), F.floor((F.col("n_below") - 1) / step)).cast("long")
    hi = F.least(F.lit(points - 1), F.ceil((F.col("n_below") + F.col("n_eq")) / step)).cast("long")
    picks = counts.withColumn("i", F.explode(F.sequence(lo, hi)))
    at = F.least(F.col("n") - 1, F.bround(F.col("i") * (F.col("n") - 1) / (points - 1)).cast("long"))
    return picks.where((at >= F.col("n_below")) & (at < F.col("n_below") + F.col("n_eq"))).select("i", F.col(value).alias("q"))


def quantiles(values: DataFrame, value: str) -> DataFrame:
    """One row: q, the frozen grid of a column as a sorted array."""
    return freeze(values, value).agg(F.array_sort(F.collect_list("q")).alias("q"))


def baseline_prior(grid: DataFrame) -> DataFrame:
    """One row (mean, median) of a frozen grid q: the average of the picks, and the one in the middle."""
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    return grid.select((total / F.size("q")).alias("mean"), F.get("q", F.floor(F.size("q") / 2).cast("int")).alias("median"))


def _count(quantiles: Column, v: Column, strict: bool) -> Column:
    """How many elements of a sorted array (of fewer than 2048) are below v, or not above it: a binary search."""
    less = lambda q: q < v if strict else q <= v
    return F.aggregate(F.array(*(F.lit(2**k) for k in range(10, -1, -1))), F.lit(0), lambda a, s: F.when(less(F.get(quantiles, a + s - 1)), a + s).otherwise(a))


def percentile_of(quantiles: Column, v: Column) -> Column:
    """Midrank of a value in a frozen grid, without interpolation, to one decimal and at most 100; null stays null."""
    lo, hi = _count(quantiles, v, True), _count(quantiles, v, False)
    n = F.size(quantiles)
    out = F.when(hi == 0, 0.0).when(lo == n, 100.0).otherwise(F.least(F.lit(100.0), F.bround(100 * ((lo + hi) / 2) / (n - 1), 1)))
    return F.when(v.isNotNull(), out)


def baseline_score(quantiles: Column, v: Column, reverse: bool, zero_is_perfect: bool) -> Column:
    pct = percentile_of(quantiles, v)
    out = 100 - pct if reverse else pct
    return F.when(v == 0, 100.0).otherwise(out) if reverse and zero_is_perfect else out


def percentile_scores(values: DataFrame, value: str, reverse: bool = False, zero_is_perfect: bool = False) -> DataFrame:
    """values with score: percentile by tie-averaged rank within the batch; a single value is 50 (100 if zero is perfect and it is zero)."""
    r = ranked(values, value).withColumnRenamed(value, "__v")
    pct = 100 * (F.col("n_below") + (F.col("n_eq") - 1) / 2) / (F.col("n") - 1)
    score = F.when(F.col("n") == 1, 50.0).otherwise(100 - pct if reverse else pct)
    if zero_is_perfect:
        score = F.when(F.col("__v") == 0, 100.0).otherwise(score)
    return values.join(r, values[value] == r["__v"], "left").withColumn("score", score).drop("__v", "n_eq", "n_below", "n")


def median_inverse(values: DataFrame, value: str, cell: str) -> DataFrame:
    """values with score: 0 gives 100, the median of the distinct cells 50, twice the median or more 0; a median of 0 counts as 1."""
    med = median(values.where(F.col(value).isNotNull()).groupBy(cell).agg(F.min(value).alias("v")), "v", "__med")
    m = F.when(F.coalesce("__med", F.lit(0.0)) == 0, 1.0).otherwise(F.col("__med"))
    return values.crossJoin(F.broadcast(med)).withColumn("score", F.greatest(F.lit(0.0), 100 - 50 * F.col(value) / m)).withColumn("score", F.when(F.col(value).isNotNull(), F.col("score"))).drop("__med")


def z_scores(values: DataFrame, value: str) -> DataFrame:
    """values with score: 50 + 25 z within 0 and 100, sample deviation; 50 if there is one value or no spread."""
    stat = values.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    z = 50 + 25 * (F.col(value) - F.col("__m")) / F.col("__s")
    flat = F.col("__s").isNull() | (F.col("__s") == 0)
    return values.crossJoin(F.broadcast(stat)).withColumn("score", F.when(F.col(value).isNull(), None).when(flat, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), z)))).drop("__m", "__s")


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dim, v) of the columns' values that aren't null."""
    return df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("double") for c in columns)))).alias("dim", "v")).where("v is not null")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson's correlation of every pair of columns, over rows that have both; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"{a}/{b}") for a, b in pairs))
    item = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}/{b}`").alias("r"))
    return row.select(F.explode(F.array(*(item(a, b) for a, b in pairs))).alias("x")).select("x.*")


def box_inputs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dim, n, low, q1, median, q3, high) of each column, quartiles between neighbours by their distance; see ranked()."""
    quartiles = {c: between_places("v", p).alias(c) for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    return ranked(_long(df, columns), "v", ["dim"]).groupBy("dim").agg(F.max("n").alias("n"), F.min("v").alias("low"), *quartiles.values(), F.max("v").alias("high"))


def histogram(df: DataFrame, columns: list[str], low: float, high: float, bins: int) -> DataFrame:
    """(dim, bin, n): counts of equal bins from low to high; what lies outside goes to the first or last."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / ((high - low) / bins))))
    return _long(df, columns).groupBy("dim", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def rollup(df: DataFrame, group: str, dims: list[str], price: str = "price", status: str = "status") -> DataFrame:
    """(group, n, mean_price, median_price, active, mean of each dimension)."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(price).alias("mean_price"), F.percentile(price, 0.5).alias("median_price"), F.count_if(F.col(status) == "ACTIVE").alias("active"), *(F.avg(c).alias(f"mean_{c}") for c in dims))


def top(df: DataFrame, metric: str, n: int, tie: str) -> DataFrame:
    """The n rows of the largest metric with place, ties by ``tie``."""
    best = df.orderBy(F.col(metric).desc_nulls_last(), tie).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col(metric).desc_nulls_last(), tie)))
