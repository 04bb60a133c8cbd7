"""Group scores, composites, feeds, peers and comparables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.functions.geo import cosine, half_even
from terrascore.sources.store import cut

from .spatial import nearest_k
from .stats import at_place, percentile_of, quantiles, ranked


#: The groups of dimensions that a place's composite is made of, and the dimensions whose lowest scores cap it.
PLACE_GROUPS = {
    "value": ["deal", "unit_amenities"],
    "access": ["transit"],
    "neighborhood": ["convenience", "parks", "greenery", "schools", "air_quality", "noise", "road_exposure"],
    "safety": ["crime", "street_danger", "shelter"],
    "building": ["building_violations", "management", "pest", "bedbug"],
}
PLACE_DIMS = [d for dims in PLACE_GROUPS.values() for d in dims]
DEALBREAKERS = ["bedbug", "building_violations", "crime", "management", "pest"]


def _folded(pairs: Column) -> Column:
    """The weighted mean of an array of (v, w) structs, those of a null v left out; null if none is left. One fold, so that
    the columns appear once in the plan."""
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
    add = lambda a, x: F.when(x["v"].isNull(), a).otherwise(F.struct((a["v"] + x["v"] * x["w"]).alias("v"), (a["w"] + x["w"]).alias("w")))
    return F.aggregate(pairs, start, add, lambda a: F.when(a["w"] != 0, a["v"] / a["w"]))


def mean_of(columns: list[str]) -> Column:
    """Mean of the columns that aren't null; null if all are."""
    return _folded(F.array(*(F.struct(F.col(c).cast("double").alias("v"), F.lit(1.0).alias("w")) for c in columns))) if columns else F.lit(None).cast("double")


def group_scores(df: DataFrame, groups: dict[str, list[str]], exclude: frozenset[str] = frozenset()) -> DataFrame:
    return df.withColumns({g: mean_of([c for c in cols if c not in exclude]) for g, cols in groups.items()})


def coverage(df: DataFrame, dims: list[str]) -> DataFrame:
    """df with coverage (share of scored dimensions) and coverage_label (null from 3/4 on, limited from 1/4 on, else very_limited)."""
    share = sum((F.col(c).isNotNull().cast("int") for c in dims), F.lit(0)) / len(dims)
    return df.withColumn("coverage", share).withColumn("coverage_label", F.when(share >= 0.75, None).when(share >= 0.25, "limited").otherwise("very_limited"))


def composite(df: DataFrame, groups: list[str], boosts: tuple[str, ...] = (), to: str = "composite") -> DataFrame:
    """df with the mean of the groups that aren't null, up to two boosted groups counting twice, to one decimal; 0 if all are null."""
    weighted = F.array(*(F.struct(F.col(g).cast("double").alias("v"), F.lit(2.0 if g in boosts[:2] else 1.0).alias("w")) for g in groups))
    return df.withColumn(to, F.rint(10 * F.coalesce(_folded(weighted), F.lit(0.0))) / 10)


def dealbreaker(df: DataFrame, score: str, dims: list[str], ignore: frozenset[str] = frozenset(), at: float = 12.0, cap: float = 55.0) -> DataFrame:
    """df with ``score`` held to the cap if a dimension is at the threshold or below, and the list of those."""
    hits = F.array_compact(F.array(*(F.when(F.col(d) <= at, F.lit(d)) for d in dims if d not in ignore)))
    return df.withColumn("dealbreakers", hits).withColumn(score, F.when(F.size("dealbreakers") > 0, F.least(F.col(score), F.lit(cap))).otherwise(F.col(score)))


def sort_column(sort: str, dims: list[str], groups: dict[str, list[str]], exclude: frozenset[str] = frozenset()) -> Column:
    """What a feed is sorted by: the composite, price, a dimension, or a group's mean without the dimensions that are excluded.

    An unknown name sorts by the composite; an excluded dimension by its group."""
    if sort in exclude:
        sort = next((g for g, cols in groups.items() if sort in cols), "composite")
    if sort in groups:
        return mean_of([c for c in groups[sort] if c not in exclude])
    return F.col(sort if sort in (*dims, "price") else "composite")


def page(df: DataFrame, sort: Column, number: int, size: int, tie: str = "id") -> DataFrame:
    """One page of rows, descending, nulls last; ties by coverage (if there is such a column), then by ``tie``."""
    order = [sort.desc_nulls_last()] + ([F.col("coverage").desc_nulls_last()] if "coverage" in df.columns else [])
    return df.orderBy(*order, tie).offset((number - 1) * size).limit(size)


def feed(
    df: DataFrame, beds: list[int] | None = None, price: tuple[float | None, float | None] = (None, None), neighborhoods: list[str] | None = None, stabilized: bool | None = None, min_composite: float | None = None,
    min_sqft: float | None = None, available_before: str | None = None, amenities: list[str] | None = None, min_coverage: float | None = None, dims: list[str] | None = None,
) -> DataFrame:
    """The active rows with coordinates that pass every filter given. A filter on a column leaves out rows where it is null.

    amenities: all of them must be in the array of that name; min_coverage: at least ceil(share * dims) scored dimensions."""
    keep = (F.upper("status") == "ACTIVE") & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    tests = [
        F.col("beds").isin(*beds) if beds else None,
        F.col("price") >= price[0] if price[0] is not None else None,
        F.col("price") <= price[1] if price[1] is not None else None,
        F.lower("neighborhood").isin(*(n.strip().lower() for n in neighborhoods)) if neighborhoods else None,
        F.col("rent_stabilized") == int(stabilized) if stabilized is not None else None,
        F.col("composite") >= min_composite if min_composite is not None else None,
        F.col("sqft") >= min_sqft if min_sqft is not None else None,
        F.col("available_at") <= F.lit(available_before).cast("date") if available_before else None,
        *(F.array_contains("amenities", a.strip()) for a in amenities or []),
        sum((F.col(c).isNotNull().cast("int") for c in dims), F.lit(0)) >= math.ceil(min_coverage * len(dims)) if min_coverage is not None and dims else None,
    ]
    for t in tests:
        keep = keep & t if t is not None else keep
    return df.where(keep)


def composite_percentile(df: DataFrame, score: str = "composite", status: str = "status", to: str = "composite_percentile") -> DataFrame:
    """df with the midrank of its composite among the composites of active rows, by a frozen grid of these."""
    grid = quantiles(df.where(F.upper(status) == "ACTIVE"), score)
    return df.crossJoin(F.broadcast(grid)).withColumn(to, percentile_of(F.col("q"), F.col(score))).drop("q")


def place_composites(scores: DataFrame, exclude: frozenset[str] = frozenset({"schools"}), boosts: tuple[str, ...] = (), key: str = "id") -> DataFrame:
    """(key, the dimensions, the groups, coverage, coverage_label, raw_composite, composite, dealbreakers) of active places.

    scores: (key, <dimension>_score for each of PLACE_DIMS), active places only. Scores are taken to one decimal; groups are means
    without the excluded dimensions; the raw composite is ranked among all, and its percentile held to 55 where a
    dealbreaker stands at 12 or below."""
    dims = [d for d in PLACE_DIMS if d not in exclude]
    df = scores.select(key, *(half_even(F.col(f"{d}_score").cast("double"), 1).alias(d) for d in PLACE_DIMS))
    df = coverage(composite(group_scores(df, PLACE_GROUPS, exclude), list(PLACE_GROUPS), boosts, "raw_composite"), dims)
    ranked = df.crossJoin(F.broadcast(quantiles(df.select("raw_composite"), "raw_composite"))).withColumn("composite", percentile_of(F.col("q"), F.col("raw_composite"))).drop("q")
    return dealbreaker(ranked, "composite", DEALBREAKERS)


def peer_context(df: DataFrame, group: str, dims: list[str], key: str = "id", least: int = 20) -> DataFrame:
    """(key, dim, percentile, median, n): midrank, a whole number, among the group's rows with that dimension, for groups of at least 20."""
    long_ = df.select(key, group, F.explode(F.map_from_arrays(F.array(*map(F.lit, dims)), F.array(*map(F.col, dims)))).alias("dim", "v")).where("v is not null")
    per = ranked(long_.select(group, "dim", "v"), "v", [group, "dim"])
    n = F.col("n")
    med = per.groupBy(group, "dim").agg(((at_place("v", F.floor((n - 1) / 2)) + at_place("v", F.floor(n / 2))) / 2).alias("median"))
    pct = F.rint(100 * (F.col("n_below") + F.col("n_eq") / 2) / n).cast("int")  # halves to the even number
    return long_.join(per.hint("merge"), [group, "dim", "v"]).join(med, [group, "dim"]).where(n >= least).select(key, "dim", pct.alias("percentile"), half_even(F.col("median"), 1).alias("median"), "n")


def candidates(df: DataFrame, key: str = "id", most: int = 50, few: int = 12) -> DataFrame:
    """(key, other, rank, scope): active rows of equal beds and neighborhood within half the price, nearest by |dlat| + |dlon|;
    with fewer than 12 of these, those of the borough within 0.03 degrees take their place; under 3 gives none. See nearest_k."""
    a = df.where("status = 'ACTIVE'").select(key, "beds", "neighborhood", "borough", "price", "lat", "lon")
    b = a.select(F.col(key).alias("other"), "beds", "neighborhood", "borough", F.col("price").alias("o_price"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = (F.col(key) != F.col("other")) & F.col("o_price").between(F.col("price") * 0.5, F.col("price") * 1.5)
    hood = nearest_k(a.drop("borough"), b.drop("borough"), key, "other", most, ["beds", "neighborhood"], near).withColumn("scope", F.lit("neighborhood"))
    hood = cut(hood, "candidates")  # read three times
    enough = hood.where(F.col("n") >= few).select(key).distinct()
    left = a.drop("neighborhood").join(enough, key, "left_anti")
    wide = nearest_k(left, b.drop("neighborhood"), key, "other", most, ["beds", "borough"], near, 0.03).withColumn("scope", F.lit("borough"))
    return hood.join(enough, key, "left_semi").unionByName(wide).where("n >= 3").drop("n")


def similar(pairs: DataFrame, key: str = "id", k: int = 5) -> DataFrame:
    """The k best candidates by cosine / ((1 + 3 km) (1 + 2 price ratio)); pairs: (key, other, a, b arrays, km, price_ratio)."""
    score = cosine(F.col("a"), F.col("b")) / ((1 + 3 * F.col("km")) * (1 + 2 * F.col("price_ratio")))
    r = pairs.withColumn("score", score)
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k).select(key, "other", "rank", "score")


def also_consider(pairs: DataFrame, groups: list[str], key: str = "id", least: float = 0.85) -> DataFrame:
    """(key, group, other): for each group in order, a candidate that is better there, alike in the other groups (cosine of at
    least 0.85) and nearest by km + 3 * price ratio, that no group before it has taken.

    pairs: (key, other, km, price_ratio, a and b: arrays of the group scores in order). A key's candidates are few (see
    candidates()); a fold over the groups takes them one by one."""
    item = F.struct((F.col("km") + 3 * F.col("price_ratio")).alias("cost"), F.col("other").alias("other"), F.col("b").alias("b"))
    per = pairs.groupBy(key).agg(F.first("a").alias("a"), F.array_sort(F.collect_list(item)).alias("c"))
    other_type = pairs.schema["other"].dataType.simpleString()
    empty = F.expr(f"cast(array() as array<{other_type}>)")
    for g, name in enumerate(groups):  # each pass is used up before the next one rebinds its names
        rest = [i for i in range(len(groups)) if i != g]
        pick = lambda v: F.array(*(F.get(v, F.lit(i)) for i in rest))
        own = lambda v: F.coalesce(F.nullif(F.get(v, F.lit(g)), F.lit(0.0)), F.lit(50.0))
        fits = lambda x: (own(x["b"]) > own(F.col("a"))) & (cosine(pick(F.col("a")), pick(x["b"])) >= least)
        taken = F.array_compact(F.array(*(F.col(f"__{n}") for n in groups[:g]))) if g else empty
        found = F.get(F.filter("c", lambda x: fits(x) & F.coalesce(~F.array_contains(taken, x["other"]), F.lit(True))), F.lit(0))
        per = per.withColumn(f"__{name}", found["other"])
    return per.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*(F.col(f"__{n}") for n in groups)))).alias("group", "other")).where("other is not null")


def compare(df: DataFrame, columns: list[str], ids: list, key: str = "id") -> DataFrame:
    """(key, column, value, rank, vs_mean, is_winner, flag) of the rows chosen: ranks by each column, ties by key, the winner, and
    ``best`` or ``lowest`` for the first or last when it differs from the mean by more than 5. Only the chosen rows are compared."""
    few = df.where(F.col(key).isin(*ids))
    long_ = few.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*map(F.col, columns)))).alias("column", "value")).where("value is not null")
    w = Window.partitionBy("column")
    r = long_.withColumn("rank", F.row_number().over(w.orderBy(F.desc("value"), key))).withColumn("vs_mean", F.col("value") - F.avg("value").over(w)).withColumn("n", F.count("*").over(w))
    flag = F.when((F.col("rank") == 1) & (F.col("vs_mean") > 5), "best").when((F.col("rank") == F.col("n")) & (F.col("vs_mean") < -5), "lowest")
    return r.withColumn("is_winner", F.col("rank") == 1).withColumn("flag", flag).drop("n")


def strengths(compared: DataFrame, key: str = "id") -> DataFrame:
    """(key, strengths, weaknesses): sorted names of the columns that a compared row is best or lowest in."""
    names = lambda f: F.array_sort(F.collect_set(F.when(F.col("flag") == f, F.col("column"))))
    return compared.groupBy(key).agg(names("best").alias("strengths"), names("lowest").alias("weaknesses"))


def component_map(df: DataFrame, dims: dict[str, list[str]], key: str = "id") -> DataFrame:
    """(key, dim, components): for each dimension a map of its component columns that aren't null, as text."""
    one = lambda cols: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*(F.col(c).cast("string") for c in cols))), lambda _, v: v.isNotNull())
    return df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, dims)), F.array(*map(one, dims.values())))).alias("dim", "components"))
