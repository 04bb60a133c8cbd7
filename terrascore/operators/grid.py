"""Grid layers and validation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import at_place, ranked

#: The cell's height and width in degrees.
STEP_LAT, STEP_LON = 0.0036, 0.0048


def anchors(lots: DataFrame, least_units: int = 10, top: int = 3) -> DataFrame:
    """(r, c, lot_id, units, place): the top lots by (units, lat, lon) of each cell that has enough units."""
    cell = lots.where("unitsres >= 1").withColumn("r", F.floor(F.col("lat") / STEP_LAT)).withColumn("c", F.floor(F.col("lon") / STEP_LON))
    w = Window.partitionBy("r", "c")
    out = cell.withColumn("total", F.sum("unitsres").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("unitsres"), F.desc("lat"), F.desc("lon"), "lot_id")))
    return out.where((F.col("total") >= least_units) & (F.col("place") <= top)).select("r", "c", "lot_id", F.col("unitsres").alias("units"), "place")


def cell_values(anchor_scores: DataFrame) -> DataFrame:
    """(r, c, value): units-weighted mean of the anchors that have a score."""
    s = anchor_scores.where("score is not null")
    return s.groupBy("r", "c").agg((F.sum(F.col("score") * F.col("units")) / F.sum("units")).alias("value"))


def write_layer(cells: DataFrame, path: str, name: str) -> None:
    """Write a layer of a grid as a long table (r, c, value) under path/layer=name; a layer that is there is replaced."""
    cells.select("r", "c", "value").write.mode("overwrite").parquet(f"{path}/layer={name}")


def layer_bounds(cells: DataFrame) -> DataFrame:
    """One row: the least and largest row and column of a layer, its numbers of rows and columns, its steps, and how many cells have a value."""
    lo, hi = (lambda c: F.min(c)), (lambda c: F.max(c))
    return cells.agg(lo("r").alias("r_min"), hi("r").alias("r_max"), lo("c").alias("c_min"), hi("c").alias("c_max"), (hi("r") - lo("r") + 1).alias("n_rows"), (hi("c") - lo("c") + 1).alias("n_cols"), F.lit(STEP_LAT).alias("lat_step"), F.lit(STEP_LON).alias("lon_step"), F.count("value").alias("filled"))


def green_blend(a: Column, b: Column) -> Column:
    """0.65 of the larger and 0.35 of the smaller of two scores; with one missing, the other."""
    return F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(0.65 * F.greatest(a, b) + 0.35 * F.least(a, b))


def sample_grid(points: DataFrame, cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """(id, value) of points (id, row, col) in continuous grid coordinates: bilinear between the four nodes around.

    Beyond half a cell outside there is no value; at the edges nodes repeat; with some of the four missing, the mean of the
    others. cells: (r, c, value). Each point meets its at most four nodes by an equi-join."""
    inside = (F.col("row") >= -0.5) & (F.col("row") <= rows - 0.5) & (F.col("col") >= -0.5) & (F.col("col") <= cols - 0.5)
    r0, c0 = F.floor("row"), F.floor("col")
    tr, tc = F.col("row") - r0, F.col("col") - c0
    node = lambda r, c, w: F.struct(F.least(F.greatest(r, F.lit(0)), F.lit(rows - 1)).alias("r"), F.least(F.greatest(c, F.lit(0)), F.lit(cols - 1)).alias("c"), w.alias("w"))
    corners = F.array(node(r0, c0, (1 - tr) * (1 - tc)), node(r0, c0 + 1, (1 - tr) * tc), node(r0 + 1, c0, tr * (1 - tc)), node(r0 + 1, c0 + 1, tr * tc))
    at = points.where(inside).select("id", F.explode(corners).alias("x")).select("id", "x.*")
    got = at.join(cells.where("value is not null"), ["r", "c"]).groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("w")).alias("b"), F.avg("value").alias("m"))
    return points.select("id").join(got, "id", "left").select("id", F.when(F.col("n") == 4, F.col("b")).otherwise(F.col("m")).alias("value"))


def view_range(cells: DataFrame, boxes: DataFrame, least: int = 4, tile: int = 64) -> DataFrame:
    """(box, lo, hi): the values at places floor(0.05 (n - 1)) and ceil(0.95 (n - 1)) of the cells in each box (box, r_min, r_max, c_min,
    c_max); boxes of fewer than four values, or of no spread, have none. Boxes meet cells by the tiles that they reach over."""
    tiles = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / tile), F.floor(F.col(high) / tile)))
    b = boxes.where("r_min <= r_max and c_min <= c_max").withColumn("__x", tiles("r_min", "r_max")).withColumn("__y", tiles("c_min", "c_max"))
    at = cells.where("value is not null").withColumns({"__x": F.floor(F.col("r") / tile), "__y": F.floor(F.col("c") / tile)})
    inside = at.join(b, ["__x", "__y"]).where(F.col("r").between(F.col("r_min"), F.col("r_max")) & F.col("c").between(F.col("c_min"), F.col("c_max")))
    picks = [at_place("value", k((F.col("n") - 1) * p)).alias(to) for k, p, to in ((F.floor, 0.05, "lo"), (F.ceil, 0.95, "hi"))]
    out = ranked(inside.select("box", "value"), "value", ["box"]).groupBy("box").agg(F.max("n").alias("n"), *picks)
    return out.where((F.col("n") >= least) & (F.col("hi") - F.col("lo") >= 1e-6)).select("box", "lo", "hi")


def gates(stats: DataFrame, exempt: tuple[str, ...] = ("air_quality",), composite: str = "composite") -> DataFrame:
    """spread()'s rows with passes: deviation of 12, 35 between p5 and p95, and at most 0.45 in the middle; exempt dimensions always pass, a composite needs 70 and 20."""
    usual = (F.col("sd") >= 12) & (F.col("p95") - F.col("p5") >= 35) & (F.col("mid_share") <= 0.45)
    top = (F.col("p95") - F.col("p5") >= 70) & (F.col("sd") >= 20)
    return stats.withColumn("passes", F.when(F.col("dim").isin(*exempt), True).when(F.col("dim") == composite, top).otherwise(usual))


def ground_truth(probes: DataFrame, scores: DataFrame, margin: float = 5.0) -> DataFrame:
    """(dim, higher, lower, score_higher, score_lower, margin, passes) of pairs (dim, higher, lower) of places: the first must win by more than five points. scores: (id, dim, score)."""
    side = lambda n: scores.select("dim", F.col("id").alias(n), F.col("score").alias(f"score_{n}"))
    j = probes.join(side("higher"), ["dim", "higher"], "left").join(side("lower"), ["dim", "lower"], "left")
    gap = F.col("score_higher") - F.col("score_lower")
    return j.withColumn("margin", F.round(gap, 1)).withColumn("passes", F.coalesce(gap > margin, F.lit(False)))


def admin_filter(df: DataFrame, ranges: dict[str, tuple[float, float]], binary: dict[str, bool] | None = None) -> DataFrame:
    """Rows whose scores lie in the ranges or are null; binary scores must be 100 (True), or 0 or null (False)."""
    keep = F.lit(True)
    for c, (lo, hi) in ranges.items():
        keep = keep & (F.col(c).between(lo, hi) | F.col(c).isNull())
    for c, yes in (binary or {}).items():
        keep = keep & (F.coalesce(F.col(c) == 100, F.lit(False)) if yes else (F.coalesce(F.col(c), F.lit(0.0)) == 0))
    return df.where(keep)


def spread(df: DataFrame, dims: list[str], least: int = 20) -> DataFrame:
    """(dim, n, mean, sd, p5, p95, mid_share, ok): population deviation, values at place min(n - 1, int(p n)), share within 45 and 55."""
    long_ = df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, dims)), F.array(*map(F.col, dims)))).alias("dim", "v")).where("v is not null")
    stat = long_.groupBy("dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.avg(F.col("v").between(45, 55).cast("double")).alias("mid_share"))
    pick = lambda p: at_place("v", F.least(F.col("n") - 1, F.floor(F.col("n") * p)))
    q = ranked(long_, "v", ["dim"]).groupBy("dim").agg(F.max("n").alias("n"), pick(0.05).alias("p5"), pick(0.95).alias("p95"))
    ok = (F.col("sd") >= 12) & (F.col("p95") - F.col("p5") >= 35) & (F.col("mid_share") <= 0.45)
    return stat.join(q, "dim").where(F.col("n") >= least).select("dim", "n", "mean", "sd", "mid_share", "p5", "p95").withColumn("ok", ok)


def drift(stored: DataFrame, fresh: DataFrame, key: str, column: str, tolerance: float = 0.10) -> DataFrame:
    """One row: n, drifted (relative difference above tolerance), null mismatches, stale (drifted > max(1, n // 5))."""
    j = stored.select(key, F.col(column).alias("a")).join(fresh.select(key, F.col(column).alias("b")), key)
    off = F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs(F.col("a")), F.lit(1e-9)) > tolerance
    out = j.agg(F.count("*").alias("n"), F.count_if(off).alias("drifted"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("null_mismatch"))
    return out.withColumn("stale", F.col("drifted") > F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
