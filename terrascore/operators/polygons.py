"""Points and polygons by an index of edges: every edge lies in the grid cells that it passes, and points meet only edges of
their own cell. No join is on a polygon's id alone, so a polygon of any number of edges is spread over its cells.

Whether a point is inside follows from the parity at its cell's lower right corner, which is carried along the row of cells
as a running count, and from the edges between that corner and the point: up the cell's right side, then left to the point.
Rows of cells lie a little off round coordinates (ORIGIN), so that no corner meets a vertex. On a border the rule is that of
a ray to the right at the point's latitude: an edge counts if its ends lie on both sides of the latitude (an end at
the latitude is below it) and it crosses to the right of the point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a cell in degrees, and where the grid begins.
CELL, ORIGIN = 0.001, 1.23456789e-7


def cell_of(v: Column, side: float = CELL) -> Column:
    return F.floor((v - ORIGIN) / side)


def border(cell: Column, side: float = CELL) -> Column:
    """The lower or left side of a cell."""
    return cell * side + ORIGIN


def cross_lon(lat: Column) -> Column:
    """Where an edge (lat1, lon1, lat2, lon2) is at a latitude."""
    return (F.col("lon2") - F.col("lon1")) * (lat - F.col("lat1")) / (F.col("lat2") - F.col("lat1")) + F.col("lon1")


def edge_cells(edges: DataFrame, poly: str, side: float = CELL) -> DataFrame:
    """edges with x and y, a row for each cell that an edge passes: column by column, the cells between where it enters and leaves."""
    e = edges.select(poly, "lat1", "lon1", "lat2", "lon2").where("lat1 is not null and lon1 is not null and lat2 is not null and lon2 is not null")
    low, high = F.least("lon1", "lon2"), F.greatest("lon1", "lon2")
    e = e.withColumn("x", F.explode(F.sequence(cell_of(low, side), cell_of(high, side))))
    # the part of the edge within the column; a hair more on both sides, lest rounding miss a cell
    span = F.col("lon2") - F.col("lon1")
    at = lambda lon: F.when(span == 0, None).otherwise(F.col("lat1") + (F.col("lat2") - F.col("lat1")) * (lon - F.col("lon1")) / span)
    left, right = at(F.greatest(low, border(F.col("x"), side))), at(F.least(high, border(F.col("x") + 1, side)))
    least, most = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    bottom = F.greatest(least, F.coalesce(F.least(left, right), least)) - 1e-9
    top = F.least(most, F.coalesce(F.greatest(left, right), most)) + 1e-9
    return e.withColumn("y", F.explode(F.sequence(cell_of(bottom, side), cell_of(top, side))))


def crossings(edges: DataFrame, poly: str, side: float = CELL) -> DataFrame:
    """(poly, y, x, n): how many edges cross the bottom line of row y between the left side of cell x (not on it) and its right side."""
    e = edges.select(poly, "lat1", "lon1", "lat2", "lon2").where("lat1 <> lat2")
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    e = e.withColumn("y", F.explode(F.sequence(cell_of(low, side), cell_of(high, side)))).withColumn("__l", border(F.col("y"), side))
    e = e.where((F.col("lat1") > F.col("__l")) != (F.col("lat2") > F.col("__l")))
    return e.groupBy(poly, "y", (F.ceil((cross_lon(F.col("__l")) - ORIGIN) / side) - 1).alias("x")).agg(F.count("*").alias("n"))


def corners(cells: DataFrame, edges: DataFrame, poly: str, side: float = CELL) -> DataFrame:
    """(poly, x, y, corner) of cells (poly, x, y): crossings of the row's bottom line to the right of the cell, a running sum along the row."""
    asked = cells.select(poly, "y", "x", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    rows = asked.unionByName(crossings(edges, poly, side).withColumn("asked", F.lit(False)))
    # asked cells come before what crosses in the cell itself
    w = Window.partitionBy(poly, "y").orderBy(F.desc("x"), F.desc("asked")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("corner", F.sum("n").over(w)).where("asked").select(poly, "x", "y", "corner")


def between(lat: Column, lon: Column, side: float = CELL) -> Column:
    """Whether an edge of the cell (x, y) lies between the cell's lower right corner and the point: 0, 1 or 2 times."""
    right, bottom = border(F.col("x") + 1, side), border(F.col("y"), side)
    at = F.col("lat1") + (F.col("lat2") - F.col("lat1")) * (right - F.col("lon1")) / (F.col("lon2") - F.col("lon1"))
    up = F.when((F.col("lon1") > right) != (F.col("lon2") > right), ((at > bottom) & (at <= lat)).cast("int")).otherwise(0)
    cross = cross_lon(lat)
    along = F.when((F.col("lat1") > lat) != (F.col("lat2") > lat), ((cross > lon) & (cross <= right)).cast("int")).otherwise(0)
    return up + along


def cover(edges: DataFrame, poly: str, side: float = CELL) -> DataFrame:
    """(poly, x, y, corner): the cells of polygons. Cells with edges have their corner's count; those without, all inside, have null."""
    touched = edge_cells(edges, poly, side).select(poly, "x", "y").distinct()
    held = corners(touched, edges, poly, side)
    gap = F.lead("x").over(Window.partitionBy(poly, "y").orderBy("x"))
    # no edge lies between two neighbours of a row, so what holds at the corner holds for all cells between
    inner = held.withColumn("__to", gap).where("corner % 2 = 1 and __to > x + 1").withColumn("x", F.explode(F.sequence(F.col("x") + 1, F.col("__to") - 1)))
    return held.unionByName(inner.select(poly, "x", "y", F.lit(None).cast("long").alias("corner")))


def dots_inside(dots: DataFrame, polygons: DataFrame, edges: DataFrame, delta: float, poly: str = "park_id", side: float = CELL / 4) -> DataFrame:
    """(id, i) of dots (id, i, lat, lon: their place's; plat, plon: their own) that lie in a polygon whose centre lies within delta of the place.

    A dot meets the polygons of its own cell; where the cell is all inside that settles it, elsewhere the cell's edges do."""
    cells = cover(edges, poly, side).join(polygons.select(poly, F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), poly)
    at = dots.withColumns({"x": cell_of(F.col("plon"), side), "y": cell_of(F.col("plat"), side)})
    near = (F.abs(F.col("lat") - F.col("r_lat")) <= delta) & (F.abs(F.col("lon") - F.col("r_lon")) <= delta)
    # one cell that is all inside settles a dot: the others of its cell aren't listed, and what borders do doesn't matter
    whole = cells.where("corner is null").select(F.col("x").alias("wx"), F.col("y").alias("wy"), "r_lat", "r_lon").distinct().hint("merge")
    held = (F.col("x") == F.col("wx")) & (F.col("y") == F.col("wy")) & near
    sure = at.join(whole, held, "left_semi").select("id", "i")
    open_ = at.join(whole, held, "left_anti").join(cells.where("corner is not null").hint("merge"), ["x", "y"]).where(near).select("id", "i", poly, "x", "y", "plat", "plon", "corner")
    tested = open_.join(edge_cells(edges, poly, side).hint("merge"), [poly, "x", "y"]).groupBy("id", "i", poly).agg((F.first("corner") + F.sum(between(F.col("plat"), F.col("plon"), side))).alias("n"))
    return sure.unionByName(tested.where("n % 2 = 1").select("id", "i")).distinct()
