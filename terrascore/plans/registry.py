"""The table of registered queries, and what all query modules share. It imports no other query module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrascore.functions import geo
from terrascore.operators import rank, scorers
from terrascore.sources.views import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIMS = [f"d{k}" for k in range(10)]
GROUPS = {"g_value": ["d0", "d1"], "g_access": ["d2", "d3"], "g_safety": ["d4", "d5"], "g_building": ["d6", "d7"], "g_nature": ["d8", "d9"]}
#: Haversine in SQL, with the same constants.
HAV = "2 * 6371008.8 * asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0)))".format
HALF = geo.half_width


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def near_sql(left: str, right: str, radius: float) -> str:
    """Join condition of a circle query between aliases."""
    h = repr(HALF(radius))
    return f"abs({left}.lat - {right}.lat) <= {h} AND abs({left}.lon - {right}.lon) <= {h} AND {HAV(a=f'{left}.lat', b=f'{left}.lon', c=f'{right}.lat', d=f'{right}.lon')} <= {radius}"


def pts(df: DataFrame, *cols: str) -> DataFrame:
    return scorers.right_points(df, *cols)


G_SQL = ", ".join(f"(coalesce({a}, 0) + coalesce({b}, 0)) / nullif(CAST({a} IS NOT NULL AS INT) + CAST({b} IS NOT NULL AS INT), 0) AS {g}" for g, (a, b) in GROUPS.items())
GROUPED = f"g AS (SELECT *, {G_SQL} FROM scores)"
COMPOSITE = "c AS (SELECT *, round_even(10 * coalesce((" + " + ".join(f"coalesce({g}, 0) * {2 if g == 'g_safety' else 1}" for g in GROUPS) + ") / nullif(" + " + ".join(f"CASE WHEN {g} IS NOT NULL THEN {2 if g == 'g_safety' else 1} ELSE 0 END" for g in GROUPS) + ", 0), 0), 0) / 10 AS composite FROM g)"


def composed(spark: SparkSession, d: str) -> DataFrame:
    return rank.composite(rank.group_scores(view(spark, d, "scores"), GROUPS), list(GROUPS), boosts=("g_safety",))


#: The nearest lot of each listing within the box.
NEAREST = f"p AS (SELECT l.id, t.lot_id, {HAV(a='l.lat', b='l.lon', c='t.lat', d='t.lon')} AS m FROM listings l JOIN lots t ON abs(l.lat - t.lat) <= 0.0015 AND abs(l.lon - t.lon) <= 0.0015), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, lot_id) AS n FROM p)"
