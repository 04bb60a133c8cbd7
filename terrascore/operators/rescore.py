"""Scoring again after a change: only places that the change can reach are computed, the rest is taken from the last run.

A change is what differs between two states of the listings, and for each table the places (lat, lon) of rows that came,
went, moved or changed. A scorer says in ``reach`` how far, in metres, a row of each of its tables matters; a change of a
table that isn't named there, such as one that shifts a season's factor for everyone, runs the scorer over all places.
What compares places with each other (percentiles, medians) isn't part of a scorer's metric: scores are made from the
merged metrics, so they are those of a full run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.functions.geo import geohash, half_width
from terrascore.sources.store import cut

from .engine import Context, Scorer, active, cells, order, scored


@dataclass
class Rescored:
    """Results as run() gives them; the number of places computed for each scorer; scorers that ran over all places."""

    results: dict[str, DataFrame]
    computed: dict[str, int]
    full: list[str]


def within_reach(places: DataFrame, changed: DataFrame, reach_m: float) -> DataFrame:
    """(id) of places (id, lat, lon) in the cell of a changed row (lat, lon) or one beside it, cells being as wide as the reach.

    A semi-join on cells: changed rows are cut down to distinct cells before they are joined."""
    side = half_width(reach_m)
    cell = lambda c: F.floor(F.col(c) / side)
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    hit = changed.where("lat is not null and lon is not null").select(cell("lat").alias("__x"), cell("lon").alias("__y")).distinct()
    hit = hit.select(around("__x"), "__y").select("__x", around("__y")).distinct()
    return places.select("id", cell("lat").alias("__x"), cell("lon").alias("__y")).join(hit, ["__x", "__y"], "left_semi").select("id")


def _hashed(df: DataFrame) -> DataFrame:
    """(id, __h) with a hash of each whole row."""
    return df.select("id", F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).alias("__h"))


def rescore(
    before: DataFrame, listings: DataFrame, tables: dict[str, DataFrame], changed: dict[str, DataFrame], as_of: str, previous: dict[str, DataFrame], names: list[str] | None = None, baselines: dict[str, DataFrame] | None = None
) -> Rescored:
    """What run() would give for listings and tables now, from its results (previous) for the listings before and the tables as they were.

    changed: {table: (lat, lon)}; tables that aren't named are as they were. The day is that of the earlier run. A scorer without a
    previous result, or that reads one that was computed anew, runs over all places."""
    baselines = baselines or {}
    todo, old = cut(active(listings), "rescore"), cut(active(before), "rescore")
    tag = lambda df: df.select("id", geohash(F.col("lat"), F.col("lon"), 8).alias("__cell"))
    tagged, tagged_old = tag(todo), tag(old)
    grid = cut(cells(todo), "rescore")
    moved = {True: grid.join(cells(old), ["id", "lat", "lon"], "left_anti").select("id"), False: _hashed(todo).join(_hashed(old), ["id", "__h"], "left_anti").select("id")}
    results: dict[str, DataFrame] = {}
    computed: dict[str, int] = {}
    full: list[str] = []

    def compute(s: Scorer, places: DataFrame) -> DataFrame:
        return s.compute(Context(places, todo, {n: tables[n] for n in (*s.needs, *s.uses) if n in tables}, as_of, results, baselines))

    for s in order(names):
        if not all(n in tables for n in s.needs):
            continue
        places = grid if s.by_cell else todo
        touched = {n for n in (*s.needs, *s.uses) if n in changed}
        if s.name not in previous or s.reach is None or touched - set(s.reach) or any(computed.get(a) for a in s.after):
            full.append(s.name)
            computed[s.name] = places.count()
            merged = compute(s, places)
        else:
            dirty = moved[s.by_cell]
            for n in sorted(touched):
                dirty = dirty.union(within_reach(places, changed[n], s.reach[n]))
            dirty = cut(dirty.distinct(), "dirty")
            computed[s.name] = dirty.count()
            fresh = compute(s, places.join(dirty, "id", "left_semi"))
            last = previous[s.name].select(*fresh.columns)
            if s.by_cell:  # the listings of a cell share their result
                rest = [c for c in fresh.columns if c != "id"]
                last = last.join(tagged_old, "id").groupBy("__cell").agg(F.first(F.struct(*rest)).alias("r")).select(F.col("__cell").alias("id"), "r.*")
            kept = last.join(places.select("id"), "id", "left_semi").join(dirty, "id", "left_anti")
            merged = kept.select(*fresh.columns).unionByName(fresh)
        out = scored(s, merged, baselines.get(s.name))
        results[s.name] = cut(tagged.join(out.withColumnRenamed("id", "__cell"), "__cell").drop("__cell") if s.by_cell else out, s.name)
    return Rescored(results, computed, full)
