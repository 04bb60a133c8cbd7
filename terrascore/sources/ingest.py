"""Listing snapshots: validation, normalisation and synchronisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.functions.geo import uuid5

REQUIRED = ("source_id", "lat", "lon", "price", "beds")
KEPT_WHEN_NULL = ("building_year", "building_stories")

_SOURCES: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_source(name: str, fetch: Callable[[SparkSession], DataFrame]) -> None:
    _SOURCES[name] = fetch


def source(name: str) -> Callable[[SparkSession], DataFrame]:
    if name not in _SOURCES:
        raise KeyError(f"unknown source {name}; known: {sorted(_SOURCES)}")
    return _SOURCES[name]


def validate(df: DataFrame, canonical: set[str], required: tuple[str, ...] = REQUIRED) -> None:
    """Raise if a field is unknown, a required value is missing or a source_id repeats; one aggregate, nothing is written."""
    if unknown := sorted(set(df.columns) - canonical):
        raise ValueError(f"unknown fields: {unknown}")
    if absent := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing fields: {absent}")
    got = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required)).first()
    if nulls := [c for c in required if got[c]]:
        raise ValueError(f"missing values: {nulls}")
    if not df.groupBy("source_id").count().where("count > 1").isEmpty():
        raise ValueError("a source_id repeats")


def normalise(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, booleans as 0 and 1, source_id as text."""
    out = {}
    for name, kind in df.dtypes:
        if kind.startswith(("array", "map", "struct")):
            out[name] = F.to_json(name)
        elif kind == "boolean":
            out[name] = F.col(name).cast("int")
        elif name == "source_id":
            out[name] = F.col(name).cast("string")
    return df.withColumns(out)


def sync(current: DataFrame, snapshot: DataFrame, source_name: str, now: str, app: str = "places") -> DataFrame:
    """The next version of the listings, with ``action`` (inserted, updated, deactivated, kept).

    current: (id, source, source_id, status, first_seen_at, last_seen_at, fields...); snapshot: (source_id, fields...).
    Known rows keep id and first_seen_at, take all fields (even null; building fields keep their value), and become
    active; new rows get a name-based id; active rows of this source that the snapshot lacks become inactive; other
    sources stay as they are. One full outer join."""
    fields = [c for c in current.columns if c not in ("id", "source", "source_id", "status", "first_seen_at", "last_seen_at")]
    snap = snapshot.select(F.lit(source_name).alias("source"), F.col("source_id").cast("string").alias("source_id"), *(F.col(c) if c in snapshot.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in fields), (F.col("first_seen_at") if "first_seen_at" in snapshot.columns else F.lit(None).cast("timestamp")).alias("first_seen_at"), F.lit(True).alias("__there"))
    c, s = current.withColumn("__here", F.lit(True)).alias("c"), snap.alias("s")
    j = c.join(s, (F.col("c.source") == F.col("s.source")) & (F.col("c.source_id") == F.col("s.source_id")), "full_outer")
    here, there = F.col("c.__here").isNotNull(), F.col("s.__there").isNotNull()
    own = here & (F.col("c.source") == source_name)
    lost = own & ~there & (F.col("c.status") == "ACTIVE")
    key = F.coalesce("c.source_id", "s.source_id")
    when = F.lit(now).cast("timestamp")

    def field(name: str):
        new = F.coalesce(f"s.{name}", f"c.{name}") if name in KEPT_WHEN_NULL else F.col(f"s.{name}")
        return F.when(there, new).otherwise(F.col(f"c.{name}")).alias(name)

    return j.select(
        F.coalesce("c.id", uuid5(F.concat_ws(":", F.lit(app), F.lit(source_name), key))).alias("id"), F.coalesce("c.source", "s.source").alias("source"), key.alias("source_id"),
        F.when(there, "ACTIVE").when(lost, "INACTIVE").otherwise(F.col("c.status")).alias("status"),
        F.when(here, F.col("c.first_seen_at")).otherwise(F.coalesce("s.first_seen_at", when)).alias("first_seen_at"), F.when(there, when).otherwise(F.col("c.last_seen_at")).alias("last_seen_at"),
        *map(field, fields), F.when(there & here, "updated").when(there, "inserted").when(lost, "deactivated").otherwise("kept").alias("action"),
    )


def sync_log(synced: DataFrame, source_name: str, now: str) -> DataFrame:
    """One audit row: seen, inserted, updated, deactivated, no error."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    row = synced.where(F.col("source") == source_name).agg(n("inserted", "updated").alias("seen"), n("inserted").alias("inserted"), n("updated").alias("updated"), n("deactivated").alias("deactivated"))
    return row.select(F.lit(source_name).alias("source"), F.lit(now).cast("timestamp").alias("at"), "*", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))


def failed_log(spark: SparkSession, source_name: str, now: str, error: Exception) -> DataFrame:
    """The audit row of a run that failed: nothing seen or changed, and why."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("seen", "inserted", "updated", "deactivated")]
    return spark.range(1).select(F.lit(source_name).alias("source"), F.lit(now).cast("timestamp").alias("at"), *zero, F.lit("failed").alias("status"), F.lit(f"{type(error).__name__}: {error}").alias("error"))


def run_sync(spark: SparkSession, current: DataFrame, source_name: str, now: str, canonical: set[str]) -> tuple[DataFrame, DataFrame]:
    """(next version of the listings, audit row) of a registered source; a source that fails leaves the listings as they are."""
    try:
        snapshot = source(source_name)(spark)
        validate(snapshot, canonical)
        synced = sync(current, normalise(snapshot), source_name, now)
        return synced.drop("action"), sync_log(synced, source_name, now)
    except (KeyError, ValueError) as error:
        return current, failed_log(spark, source_name, now, error)
