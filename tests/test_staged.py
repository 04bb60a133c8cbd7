"""Scorers run in stages: results by key, reuse, and what a change brings about."""

import importlib
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from terrascore.functions.geo import geohash
from terrascore.operators import engine, rescore
from terrascore.plans import engine_queries, feed_queries
from terrascore.sources import store, versions
from terrascore.sources.views import AS_OF_EVENTS, view
from terrascore.streaming import sync_batches

SOME = ["schools", "rent_stabilized", "road_exposure", "air_quality", "unit_amenities"]


def rows(df):
    return sorted(df.select("id", "score").collect(), key=lambda r: r.id)


def test_stages_equal_single_runs_and_are_reused(spark, sf, tmp_path):
    x, tables, path = feed_queries.to_score(spark, sf), feed_queries.tables_of(spark, sf), f"file://{tmp_path}/r"
    first = engine.run_staged(x, tables, AS_OF_EVENTS, path, SOME)
    assert sorted(first.made) == sorted(SOME) and not first.found
    single = engine.run(x, tables, AS_OF_EVENTS, SOME)
    for n in SOME:
        assert rows(first.results[n]) == rows(single[n])
    again = engine.run_staged(feed_queries.to_score(spark, sf), feed_queries.tables_of(spark, sf), AS_OF_EVENTS, path, SOME)
    assert again.made == [] and sorted(again.found) == sorted(SOME) and again.keys == first.keys
    # another version of one table: only what reads it, or reads that, is made anew
    other = engine.run_staged(x, tables, AS_OF_EVENTS, path, SOME, versions={"trucks": "next"})
    assert sorted(other.made) == ["air_quality", "road_exposure"]
    later = engine.run_staged(x, tables, "2024-02-01", path, ["schools"])
    assert later.made == ["schools"]


def test_scorers_without_their_tables_are_left_out_and_keys_tell_revisions(spark, sf, tmp_path):
    x, path = view(spark, sf, "listings"), f"file://{tmp_path}/r"
    lots = {"lots": view(spark, sf, "lots")}
    got = engine.run_staged(x, lots, AS_OF_EVENTS, path, ["rent_stabilized", "schools"], ids=[1, 2, 3])
    assert list(got.results) == ["rent_stabilized"] and {r.id for r in got.results["rent_stabilized"].collect()} == {1, 2, 3}
    old = engine.SCORERS["rent_stabilized"]
    try:
        engine.revise("rent_stabilized", compute=old.compute)
        assert engine.run_staged(x, lots, AS_OF_EVENTS, path, ["rent_stabilized"], ids=[1, 2, 3]).made == ["rent_stabilized"]
    finally:
        engine.register(old)


def test_a_table_is_kept_whole_or_not_at_all(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    boom = lambda: spark.range(3).selectExpr("raise_error('no') AS x")
    with pytest.raises(Exception, match="no"):
        s.keep("a", "k", boom)
    assert not s.has("a", "k")
    assert s.keep("a", "k", lambda: spark.range(3)).count() == 3 and s.keep("a", "k", boom).count() == 3
    assert s.made == [("a", "k")] and s.found == [("a", "k")]
    s.keep("a", "other", lambda: spark.range(1))
    s.drop_others("a", {"other"})
    assert not s.has("a", "k") and s.has("a", "other")


def test_fingerprints_tell_files_and_plans(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(5).write.parquet(path)
    one = store.fingerprint(spark.read.parquet(path))
    assert one == store.fingerprint(spark.read.parquet(path)) and one != store.fingerprint(spark.read.parquet(path).where("id > 1"))
    spark.range(5).write.mode("append").parquet(path)
    assert one != store.fingerprint(spark.read.parquet(path))


def test_every_scorer_declares_what_it_reads():
    for s in engine.SCORERS.values():
        assert not set(s.needs) & set(s.uses), s.name
    assert set(engine_queries.SCORES) == set(engine.SCORERS)


@pytest.mark.parametrize("name", ["engine_queries", "feed_queries", "listing_queries", "queries", "record_queries", "registry", "scorer_queries", "source_queries"])
def test_each_query_module_can_be_imported_first(name):
    assert importlib.import_module(f"terrascore.plans.{name}")
    subprocess.run([sys.executable, "-c", f"import terrascore.plans.{name}"], check=True, timeout=120)


def test_only_what_a_change_reaches_is_scored_again(spark, sf):
    got = engine_queries.followed(spark, sf)
    x, tables = feed_queries.to_score(spark, sf), feed_queries.tables_of(spark, sf)
    whole = engine.run(x, tables, AS_OF_EVENTS, engine_queries.FOLLOWED)
    for n in engine_queries.FOLLOWED:
        assert rows(got.results[n]) == rows(whole[n]), n
    places = engine.cells(engine.active(x)).count()
    assert not got.full and 0 < got.computed["schools"] < places / 4 and 0 < got.computed["road_exposure"] < places
    # nothing changed: nothing is computed; a table that isn't told by place: everything is
    same = rescore.rescore(x, x, tables, {}, AS_OF_EVENTS, whole, ["schools", "flood_risk"])
    assert same.computed == {"schools": 0, "flood_risk": 0} and rows(same.results["schools"]) == rows(whole["schools"])
    every = rescore.rescore(x, x, tables, {"lots": tables["lots"]}, AS_OF_EVENTS, whole, ["bedbug", "flood_risk"])
    assert every.full == ["bedbug"] and every.computed["flood_risk"] > 0


def test_versions_are_kept_pinned_and_retired(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    of = lambda n: spark.range(n)
    for n in (1, 2, 3):
        assert versions.publish(of(n), path, keep=2, notes={f"k{n}": n})
    assert [v.number for v in versions.versions(spark, path)] == [2, 3] and versions.latest(spark, path).notes == {"k1": 1, "k2": 2, "k3": 3}
    assert versions.published(spark, path).count() == 3 and versions.published(spark, path, 2).count() == 2
    with pytest.raises(ValueError, match="no version 1"):
        versions.published(spark, path, 1)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2
    pinned = versions.published(spark, path, 3)
    assert versions.publish(of(9), path, keep=2) and pinned.count() == 3 and versions.published(spark, path).count() == 9


def test_two_writers_leave_one_winner(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    versions.publish(spark.range(1), path)
    with ThreadPoolExecutor(2) as pool:
        tried = [pool.submit(versions.publish, spark.range(n), path, 1) for n in (5, 6)]
    errors = [f.exception() for f in tried if f.exception()]
    assert len(errors) == 1 and isinstance(errors[0], versions.Conflict)
    assert versions.latest(spark, path).number == 2 and versions.published(spark, path).count() in (5, 6)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2  # the loser's files are gone
    with pytest.raises(versions.Conflict):
        versions.publish(spark.range(7), path, expect=1)
    with pytest.raises(versions.Conflict):
        versions.publish(spark.range(7), path, expect=9)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    path, logs = f"file://{tmp_path}/listings", []
    versions.publish(spark.createDataFrame([("k", "a", "1", "ACTIVE", None, None, 5)], "id string, source string, source_id string, status string, first_seen_at timestamp, last_seen_at timestamp, price int"), path)
    step = sync_batches(path, "a", lambda n: f"2024-02-0{n + 1}", lambda log: logs.append(log.first()))
    batch = spark.createDataFrame([("2", 7)], "source_id string, price int")
    for number in (0, 0, 1, 0):
        step(batch, number)
    assert [(x.inserted, x.updated) for x in logs] == [(1, 0), (0, 1)] and versions.latest(spark, path).number == 3


def test_samples_are_seeded_and_spread_over_cells(spark, sf):
    x = engine.active(view(spark, sf, "listings"))
    one, same, other = (sorted(r.id for r in engine.stratified(df, 2, 6, s).collect()) for df, s in ((x, 1), (x.repartition(7), 1), (x, 2)))
    assert one == same != other
    cells = x.withColumn("c", geohash(F.col("lat"), F.col("lon"), 6)).groupBy("c").count().collect()
    assert len(one) == sum(min(2, r["count"]) for r in cells)


def test_audit_finds_what_drifted_in_the_sample(spark, sf):
    x, tables = view(spark, sf, "listings"), {"lots": view(spark, sf, "lots"), "school_sites": view(spark, sf, "school_sites")}
    sample = {r.id for r in engine.stratified(engine.active(x), 1, 6, 3).collect()}
    fresh = engine.SCORERS["schools"].compute(engine.Context(engine.active(x), x, tables, AS_OF_EVENTS))
    off = fresh.withColumn("rating", F.when(F.col("id") % 2 == 0, F.col("rating") * 2 + 1).otherwise(F.col("rating")))
    got = {r.scorer: r for r in engine.audit(x, tables, AS_OF_EVENTS, {"schools": off, "pest": off}, each=1, precision=6, seed=3).collect()}
    assert got.keys() == {"schools"} and got["schools"].n == len(sample) and got["schools"].drifted == sum(i % 2 == 0 for i in sample) and got["schools"].stale
    calm = engine.audit(x, tables, AS_OF_EVENTS, {"schools": fresh}, each=1, precision=6, seed=3).first()
    assert calm.drifted == 0 and not calm.stale
