"""Queries of all scorers together, run in stages, and of what is made of their results, with SQL composed of the scorers' own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.operators import engine, rank, stats
from terrascore.operators.rescore import Rescored, rescore
from terrascore.plans import listing_queries, scorer_queries  # noqa: F401
from terrascore.plans.feed_queries import CELL8, tables_of, to_score
from terrascore.plans.registry import ORACLES, query
from terrascore.sources.store import shared_folder
from terrascore.sources.views import AS_OF_EVENTS, AS_OF_ORDERS, view, view_sql

#: Scorers whose scores are ranked in a frozen baseline here: that of a scored dimension's hundredth.
RANKED = ("building_violations", "management", "pest", "bedbug")


def baselines(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    grid = stats.quantiles(view(spark, d, "scores").withColumn("v", F.col("d0") / 100), "v")
    return dict.fromkeys(RANKED, grid)


def staged(spark: SparkSession, d: str) -> engine.Staged:
    """All scorers over all active listings; results that the shared folder holds already for the same inputs are read."""
    return engine.run_staged(to_score(spark, d), tables_of(spark, d), AS_OF_EVENTS, f"{shared_folder(spark)}/engine-results", baselines=baselines(spark, d))


def all_scores(spark: SparkSession, d: str) -> DataFrame:
    """Listings with <scorer>_score of every scorer."""
    results = {n: df.select("id", F.col("score").cast("double").alias("score")) for n, df in staged(spark, d).results.items()}
    return engine.write_back(view(spark, d, "listings").select("id", "status"), results)


BASE = view_sql("listings").removeprefix("WITH listings AS (").removesuffix(")")
ACTIVE = f"listings AS (SELECT * FROM ({BASE}) l WHERE status = 'ACTIVE')"
BY_CELL = f"listings AS (SELECT CAST(cell AS BIGINT) AS id, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon FROM (SELECT l.*, {CELL8} AS cell FROM ({BASE}) l WHERE status = 'ACTIVE') GROUP BY cell)"


def own_sql(name: str, by_cell: bool, *swaps: tuple[str, str]) -> str:
    """A scorer's SQL over the places that the engine gives it, on the engine's day."""
    sql = ORACLES[name]
    for old, new in ((f"listings AS ({BASE})", BY_CELL if by_cell else ACTIVE), *swaps):
        assert old in sql, (name, old)
        sql = sql.replace(old, new)
    return sql


#: Swaps from the day and shares of the scorers' own queries to those of the engine's.
DAY, MONTH, NEW = (AS_OF_ORDERS, AS_OF_EVENTS), (f"m = {int(AS_OF_ORDERS[5:7])}", f"m = {int(AS_OF_EVENTS[5:7])}"), ("yearbuilt >= 1998", f"yearbuilt >= {int(AS_OF_EVENTS[:4]) - 3}")
#: Rounded from the exact value of the double, not from a product that may come out as a half.
AIR = "22 + greatest(0.0, least(1.0, (20 - air_index) / 12)) * 70"
EXACT = (f"round({AIR}, 1)", f"CAST(round(CAST({AIR} AS DECIMAL(30, 20)), 1) AS DOUBLE)")
CASUALTIES = ("JOIN crashes c ON c.killed > 0 AND", "JOIN shootings c ON")
IN_GRID = "(SELECT CASE WHEN hi = 0 THEN 100.0 WHEN lo = 1001 THEN 0.0 ELSE round(100 - least(100.0, round_even((lo + hi) / 20.0, 1)), 1) END FROM (SELECT count(*) FILTER (q < {v}) AS lo, count(*) FILTER (q <= {v}) AS hi FROM pq))"
HALF_AT_MEDIAN = "greatest(0, 100 - 50 * {v} / (SELECT CASE WHEN coalesce(median({v}), 0) = 0 THEN 1.0 ELSE median({v}) END FROM x_{n}))"
#: scorer: (its rows, its score from them).
SCORES: dict[str, tuple[str, str]] = {
    "deal": (own_sql("sc01_deal", False), "CASE WHEN deviation IS NOT NULL THEN greatest(0, least(100, 50 + 25 * (deviation - (SELECT avg(deviation) FROM x_deal)) / (SELECT stddev_samp(deviation) FROM x_deal))) END"),
    "unit_amenities": (own_sql("sc02_unit_amenities", False), "CASE WHEN total IS NOT NULL THEN 100 * ((SELECT count(*) FROM x_unit_amenities o WHERE o.total < x.total) + ((SELECT count(*) FROM x_unit_amenities o WHERE o.total = x.total) - 1) / 2) / ((SELECT count(total) FROM x_unit_amenities) - 1) END"),
    "transit": (own_sql("sc03_transit", True), "score"),
    "crime": (own_sql("sc04_crime", True, CASUALTIES).replace("WITH ", f"{view_sql('shootings')}, ", 1), HALF_AT_MEDIAN.format(v="rate", n="crime")),
    "noise": (own_sql("sc05_noise", True), HALF_AT_MEDIAN.format(v="rate", n="noise")),
    "building_violations": (own_sql("sc06_violations", False, DAY, NEW), f"CASE WHEN per_unit IS NOT NULL THEN {IN_GRID.format(v='x.per_unit')} END"),
    "management": (own_sql("sc07_management", False, DAY, NEW, MONTH), f"CASE WHEN per_unit IS NOT NULL THEN {IN_GRID.format(v='x.per_unit')} END"),
    "pest": (own_sql("sc08_pest", False, NEW), f"CASE WHEN rate IS NOT NULL THEN {IN_GRID.format(v='x.rate')} END"),
    "bedbug": (own_sql("sc09_bedbug", False, DAY, NEW), f"CASE WHEN rate IS NOT NULL THEN {IN_GRID.format(v='x.rate')} END"),
    "street_danger": (own_sql("sc10_street_danger", True), "round(100 * exp(-rate / 8), 1)"),
    "shelter": (own_sql("sc11_facilities", True, DAY), HALF_AT_MEDIAN.format(v="exposure", n="shelter")),
    "parks": (own_sql("sc12_parks", True), "effective"),
    "greenery": (own_sql("sc13_greenery", True), "absolute"),
    "convenience": (own_sql("sc14_convenience", True), "absolute"),
    "schools": (own_sql("sc15_schools", True), "rating"),
    "road_exposure": (own_sql("sc17_road_exposure", True), "round(greatest(0.0, 100 - 6 * road_index), 1)"),
    "air_quality": (own_sql("sc16_air_quality", False, ("d0 / 10 AS road", "rx.road_index AS road"), ("LEFT JOIN scores s ON s.id = c.id", "LEFT JOIN rx ON rx.id = c.id"), EXACT), "score"),
    "flood_risk": (own_sql("sc18_flood_risk", False), "score"),
    "rent_stabilized": (own_sql("sc19_rent_stabilized", False), "score"),
}
ON_CELLS = {n for n, s in engine.SCORERS.items() if s.by_cell}
GRID = "pf AS (SELECT d0 / 100 AS v, row_number() OVER (ORDER BY d0) - 1 AS r, count(*) OVER () AS n FROM scores WHERE d0 IS NOT NULL), pg AS (SELECT i, least(n - 1, CAST(round_even(i * (n - 1) / 1000, 0) AS BIGINT)) AS at FROM (SELECT unnest(range(0, 1001)) AS i), (SELECT max(n) AS n FROM pf)), pq AS MATERIALIZED (SELECT pf.v AS q FROM pg JOIN pf ON pf.r = pg.at)"
_order = [n for n in SCORES if n != "air_quality"] + ["air_quality"]  # the last reads the results of roads
PARTS = ", ".join(
    f"x_{n} AS MATERIALIZED (SELECT * FROM ({SCORES[n][0]})), s_{n} AS MATERIALIZED (SELECT id, round({SCORES[n][1]}, 4) AS score FROM x_{n} x)" + (", rx AS (SELECT a.id, x.road_index FROM act a JOIN x_road_exposure x ON x.id = a.cell)" if n == "road_exposure" else "") for n in _order
)
ALL_SCORES = f"{view_sql('scores')}, {GRID}, base AS ({BASE}), act AS MATERIALIZED (SELECT l.id, CAST({CELL8} AS BIGINT) AS cell FROM base l WHERE status = 'ACTIVE'), {PARTS}, every AS MATERIALIZED (SELECT b.id, b.status, {', '.join(f's_{n}.score AS {n}_score' for n in SCORES)} FROM base b LEFT JOIN act ON act.id = b.id {' '.join(f'LEFT JOIN s_{n} ON s_{n}.id = act.{"cell" if n in ON_CELLS else "id"}' for n in SCORES)})"


@query("sc21_engine", f"{ALL_SCORES} SELECT id, {', '.join(f'{n}_score' for n in SCORES)} FROM every")
def sc21(spark, d):
    """Every scorer over all active listings, in stages, written back."""
    return all_scores(spark, d).select("id", *(F.round(f"{n}_score", 4).alias(f"{n}_score") for n in SCORES))


TENTH = "round_even({} * 10, 0) / 10".format
MEAN = lambda dims: f"({' + '.join(f'coalesce({x}, 0)' for x in dims)}) / nullif({' + '.join(f'CAST({x} IS NOT NULL AS INT)' for x in dims)}, 0)"
COUNTED = {g: [x for x in dims if x != "schools"] for g, dims in rank.PLACE_GROUPS.items()}
COMPOSITES = f"""{ALL_SCORES}, t AS (SELECT id, {', '.join(f'{TENTH(f"{x}_score")} AS {x}' for x in rank.PLACE_DIMS)} FROM every WHERE status = 'ACTIVE'), g AS (SELECT *, {', '.join(f'{MEAN(dims)} AS "{k}"' for k, dims in COUNTED.items())} FROM t), c AS (SELECT *, {TENTH(f"coalesce({MEAN([f'{chr(34)}{k}{chr(34)}' for k in COUNTED])}, 0)")} AS raw_composite, ({' + '.join(f'CAST({x} IS NOT NULL AS INT)' for dims in COUNTED.values() for x in dims)}) / 16 AS coverage FROM g),
cf AS (SELECT raw_composite AS v, row_number() OVER (ORDER BY raw_composite) - 1 AS r, count(*) OVER () AS n FROM c), cg AS (SELECT i, least(n - 1, CAST(round_even(i * (n - 1) / 1000, 0) AS BIGINT)) AS at FROM (SELECT unnest(range(0, 1001)) AS i), (SELECT max(n) AS n FROM cf)), cq AS (SELECT cf.v AS q FROM cg JOIN cf ON cf.r = cg.at), cu AS (SELECT u.v, count(*) FILTER (q < u.v) AS lo, count(*) FILTER (q <= u.v) AS hi FROM (SELECT DISTINCT raw_composite AS v FROM c) u CROSS JOIN cq GROUP BY 1),
p AS (SELECT c.*, CASE WHEN hi = 0 THEN 0.0 WHEN lo = 1001 THEN 100.0 ELSE least(100.0, round_even((lo + hi) / 20.0, 1)) END AS pct FROM c JOIN cu ON cu.v = c.raw_composite), k AS (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {x} <= 12 THEN '{x}' END" for x in rank.DEALBREAKERS)}) AS dealbreakers FROM p), placed AS (SELECT *, CASE WHEN dealbreakers <> '' THEN least(pct, 55.0) ELSE pct END AS composite FROM k)"""


def composites(spark: SparkSession, d: str) -> DataFrame:
    """Composites of the scores as they are shown, to four decimals."""
    shown = [F.round(f"{n}_score", 4).alias(f"{n}_score") for n in rank.PLACE_DIMS]
    return rank.place_composites(all_scores(spark, d).where("status = 'ACTIVE'").select("id", *shown))


@query("rk05_place_composites", f"{COMPOSITES} SELECT id, {', '.join(f'round(\"{k}\", 4) AS g_{k}' for k in COUNTED)}, coverage, CASE WHEN coverage >= 0.75 THEN NULL WHEN coverage >= 0.25 THEN 'limited' ELSE 'very_limited' END AS coverage_label, raw_composite, composite, dealbreakers FROM placed")
def rk05_place(spark, d):
    """From scorers to composites: groups of the real dimensions, rank among active listings, and dealbreakers."""
    c = composites(spark, d)
    return c.select("id", *(F.round(k, 4).alias(f"g_{k}") for k in COUNTED), "coverage", "coverage_label", "raw_composite", "composite", F.array_join("dealbreakers", ",").alias("dealbreakers"))


@query("rk06_place_feed", f"{COMPOSITES} SELECT p.id, b.price, p.composite, p.coverage FROM placed p JOIN base b USING (id) WHERE b.beds IN (1, 2) AND p.composite >= 40 ORDER BY p.composite DESC, p.coverage DESC, p.id LIMIT 50")
def rk06_place(spark, d):
    """The first page of a feed sorted by the composite of the scorers' results."""
    x = view(spark, d, "listings").drop("composite").join(composites(spark, d), "id")
    f = rank.feed(x, beds=[1, 2], min_composite=40)
    return rank.page(f, rank.sort_column("composite", rank.PLACE_DIMS, rank.PLACE_GROUPS), 1, 50).select("id", "price", "composite", "coverage")


#: Scorers whose change is followed, and the rows that came since the last run.
FOLLOWED = ["unit_amenities", "schools", "shelter", "road_exposure", "flood_risk"]
CAME = {"shelters": "shelter_id % 10 = 0", "firehouses": "house_id % 25 = 0"}


def followed(spark: SparkSession, d: str) -> Rescored:
    """An earlier run without some listings and some rows of two tables, and what is scored again when they come."""
    x, tables = to_score(spark, d), tables_of(spark, d)
    before = x.where("id % 17 <> 0").withColumn("amenities", F.when(F.col("id") % 23 != 0, F.col("amenities")))
    previous = engine.run_staged(before, {**tables, **{n: tables[n].where(f"not ({c})") for n, c in CAME.items()}}, AS_OF_EVENTS, f"{shared_folder(spark)}/engine-results", FOLLOWED)
    return rescore(before, x, tables, {n: tables[n].where(c) for n, c in CAME.items()}, AS_OF_EVENTS, previous.results, FOLLOWED)


@query("sc21_rescored", f"{ALL_SCORES} SELECT id, {', '.join(f'{n}_score' for n in FOLLOWED)} FROM every")
def sc21_rescored(spark, d):
    """Only places that a change can reach are computed; the scores are those of a full run."""
    results = {n: df.select("id", F.col("score").cast("double").alias("score")) for n, df in followed(spark, d).results.items()}
    return engine.write_back(view(spark, d, "listings").select("id"), results).select("id", *(F.round(f"{n}_score", 4).alias(f"{n}_score") for n in FOLLOWED))


#: Scorers whose stored metrics are held against fresh ones: (column, its SQL by cell, its SQL at the listing).
AUDITED = {"schools": ("rating", "x_schools", own_sql("sc15_schools", False)), "road_exposure": ("road_index", "x_road_exposure", own_sql("sc17_road_exposure", False)), "flood_risk": ("score", "x_flood_risk", own_sql("sc18_flood_risk", False))}
DRIFTS = " UNION ALL ".join(f"SELECT '{n}' AS scorer, '{c}' AS \"column\", o.{c} AS a, f.{c} AS b FROM act JOIN {old} o ON o.id = act.{'cell' if n in ON_CELLS else 'id'} JOIN ({fresh}) f ON f.id = act.id" for n, (c, old, fresh) in AUDITED.items())
DRIFTED = "count(*) FILTER (abs(a - b) / greatest(abs(a), 1e-9) > 0.1)"


@query("vl04_audit", f'{ALL_SCORES}, j AS ({DRIFTS}) SELECT scorer, "column", count(*) AS n, {DRIFTED} AS drifted, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS null_mismatch, {DRIFTED} > greatest(1, floor(count(*) / 5)) AS stale FROM j GROUP BY 1, 2')
def vl04_audit(spark, d):
    """What the engine stored by cell, held against a fresh computation at each active listing's own coordinates."""
    results = staged(spark, d).results
    return engine.audit(to_score(spark, d), tables_of(spark, d), AS_OF_EVENTS, {n: results[n] for n in AUDITED}, each=2**31)
