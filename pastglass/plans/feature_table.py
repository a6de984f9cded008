"""Problem 5: one row per pitcher and batter with counts, totals and recency of 288 event types."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.operators.deliveries import latest
from pastglass.operators.features import deltas, features, later_deltas, merge_state, one_row_each, refresh
from pastglass.plans.attributes import PITCHES_SQL
from pastglass.sources.tables import table

FLAGS = ["runner_on_1b", "runner_on_2b", "runner_on_3b"]
BLOCK = 512
TYPES = [f"{b}-{s}|{o}|{x}{y}{z}" for b, s, o, x, y, z in product(range(4), range(3), range(3), range(2), range(2), range(2))]


def code() -> F.Column:
    """The event type as its place in TYPES; null where a part is null or outside its range."""
    parts = [("balls_before", 4), ("strikes_before", 3), ("outs_before", 3), *((f, 2) for f in FLAGS)]
    n, ok = F.lit(0), F.lit(True)
    for c, size in parts:
        n, ok = n * size + F.col(c), ok & F.col(c).between(0, size - 1)
    return F.when(ok, n.cast("short"))


def name(n: F.Column) -> F.Column:
    """The text of a code."""
    bits = [F.pmod(F.floor(n / d), F.lit(2)).cast("string") for d in (4, 2, 1)]
    return F.concat(F.floor(n / 72).cast("string"), F.lit("-"), F.pmod(F.floor(n / 24), F.lit(3)).cast("string"), F.lit("|"), F.pmod(F.floor(n / 8), F.lit(3)).cast("string"), F.lit("|"), *bits)


def entity_features(spark: SparkSession, folder: str) -> DataFrame:
    """(entity_kind, entity_id, event_type, n, total, last_period) from all deliveries."""
    train = table(spark, folder, "train")
    changes = deltas(train, ["pitcher_id", "asof_pitcher_n"], "loaded_at", {"pitcher": "pitcher_id", "batter": "batter_id"}, code(), "season", "control_success", F.floor(F.col("asof_pitcher_n") / BLOCK))
    return features(merge_state(None, changes)).withColumn("event_type", name(F.col("event_type")))


def p5_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """The features of the deliveries until 2024, brought up to date by the deltas of those since."""
    train, since = table(spark, folder, "train"), F.lit("2024-01-01").cast("timestamp_ntz")
    early, late = train.filter(F.col("loaded_at") < since), train.filter(F.col("loaded_at") >= since)
    what = (["pitcher_id", "asof_pitcher_n"], "loaded_at", {"pitcher": "pitcher_id", "batter": "batter_id"}, code(), "season", "control_success")
    state = merge_state(None, deltas(early, *what, F.floor(F.col("asof_pitcher_n") / BLOCK)))
    changes = later_deltas(latest(early, "pitcher_id", "asof_pitcher_n", "loaded_at", BLOCK).drop("__blk"), late, *what)
    out = refresh(features(state), merge_state(state, changes), changes)
    return out.withColumn("event_type", name(F.col("event_type"))).withColumnsRenamed({"n": "pitches", "total": "successes", "last_period": "last_season"})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entities and event types with two or more pitches and no success."""
    return entity_features(spark, folder).filter((F.col("n") >= 2) & (F.col("total") == 0)).select("entity_kind", "entity_id", "event_type")


def p5_long(spark: SparkSession, folder: str) -> DataFrame:
    """The features that aren't empty, one row each."""
    return entity_features(spark, folder).withColumnsRenamed({"n": "pitches", "total": "successes", "last_period": "last_season"})


def p5_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entity, arrays over the 288 types in the order of TYPES."""
    return one_row_each(entity_features(spark, folder), TYPES)


_LONG = f"""
WITH p AS ({PITCHES_SQL}),
e AS (SELECT 'pitcher' AS entity_kind, pitcher_id AS entity_id, * FROM p UNION ALL SELECT 'batter', batter_id, * FROM p WHERE batter_id IS NOT NULL),
f AS (SELECT entity_kind, entity_id, balls_before || '-' || strikes_before || '|' || outs_before || '|' || runner_on_1b || runner_on_2b || runner_on_3b AS event_type,
  count(*) AS pitches, coalesce(sum(control_success), 0)::BIGINT AS successes, max(season) AS last_season FROM e GROUP BY ALL)
"""
SQL = {
    "p5_found": _LONG + "SELECT entity_kind, entity_id, event_type FROM f WHERE pitches >= 2 AND successes = 0",
    "p5_long": _LONG + "SELECT * FROM f",
    "p5_refresh": _LONG + "SELECT * FROM f",
}
QUERIES = {"p5_found": p5_found, "p5_long": p5_long, "p5_refresh": p5_refresh, "p5_features": p5_features}
