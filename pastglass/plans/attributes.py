"""Problem 1: pitcher totals as known at each pitch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.operators.asof import as_known
from pastglass.operators.deliveries import latest
from pastglass.sources.tables import table

BLOCK = 512
TOTALS = {"c0_succ": "known_succ", "c0_mid": "known_mid", "c0_ball": "known_ball", "c0_rev": "known_rev", "c0_strk": "known_strk", "n0": "known_n0"}


def known_at_pitch(spark: SparkSession, folder: str, totals: dict[str, str]) -> DataFrame:
    """Every pitch with the state known at it and its successes so far."""
    train = table(spark, folder, "train").select("pitcher_id", "asof_pitcher_n", "season", "asof_pitcher_success_rate", "control_success", "loaded_at")
    pitches = latest(train, "pitcher_id", "asof_pitcher_n", "loaded_at", BLOCK).drop("loaded_at")
    return as_known(
        pitches, table(spark, folder, "pitcher_state"), entity="pitcher_id", at="asof_pitcher_n", period="season", valid_from="n0", known_from="known_season",
        rank=["revision"], payload=totals, running={"succ_so_far": ("known_succ", "control_success")}, block=BLOCK,
    )


def p1_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Each pitch with the totals and the success rate valid and known at it."""
    rate = F.when(F.col("asof_pitcher_n") > 0, F.col("succ_so_far") / F.col("asof_pitcher_n"))
    return known_at_pitch(spark, folder, TOTALS).select("pitcher_id", "asof_pitcher_n", "season", *TOTALS.values(), F.round(rate, 9).alias("known_rate"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pitches whose given success rate is not the rate known at them."""
    rows = known_at_pitch(spark, folder, {"c0_succ": "known_succ"})
    wrong = F.abs(F.col("asof_pitcher_success_rate") - F.col("succ_so_far") / F.col("asof_pitcher_n")) > 1e-9
    return rows.filter((F.col("asof_pitcher_n") > 0) & wrong).select("pitcher_id", "asof_pitcher_n")


PITCHES_SQL = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pitcher_id, asof_pitcher_n ORDER BY loaded_at DESC) AS rn FROM train) WHERE rn = 1"

KNOWN_SQL = f"""
WITH p AS ({PITCHES_SQL}),
s AS (SELECT DISTINCT pitcher_id, n0, known_season, revision, c0_succ, c0_mid, c0_ball, c0_rev, c0_strk FROM pitcher_state),
j AS (
  SELECT p.pitcher_id, p.asof_pitcher_n, p.season, p.asof_pitcher_success_rate, s.* EXCLUDE (pitcher_id),
         row_number() OVER (PARTITION BY p.pitcher_id, p.asof_pitcher_n ORDER BY s.n0 DESC NULLS LAST, s.known_season DESC, s.revision DESC NULLS LAST, c0_succ DESC NULLS LAST, c0_mid DESC NULLS LAST, c0_ball DESC NULLS LAST, c0_rev DESC NULLS LAST, c0_strk DESC NULLS LAST) AS rk
  FROM p LEFT JOIN s ON s.pitcher_id = p.pitcher_id AND s.n0 <= p.asof_pitcher_n AND s.known_season <= p.season),
c AS (SELECT pitcher_id, asof_pitcher_n, coalesce(control_success, 0) AS y FROM p),
cum AS (SELECT pitcher_id, asof_pitcher_n, sum(y) OVER (PARTITION BY pitcher_id ORDER BY asof_pitcher_n) - y AS before FROM c),
k AS (
  SELECT j.*, cum.before - coalesce((SELECT sum(y) FROM c WHERE c.pitcher_id = j.pitcher_id AND c.asof_pitcher_n < j.n0), 0) AS since
  FROM j JOIN cum USING (pitcher_id, asof_pitcher_n) WHERE rk = 1)
"""

SQL = {
    "p1_asof": KNOWN_SQL + """
SELECT pitcher_id, asof_pitcher_n, season, c0_succ AS known_succ, c0_mid AS known_mid, c0_ball AS known_ball, c0_rev AS known_rev, c0_strk AS known_strk, n0 AS known_n0,
       CASE WHEN asof_pitcher_n > 0 THEN round((c0_succ + since)::DOUBLE / asof_pitcher_n, 9) END AS known_rate FROM k""",
    "p1_found": KNOWN_SQL + """
SELECT pitcher_id, asof_pitcher_n FROM k
WHERE asof_pitcher_n > 0 AND abs(asof_pitcher_success_rate - (c0_succ + since)::DOUBLE / asof_pitcher_n) > 1e-9""",
}

QUERIES = {"p1_found": p1_found, "p1_asof": p1_asof}
