"""Problem 3: missing rates of pitches filled from the same pitcher and season."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.operators.deliveries import latest
from pastglass.operators.fill import fill
from pastglass.plans.attributes import PITCHES_SQL
from pastglass.sources.tables import table

FIELDS = ["asof_pitcher_prev1_game_success_rate", "asof_pitcher_breaking_rate", "asof_pitcher_offspeed_rate"]
#: Pitches in a block: those that count as alike in time.
BLOCK = 64


def filled_pitches(spark: SparkSession, folder: str, levels: dict[str, list] | None = None) -> DataFrame:
    """Every pitch with the three rates (and categorical fields, if any) filled and marked."""
    train = table(spark, folder, "train").select("pitcher_id", "asof_pitcher_n", "season", *FIELDS, *(levels or {}), "loaded_at")
    pitches = latest(train, "pitcher_id", "asof_pitcher_n", "loaded_at", BLOCK).drop("loaded_at")
    return fill(pitches, group=["pitcher_id", "season"], order="asof_pitcher_n", blk="__blk", fields={f: (0.0, 1.0) for f in FIELDS}, levels=levels)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The filled values that have an observed one at an earlier pitch of the same pitcher and season."""
    rows = filled_pitches(spark, folder)
    hits = F.array_compact(F.array(*[F.when(F.col(f"{f}_was_filled") & F.col(f"{f}_has_earlier"), F.lit(f)) for f in FIELDS]))
    return rows.select("pitcher_id", "asof_pitcher_n", F.explode(hits).alias("field"))


def p3_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Every pitch with filled values and marks; the batter's hand as an example of a categorical field."""
    rows = filled_pitches(spark, folder, {"batter_hand": [1, 2, 3]})
    names = [*FIELDS, "batter_hand"]
    return rows.select("pitcher_id", "asof_pitcher_n", "season", *[f"{f}_filled" for f in names], *[f"{f}_was_filled" for f in names])


_CASES = " UNION ALL ".join(f"SELECT pitcher_id, asof_pitcher_n, season, '{f}' AS field, CASE WHEN {f} BETWEEN 0 AND 1 THEN {f} END AS v FROM p" for f in FIELDS)
SQL = {
    "p3_found": f"""
WITH p AS ({PITCHES_SQL}), l AS ({_CASES}),
f AS (SELECT pitcher_id, season, field, min(asof_pitcher_n) AS first_n FROM l WHERE v IS NOT NULL GROUP BY ALL)
SELECT l.pitcher_id, l.asof_pitcher_n, l.field FROM l JOIN f USING (pitcher_id, season, field) WHERE l.v IS NULL AND f.first_n < l.asof_pitcher_n"""
}
QUERIES = {"p3_found": p3_found, "p3_fill": p3_fill}
