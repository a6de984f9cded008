"""Test adapter: the tables of this project in the roles that the operators know, in Spark and in SQL.

trials: one row per pitch (the delivery that counts). a, b: pitcher and batter; period: season; seg: game type;
ctx: balls*3+strikes; y: outcome; na: the pitcher's counter; r_*: his as-of rates, null where they are no rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastglass.functions.scalars import share
from pastglass.operators.deliveries import latest
from pastglass.sources.tables import table

RATES = {
    "r_succ": "asof_pitcher_success_rate", "r_mid": "asof_pitcher_middle_rate", "r_ball": "asof_pitcher_ball_rate", "r_strk": "asof_pitcher_strike_rate", "r_rev": "asof_pitcher_reverse_rate",
    "r_prev1": "asof_pitcher_prev1_game_success_rate", "r_prev3": "asof_pitcher_prev3_game_success_rate", "r_prev5": "asof_pitcher_prev5_game_success_rate", "r_bsucc": "asof_batter_success_rate", "r_bmid": "asof_batter_middle_rate",
    "r_fast": "asof_pitcher_fastball_rate", "r_brk": "asof_pitcher_breaking_rate", "r_off": "asof_pitcher_offspeed_rate",
}
PLAIN = {
    "row_id": "row_id", "a": "pitcher_id", "na": "asof_pitcher_n", "period": "season", "month": "game_month", "dow": "game_dayofweek", "inning": "inning", "side": "top_bottom", "seg": "game_type", "balls": "balls_before", "strikes": "strikes_before",
    "outs": "outs_before", "on1": "runner_on_1b", "on2": "runner_on_2b", "on3": "runner_on_3b", "runners": "num_runners_on", "margin": "score_diff_pitcher_team", "b": "batter_id", "nb": "asof_batter_n", "nmix": "asof_pitcher_pitchmix_n", "ahand": "pitcher_hand", "bhand": "batter_hand",
    "ateam": "pitcher_team_id", "li": "li", "we": "home_win_expectancy", "y": "control_success",
}
BLOCK = 512

TRIALS = f"""
WITH t AS (SELECT {', '.join(f'{c} AS {n}' for n, c in PLAIN.items())}, {', '.join(f'CASE WHEN {c} BETWEEN 0 AND 1 THEN {c} END AS {n}' for n, c in RATES.items())}, balls_before * 3 + strikes_before AS ctx
  FROM (SELECT *, row_number() OVER (PARTITION BY pitcher_id, asof_pitcher_n ORDER BY loaded_at DESC) AS rn FROM train) WHERE rn = 1)"""


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """One row per pitch, in roles."""
    rows = table(spark, folder, "train").select(*PLAIN.values(), *RATES.values(), "loaded_at")
    rows = latest(rows, "pitcher_id", "asof_pitcher_n", "loaded_at", BLOCK)
    return rows.select(*[F.col(c).alias(n) for n, c in PLAIN.items()], *[share(F.col(c)).alias(n) for n, c in RATES.items()], (F.col("balls_before") * 3 + F.col("strikes_before")).alias("ctx"))


K_A, K_C = 200.0, 500.0

#: pr: scored trials (y known, not of the first period) with two members and their blend.
PRED = TRIALS + """,
u AS (SELECT * FROM t WHERE y IS NOT NULL),
pa AS (SELECT a, period, sum(y) AS s, count(*) AS n FROM u GROUP BY ALL),
pg AS (SELECT period, sum(s) AS s, sum(n) AS n FROM pa GROUP BY ALL),
g AS (SELECT period, sum(s) OVER (ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DOUBLE / sum(n) OVER (ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rate FROM pg),
qa AS (SELECT a, period, sum(s) OVER w AS s, sum(n) OVER w AS n FROM pa WINDOW w AS (PARTITION BY a ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pc AS (SELECT ctx, period, sum(y) AS s, count(*) AS n FROM u GROUP BY ALL),
qc AS (SELECT ctx, period, sum(s) OVER w AS s, sum(n) OVER w AS n FROM pc WINDOW w AS (PARTITION BY ctx ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pr AS (SELECT u.*, (coalesce(qa.s, 0) + 200.0::DOUBLE * g.rate) / (coalesce(qa.n, 0) + 200.0::DOUBLE) AS p1, (coalesce(qc.s, 0) + 500.0::DOUBLE * g.rate) / (coalesce(qc.n, 0) + 500.0::DOUBLE) AS p2
  FROM u JOIN g ON g.period = u.period AND g.rate IS NOT NULL JOIN qa ON qa.a = u.a AND qa.period = u.period JOIN qc ON qc.ctx = u.ctx AND qc.period = u.period),
pp AS (SELECT *, 0.3::DOUBLE * p1 + 0.7::DOUBLE * p2 AS p FROM pr)"""


def before(cells: DataFrame, keys: list[str], sums: list[str], period: str = "period") -> DataFrame:
    """cells (keys, period, sums) with each sum over the strictly earlier periods instead of its own."""
    w = Window.partitionBy(*keys).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    return cells.select(*keys, period, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(s) for s in sums])


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Scored trials with members p1 (entity), p2 (context) and blend p, all from earlier periods only."""
    u = trials(spark, folder).filter(F.col("y").isNotNull())
    pa = u.groupBy("a", "period").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    pc = u.groupBy("ctx", "period").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    pg = pc.groupBy("period").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    line = Window.orderBy("period").rangeBetween(Window.unboundedPreceding, -1)  # one row per period
    g = pg.select(F.col("period").alias("gp"), (F.sum("s").over(line) / F.sum("n").over(line)).alias("rate")).filter(F.col("rate").isNotNull())
    qa = before(pa, ["a"], ["s", "n"]).select(F.col("a").alias("qa"), F.col("period").alias("qap"), F.col("s").alias("sa"), F.col("n").alias("nn"))
    qc = before(pc, ["ctx"], ["s", "n"]).select(F.col("ctx").alias("qc"), F.col("period").alias("qcp"), F.col("s").alias("sc"), F.col("n").alias("nc"))
    out = u.join(g, F.col("period") == F.col("gp")).join(qa, (F.col("a") == F.col("qa")) & (F.col("period") == F.col("qap"))).join(qc, (F.col("ctx") == F.col("qc")) & (F.col("period") == F.col("qcp")))
    out = out.withColumn("p1", (F.col("sa") + K_A * F.col("rate")) / (F.col("nn") + K_A)).withColumn("p2", (F.col("sc") + K_C * F.col("rate")) / (F.col("nc") + K_C))
    return out.withColumn("p", 0.3 * F.col("p1") + 0.7 * F.col("p2")).drop("gp", "rate", "qa", "qap", "sa", "nn", "qc", "qcp", "sc", "nc")
