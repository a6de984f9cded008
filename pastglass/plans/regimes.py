"""Shift of every column of train between three pairs of seasons (survey K12 to K15), and what tells a season apart (K34)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.operators import metrics as M
from pastglass.operators.deliveries import latest
from pastglass.operators.profile import quantiles
from pastglass.plans.rowlocal import r6
from pastglass.plans.trials import BLOCK
from pastglass.sources.tables import cut, table

PAIRS = [(2022, 2023), (2023, 2024), (2022, 2024)]
#: A column of numbers is numeric with more distinct values than this, else categorical.
FEW = 20
TEXTS = ["top_bottom", "game_type", "base_state"]
NUMBERS = """game_month game_dayofweek inning balls_before strikes_before outs_before run_top_before run_bot_before run_total_before score_diff_home score_diff_pitcher_team
runner_on_1b runner_on_2b runner_on_3b num_runners_on pitcher_id batter_id pitcher_hand batter_hand pitcher_team_id batter_team_id asof_pitcher_n asof_batter_n asof_pitcher_pitchmix_n
home_win_expectancy away_win_expectancy li asof_pitcher_success_rate asof_pitcher_reverse_rate asof_pitcher_middle_rate asof_pitcher_ball_rate asof_pitcher_strike_rate
asof_pitcher_prev1_game_success_rate asof_pitcher_prev3_game_success_rate asof_pitcher_prev5_game_success_rate asof_pitcher_prev1_game_middle_rate asof_pitcher_prev3_game_middle_rate asof_pitcher_prev5_game_middle_rate
asof_batter_success_rate asof_batter_middle_rate asof_pitcher_fastball_rate asof_pitcher_breaking_rate asof_pitcher_offspeed_rate""".split()  # fmt: skip


def finite(c: str) -> Column:
    """c as a double, null where it is no finite number."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """(feature, kind, num, txt, s2022, s2023, s2024): how often each value of each column occurs, in one aggregation."""
    rows = latest(table(spark, folder, "train").select("season", *TEXTS, *NUMBERS, "loaded_at"), "pitcher_id", "asof_pitcher_n", "loaded_at", BLOCK)
    one = [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("num"), F.col(c).alias("txt")) for c in TEXTS]
    one += [F.struct(F.lit(c).alias("feature"), finite(c).alias("num"), F.when(finite(c).isNotNull(), F.col(c).cast("string")).alias("txt")) for c in NUMBERS]
    long = rows.select("season", F.explode(F.array(*one)).alias("x")).select("season", "x.*")
    counts = long.groupBy("feature", "num", "txt").agg(*[F.sum((F.col("season") == y).cast("long")).alias(f"s{y}") for y in (2022, 2023, 2024)])
    kinds = counts.groupBy("feature").agg((F.count_distinct("num") > FEW).alias("numeric")).select(F.col("feature").alias("kf"), "numeric")
    return counts.join(F.broadcast(kinds), F.col("feature") == F.col("kf")).drop("kf")  # one row for each column


def paired(counts: DataFrame) -> DataFrame:
    """counts for each pair of seasons: from_season, to_season, l, r."""
    sides = F.array(*[F.struct(F.lit(a).alias("from_season"), F.lit(b).alias("to_season"), F.col(f"s{a}").alias("l"), F.col(f"s{b}").alias("r")) for a, b in PAIRS])
    return counts.withColumn("x", F.explode(sides)).select("feature", "x.from_season", "x.to_season", "num", F.coalesce("txt", F.lit("__NA__")).alias("name"), "x.l", "x.r")


KEYS = ["feature", "from_season", "to_season"]


def numeric_shift(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each numeric column and pair: ks, psi, means, medians and missing shares."""
    both = cut(paired(cells(spark, folder).filter("numeric")))  # counts of values, read five times
    given = both.filter("num IS NOT NULL")
    out = M.two_sample_ks(given, KEYS, "num", "l", "r").join(M.stability_index(given, KEYS, "num", "l", "r"), KEYS)
    for side, name in (("l", "from"), ("r", "to")):
        middle = quantiles(given, KEYS, "num", [0.5], "q", side).select(*KEYS, F.col("q")[0].alias(f"median_{name}"))
        out = out.join(middle, KEYS, "left")
    rest = both.groupBy(*KEYS).agg(*[a for side, name in (("l", "from"), ("r", "to")) for a in ((F.sum(F.col("num") * F.col(side)) / F.nullif(F.sum(F.when(F.col("num").isNotNull(), F.col(side))), F.lit(0))).alias(f"mean_{name}"), (F.sum(F.when(F.col("num").isNull(), F.col(side)).otherwise(0)) / F.nullif(F.sum(side), F.lit(0))).alias(f"missing_{name}"))])
    return out.join(rest, KEYS)


def categorical_shift(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each other column and pair: divergence, top category and unseen share; missing is a category."""
    both = cut(paired(cells(spark, folder).filter("NOT numeric")))
    return M.divergence(both, KEYS, "name", "l", "r")


def k12_ks(spark: SparkSession, folder: str) -> DataFrame:
    """Two-sample statistic, means, medians and missing shares of every numeric column for every pair of seasons."""
    return numeric_shift(spark, folder).select(*KEYS, *[r6(c).alias(c) for c in ("ks", "mean_from", "mean_to", "median_from", "median_to", "missing_from", "missing_to")])


def k13_psi(spark: SparkSession, folder: str) -> DataFrame:
    """Population stability index of every numeric column for every pair of seasons."""
    given = cut(paired(cells(spark, folder).filter("numeric")).filter("num IS NOT NULL"))
    return M.stability_index(given, KEYS, "num", "l", "r").select(*KEYS, r6("psi").alias("psi"))


def k14_js(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence, top category with its shares, and unseen share of every categorical column and pair."""
    return categorical_shift(spark, folder).select(*KEYS, "top_category", *[r6(c).alias(c) for c in ("js", "top_left", "top_right", "unseen")])


def k15_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Columns by how much 2023 differs from the seasons on both sides: the smaller shift less half of that across."""
    num = numeric_shift(spark, folder).select("feature", "from_season", "to_season", F.col("ks").alias("shift"), (F.col("mean_to") - F.col("mean_from")).alias("moved"), F.lit("numeric").alias("kind"))
    cat = categorical_shift(spark, folder).select("feature", "from_season", "to_season", F.col("js").alias("shift"), F.lit(None).cast("double").alias("moved"), F.lit("categorical").alias("kind"))
    at = lambda a, b, c: F.max(F.when((F.col("from_season") == a) & (F.col("to_season") == b), F.col(c)))
    out = num.unionByName(cat).groupBy("feature", "kind").agg(at(2022, 2023, "shift").alias("s1"), at(2023, 2024, "shift").alias("s2"), at(2022, 2024, "shift").alias("s3"), at(2022, 2023, "moved").alias("direction"))
    return out.select("feature", "kind", r6("s1").alias("shift_22_23"), r6("s2").alias("shift_23_24"), r6("s3").alias("shift_22_24"), r6(F.least("s1", "s2") - 0.5 * F.col("s3")).alias("specificity"), r6("direction").alias("direction_2023"))


_d = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pitcher_id, asof_pitcher_n ORDER BY loaded_at DESC) AS rn FROM train) WHERE rn = 1)"
_x = " UNION ALL ".join([f"SELECT season, '{c}' AS feature, NULL::DOUBLE AS num, {c} AS txt FROM d" for c in TEXTS] + [f"SELECT season, '{c}', CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END, CASE WHEN isfinite({c}::DOUBLE) THEN {c}::VARCHAR END FROM d" for c in NUMBERS])
_base = f"""WITH {_d}, x AS ({_x}), c AS (SELECT feature, num, txt, {', '.join(f'sum((season = {y})::INT)::DOUBLE AS s{y}' for y in (2022, 2023, 2024))} FROM x GROUP BY ALL),
k AS (SELECT feature, count(DISTINCT num) > {FEW} AS numeric FROM c GROUP BY feature),
b AS ({' UNION ALL '.join(f"SELECT feature, numeric, {a} AS from_season, {b} AS to_season, num, coalesce(txt, '__NA__') AS name, s{a} AS l, s{b} AS r FROM c JOIN k USING (feature)" for a, b in PAIRS)}),
g AS (SELECT * FROM b WHERE numeric AND num IS NOT NULL),
dd AS (SELECT feature, from_season, to_season, abs(sum(l) OVER w / nullif(sum(l) OVER p, 0) - sum(r) OVER w / nullif(sum(r) OVER p, 0)) AS d FROM (SELECT feature, from_season, to_season, num, sum(l) AS l, sum(r) AS r FROM g GROUP BY ALL) WINDOW w AS (PARTITION BY feature, from_season, to_season ORDER BY num), p AS (PARTITION BY feature, from_season, to_season)),
ks AS (SELECT feature, from_season, to_season, max(d) AS ks FROM dd GROUP BY ALL),
y AS (SELECT x.* FROM x JOIN k USING (feature) WHERE numeric),
st AS (SELECT feature, season, avg(num) AS mean, median(num) AS med, avg((num IS NULL)::INT) AS missing FROM y GROUP BY ALL),
ns AS (SELECT ks.*, f.mean AS mean_from, t.mean AS mean_to, f.med AS median_from, t.med AS median_to, f.missing AS missing_from, t.missing AS missing_to FROM ks JOIN st f ON f.feature = ks.feature AND f.season = from_season JOIN st t ON t.feature = ks.feature AND t.season = to_season),
w AS (SELECT feature, from_season, to_season, name, sum(l) AS l, sum(r) AS r FROM b WHERE NOT numeric GROUP BY ALL),
q AS (SELECT *, l / sum(l) OVER p AS pl, r / sum(r) OVER p AS pr FROM w WINDOW p AS (PARTITION BY feature, from_season, to_season)),
js AS (SELECT feature, from_season, to_season, sum((CASE WHEN pl > 0 THEN pl * ln(pl / ((pl + pr) / 2)) ELSE 0 END + CASE WHEN pr > 0 THEN pr * ln(pr / ((pl + pr) / 2)) ELSE 0 END) / 2) AS js, arg_min(name, (-l, name)) AS top_category, arg_min(pl, (-l, name)) AS top_left, arg_min(pr, (-l, name)) AS top_right, sum(CASE WHEN l = 0 THEN pr ELSE 0 END) AS unseen FROM q GROUP BY ALL)"""
_at = lambda a, b, c: f"max(CASE WHEN from_season = {a} AND to_season = {b} THEN {c} END)"
SQL = {
    "k12_ks": f"{_base} SELECT feature, from_season, to_season, {', '.join(f'round({c}, 6) AS {c}' for c in ('ks', 'mean_from', 'mean_to', 'median_from', 'median_to', 'missing_from', 'missing_to'))} FROM ns",
    "k13_psi": f"""{_base}, z AS ({' UNION ALL '.join(f"SELECT feature, {a} AS from_season, {b} AS to_season, season = {b} AS s, num FROM y WHERE season IN ({a}, {b}) AND num IS NOT NULL" for a, b in PAIRS)}),
e AS (SELECT feature, from_season, to_season, list_sort(list_distinct(quantile_cont(num, {[i / 10 for i in range(11)]}))) AS e FROM z GROUP BY ALL),
h AS (SELECT feature, from_season, to_season, len(e) AS n, greatest(least(len(list_filter(e[2:], lambda v: v <= num)), len(e) - 2), 0) AS bin, sum((NOT s)::INT)::DOUBLE AS l, sum(s::INT)::DOUBLE AS r FROM z JOIN e USING (feature, from_season, to_season) GROUP BY ALL),
u AS (SELECT feature, from_season, to_season, n, greatest(l / sum(l) OVER p, 1e-6) AS l, greatest(r / sum(r) OVER p, 1e-6) AS r FROM h WINDOW p AS (PARTITION BY feature, from_season, to_season))
SELECT feature, from_season, to_season, round(CASE WHEN max(n) < 3 THEN 0 ELSE sum((l - r) * ln(l / r)) END, 6) AS psi FROM u GROUP BY ALL""",
    "k14_js": f"{_base} SELECT feature, from_season, to_season, top_category, {', '.join(f'round({c}, 6) AS {c}' for c in ('js', 'top_left', 'top_right', 'unseen'))} FROM js",
    "k15_ranking": f"""{_base}, a AS (SELECT feature, 'numeric' AS kind, from_season, to_season, ks AS shift, mean_to - mean_from AS moved FROM ns UNION ALL SELECT feature, 'categorical', from_season, to_season, js, NULL FROM js),
o AS (SELECT feature, kind, {_at(2022, 2023, 'shift')} AS s1, {_at(2023, 2024, 'shift')} AS s2, {_at(2022, 2024, 'shift')} AS s3, {_at(2022, 2023, 'moved')} AS dir FROM a GROUP BY ALL)
SELECT feature, kind, round(s1, 6) AS shift_22_23, round(s2, 6) AS shift_23_24, round(s3, 6) AS shift_22_24, round(least(s1, s2) - 0.5 * s3, 6) AS specificity, round(dir, 6) AS direction_2023 FROM o""",
}
QUERIES = {f.__name__: f for f in (k12_ks, k13_psi, k14_js, k15_ranking)}
