"""The search for slices with systematic error on eleven derived axes (survey B13, B14, C11 and K27 to K31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.functions import scalars as S
from pastglass.operators import slices as L
from pastglass.operators import state as T
from pastglass.plans.rowlocal import KEY, r6
from pastglass.plans.trials import PRED, before, predictions, trials
from pastglass.sources.tables import cut

AXES = ["game_type", "pitcher_history", "batter_history", "matchup_novelty", "count_family", "hand_matchup", "inning_phase", "base_state", "two_outs", "pitcher_state", "batter_state"]
PAIRS = [("game_type", "pitcher_history"), ("game_type", "batter_history"), ("count_family", "pitcher_history"), ("count_family", "batter_history"), ("hand_matchup", "count_family"), ("inning_phase", "game_type")]
#: Seasons whose slices must agree, and least shares of a single slice and of a pair.
BOTH, SHARE, PAIR_SHARE = (2022, 2024), 0.02, 0.01
#: What a pair must add to the better of its parents, and how many slices are resampled how often.
MATERIAL, TOP, REPS = 0.001, 10, 500
EDGES, NAMES = [-1, 0, 20, 100, 500, float("inf")], ["0", "1_20", "21_100", "101_500", "500_plus"]


def family() -> Column:
    """Five families of counts, the first that holds."""
    b, s = F.col("balls"), F.col("strikes")
    return S.first_match([(b == 3, "three_ball"), (s == 2, "two_strike"), (b > s, "batter_ahead"), (b == s, "even")], "pitcher_ahead")


def framed(spark: SparkSession, folder: str) -> DataFrame:
    """Scored trials with the eleven axes and err, the blend's squared error."""
    t, pr = trials(spark, folder), predictions(spark, folder)
    cells = t.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b", "period").agg(F.count("*").alias("met"))
    met = before(cells, ["a", "b"], ["met"]).select(F.col("a").alias("ma"), F.col("b").alias("mb"), F.col("period").alias("mp"), "met")
    pr = pr.join(met, (F.col("a") == F.col("ma")) & (F.col("b") == F.col("mb")) & (F.col("period") == F.col("mp")), "left").drop("ma", "mb", "mp")
    for e, n, rate in (("a", "na", "r_succ"), ("b", "nb", "r_bsucc")):
        state = T.prior_state(t, e, "period", n, [rate]).withColumnRenamed("was_0", f"was_{e}")
        pr = T.with_state(pr, state, e, "period").withColumn(f"seen_{e}", F.when(F.col(n) - F.col(f"was_{e}.n0") > 0, "yes").otherwise("no")).drop(f"was_{e}")
    bucket = lambda n: S.right_closed(F.coalesce(F.col(n), F.lit(0)), EDGES, NAMES)
    known = F.coalesce(F.col("met"), F.lit(0))
    risp = (F.coalesce("on2", F.lit(0)) != 0) | (F.coalesce("on3", F.lit(0)) != 0)
    axes = {
        "game_type": F.coalesce(F.col("seg"), F.lit("nan")), "pitcher_history": bucket("na"), "batter_history": bucket("nb"),
        "matchup_novelty": S.first_match([(known == 0, "unseen"), (known <= 5, "low_1_5")], "established"), "count_family": family(),
        "hand_matchup": F.when(F.col("ahand").eqNullSafe(F.col("bhand")), "same").otherwise("opposite"),
        "inning_phase": S.first_match([(F.col("inning") <= 3, "early"), (F.col("inning") <= 6, "middle"), (F.col("inning") <= 9, "late")], "extras"),
        "base_state": S.first_match([(F.coalesce("runners", F.lit(0)) == 0, "empty"), (risp, "RISP")], "runner_non_RISP"),
        "two_outs": F.when(F.col("outs") == 2, "yes").otherwise("no"), "pitcher_state": F.col("seen_a"), "batter_state": F.col("seen_b"),
    }
    return pr.select(*KEY, "period", "p", "y", *[v.alias(k) for k, v in axes.items()], F.pow(F.col("p") - F.col("y"), 2).alias("err"))


def scanned(rows: DataFrame, pairs: list[tuple[str, str]] | bool = False) -> DataFrame:
    """Every slice with its size, share, means, excess of error over the season's and calibration error."""
    cells = L.scan(rows, AXES, {"mean_y": F.col("y"), "mean_p": F.col("p"), "brier": F.col("err")}, "period", pairs)
    base = rows.groupBy("period").agg(F.avg("err").alias("base")).withColumnRenamed("period", "bp")
    return cells.join(F.broadcast(base), F.col("period") == F.col("bp")).withColumn("excess", F.col("brier") - F.col("base")).withColumn("bias", F.col("mean_y") - F.col("mean_p"))  # one row for each season


def ranked(cells: DataFrame, least: float) -> DataFrame:
    """(axis, value, score, same, widest) of the slices that are large enough and worse than all rows in both seasons."""
    one, two = BOTH
    wide = cells.groupBy("axis", "value").pivot("period", list(BOTH)).agg(F.max("share").alias("share"), F.max("excess").alias("excess"), F.max("bias").alias("bias"))
    good = wide.filter(f"`{one}_share` >= {least} AND `{two}_share` >= {least} AND `{one}_excess` > 0 AND `{two}_excess` > 0")
    return good.select("axis", "value", F.least(f"{one}_excess", f"{two}_excess").alias("score"), (F.signum(f"{one}_bias") == F.signum(f"{two}_bias")).alias("same"), F.greatest(F.abs(f"{one}_bias"), F.abs(f"{two}_bias")).alias("widest"))


def judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(singles, pairs) ranked; pairs with the better score of their parents, null where neither qualifies, and whether they add to it."""
    single, pair = ranked(scanned(rows), SHARE), ranked(scanned(rows, PAIRS), PAIR_SHARE)
    parent = single.select(F.col("axis").alias("pa"), F.col("value").alias("pv"), F.col("score").alias("ps"))
    pair = pair.withColumn("a", F.split("axis", "\\*")).withColumn("v", F.split("value", "\\*"))
    for i in (0, 1):
        side = parent.select(*[F.col(c).alias(f"{c}{i}") for c in parent.columns])
        pair = pair.join(side, (F.col("a")[i] == F.col(f"pa{i}")) & (F.col("v")[i] == F.col(f"pv{i}")), "left")
    best = F.greatest("ps0", "ps1")
    return single, pair.select("axis", "value", "score", "same", "widest", best.alias("parent"), F.coalesce(F.col("score") > best + MATERIAL, F.lit(True)).alias("adds"))


def kind() -> Column:
    """Whether the error is one of level, of discrimination, or both, by the squared bias against the common excess."""
    sq = F.col("widest") * F.col("widest")
    return F.when(sq > 0.5 * F.col("score"), F.when(F.col("score") > sq, "BOTH").otherwise("CALIBRATION")).otherwise("DISCRIMINATION")


def chosen(rows: DataFrame) -> DataFrame:
    """The slices with the same sign of bias in both seasons, pairs only if they add to their parents."""
    single, pair = judged(rows)
    return single.filter("same").select("axis", "value", "score", "widest").unionByName(pair.filter("same AND adds").select("axis", "value", "score", "widest"))


def k27_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every level of the eleven axes in each season: size, share, means, error and excess."""
    cells = scanned(framed(spark, folder))
    return cells.select("period", "axis", "value", "n", *[r6(c).alias(c) for c in ("share", "mean_y", "mean_p", "brier", "excess")])


def k28_stable(spark: SparkSession, folder: str) -> DataFrame:
    """Single slices of 2 % of the rows or more that are worse than all rows in both seasons, with their common score."""
    return ranked(scanned(framed(spark, folder)), SHARE).select("axis", "value", r6("score").alias("score"), "same")


def k29_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of 1 % or more that are worse in both seasons, with the better score of their parents and whether they add to it."""
    return judged(cut(framed(spark, folder)))[1].select("axis", "value", r6("score").alias("score"), "same", r6("parent").alias("parent"), "adds")


def k30_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of the ten best slices in both seasons (a top-k report), and whether all of a slice lie above zero."""
    rows = cut(framed(spark, folder).filter(F.col("period").isin(*BOTH)))
    top = [(r["axis"].split("*"), r["value"].split("*")) for r in chosen(rows).orderBy(F.col("score").desc(), "axis", "value").limit(TOP).collect()]
    masks = {" & ".join(f"{a}={v}" for a, v in zip(*names)): F.lit(True) for names in top}
    for names in top:
        cond = F.lit(True)
        for a, v in zip(*names):
            cond = cond & (F.col(a) == v)
        masks[" & ".join(f"{a}={v}" for a, v in zip(*names))] = cond
    out = L.bootstrap(rows, ["period"], masks or {"none": F.lit(False)}, F.col("err"), REPS, 42)
    stable = out.groupBy("mask").agg((F.bool_and(F.col("lo") > 0) & (F.count("*") == 2)).alias("stable")).withColumnRenamed("mask", "sm")
    return out.join(stable, F.col("mask") == F.col("sm")).select("period", F.col("mask").alias("slice"), *[r6(c).alias(c) for c in ("excess", "lo", "hi")], "stable")


def k31_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen slices with the kind of their error."""
    return chosen(cut(framed(spark, folder))).select("axis", "value", r6("score").alias("score"), kind().alias("kind"))


def c11_signs(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of game type and count family whose mean residual has one sign and at least 0.005 in size in both seasons."""
    cells = framed(spark, folder).filter(F.col("period").isin(*BOTH)).groupBy("game_type", "count_family").pivot("period", list(BOTH)).agg(F.avg(F.col("y") - F.col("p")))
    x, y = (F.col(f"`{s}`") for s in BOTH)
    return cells.filter((F.signum(x) == F.signum(y)) & (F.abs(x) >= 0.005) & (F.abs(y) >= 0.005)).select("game_type", "count_family", r6(x).alias("first"), r6(y).alias("second"))


_bucket = lambda n: f"CASE WHEN coalesce({n}, 0) <= 0 THEN '0' WHEN {n} <= 20 THEN '1_20' WHEN {n} <= 100 THEN '21_100' WHEN {n} <= 500 THEN '101_500' ELSE '500_plus' END"
FRAME = f"""{PRED},
mc AS (SELECT a, b, period, count(*) AS k FROM t WHERE b IS NOT NULL GROUP BY ALL), mw AS (SELECT a, b, period, coalesce(sum(k) OVER (PARTITION BY a, b ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS met FROM mc),
sa AS (SELECT a, period, max(na) AS m FROM t GROUP BY ALL), wa AS (SELECT a, period, max(m) OVER (PARTITION BY a ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n0 FROM sa),
sb AS (SELECT b, period, max(nb) AS m FROM t WHERE b IS NOT NULL GROUP BY ALL), wb AS (SELECT b, period, max(m) OVER (PARTITION BY b ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n0 FROM sb),
fr AS (SELECT pp.a, pp.na, pp.period, p, y, pow(p - y, 2) AS err, coalesce(seg, 'nan') AS game_type, {_bucket('na')} AS pitcher_history, {_bucket('nb')} AS batter_history,
  CASE WHEN coalesce(met, 0) = 0 THEN 'unseen' WHEN met <= 5 THEN 'low_1_5' ELSE 'established' END AS matchup_novelty,
  CASE WHEN balls = 3 THEN 'three_ball' WHEN strikes = 2 THEN 'two_strike' WHEN balls > strikes THEN 'batter_ahead' WHEN balls = strikes THEN 'even' ELSE 'pitcher_ahead' END AS count_family,
  CASE WHEN ahand IS NOT DISTINCT FROM bhand THEN 'same' ELSE 'opposite' END AS hand_matchup,
  CASE WHEN inning <= 3 THEN 'early' WHEN inning <= 6 THEN 'middle' WHEN inning <= 9 THEN 'late' ELSE 'extras' END AS inning_phase,
  CASE WHEN coalesce(runners, 0) = 0 THEN 'empty' WHEN coalesce(on2, 0) <> 0 OR coalesce(on3, 0) <> 0 THEN 'RISP' ELSE 'runner_non_RISP' END AS base_state,
  CASE WHEN outs = 2 THEN 'yes' ELSE 'no' END AS two_outs, CASE WHEN na - wa.n0 > 0 THEN 'yes' ELSE 'no' END AS pitcher_state, CASE WHEN nb - wb.n0 > 0 THEN 'yes' ELSE 'no' END AS batter_state
  FROM pp LEFT JOIN mw ON mw.a = pp.a AND mw.b = pp.b AND mw.period = pp.period LEFT JOIN wa ON wa.a = pp.a AND wa.period = pp.period LEFT JOIN wb ON wb.b = pp.b AND wb.period = pp.period),
bs AS (SELECT period, avg(err) AS base FROM fr GROUP BY period)"""
_axis = " UNION ALL ".join(f"SELECT period, '{a}' AS axis, {a} AS value, y, p, err FROM fr" for a in AXES)
_pair = " UNION ALL ".join(f"SELECT period, '{a}*{b}' AS axis, {a} || '*' || {b} AS value, y, p, err FROM fr" for a, b in PAIRS)
_cells = lambda name, rows: f"{name} AS (SELECT *, n / sum(n) OVER (PARTITION BY period, axis) AS share FROM (SELECT x.period, axis, value, count(*) AS n, avg(y) AS mean_y, avg(p) AS mean_p, avg(err) AS brier, avg(err) - max(base) AS excess, avg(y) - avg(p) AS bias FROM ({rows}) x JOIN bs ON bs.period = x.period GROUP BY ALL))"
_rank = lambda name, cells, least: f"{name} AS (SELECT axis, value, min(excess) AS score, min(sign(bias)) = max(sign(bias)) AS same, max(abs(bias)) AS widest FROM {cells} WHERE period IN (2022, 2024) GROUP BY ALL HAVING count(*) = 2 AND min(share) >= {least} AND min(excess) > 0)"
_all = f"""{FRAME}, {_cells('sc', _axis)}, {_cells('pcl', _pair)}, {_rank('sr', 'sc', SHARE)}, {_rank('pk', 'pcl', PAIR_SHARE)},
pj AS (SELECT k.*, greatest(x.score, z.score) AS parent, coalesce(k.score > greatest(x.score, z.score) + 0.001, true) AS adds FROM pk k LEFT JOIN sr x ON x.axis = split_part(k.axis, '*', 1) AND x.value = split_part(k.value, '*', 1) LEFT JOIN sr z ON z.axis = split_part(k.axis, '*', 2) AND z.value = split_part(k.value, '*', 2)),
ch AS (SELECT axis, value, score, widest FROM sr WHERE same UNION ALL SELECT axis, value, score, widest FROM pj WHERE same AND adds)"""
SQL = {
    "k27_scan": f"{FRAME}, {_cells('sc', _axis)} SELECT period, axis, value, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('share', 'mean_y', 'mean_p', 'brier', 'excess'))} FROM sc",
    "k28_stable": f"{_all} SELECT axis, value, round(score, 6) AS score, same FROM sr",
    "k29_pairs": f"{_all} SELECT axis, value, round(score, 6) AS score, same, round(parent, 6) AS parent, adds FROM pj",
    "k31_labels": f"{_all} SELECT axis, value, round(score, 6) AS score, CASE WHEN widest * widest > 0.5 * score THEN CASE WHEN score > widest * widest THEN 'BOTH' ELSE 'CALIBRATION' END ELSE 'DISCRIMINATION' END AS kind FROM ch",
    "c11_signs": f"{FRAME}, c AS (SELECT game_type, count_family, avg(CASE WHEN period = 2022 THEN y - p END) AS x, avg(CASE WHEN period = 2024 THEN y - p END) AS z FROM fr GROUP BY ALL) SELECT game_type, count_family, round(x, 6) AS first, round(z, 6) AS second FROM c WHERE sign(x) = sign(z) AND abs(x) >= 0.005 AND abs(z) >= 0.005",
}
QUERIES = {f.__name__: f for f in (k27_scan, k28_stable, k29_pairs, k30_bootstrap, k31_labels, c11_signs)}
