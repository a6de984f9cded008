"""Scores, calibration, blends and tests on the scored trials (survey groups J and K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.functions import scalars as S
from pastglass.operators import calibrate as C
from pastglass.operators import metrics as M
from pastglass.operators.slices import masked
from pastglass.operators.state import extrapolated
from pastglass.plans.rowlocal import KEY, r6
from pastglass.plans.trials import PRED, predictions, trials



def _py() -> tuple[Column, Column]:
    return F.col("p"), F.col("y")


def masks() -> dict[str, Column]:
    """Overlapping groups of trials."""
    return {"all": F.lit(True), "regular": F.col("seg") == "R", "other": F.col("seg") == "F", "two_strikes": F.col("strikes") == 2, "full": F.col("ctx") == 11}


def k1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the blend by season and overlapping group."""
    p, y = _py()
    rows = masked(predictions(spark, folder), masks())
    return rows.groupBy("period", "mask").agg(F.count("*").alias("n"), r6(M.brier(p, y)).alias("brier"), F.round(M.skill(p, y), 4).alias("skill"), F.round(F.greatest(M.skill(p, y), F.lit(0.0)), 4).alias("skill_floor"), r6(M.log_loss(p, y)).alias("log_loss"), F.round(M.skill_gain(F.col("p1"), p, y), 4).alias("gain_p1"))


def k6_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Area under the curve by season, ties at half."""
    return M.auc(predictions(spark, folder).withColumn("q", r6("p")), ["period"], "q", "y").select("period", r6("auc").alias("auc"))


def k7_ece(spark: SparkSession, folder: str) -> DataFrame:
    """Expected calibration error by season."""
    return M.expected_error(M.calibration(predictions(spark, folder), ["period"], "p", "y"), ["period"]).select("period", r6("ece").alias("ece"))


def k8_reliability(spark: SparkSession, folder: str) -> DataFrame:
    """The reliability table with its empty bins."""
    return M.calibration(predictions(spark, folder), ["period"], "p", "y").select("period", "bin", "n", r6("mean_p").alias("mean_p"), r6("mean_y").alias("mean_y"))


def k9_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Noise floor, paired noise and z of the blend against its first member, and whether all seasons improve."""
    p, y = _py()
    by = predictions(spark, folder).groupBy("period").agg(F.round(M.noise_floor(F.col("p1"), p), 4).alias("floor"), F.round(M.two_sigma_gain(F.col("p1"), p, y), 4).alias("two_sigma"), F.round(M.paired_z(F.col("p1"), p, y), 4).alias("z"), F.round(M.skill_gain(F.col("p1"), p, y), 4).alias("gain"))
    verdict = by.agg(F.bool_and(F.col("gain") > 0).alias("all_gain"), F.bool_and(F.col("gain") > F.col("two_sigma")).alias("all_clear"))
    return by.crossJoin(F.broadcast(verdict))  # one row


def k22_oracle(spark: SparkSession, folder: str) -> DataFrame:
    """Best member per row, in hindsight: the bound of any routing, with the members' spread and correlations."""
    p, y = _py()
    pr = predictions(spark, folder)
    best = F.when(y == 1, F.greatest("p1", "p2")).otherwise(F.least("p1", "p2"))
    return pr.groupBy("period").agg(r6(M.brier(best, y)).alias("bound"), F.round(M.skill_gain(p, best, y), 4).alias("gain"), r6(F.avg(F.abs(F.col("p1") - F.col("p2")) / 2)).alias("spread"), r6(F.corr("p1", "p2")).alias("corr"), r6(F.corr(F.col("p2") - p, y - p)).alias("residual_corr"))


def k43_change(spark: SparkSession, folder: str) -> DataFrame:
    """How far the blend lies from its second member."""
    p, y = _py()
    d = p - F.col("p2")
    return predictions(spark, folder).groupBy("period").agg(r6(F.avg(d)).alias("mean_shift"), r6(F.max(F.abs(d))).alias("max_abs"), F.round(M.noise_floor(F.col("p2"), p), 4).alias("floor"))


def j1_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Scale and bias of the least Brier score on a grid, refined once, for each season; edge: on the edge of the grid."""
    best = C.grid_fit(predictions(spark, folder), "period", "p", "y")
    return best.select("period", F.round("scale", 4).alias("scale"), F.round("bias", 4).alias("bias"), r6("loss").alias("loss"), "edge")


def j2_chained(spark: SparkSession, folder: str) -> DataFrame:
    """Each season scored with the calibration fitted on the season before."""
    p, y = _py()
    pr = predictions(spark, folder)
    return C.chained(pr, C.grid_fit(pr, "period", "p", "y"), "period", "p", "p_cal").groupBy("period").agg(r6(M.brier(F.col("p_cal"), y)).alias("brier"), r6(F.avg("p_cal")).alias("mean_p"))


def j3_shift(spark: SparkSession, folder: str) -> DataFrame:
    """The logit shift that brings each season's mean prediction to its outcome rate."""
    return C.level_shift(predictions(spark, folder), ["period"], "p", "y").select("period", r6("shift").alias("shift"))


def j2_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each season and segment scored with the calibration fitted on the same segment of the season before."""
    pr = predictions(spark, folder)
    fits = C.grid_fit(pr, "period", "p", "y", ["seg"])
    return C.chained(pr, fits, "period", "p", "p_cal", ["seg"]).groupBy("period", "seg").agg(r6(M.brier(F.col("p_cal"), F.col("y"))).alias("brier"), r6(F.avg("p_cal")).alias("mean_p"))


def j4_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Each season calibrated as the season before, then moved to the outcome rate forecast from earlier seasons alone."""
    pr = predictions(spark, folder)
    fits = C.grid_fit(pr, "period", "p", "y")
    rates = extrapolated(trials(spark, folder).groupBy("period").agg(F.avg("y").alias("rate")), "period", "rate")
    shifts = C.drift_shift(pr, fits, rates, "period", "p", "y")
    moved = C.chained(pr, fits, "period", "p", "q", None, shifts).join(shifts.select(F.col("period").alias("sp"), "shift"), F.col("period") == F.col("sp"), "left")
    return moved.groupBy("period").agg(F.round(F.max(F.coalesce("shift", F.lit(0.0))), 5).alias("shift"), r6(M.brier(F.col("q"), F.col("y"))).alias("brier"), F.round(F.avg("q"), 5).alias("mean_p"))


def j6_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Members calibrated, blended by group, and calibrated again, by a spec."""
    spec = C.Blend(members={"p1": (1.1, 0.02), "p2": (0.9, -0.01)}, weights={"p1": 0.6, "p2": 0.4}, after=(1.05, 0.0))
    return predictions(spark, folder).select(*KEY, r6(C.blended(spec)).alias("p_blend"))


def j10_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Brier score of every blend weight, in one pass, and the vertex of the parabola through three of them."""
    return C.sweep(predictions(spark, folder), "period", "p1", "p2", "y", [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]).select("period", "weight", r6("brier").alias("brier"))


def j13_vertex(spark: SparkSession, folder: str) -> DataFrame:
    """Weight at the vertex through the scores at 0, 0.5 and 1."""
    return C.vertex(C.sweep(predictions(spark, folder), "period", "p1", "p2", "y", [0.0, 0.5, 1.0]), "period", (0.0, 0.5, 1.0)).select("period", F.round("vertex", 4).alias("vertex"))


_lo = lambda p: f"least(greatest({p}, 1e-6), 1 - 1e-6)"
_rc = lambda p, s, b: f"1 / (1 + exp(-(ln({_lo(p)} / (1 - {_lo(p)})) * {s} + {b})))"
_noise = lambda a, b: f"round(2e5 * sqrt(sum(pow({a} - {b}, 2))) / (count(*) * 0.2498::DOUBLE), 4)"
_gain = lambda a, b: f"round(1e5 * (avg(pow({a} - y, 2)) - avg(pow({b} - y, 2))) / nullif(avg(y) * (1 - avg(y)), 0), 4)"
_masks = " UNION ALL ".join(f"SELECT '{n}' AS mask, * FROM pp WHERE {c}" for n, c in (("all", "true"), ("regular", "seg = 'R'"), ("other", "seg = 'F'"), ("two_strikes", "strikes = 2"), ("full", "ctx = 11")))
_cal = f"{PRED}, c AS (SELECT period, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM pp GROUP BY ALL)"
_s1, _b1 = [round(0.2 + 0.05 * i, 4) for i in range(37)], [round(-0.3 + 0.025 * i, 4) for i in range(25)]


def fit_sql(rows: str, keys: str, name: str = "m2") -> str:
    """CTEs of the grid fit of `rows` (keys, p, y) by `keys`; the last, `name`, has keys, scale, bias, loss and edge."""
    return f"""{name}c AS (SELECT {keys}, ln({_lo('p')} / (1 - {_lo('p')})) AS z, count(*) AS n, sum(y)::DOUBLE AS s FROM {rows} GROUP BY ALL), {name}g AS (SELECT unnest({_s1}::DOUBLE[]) AS scale), {name}h AS (SELECT unnest({_b1}::DOUBLE[]) AS bias),
{name}l AS (SELECT {keys}, scale, bias, 1 / (1 + exp(-(z * scale + bias))) AS q, n, s FROM {name}c, {name}g, {name}h), {name}f AS (SELECT {keys}, scale, bias, sum(n * q * q - 2 * q * s + s) / sum(n) AS loss FROM {name}l GROUP BY ALL),
{name}m AS (SELECT * FROM {name}f QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(loss, 12), scale, bias) = 1),
{name}r AS (SELECT * REPLACE (scale + 0.005::DOUBLE * i AS scale, bias + 0.0025::DOUBLE * j AS bias) FROM {name}m, range(-10, 11) a(i), range(-10, 11) b(j)),
{name}k AS (SELECT {keys}, scale, bias, 1 / (1 + exp(-(z * scale + bias))) AS q, n, s FROM {name}r JOIN {name}c USING ({keys})), {name}e AS (SELECT {keys}, scale, bias, sum(n * q * q - 2 * q * s + s) / sum(n) AS loss FROM {name}k GROUP BY ALL),
{name} AS (SELECT *, NOT (round(scale, 9) > 0.26 AND round(scale, 9) < 1.94 AND round(bias, 9) > -0.27 AND round(bias, 9) < 0.27) AS edge FROM {name}e QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(loss, 12), scale, bias) = 1)"""


def shift_sql(rows: str, keys: str, name: str = "sh") -> str:
    """CTEs of the level shift of `rows` (keys, z, goal) by bisection; the last, `name`, has keys and shift."""
    same = " AND ".join(f"x.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    return f"""{name}b({keys}, lo, hi, k) AS (SELECT DISTINCT {keys}, -8::DOUBLE, 8::DOUBLE, 0 FROM {rows}
UNION ALL SELECT {own}, CASE WHEN avg(1 / (1 + exp(-(x.z + (b.lo + b.hi) / 2)))) < max(x.goal) THEN (b.lo + b.hi) / 2 ELSE b.lo END, CASE WHEN avg(1 / (1 + exp(-(x.z + (b.lo + b.hi) / 2)))) < max(x.goal) THEN b.hi ELSE (b.lo + b.hi) / 2 END, b.k + 1
  FROM {name}b b JOIN {rows} x ON {same} WHERE b.k < 46 GROUP BY {own}, b.lo, b.hi, b.k),
{name} AS (SELECT {keys}, (lo + hi) / 2 AS shift FROM {name}b WHERE k = 46)"""


_fit = f"{PRED}, {fit_sql('pp', 'period')}"
_z = lambda p: f"ln({_lo(p)} / (1 - {_lo(p)}))"
_rec = PRED.replace("WITH", "WITH RECURSIVE", 1)
SQL = {
    "k1_scores": f"{PRED}, m AS ({_masks}) SELECT period, mask, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(1e5 * (1 - avg(pow(p - y, 2)) / nullif(avg(y) * (1 - avg(y)), 0)), 4) AS skill, round(greatest(1e5 * (1 - avg(pow(p - y, 2)) / nullif(avg(y) * (1 - avg(y)), 0)), 0), 4) AS skill_floor, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, {_gain('p1', 'p')} AS gain_p1 FROM m GROUP BY ALL",
    "k6_auc": f"{PRED}, q AS (SELECT period, round(p, 6) AS q, y FROM pp), c AS (SELECT period, q, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM q GROUP BY ALL), w AS (SELECT *, sum(n0) OVER (PARTITION BY period ORDER BY q) - n0 / 2 AS below FROM c) SELECT period, round(sum(n1 * below) / (sum(n1) * sum(n0)), 6) AS auc FROM w GROUP BY period",
    "k7_ece": f"{_cal} SELECT period, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM c GROUP BY period",
    "k8_reliability": f"{_cal} SELECT s.period, s.bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y FROM (SELECT DISTINCT period, i::INT AS bin FROM pp, range(0, 10) x(i)) s LEFT JOIN c ON c.period = s.period AND c.bin = s.bin",
    "k9_tests": f"{PRED}, b AS (SELECT period, {_noise('p1', 'p')} AS floor, round(2e5 * stddev_pop(pow(p1 - y, 2) - pow(p - y, 2)) / sqrt(count(*)) / (avg(y) * (1 - avg(y))), 4) AS two_sigma, round(avg(pow(p1 - y, 2) - pow(p - y, 2)) / (stddev_samp(pow(p1 - y, 2) - pow(p - y, 2)) / sqrt(count(*))), 4) AS z, {_gain('p1', 'p')} AS gain FROM pp GROUP BY period) SELECT *, bool_and(gain > 0) OVER () AS all_gain, bool_and(gain > two_sigma) OVER () AS all_clear FROM b",
    "k22_oracle": f"{PRED}, o AS (SELECT *, CASE WHEN y = 1 THEN greatest(p1, p2) ELSE least(p1, p2) END AS best FROM pp) SELECT period, round(avg(pow(best - y, 2)), 6) AS bound, {_gain('p', 'best')} AS gain, round(avg(abs(p1 - p2) / 2), 6) AS spread, round(corr(p1, p2), 6) AS corr, round(corr(p2 - p, y - p), 6) AS residual_corr FROM o GROUP BY period",
    "k43_change": f"{PRED} SELECT period, round(avg(p - p2), 6) AS mean_shift, round(max(abs(p - p2)), 6) AS max_abs, {_noise('p2', 'p')} AS floor FROM pp GROUP BY period",
    "j1_grid": f"{_fit} SELECT period, round(scale, 4) AS scale, round(bias, 4) AS bias, round(loss, 6) AS loss, edge FROM m2",
    "j2_chained": f"{_fit}, a AS (SELECT pp.period, y, CASE WHEN scale IS NULL THEN p ELSE {_rc('p', 'scale', 'bias')} END AS q FROM pp LEFT JOIN m2 ON m2.period + 1 = pp.period) SELECT period, round(avg(pow(q - y, 2)), 6) AS brier, round(avg(q), 6) AS mean_p FROM a GROUP BY period",
    "j2_segments": f"{PRED}, {fit_sql('pp', 'seg, period')}, a AS (SELECT pp.period, pp.seg, y, CASE WHEN scale IS NULL THEN p ELSE {_rc('p', 'scale', 'bias')} END AS q FROM pp LEFT JOIN m2 ON m2.period + 1 = pp.period AND m2.seg = pp.seg) SELECT period, seg, round(avg(pow(q - y, 2)), 6) AS brier, round(avg(q), 6) AS mean_p FROM a GROUP BY ALL",
    "j3_shift": f"{_rec}, zz AS (SELECT period, {_z('p')} AS z, avg(y) OVER (PARTITION BY period) AS goal FROM pp), {shift_sql('zz', 'period')} SELECT period, round(shift, 6) AS shift FROM sh",
    "j4_drift": f"""{_rec}, {fit_sql('pp', 'period')}, br AS (SELECT period, avg(y) AS rate FROM t GROUP BY period), bd AS (SELECT period, rate, rate - lag(rate) OVER (ORDER BY period) AS delta FROM br),
bf AS (SELECT period, lag(rate) OVER (ORDER BY period) + coalesce(avg(delta) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS forecast FROM bd),
zz AS (SELECT pp.period + 1 AS period, {_z(_rc('p', 'scale', 'bias'))} AS z, forecast AS goal FROM pp JOIN m2 ON m2.period = pp.period JOIN bf ON bf.period = pp.period + 1 WHERE forecast IS NOT NULL), {shift_sql('zz', 'period')},
a AS (SELECT pp.period, y, coalesce(shift, 0) AS d, CASE WHEN scale IS NULL THEN p ELSE {_rc('p', 'scale', '(bias + coalesce(shift, 0))')} END AS q FROM pp LEFT JOIN m2 ON m2.period + 1 = pp.period LEFT JOIN sh ON sh.period = pp.period)
SELECT period, round(max(d), 5) AS shift, round(avg(pow(q - y, 2)), 6) AS brier, round(avg(q), 5) AS mean_p FROM a GROUP BY period""",
    "j6_blend": f"{PRED}, z AS (SELECT a, na, 0.6::DOUBLE * {_rc('p1', '1.1::DOUBLE', '0.02')} + 0.4::DOUBLE * {_rc('p2', '0.9::DOUBLE', '-0.01')} AS q FROM pp) SELECT a, na, round({_rc('q', '1.05::DOUBLE', '0')}, 6) AS p_blend FROM z",
    "j10_sweep": f"{PRED} SELECT period, w AS weight, round(avg(pow((1 - w) * p1 + w * p2 - y, 2)), 6) AS brier FROM pp, (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS w) GROUP BY ALL",
    "j13_vertex": f"{PRED}, b AS (SELECT period, avg(pow(p1 - y, 2)) AS s0, avg(pow(0.5::DOUBLE * p1 + 0.5::DOUBLE * p2 - y, 2)) AS s1, avg(pow(p2 - y, 2)) AS s2 FROM pp GROUP BY period) SELECT period, round((0.75::DOUBLE * s0 - s1 + 0.25::DOUBLE * s2) / (s0 - 2 * s1 + s2), 4) AS vertex FROM b",
}
QUERIES = {f.__name__: f for f in (k1_scores, k6_auc, k7_ece, k8_reliability, k9_tests, k22_oracle, k43_change, j1_grid, j2_chained, j2_segments, j3_shift, j4_drift, j6_blend, j10_sweep, j13_vertex)}
