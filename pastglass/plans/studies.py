"""Further studies on the scored trials: staged blends, expanding calibration, coverage, corrections and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastglass.functions import scalars as S
from pastglass.operators import calibrate as C
from pastglass.operators import metrics as M
from pastglass.operators import residual as R
from pastglass.operators.encode import edges_of, medians
from pastglass.operators.profile import quantiles
from pastglass.operators.slices import masked
from pastglass.plans.residuals import residuals
from pastglass.plans.rowlocal import KEY, r6
from pastglass.plans.scores import _rc, fit_sql
from pastglass.plans.shifts import err
from pastglass.plans.trials import PRED, TRIALS, predictions, trials


def b19_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress within the season, early and late parts, and their products with reliability; missing flags."""
    part = S.clip((F.col("month") - 3) / 7.0, 0.0, 1.0)
    rel = S.reliability(F.col("na"), 100.0)
    return trials(spark, folder).select(*KEY, r6(part).alias("progress"), (part < 0.3).cast("int").alias("early"), (part > 0.7).cast("int").alias("late"), r6(part * rel).alias("progress_rel"), *[F.col(c).isNull().cast("int").alias(f"{c}_isna") for c in ("r_prev1", "r_prev5", "li")])


def j7_staged(spark: SparkSession, folder: str) -> DataFrame:
    """Two stages: a group blend of calibrated members, then a fixed convex blend with a member."""
    group = C.blended(C.Blend({"p1": (1.05, 0.0), "p2": (0.95, 0.01)}, {"p1": 0.5, "p2": 0.5}))
    return predictions(spark, folder).select(*KEY, r6(0.98 * group + 0.02 * F.col("p1")).alias("p_staged"))


def j11_expanding(spark: SparkSession, folder: str) -> DataFrame:
    """Each season calibrated on all seasons before it; the first is left as it is."""
    pr = predictions(spark, folder)
    last = pr.agg(F.max("period").alias("last"))
    past = pr.select("period", "p", "y").crossJoin(F.broadcast(last)).filter("period < last")  # one row
    past = past.withColumn("fold", F.explode(F.sequence(F.col("period") + 1, F.col("last"))))
    fits = C.grid_fit(past, "fold", "p", "y").select((F.col("fold") - 1).alias("period"), "scale", "bias")
    return C.chained(pr, fits, "period", "p", "p_cal").groupBy("period").agg(r6(M.brier(F.col("p_cal"), F.col("y"))).alias("brier"))


def j15_alpha(spark: SparkSession, folder: str) -> DataFrame:
    """A seasonal signal added to the later months with every strength, as three sums."""
    signal = S.clip(F.coalesce(F.col("r_prev1") - F.col("r_prev5"), F.lit(0.0)), -0.2, 0.2)
    pr = predictions(spark, folder).filter("month >= 6").withColumn("q", F.col("p") + signal)
    return C.sweep(pr, "period", "p", "q", "y", [0.0, 0.1, 0.3, 1.0]).select("period", F.col("weight").alias("alpha"), r6("brier").alias("brier"))


def k35_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of 2024's rows, the share whose group was seen before, with the number of groups and the median size of the seen."""
    t = trials(spark, folder)
    out = None
    for name, keys in (("a", ["a"]), ("b", ["b"]), ("ab", ["a", "b"]), ("actx", ["a", "ctx"])):
        cells = t.filter("period < 2024 AND y IS NOT NULL").dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("k"))
        met = t.filter("period = 2024").join(cells, keys, "left")
        one = met.agg(F.lit(name).alias("level"), r6(F.avg(F.col("k").isNotNull().cast("int"))).alias("seen"))
        one = one.crossJoin(F.broadcast(medians(met, ["k"]).toDF("median_n")))  # one row
        one = one.crossJoin(F.broadcast(cells.agg(F.count("*").alias("groups"))))  # one row
        out = one if out is None else out.unionByName(one)
    return out


def k37_any(spark: SparkSession, folder: str) -> DataFrame:
    """Share of rows with any of the recent rates, by season."""
    return trials(spark, folder).groupBy("period").agg(r6(F.avg(F.coalesce("r_prev1", "r_prev3", "r_prev5").isNotNull().cast("int"))).alias("coverage"))


def k40_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Gain, mean and absolute size of the count correction in 2024, by overlapping group: also the tenth of the greatest gain and of the greatest correction."""
    pr = predictions(spark, folder).filter("period = 2024")
    pr = R.looked_up(pr, R.flat_table(residuals(spark, folder), ["ctx"], 500.0), ["ctx"], "add").withColumn("q", S.clip(F.col("p") + F.col("add"), 0.0, 1.0))
    pr = pr.withColumn("gain", F.round(F.pow(F.col("p") - F.col("y"), 2) - F.pow(F.col("q") - F.col("y"), 2), 9)).withColumn("size", F.round(F.abs("add"), 9))
    pr = pr.crossJoin(F.broadcast(edges_of(pr, ["gain", "size"], [0.9])))  # one row
    groups = {
        "all": F.lit(True), "regular": F.col("seg") == "R", "other": F.col("seg") == "F", "two_strikes": F.col("strikes") == 2, "raised": F.col("add") > 0, "pitcher_low": F.coalesce("na", F.lit(0)) < 100, "batter_low": F.coalesce("nb", F.lit(0)) < 100,
        "same_hand": F.col("ahand").eqNullSafe(F.col("bhand")), "late_inning": F.col("inning") >= 7, "top10_effective": F.col("gain") >= F.col("gain_q")[0], "large_correction": F.col("size") >= F.col("size_q")[0],
    }
    return masked(pr, groups).groupBy("mask").agg(F.count("*").alias("n"), F.round(F.avg("gain") * 1e5, 4).alias("gain"), r6(F.avg("add")).alias("mean_add"), r6(F.avg(F.abs("add"))).alias("mean_abs"))


TOPS = (1, 5, 10, 20)
DESCRIPTORS = ["y", "p", "na", "nb", "inning", "balls", "strikes", "runners"]


def k41_concentration(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of every descriptor among the 1, 5, 10 and 20 % of the greatest errors, and among all, by season."""
    pr = predictions(spark, folder).withColumn("e", r6(err()))
    cuts = quantiles(pr, ["period"], "e", [1 - k / 100 for k in TOPS]).withColumnRenamed("period", "cp")
    pr = pr.join(F.broadcast(cuts), F.col("period") == F.col("cp"))  # one row for each season
    bands = {"all": F.lit(True)} | {str(k): F.col("e") >= F.col("q")[i] for i, k in enumerate(TOPS)}
    cells = masked(pr, bands).groupBy("period", "mask").agg(*[F.avg(c).alias(c) for c in DESCRIPTORS])
    long = cells.select("period", "mask", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in DESCRIPTORS])).alias("x")).select("period", "mask", "x.*")
    whole = long.filter("mask = 'all'").select(F.col("period").alias("wp"), F.col("feature").alias("wf"), F.col("v").alias("all_value"))
    out = long.filter("mask <> 'all'").join(whole, (F.col("period") == F.col("wp")) & (F.col("feature") == F.col("wf")))
    return out.select("period", F.col("mask").cast("int").alias("top"), "feature", F.round("v", 5).alias("value"), F.round("all_value", 5).alias("all_value"))


WEIGHTS = (50.0, 200.0, 1000.0, 5000.0)


def k42_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Mean residual by fifth of the shrunken success rate, and the spread over the fifths, for every prior weight."""
    pr = predictions(spark, folder)
    shrunk = {f"k{int(k)}": F.round((F.col("na") * F.coalesce("r_succ", F.lit(0.5)) + k * 0.5) / (F.col("na") + k), 9) for k in WEIGHTS}
    pr = pr.select("p", "y", *[v.alias(n) for n, v in shrunk.items()])
    pr = pr.crossJoin(F.broadcast(edges_of(pr, list(shrunk), [i / 5 for i in range(6)])))  # one row
    above = lambda name: F.size(F.filter(F.array_distinct(f"{name}_q"), lambda e: e < F.col(name)))
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.greatest(above(f"k{int(k)}") - 1, F.lit(0)).alias("fifth")) for k in WEIGHTS])
    cells = pr.select("p", "y", F.explode(each).alias("x")).groupBy("x.k", "x.fifth").agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("p")).alias("residual"))
    w = Window.partitionBy("k")  # five rows
    return cells.select("k", "fifth", "n", r6("residual").alias("residual"), r6(F.max("residual").over(w) - F.min("residual").over(w)).alias("spread"))


_part = "least(greatest((month - 3) / 7.0::DOUBLE, 0), 1)"
_sig = "least(greatest(coalesce(r_prev1 - r_prev5, 0), -0.2), 0.2)"
_lev = lambda n, keys: f"SELECT '{n}' AS level, round(avg((k IS NOT NULL)::INT), 6) AS seen, median(k)::DOUBLE AS median_n, (SELECT count(*) FROM {n}c) AS groups FROM t LEFT JOIN {n}c ON {' AND '.join(f'{n}c.{k} = t.{k}' for k in keys)} WHERE period = 2024"
_cell = lambda n, keys: f"{n}c AS (SELECT {', '.join(keys)}, count(*) AS k FROM t WHERE period < 2024 AND y IS NOT NULL AND {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY ALL)"
_levels = [("a", ["a"]), ("b", ["b"]), ("ab", ["a", "b"]), ("actx", ["a", "ctx"])]
_groups = {
    "all": "true", "regular": "seg = 'R'", "other": "seg = 'F'", "two_strikes": "strikes = 2", "raised": "add > 0", "pitcher_low": "coalesce(na, 0) < 100", "batter_low": "coalesce(nb, 0) < 100", "same_hand": "ahand IS NOT DISTINCT FROM bhand",
    "late_inning": "inning >= 7", "top10_effective": "gain >= (SELECT quantile_cont(gain, 0.9) FROM q)", "large_correction": "size >= (SELECT quantile_cont(size, 0.9) FROM q)",
}
SQL = {
    "b19_progress": f"{TRIALS} SELECT a, na, round({_part}, 6) AS progress, ({_part} < 0.3)::INT AS early, ({_part} > 0.7)::INT AS late, round({_part} * na / (na + 100.0::DOUBLE), 6) AS progress_rel, (r_prev1 IS NULL)::INT AS r_prev1_isna, (r_prev5 IS NULL)::INT AS r_prev5_isna, (li IS NULL)::INT AS li_isna FROM t",
    "j7_staged": f"{PRED}, z AS (SELECT a, na, p1, 0.5::DOUBLE * {_rc('p1', '1.05::DOUBLE', '0')} + 0.5::DOUBLE * {_rc('p2', '0.95::DOUBLE', '0.01')} AS q FROM pp) SELECT a, na, round(0.98::DOUBLE * {_rc('q', '1', '0')} + 0.02::DOUBLE * p1, 6) AS p_staged FROM z",
    "j11_expanding": f"{PRED}, f AS (SELECT DISTINCT period AS fold FROM pp), x AS (SELECT fold, p, y FROM pp JOIN f ON period < fold), {fit_sql('x', 'fold')} SELECT period, round(avg(pow(CASE WHEN scale IS NULL THEN p ELSE {_rc('p', 'scale', 'bias')} END - y, 2)), 6) AS brier FROM pp LEFT JOIN m2 ON fold = period GROUP BY period",
    "j15_alpha": f"{PRED} SELECT period, w AS alpha, round(avg(pow(p + w * {_sig} - y, 2)), 6) AS brier FROM pp, (SELECT unnest([0.0, 0.1, 0.3, 1.0]::DOUBLE[]) AS w) WHERE month >= 6 GROUP BY ALL",
    "k35_coverage": f"{TRIALS}, {', '.join(_cell(*x) for x in _levels)} {' UNION ALL '.join(_lev(*x) for x in _levels)}",
    "k37_any": f"{TRIALS} SELECT period, round(avg((coalesce(r_prev1, r_prev3, r_prev5) IS NOT NULL)::INT), 6) AS coverage FROM t GROUP BY period",
    "k40_corrections": f"{PRED}, re AS (SELECT *, (y - p) - avg(y - p) OVER (PARTITION BY period) AS r FROM pp WHERE seg = 'R' AND period < 2024), f AS (SELECT ctx AS c, sum(r) / (count(*) + 500.0::DOUBLE) AS v FROM re GROUP BY ctx), q0 AS (SELECT pp.*, coalesce(v, 0) AS add, least(greatest(p + coalesce(v, 0), 0), 1) AS q FROM pp LEFT JOIN f ON c = ctx WHERE period = 2024), q AS (SELECT *, round(pow(p - y, 2) - pow(q - y, 2), 9) AS gain, round(abs(add), 9) AS size FROM q0), m AS ({' UNION ALL '.join(f'''SELECT '{n}' AS mask, * FROM q WHERE {c}''' for n, c in _groups.items())}) SELECT mask, count(*) AS n, round(avg(gain) * 1e5, 4) AS gain, round(avg(add), 6) AS mean_add, round(avg(abs(add)), 6) AS mean_abs FROM m GROUP BY mask",
    "k41_concentration": f"{PRED}, e AS (SELECT *, round(pow(p - y, 2), 6) AS e FROM pp), c AS (SELECT period, quantile_cont(e, {[1 - k / 100 for k in TOPS]}) AS q FROM e GROUP BY period), {' , '.join(f'b{k} AS (SELECT e.* FROM e JOIN c USING (period) WHERE e.e >= q[{i + 1}])' for i, k in enumerate(TOPS))}, l AS ({' UNION ALL '.join(f"SELECT period, {k} AS top, '{c}' AS feature, avg({c}) AS value FROM b{k} GROUP BY period" for k in TOPS for c in DESCRIPTORS)}), w AS ({' UNION ALL '.join(f"SELECT period, '{c}' AS feature, avg({c}) AS v FROM e GROUP BY period" for c in DESCRIPTORS)}) SELECT l.period, top, l.feature, round(value, 5) AS value, round(v, 5) AS all_value FROM l JOIN w ON w.period = l.period AND w.feature = l.feature",
    "k42_sweep": f"{PRED}, x AS ({' UNION ALL '.join(f'SELECT {k}::DOUBLE AS k, round((na * coalesce(r_succ, 0.5) + {k}::DOUBLE * 0.5) / (na + {k}::DOUBLE), 9) AS v, p, y FROM pp' for k in WEIGHTS)}), e AS (SELECT k, list_distinct(quantile_cont(v, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM x GROUP BY k), c AS (SELECT k, greatest(len(list_filter(e, lambda z: z < v)) - 1, 0)::INT AS fifth, count(*) AS n, avg(y - p) AS residual FROM x JOIN e USING (k) GROUP BY ALL) SELECT k, fifth, n, round(residual, 6) AS residual, round(max(residual) OVER w - min(residual) OVER w, 6) AS spread FROM c WINDOW w AS (PARTITION BY k)",
}
QUERIES = {f.__name__: f for f in (b19_progress, j7_staged, j11_expanding, j15_alpha, k35_coverage, k37_any, k40_corrections, k41_concentration, k42_sweep)}
