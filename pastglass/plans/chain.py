"""The whole post-processing of a season's predictions, in order (survey J9), built step by step and switched by name (O1, O7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.functions import scalars as S
from pastglass.operators import calibrate as C
from pastglass.operators import residual as R
from pastglass.operators import state as T
from pastglass.plans import states
from pastglass.plans.residuals import SPEC, _cl, _flat, _inter, lev
from pastglass.plans.rowlocal import KEY, r6
from pastglass.plans.scores import _rc
from pastglass.plans.trials import PRED, predictions, trials
from pastglass.sources.tables import stored

SEASON, SHIFT = 2024, -0.02
BLEND = C.Blend(members={"p1": (1.1, 0.02), "p2": (0.9, -0.01)}, weights={"p1": 0.6, "p2": 0.4}, after=(1.05, 0.0))

#: A step: (rows with p_out, history before the season, season) -> rows with p_out changed.
Step = Callable[[DataFrame, DataFrame, int], DataFrame]


def blend_step(rows: DataFrame, past: DataFrame, season: int) -> DataFrame:
    """Members calibrated, blended and calibrated."""
    return rows.withColumn("p_out", C.blended(BLEND))


def season_form_step(rows: DataFrame, past: DataFrame, season: int) -> DataFrame:
    """Moved by the pitcher's form in the season so far, centred on the mean form of the season before."""
    def formed(x: DataFrame, upto: int) -> DataFrame:
        state = T.boundary(past, "a", "period", upto, "na", ["r_succ"], "y").select(F.col("a").alias("fa"), F.struct("n0", "c_r_succ").alias("was_0"))
        adj, here = T.form_adjustment("na", "r_succ", states.M)
        return x.join(state, F.col("a") == F.col("fa"), "left").withColumn("adj", adj).withColumn("here", here).drop("fa", "was_0")

    mu = formed(past.filter((F.col("period") == season - 1) & F.col("p").isNotNull()), season - 1).filter("here > 0").agg(F.avg("adj").alias("mu"))
    out = formed(rows, season).crossJoin(F.broadcast(mu))  # one row
    return out.withColumn("p_out", T.apply_form(F.col("p_out"), F.col("adj"), F.coalesce("mu", F.lit(0.0)), states.ALPHA)).drop("adj", "here", "mu")


def batter_form_step(rows: DataFrame, past: DataFrame, season: int) -> DataFrame:
    """Moved by the batter's form, drawn to all batters' rate where he has no trials before."""
    state = T.boundary(past, "b", "period", season, "nb", ["r_bsucc"]).select(F.col("b").alias("fb"), F.struct("n0", "c_r_bsucc").alias("was_0"))
    pooled = state.agg((F.sum("was_0.c_r_bsucc") / F.nullif(F.sum("was_0.n0"), F.lit(0.0))).alias("pooled"))
    out = rows.join(state, F.col("b") == F.col("fb"), "left").crossJoin(F.broadcast(pooled))  # one row
    adj = T.form_adjustment("nb", "r_bsucc", states.M, F.col("pooled"))[0]
    return out.withColumn("p_out", T.apply_form(F.col("p_out"), adj, F.lit(0.0), states.BATTER_ALPHA)).drop("fb", "was_0", "pooled")


def cold_start_step(rows: DataFrame, past: DataFrame, season: int) -> DataFrame:
    """Mixed with the experts where the batter is new in the regular segment."""
    seen = past.filter("b IS NOT NULL").select(F.col("b").alias("kb")).distinct()
    gate = F.col("kb").isNull() & (F.col("seg") == "R")
    return rows.join(seen, F.col("b") == F.col("kb"), "left").withColumn("p_out", R.expert_mix(F.col("p_out"), (F.col("p1") + F.col("p2")) / 2, gate, 0.5)).drop("kb")


def corrections_step(rows: DataFrame, past: DataFrame, season: int) -> DataFrame:
    """Moved by the residual tables of the regular segment before the season."""
    known = past.filter((F.col("seg") == "R") & F.col("p").isNotNull()).withColumn("lev", lev())
    r = R.centred(known, F.col("y") - F.col("p"), ["period"])
    tables = [(c, R.flat_table(r, list(c.keys), c.k) if c.keys[0] != "a" else R.interaction_table(r, "a", list(c.keys[1:]), c.k)) for c in SPEC]
    return R.corrected(rows.withColumn("lev", lev()), "p_out", tables, F.col("seg") == "R", "p_new").withColumn("p_out", F.col("p_new")).drop("p_new", "lev")


def shift_step(rows: DataFrame, past: DataFrame, season: int) -> DataFrame:
    """Moved by one constant in log odds."""
    return rows.withColumn("p_out", S.recalibrate(F.col("p_out"), 1.0, SHIFT))


#: All steps, in the order in which they apply.
STEPS: dict[str, Step] = {"blend": blend_step, "season_form": season_form_step, "batter_form": batter_form_step, "cold_start": cold_start_step, "corrections": corrections_step, "shift": shift_step}


def history(spark: SparkSession, folder: str) -> DataFrame:
    """All trials, with members and blend where they have been scored; written once, as every step reads it."""
    t = trials(spark, folder)
    scored = predictions(spark, folder).select(F.col("a").alias("sa"), F.col("na").alias("sn"), "p1", "p2", "p")
    return stored(t.join(scored, (F.col("a") == F.col("sa")) & (F.col("na") == F.col("sn")), "left").drop("sa", "sn"))


def run(full: DataFrame, season: int, steps: dict[str, Step] = STEPS, off: frozenset[str] = frozenset()) -> DataFrame:
    """The scored trials of a season with p_out after all steps but those switched off.

    A step is called with the rows of the season and those of earlier seasons, and with nothing else: what it learns
    can come from no later period. A name in `off` that is no step is an error.
    """
    if not off <= set(steps):
        raise ValueError(f"no such steps: {sorted(off - set(steps))}")
    past, rows = full.filter(F.col("period") < season), full.filter((F.col("period") == season) & F.col("p").isNotNull()).withColumn("p_out", F.col("p"))
    for name, step in steps.items():
        rows = rows if name in off else step(rows, past, season)
    return rows


def j9_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Every pitch of 2024 after the whole chain."""
    return run(history(spark, folder), SEASON).select(*KEY, r6("p_out").alias("p_out"))


def o7_switches(spark: SparkSession, folder: str) -> DataFrame:
    """Squared error of 2024 by the whole chain, and with each step switched off."""
    full = history(spark, folder)
    out = None
    for off in ("none", *STEPS):
        one = run(full, SEASON, STEPS, frozenset() if off == "none" else frozenset([off])).agg(F.lit(off).alias("off"), F.count("*").alias("n"), r6(F.avg(F.pow(F.col("p_out") - F.col("y"), 2))).alias("brier"))
        out = one if out is None else out.unionByName(one)
    return out


_mix = f"0.6::DOUBLE * {_rc('p1', '1.1::DOUBLE', '0.02')} + 0.4::DOUBLE * {_rc('p2', '0.9::DOUBLE', '-0.01')}"
_cnt = lambda n, r: f"round_even({n} * coalesce({r}, 0), 0)"
_bd = lambda name, e, n, r, upto, plus="", y="": f"{name} AS (SELECT e, n0, c FROM (SELECT {e} AS e, {n}{plus} AS n0, {_cnt(n, r)}{y} AS c, row_number() OVER (PARTITION BY {e} ORDER BY {n} DESC, {_cnt(n, r)}{y} DESC) AS rn FROM t WHERE period < {upto} AND {e} IS NOT NULL AND {n} IS NOT NULL) WHERE rn = 1)"
_ad = lambda n, r, s, p0: f"CASE WHEN {n} - {s}.n0 >= 0 THEN ({_cnt(n, r)} - {s}.c + 75.0::DOUBLE * {p0}) / ({n} - {s}.n0 + 75.0::DOUBLE) - {p0} END"


def _chain_sql(off: str = "none") -> str:
    on = lambda name, new, old: old if off == name else new
    q = [on("blend", f"{_rc('q', '1.05::DOUBLE', '0')}", "p"), on("season_form", f"{_cl('q1 + 0.28::DOUBLE * coalesce(ad - coalesce(mu, 0), 0)')}", "q1"), on("batter_form", f"{_cl('q2 + 0.1::DOUBLE * coalesce(bad, 0)')}", "q2"), on("cold_start", "CASE WHEN kb IS NULL AND seg = 'R' THEN 0.5::DOUBLE * q3 + 0.5::DOUBLE * (p1 + p2) / 2 ELSE q3 END", "q3")]
    fixed = _cl(f"{_cl(f'{_cl("q4 + hv")} + cv')} + lv")
    five = on("corrections", f"CASE WHEN seg = 'R' THEN {fixed} ELSE q4 END", "q4")
    return f"""SELECT a, na, y, {on('shift', _rc('q5', '1', '-0.02'), 'q5')} AS p_out FROM (SELECT *, {five} AS q5 FROM (SELECT *, {q[3]} AS q4 FROM (SELECT *, {q[2]} AS q3 FROM (SELECT *, {q[1]} AS q2 FROM (SELECT *, {q[0]} AS q1 FROM w)))))"""


_HEAD = f"""{PRED}, x AS (SELECT *, CASE WHEN strikes > balls THEN 0 WHEN balls > strikes + 1 THEN 2 ELSE 1 END AS lev, {_mix} AS q FROM pp), re AS (SELECT *, (y - p) - avg(y - p) OVER (PARTITION BY period) AS r FROM x WHERE seg = 'R' AND period < 2024),
{_bd('ga', 'a', 'na', 'r_succ', 2024, ' + 1', ' + coalesce(y, 0)')}, {_bd('gp', 'a', 'na', 'r_succ', 2023, ' + 1', ' + coalesce(y, 0)')}, {_bd('gb', 'b', 'nb', 'r_bsucc', 2024)},
mu AS (SELECT avg({_ad('na', 'r_succ', 'gp', '(gp.c / nullif(gp.n0, 0))')}) AS mu FROM x JOIN gp ON gp.e = x.a WHERE period = 2023 AND na - gp.n0 > 0), po AS (SELECT sum(c) / nullif(sum(n0), 0) AS pooled FROM gb), kk AS (SELECT DISTINCT b AS kb FROM t WHERE period < 2024 AND b IS NOT NULL),
w AS (SELECT x.*, mu, kb, {_ad('na', 'r_succ', 'ga', '(ga.c / nullif(ga.n0, 0))')} AS ad, {_ad('nb', 'r_bsucc', 'gb', 'coalesce(gb.c / nullif(gb.n0, 0), pooled)')} AS bad, coalesce(h.v, 0) AS hv, coalesce(c.v, 0) AS cv, coalesce(l.v, 0) AS lv FROM x CROSS JOIN mu CROSS JOIN po LEFT JOIN ga ON ga.e = x.a LEFT JOIN gb ON gb.e = x.b LEFT JOIN kk ON kb = x.b
  LEFT JOIN {_flat('bhand', 2000)} h ON h.bhand = x.bhand LEFT JOIN {_inter('ctx', 500)} c ON c.a = x.a AND c.ctx = x.ctx LEFT JOIN {_inter('lev', 2000)} l ON l.a = x.a AND l.lev = x.lev WHERE period = 2024)"""
SQL = {
    "j9_chain": f"{_HEAD} SELECT a, na, round(p_out, 6) AS p_out FROM ({_chain_sql()})",
    "o7_switches": f"{_HEAD} " + " UNION ALL ".join(f"SELECT '{off}' AS off, count(*) AS n, round(avg(pow(p_out - y, 2)), 6) AS brier FROM ({_chain_sql(off)})" for off in ("none", *STEPS)),
}
QUERIES = {"j9_chain": j9_chain, "o7_switches": o7_switches}
