"""As-of state and its derivatives on the trials (survey groups D, F and I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.operators import state as S
from pastglass.operators.slices import top_fraction
from pastglass.plans.rowlocal import KEY, r6
from pastglass.plans.trials import PRED, TRIALS, predictions, trials

PRATES = ["r_succ", "r_mid", "r_ball", "r_strk", "r_rev"]
M, ALPHA = 75.0, 0.28


def _stated(spark: SparkSession, folder: str, outcome: str | None = None, back: tuple[int, ...] = (0,)) -> DataFrame:
    t = trials(spark, folder)
    return S.with_state(t, S.prior_state(t, "a", "period", "na", PRATES, outcome, back), "a", "period")


def i1_boundary(spark: SparkSession, folder: str) -> DataFrame:
    """State of each pitcher from the seasons before 2024."""
    return S.boundary(trials(spark, folder), "a", "period", 2024, "na", PRATES)


def i3_state(spark: SparkSession, folder: str) -> DataFrame:
    """Trials and rates of the running season for each pitch."""
    t = _stated(spark, folder)
    pairs = {r: S.current("na", r) for r in PRATES}
    return t.select(*KEY, pairs["r_succ"][0].alias("n_season"), *[r6(v[1]).alias(f"cur_{r[2:]}") for r, v in pairs.items()])


def i3_batter_state(spark: SparkSession, folder: str) -> DataFrame:
    """The same for batters, whose counters may tie."""
    t = trials(spark, folder)
    t = S.with_state(t, S.prior_state(t, "b", "period", "nb", ["r_bsucc"]), "b", "period")
    n, cur = S.current("nb", "r_bsucc")
    return t.select(*KEY, n.alias("n_season"), r6(cur).alias("cur_bsucc"))


def i4_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The running success rate from boundaries that include the last trial."""
    n, cur = S.current("na", "r_succ")
    return _stated(spark, folder, "y").select(*KEY, n.alias("n_season"), r6(cur).alias("cur_succ"))


def i5_recent_form(spark: SparkSession, folder: str) -> DataFrame:
    """Five-game rate less the running rate, and the running less the career rates."""
    t = _stated(spark, folder)
    return t.select(*KEY, r6(F.col("r_prev5") - S.current("na", "r_succ")[1]).alias("recent_form"), *[r6(S.current("na", r)[1] - F.col(r)).alias(f"vs_career_{r[2:]}") for r in PRATES])


def i8_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Success rate over the last one and two seasons before each pitch's season."""
    t = _stated(spark, folder, back=(0, 1, 2))
    return t.select(*KEY, *[r6(S.window_rate("r_succ", w)).alias(f"last_{w}") for w in (1, 2)])


def i9_form(spark: SparkSession, folder: str) -> DataFrame:
    """The blend moved by the season's form, centred on the season before."""
    pr = predictions(spark, folder)
    t = S.with_state(pr, S.prior_state(trials(spark, folder), "a", "period", "na", ["r_succ"], "y"), "a", "period")
    adj, here = S.form_adjustment("na", "r_succ", M)
    t = t.withColumn("adj", adj).withColumn("here", here)
    mu = t.filter("here > 0").groupBy("period").agg(F.avg("adj").alias("mu")).select((F.col("period") + 1).alias("mp"), "mu")
    t = t.join(mu, F.col("period") == F.col("mp"), "left")
    return t.select(*KEY, r6("adj").alias("adj"), r6(S.apply_form(F.col("p"), F.col("adj"), F.coalesce("mu", F.lit(0.0)), ALPHA)).alias("p_form"))


#: Strength of the batters' form.
BATTER_ALPHA = 0.1


def with_batter_form(rows: DataFrame, t: DataFrame) -> DataFrame:
    """rows with adj, the batter's form; without trials before the period it is drawn to the pooled rate of all batters before it."""
    state = S.prior_state(t, "b", "period", "nb", ["r_bsucc"])
    pooled = state.groupBy("period").agg((F.sum("was_0.c_r_bsucc") / F.nullif(F.sum("was_0.n0"), F.lit(0.0))).alias("pooled")).withColumnRenamed("period", "pp")
    rows = S.with_state(rows, state, "b", "period").join(F.broadcast(pooled), F.col("period") == F.col("pp"), "left")  # one row for each period
    return rows.withColumn("adj", S.form_adjustment("nb", "r_bsucc", M, F.col("pooled"))[0]).drop("pp", "pooled", "was_0")


def i10_pooled_form(spark: SparkSession, folder: str) -> DataFrame:
    """Form adjustment of batters with the pooled rate of earlier seasons for those without trials."""
    t = trials(spark, folder)
    return with_batter_form(t, t).select(*KEY, (r6("adj") + 0.0).alias("adj"))  # no minus zero


def i11_batter_form(spark: SparkSession, folder: str) -> DataFrame:
    """The blend moved by the batter's form, without centring."""
    rows = with_batter_form(predictions(spark, folder), trials(spark, folder))
    return rows.select(*KEY, r6(S.apply_form(F.col("p"), F.col("adj"), F.lit(0.0), BATTER_ALPHA)).alias("p_form"))


def i29_transport(spark: SparkSession, folder: str) -> DataFrame:
    """Progress within 2023 moved onto the state at the start of 2024."""
    t = trials(spark, folder)
    old, new = (S.boundary(t, "a", "period", y, "na", ["r_succ"]).select(F.col("a").alias(f"e{y}"), F.struct("n0", "c_r_succ").alias(f"b{y}")) for y in (2023, 2024))
    rows = t.filter("period = 2023").join(old, F.col("a") == F.col("e2023")).join(new, F.col("a") == F.col("e2024"))
    n, rate = S.transported("na", "r_succ", "b2023", "b2024")
    return rows.select(*KEY, n.alias("n_new"), r6(rate).alias("rate_new"))


def f5_extrapolate(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome rate by season with its change and a forecast from the changes before."""
    m = trials(spark, folder).groupBy("period").agg(F.avg("y").alias("rate"))
    return S.extrapolated(m, "period", "rate").select("period", *[r6(c).alias(c) for c in ("rate", "delta", "forecast")])


def f8_debut(spark: SparkSession, folder: str) -> DataFrame:
    """Pitches in the first season of their pitcher, by season."""
    t = trials(spark, folder)
    first = t.groupBy("a").agg(F.min("period").alias("first")).withColumnRenamed("a", "fa")
    return t.join(first, F.col("a") == F.col("fa")).groupBy("period").agg(F.sum((F.col("period") == F.col("first")).cast("long")).alias("debut_rows"), F.count("*").alias("n_rows"))


def f1_last_first(spark: SparkSession, folder: str) -> DataFrame:
    """Last row of each batter by counter: the first in key order and the last in key order on ties."""
    t = trials(spark, folder).filter("b IS NOT NULL")
    top = t.groupBy("b").agg(F.max("nb").alias("top")).withColumnRenamed("b", "tb")
    ties = t.join(top, (F.col("b") == F.col("tb")) & (F.col("nb") == F.col("top")))
    key = F.struct("a", "na")
    return ties.groupBy("b").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.max("nb").alias("nb")).select("b", "nb", F.col("lo.a").alias("first_a"), F.col("lo.na").alias("first_na"), F.col("hi.a").alias("last_a"), F.col("hi.na").alias("last_na"))


def f9_worst_tenth(spark: SparkSession, folder: str) -> DataFrame:
    """The tenth of each season's predictions with the greatest error, ties by key."""
    pr = predictions(spark, folder).withColumn("err", r6((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))))
    return top_fraction(pr.select(*KEY, "period", "err"), "period", "err", KEY, 10).drop("err")


_ST = lambda e, n, rates, plus="", y="": f"""
ls AS (SELECT {e} AS e, period AS lp, {n}{plus} AS n0, {', '.join(f'round_even({n} * coalesce({r}, 0), 0){y if i == 0 else ""} AS c_{r}' for i, r in enumerate(rates))},
  row_number() OVER (PARTITION BY {e}, period ORDER BY {n} DESC, {', '.join(f'round_even({n} * coalesce({r}, 0), 0){y if i == 0 else ""} DESC' for i, r in enumerate(rates))}) AS rn FROM t WHERE {e} IS NOT NULL),
l1 AS (SELECT * EXCLUDE (rn), dense_rank() OVER (ORDER BY lp) AS i FROM ls WHERE rn = 1)"""  # noqa: E731
_PR = lambda k, rates: ", ".join(f"(SELECT arg_max(x.{c}, x.n0) FROM l1 x WHERE x.e = l1.e AND x.i < l1.i - {k}) AS {c}_{k}" for c in ["n0", *(f"c_{r}" for r in rates)])


def _state_sql(e: str, n: str, rates: list[str], select: str, plus: str = "", y: str = "", back: tuple[int, ...] = (0,), frm: str = "t", head: str = TRIALS, more: str = "", source: str = "j") -> str:
    return f"{head},{_ST(e, n, rates, plus, y)}, st AS (SELECT e, lp, {', '.join(_PR(k, rates) for k in back)} FROM l1), j AS (SELECT {frm}.*, st.* FROM {frm} LEFT JOIN st ON st.e = {frm}.{e} AND st.lp = {frm}.period){more} SELECT {select} FROM {source}"


_cur = lambda r, n="na": f"CASE WHEN {n} - n0_0 > 0 THEN (round_even({n} * coalesce({r}, 0), 0) - c_{r}_0) / ({n} - n0_0) END"
_bound = lambda y: f"(SELECT a AS e, arg_max(na, na) AS n0, arg_max(round_even(na * coalesce(r_succ, 0), 0), na) AS c0 FROM t WHERE period < {y} GROUP BY a)"
_adj = lambda n, r, p0: f"CASE WHEN {n} - n0_0 >= 0 THEN (round_even({n} * coalesce({r}, 0), 0) - c_{r}_0 + 75.0::DOUBLE * {p0}) / ({n} - n0_0 + 75.0::DOUBLE) - {p0} END"
_FORM = f", k AS (SELECT *, na - n0_0 AS here, {_adj('na', 'r_succ', '(c_r_succ_0 / nullif(n0_0, 0))')} AS adj FROM j), m AS (SELECT period + 1 AS mp, avg(adj) AS mu FROM k WHERE here > 0 GROUP BY ALL)"
_POOL = ", pl AS (SELECT lp, sum(c_r_bsucc_0) / nullif(sum(n0_0), 0) AS pooled FROM st GROUP BY lp)"
_badj = _adj("nb", "r_bsucc", "coalesce(c_r_bsucc_0 / nullif(n0_0, 0), pooled)")
SQL = {
    "i1_boundary": f"{TRIALS} SELECT a, arg_max(na, na)::DOUBLE AS n0, {', '.join(f'arg_max(round_even(na * coalesce({r}, 0), 0), na) AS c_{r}' for r in PRATES)} FROM t WHERE period < 2024 GROUP BY a",
    "i3_state": _state_sql("a", "na", PRATES, f"a, na, (na - n0_0)::DOUBLE AS n_season, {', '.join(f'round({_cur(r)}, 6) AS cur_{r[2:]}' for r in PRATES)}"),
    "i3_batter_state": _state_sql("b", "nb", ["r_bsucc"], f"a, na, (nb - n0_0)::DOUBLE AS n_season, round({_cur('r_bsucc', 'nb')}, 6) AS cur_bsucc"),
    "i4_exact": _state_sql("a", "na", PRATES, f"a, na, (na - n0_0)::DOUBLE AS n_season, round({_cur('r_succ')}, 6) AS cur_succ", " + 1", " + coalesce(y, 0)"),
    "i5_recent_form": _state_sql("a", "na", PRATES, f"a, na, round(r_prev5 - ({_cur('r_succ')}), 6) AS recent_form, {', '.join(f'round(({_cur(r)}) - {r}, 6) AS vs_career_{r[2:]}' for r in PRATES)}"),
    "i8_windows": _state_sql("a", "na", ["r_succ"], "a, na, " + ", ".join(f"round(CASE WHEN n0_0 - n0_{w} > 0 THEN (c_r_succ_0 - c_r_succ_{w}) / (n0_0 - n0_{w}) END, 6) AS last_{w}" for w in (1, 2)), back=(0, 1, 2)),
    "i9_form": _state_sql("a", "na", ["r_succ"], "a, na, round(adj, 6) AS adj, round(least(greatest(p + 0.28::DOUBLE * coalesce(adj - coalesce(mu, 0), 0), 0), 1), 6) AS p_form", " + 1", " + coalesce(y, 0)", frm="pp", head=PRED, more=_FORM, source="k LEFT JOIN m ON m.mp = k.period"),
    "i10_pooled_form": _state_sql("b", "nb", ["r_bsucc"], f"a, na, round({_badj}, 6) + 0.0::DOUBLE AS adj", more=_POOL, source="j LEFT JOIN pl ON pl.lp = j.period"),
    "i11_batter_form": _state_sql("b", "nb", ["r_bsucc"], f"a, na, round(least(greatest(p + 0.1::DOUBLE * coalesce({_badj}, 0), 0), 1), 6) AS p_form", frm="pp", head=PRED, more=_POOL, source="j LEFT JOIN pl ON pl.lp = j.period"),
    "i29_transport": f"{TRIALS} SELECT a, na, (n.n0 + na - o.n0)::DOUBLE AS n_new, round(CASE WHEN n.n0 + na - o.n0 > 0 THEN (n.c0 + round_even(na * coalesce(r_succ, 0), 0) - o.c0) / (n.n0 + na - o.n0) END, 6) AS rate_new FROM t JOIN {_bound(2023)} o ON o.e = a JOIN {_bound(2024)} n ON n.e = a WHERE period = 2023",
    "f5_extrapolate": f"{TRIALS}, m AS (SELECT period, avg(y) AS rate FROM t GROUP BY 1), d AS (SELECT *, rate - lag(rate) OVER (ORDER BY period) AS delta, lag(rate) OVER (ORDER BY period) AS prev FROM m) SELECT period, round(rate, 6) AS rate, round(delta, 6) AS delta, round(prev + coalesce(avg(delta) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS forecast FROM d",
    "f8_debut": f"{TRIALS}, f AS (SELECT a AS fa, min(period) AS first FROM t GROUP BY 1) SELECT period, sum((period = first)::BIGINT)::BIGINT AS debut_rows, count(*) AS n_rows FROM t JOIN f ON fa = a GROUP BY 1",
    "f1_last_first": f"{TRIALS}, k AS (SELECT *, max(nb) OVER (PARTITION BY b) AS top FROM t WHERE b IS NOT NULL), o AS (SELECT b, nb, a, na, row_number() OVER (PARTITION BY b ORDER BY a, na) AS lo, row_number() OVER (PARTITION BY b ORDER BY a DESC, na DESC) AS hi FROM k WHERE nb = top) SELECT x.b, x.nb, x.a AS first_a, x.na AS first_na, z.a AS last_a, z.na AS last_na FROM o x JOIN o z ON z.b = x.b AND x.lo = 1 AND z.hi = 1",
    "f9_worst_tenth": f"{PRED}, e AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY round((p - y) * (p - y), 6) DESC, a, na) AS rk, count(*) OVER (PARTITION BY period) AS n FROM pp) SELECT a, na, period FROM e WHERE rk <= n // 10",
}
QUERIES = {f.__name__: f for f in (i1_boundary, i3_state, i3_batter_state, i4_exact, i5_recent_form, i8_windows, i9_form, i10_pooled_form, i11_batter_form, i29_transport, f5_extrapolate, f8_debut, f1_last_first, f9_worst_tenth)}
