"""The whole state group, its differences and gates, role features and tree inputs (survey I2, I6, I7, B9, B13, B14, B23, B34)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.functions import scalars as S
from pastglass.operators import encode as E
from pastglass.operators import state as T
from pastglass.plans.rowlocal import KEY, r6
from pastglass.plans.trials import PRED, TRIALS, predictions, trials

#: State groups: name -> (entity, counter, rates by short name).
GROUPS = {
    "p": ("a", "na", {"succ": "r_succ", "mid": "r_mid", "ball": "r_ball", "rev": "r_rev", "strk": "r_strk"}),
    "mix": ("a", "nmix", {"fb": "r_fast", "br": "r_brk", "off": "r_off"}),
    "b": ("b", "nb", {"succ": "r_bsucc", "mid": "r_bmid"}),
}
CELLS = {f"count_{b}_{s}": (("balls", b), ("strikes", s)) for b in range(4) for s in range(3)} | {f"hand_{x}_{y}": (("ahand", x), ("bhand", y)) for x in (1, 2) for y in (1, 2)}


def with_groups(t: DataFrame, groups: dict[str, tuple[str, str, dict[str, str]]] = GROUPS) -> DataFrame:
    """t with cur_<group>_n and cur_<group>_<rate>: trials of the running season and their rates, null without any."""
    full = t
    for g, (entity, n, rates) in groups.items():
        state = T.prior_state(t, entity, "period", n, list(rates.values())).withColumnRenamed("was_0", f"was_{g}")
        full = T.with_state(full, state, entity, "period")
        pairs = {k: T.current(n, r, f"was_{g}") for k, r in rates.items()}
        here = next(iter(pairs.values()))[0]
        full = full.withColumns({f"cur_{g}_n": F.when(here > 0, here)} | {f"cur_{g}_{k}": v[1] for k, v in pairs.items()}).drop(f"was_{g}")
    return full


def columns(groups: dict[str, tuple[str, str, dict[str, str]]] = GROUPS) -> list[str]:
    return [f"cur_{g}_{k}" for g, (_, _, rates) in groups.items() for k in ("n", *rates)]


def i2_state(spark: SparkSession, folder: str) -> DataFrame:
    """The thirteen state columns of pitcher, pitch mix and batter."""
    return with_groups(trials(spark, folder)).select(*KEY, *[r6(F.col(c).cast("double")).alias(c) for c in columns()])


def i6_career(spark: SparkSession, folder: str) -> DataFrame:
    """The ten rates of the running season less those of the career."""
    t = with_groups(trials(spark, folder))
    return t.select(*KEY, *[r6(F.col(f"cur_{g}_{k}") - F.col(r)).alias(f"cur_{g}_{k}_vs_career") for g, (_, _, rates) in GROUPS.items() for k, r in rates.items()])


def i7_gated(spark: SparkSession, folder: str) -> DataFrame:
    """The pitcher's five running rates in the cell of the count and of the hands, null elsewhere: eighty columns."""
    t, out = with_groups(trials(spark, folder), {"p": GROUPS["p"]}), {}
    for k in GROUPS["p"][2]:
        cells = {f"p_{k}_x_{name}": (F.col(x) == v) & (F.col(y) == w) for name, ((x, v), (y, w)) in CELLS.items()}
        out |= T.gated(r6(f"cur_p_{k}"), cells)
    return t.select(*KEY, *[v.alias(k) for k, v in out.items()])


def roles() -> dict[str, Column]:
    """Phase, experience, dominant mix (the first on ties), stability of form, and the team in its phase and segment."""
    inning, n = F.coalesce("inning", F.lit(-1)), F.coalesce("na", F.lit(0))
    gap = F.abs(F.col("r_prev1") - F.col("r_prev5"))
    phase = S.first_match([(inning <= 3, "early"), (inning <= 6, "middle")], "late")
    return {
        "phase": phase, "experience": S.first_match([(n == 0, "new"), (n < 200, "low"), (n < 1000, "medium"), (n < 3000, "high")], "veteran"),
        "pitch_mix": S.argmax_name({"fastball": F.col("r_fast"), "breaking": F.col("r_brk"), "offspeed": F.col("r_off")}, "unknown"),
        "stability": S.first_match([(F.round(gap, 9) <= 0.02, "stable"), (F.round(gap, 9) <= 0.05, "small"), (F.round(gap, 9) <= 0.10, "medium")], "volatile_or_unknown"),
        "team_context": F.concat_ws("|", F.coalesce("ateam", F.lit(-1)).cast("string"), phase, F.coalesce("seg", F.lit("nan"))),
    }


def b13_roles(spark: SparkSession, folder: str) -> DataFrame:
    """The five role features of every pitch."""
    return trials(spark, folder).select(*KEY, *[v.alias(k) for k, v in roles().items()])


def b14_family(spark: SparkSession, folder: str) -> DataFrame:
    """Pitches of each family of counts, by the definition of three levels and by that of five."""
    from pastglass.plans.mining import family

    three = S.first_match([(F.col("balls") > F.col("strikes"), "batter_ahead"), (F.col("balls") == F.col("strikes"), "even")], "pitcher_ahead")
    return trials(spark, folder).groupBy(three.alias("three"), family().alias("five")).agg(F.count("*").alias("n"))


#: Products of a situation's flag and a rate.
FLAGS = {"three_balls": "balls = 3", "pitchers_count": "strikes = 2 AND balls <= 1"}
PRODUCTS = {"middle_x_3ball": ("r_mid", "three_balls"), "ball_x_pcount": ("r_ball", "pitchers_count"), "breaking_x_pcount": ("r_brk", "pitchers_count"), "strike_x_3ball": ("r_strk", "three_balls")}


def b09_products(spark: SparkSession, folder: str) -> DataFrame:
    """Both flags, the four products of a flag and a rate, and the success rate less the middle rate."""
    flag = {k: F.expr(c).cast("int") for k, c in FLAGS.items()}
    return trials(spark, folder).select(*KEY, *[v.alias(k) for k, v in flag.items()], *[r6(F.col(r) * flag[f]).alias(k) for k, (r, f) in PRODUCTS.items()], r6(F.col("r_succ") - F.col("r_mid")).alias("success_minus_middle"))


#: Intercepts by segment, and that of any other.
INTERCEPTS, OTHER = {"R": 0.04, "F": -0.11}, 0.01


def b23_intercept(spark: SparkSession, folder: str) -> DataFrame:
    """The blend moved by the intercept of the pitch's own segment; unknown and missing segments by the default."""
    b = F.coalesce(*[F.when(F.col("seg") == k, F.lit(v)) for k, v in INTERCEPTS.items()], F.lit(OTHER))
    return predictions(spark, folder).select(*KEY, r6(S.recalibrate(F.col("p"), 1.0, b)).alias("p_moved"))


def b34_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs of a tree model for 2024 by what was seen before: medians for missing numbers, -1 for missing or new categories."""
    t = trials(spark, folder)
    past, now = t.filter("period < 2024"), t.filter("period = 2024")
    numbers = ["li", "r_prev1", "r_prev5", "r_succ"]
    now = now.crossJoin(F.broadcast(E.medians(past, numbers)))  # one row
    for c in ("side", "seg"):
        now = E.apply_codes(now, E.category_codes(past, c), c, f"{c}_code", -1)
    return now.select(*KEY, *[r6(F.coalesce(c, f"{c}_med")).alias(f"{c}_tree") for c in numbers], "side_code", "seg_code")


def _state(g: str) -> str:
    e, n, rates = GROUPS[g]
    parts = ", ".join([f"{n}::DOUBLE AS n0", *(f"round_even({n} * coalesce({r}, 0), 0) AS c_{k}" for k, r in rates.items())])
    order = ", ".join(["n0 DESC", *(f"c_{k} DESC" for k in rates)])
    last = ", ".join(f"last_value({c}) OVER w AS {c}_0" for c in ["n0", *(f"c_{k}" for k in rates)])
    return f"""{g}c AS (SELECT {e} AS e, period, {parts} FROM t WHERE {e} IS NOT NULL AND {n} IS NOT NULL), {g}r AS (SELECT *, row_number() OVER (PARTITION BY e, period ORDER BY {order}) AS rn FROM {g}c),
{g}s AS (SELECT e, period, {last} FROM {g}r WHERE rn = 1 WINDOW w AS (PARTITION BY e ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _now(g: str) -> str:
    _, n, rates = GROUPS[g]
    here = f"(t.{n} - {g}s.n0_0)"
    return ", ".join([f"CASE WHEN {here} > 0 THEN {here} END AS cur_{g}_n", *(f"CASE WHEN {here} > 0 THEN (round_even(t.{n} * coalesce(t.{r}, 0), 0) - {g}s.c_{k}_0) / {here} END AS cur_{g}_{k}" for k, r in rates.items())])


STATE = f"{TRIALS}, {', '.join(_state(g) for g in GROUPS)}, cu AS (SELECT t.*, {', '.join(_now(g) for g in GROUPS)} FROM t {' '.join(f'LEFT JOIN {g}s ON {g}s.e = t.{v[0]} AND {g}s.period = t.period' for g, v in GROUPS.items())})"
_phase = "CASE WHEN inning <= 3 THEN 'early' WHEN inning <= 6 THEN 'middle' ELSE 'late' END"
_gap = "round(abs(r_prev1 - r_prev5), 9)"
_top = "greatest(r_fast, r_brk, r_off)"
SQL = {
    "i2_state": f"{STATE} SELECT a, na, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in columns())} FROM cu",
    "i6_career": f"{STATE} SELECT a, na, {', '.join(f'round(cur_{g}_{k} - {r}, 6) AS cur_{g}_{k}_vs_career' for g, v in GROUPS.items() for k, r in v[2].items())} FROM cu",
    "i7_gated": f"{STATE} SELECT a, na, {', '.join(f'CASE WHEN {x} = {v} AND {y} = {w} THEN round(cur_p_{k}, 6) END AS p_{k}_x_{n}' for k in GROUPS['p'][2] for n, ((x, v), (y, w)) in CELLS.items())} FROM cu",
    "b13_roles": f"{TRIALS} SELECT a, na, {_phase} AS phase, CASE WHEN na = 0 THEN 'new' WHEN na < 200 THEN 'low' WHEN na < 1000 THEN 'medium' WHEN na < 3000 THEN 'high' ELSE 'veteran' END AS experience, CASE WHEN r_fast = {_top} THEN 'fastball' WHEN r_brk = {_top} THEN 'breaking' WHEN r_off = {_top} THEN 'offspeed' ELSE 'unknown' END AS pitch_mix, CASE WHEN {_gap} <= 0.02 THEN 'stable' WHEN {_gap} <= 0.05 THEN 'small' WHEN {_gap} <= 0.10 THEN 'medium' ELSE 'volatile_or_unknown' END AS stability, coalesce(ateam, -1)::VARCHAR || '|' || {_phase} || '|' || coalesce(seg, 'nan') AS team_context FROM t",
    "b14_family": f"{TRIALS} SELECT CASE WHEN balls > strikes THEN 'batter_ahead' WHEN balls = strikes THEN 'even' ELSE 'pitcher_ahead' END AS three, CASE WHEN balls = 3 THEN 'three_ball' WHEN strikes = 2 THEN 'two_strike' WHEN balls > strikes THEN 'batter_ahead' WHEN balls = strikes THEN 'even' ELSE 'pitcher_ahead' END AS five, count(*) AS n FROM t GROUP BY ALL",
    "b09_products": f"{TRIALS} SELECT a, na, {', '.join(f'({c})::INT AS {k}' for k, c in FLAGS.items())}, {', '.join(f'round({r} * ({FLAGS[f]})::INT, 6) AS {k}' for k, (r, f) in PRODUCTS.items())}, round(r_succ - r_mid, 6) AS success_minus_middle FROM t",
    "b23_intercept": f"{PRED} SELECT a, na, round(1 / (1 + exp(-(ln(p / (1 - p)) + CASE seg WHEN 'R' THEN 0.04 WHEN 'F' THEN -0.11 ELSE 0.01 END))), 6) AS p_moved FROM pp",
    "b34_tree": f"{TRIALS}, h AS (SELECT * FROM t WHERE period < 2024), m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in ('li', 'r_prev1', 'r_prev5', 'r_succ'))} FROM h), ks AS (SELECT side AS v, row_number() OVER (ORDER BY side) - 1 AS code FROM (SELECT DISTINCT side FROM h WHERE side IS NOT NULL)), kg AS (SELECT seg AS v, row_number() OVER (ORDER BY seg) - 1 AS code FROM (SELECT DISTINCT seg FROM h WHERE seg IS NOT NULL)) SELECT a, na, {', '.join(f'round(coalesce({c}, m_{c}), 6) AS {c}_tree' for c in ('li', 'r_prev1', 'r_prev5', 'r_succ'))}, coalesce(ks.code, -1) AS side_code, coalesce(kg.code, -1) AS seg_code FROM t CROSS JOIN m LEFT JOIN ks ON ks.v = side LEFT JOIN kg ON kg.v = seg WHERE period = 2024",
}
QUERIES = {f.__name__: f for f in (i2_state, i6_career, i7_gated, b13_roles, b14_family, b09_products, b23_intercept, b34_tree)}
