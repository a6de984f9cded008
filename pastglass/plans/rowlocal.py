"""Row-local features, bins and encodings (survey groups A and B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.functions import scalars as S
from pastglass.operators import encode as E
from pastglass.plans.trials import TRIALS, trials

KEY = ["a", "na"]


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def _sql(exprs: str) -> str:
    return f"{TRIALS} SELECT a, na, {exprs} FROM t"


def b_flags() -> dict[str, Column]:
    c = F.col
    return {
        "count_state": c("ctx"), "same_hand": (c("ahand") == c("bhand")).cast("int"), "late_inning": (c("inning") >= 7).cast("int"), "two_strikes": (c("strikes") == 2).cast("int"), "three_balls": (c("balls") == 3).cast("int"),
        "gap_prev": r6(c("r_prev1") - c("r_prev5")), "gap_career": r6(c("r_prev5") - c("r_succ")), "log_n": r6(S.log1p_floor(c("na"))), "count_text": F.concat_ws("-", "balls", "strikes"),
        "strike_minus_ball": r6(c("r_strk") - c("r_ball")), "dominance": r6(c("r_fast") - F.greatest("r_brk", "r_off")), "mid_x_three": r6(c("r_mid") * (c("balls") == 3).cast("int")), "cell": c("period") * 10000 + c("month") * 100 + c("dow"),
    }


FLAGS_SQL = """ctx AS count_state, (ahand = bhand)::INT AS same_hand, (inning >= 7)::INT AS late_inning, (strikes = 2)::INT AS two_strikes, (balls = 3)::INT AS three_balls,
round(r_prev1 - r_prev5, 6) AS gap_prev, round(r_prev5 - r_succ, 6) AS gap_career, round(ln(1 + greatest(na, 0)::DOUBLE), 6) AS log_n, balls || '-' || strikes AS count_text,
round(r_strk - r_ball, 6) AS strike_minus_ball, round(r_fast - greatest(r_brk, r_off), 6) AS dominance, round(r_mid * (balls = 3)::INT, 6) AS mid_x_three, period * 10000 + month * 100 + dow AS cell"""


def b_buckets() -> dict[str, Column]:
    c = F.col
    return {
        "leverage": F.when(c("strikes") > c("balls"), 0).when(c("balls") > c("strikes") + 1, 2).otherwise(1), "pressure": F.when(c("runners") >= 2, 2).otherwise(c("runners").cast("int")),
        "count_family": S.first_match([(c("strikes") == 2, "two_strike"), (c("balls") == 3, "three_ball"), (c("ctx") == 0, "first"), (c("balls") > c("strikes"), "behind")], "even"),
        "history": S.right_closed(c("na"), [-1, 0, 100, 1000, 5000], ["none", "few", "some", "many"]), "phase": S.steps(c("inning"), [3, 6], [1.0, 2.0, 3.0]), "mix": S.argmax_name({"fast": c("r_fast"), "brk": c("r_brk"), "off": c("r_off")}, "none"),
        "signal": r6(S.clip(F.coalesce(c("r_prev1") - c("r_prev5"), F.lit(0.0)), -0.2, 0.2)),
    }


BUCKETS_SQL = """CASE WHEN strikes > balls THEN 0 WHEN balls > strikes + 1 THEN 2 ELSE 1 END AS leverage, CASE WHEN runners >= 2 THEN 2 ELSE runners::INT END AS pressure,
CASE WHEN strikes = 2 THEN 'two_strike' WHEN balls = 3 THEN 'three_ball' WHEN ctx = 0 THEN 'first' WHEN balls > strikes THEN 'behind' ELSE 'even' END AS count_family,
CASE WHEN na > -1 AND na <= 0 THEN 'none' WHEN na > 0 AND na <= 100 THEN 'few' WHEN na > 100 AND na <= 1000 THEN 'some' WHEN na > 1000 AND na <= 5000 THEN 'many' ELSE 'nan' END AS history,
CASE WHEN inning <= 3 THEN 1.0 WHEN inning <= 6 THEN 2.0 ELSE 3.0 END::DOUBLE AS phase,
CASE WHEN r_fast = greatest(r_fast, r_brk, r_off) THEN 'fast' WHEN r_brk = greatest(r_fast, r_brk, r_off) THEN 'brk' WHEN r_off = greatest(r_fast, r_brk, r_off) THEN 'off' ELSE 'none' END AS mix,
round(least(greatest(coalesce(r_prev1 - r_prev5, 0), -0.2), 0.2), 6) AS signal"""


def b_smooth() -> dict[str, Column]:
    c = F.col
    mix = S.composition([c("r_fast"), c("r_brk"), c("r_off")], 0.05)
    return {n: r6(v) for n, v in mix.items()} | {
        "bits": r6(S.entropy_bits(c("r_succ"))), "log_odds": r6(S.logit(c("r_succ"))), "moved": r6(S.recalibrate(c("r_succ"), 1.1, -0.05)), "n_succ": S.counted(c("na"), c("r_succ")), "rel": r6(S.reliability(c("na"), 75.0)),
        "drawn": r6(S.shrink_rate(c("r_succ"), c("na"), 75.0, F.lit(0.5))), "lam": r6(S.lambda_shrink(c("r_bsucc"), c("nb"), 300.0, F.lit(0.48))), "season_prior": r6(S.clip(0.01 * c("period") - 19.7, 0, 1)), "spread": r6(F.hypot("r_brk", "r_off")),
    }


_sh = "(coalesce({}, 0) + 0.05) / (coalesce(r_fast, 0) + coalesce(r_brk, 0) + coalesce(r_off, 0) + 3 * 0.05::DOUBLE)"
_f, _b, _o = (_sh.format(x) for x in ("r_fast", "r_brk", "r_off"))
_h = f"-({_f} * ln({_f}) + {_b} * ln({_b}) + {_o} * ln({_o}))"
_q = "least(greatest(r_succ, 1e-6), 1 - 1e-6)"
SMOOTH_SQL = f"""round({_h}, 6) AS entropy, round(greatest({_f}, {_b}, {_o}), 6) AS top_share, round(exp({_h}), 6) AS effective, round(ln(({_f}) / ({_b})), 6) AS log_ratio,
round(CASE WHEN r_succ IS NOT NULL THEN -(CASE WHEN r_succ > 0 THEN r_succ * log2(r_succ) ELSE 0 END + CASE WHEN r_succ < 1 THEN (1 - r_succ) * log2(1 - r_succ) ELSE 0 END) END, 6) AS bits,
round(CASE WHEN r_succ IS NOT NULL THEN ln({_q} / (1 - {_q})) END, 6) AS log_odds, round(CASE WHEN r_succ IS NOT NULL THEN 1 / (1 + exp(-(1.1::DOUBLE * ln({_q} / (1 - {_q})) - 0.05))) END, 6) AS moved,
round_even(na * coalesce(r_succ, 0), 0) AS n_succ, round(na / (na + 75.0::DOUBLE), 6) AS rel, round(CASE WHEN r_succ IS NULL THEN 0.5 ELSE (na * r_succ + 37.5) / (na + 75.0::DOUBLE) END, 6) AS drawn,
round(CASE WHEN r_bsucc IS NULL OR nb <= 0 THEN 0.48 ELSE nb / (nb + 300.0::DOUBLE) * r_bsucc + (1 - nb / (nb + 300.0::DOUBLE)) * 0.48 END, 6) AS lam,
round(least(greatest(0.01::DOUBLE * period - 19.7, 0), 1), 6) AS season_prior, round(sqrt(r_brk * r_brk + r_off * r_off), 6) AS spread"""


def b29_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Category codes fitted on earlier seasons, applied to the last: unseen and null have none."""
    t = trials(spark, folder)
    codes = E.category_codes(t.filter("period < 2024").withColumn("v", F.concat_ws("|", "seg", "side", "balls")), "v")
    return E.apply_codes(t.filter("period = 2024").withColumn("v", F.concat_ws("|", "seg", "side", "balls")), codes, "v", "code", None).select(*KEY, "code")


def b31_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """Id vocabulary from 1 on over earlier seasons; unknown and missing ids are 0."""
    t = trials(spark, folder)
    ids = E.category_codes(t.filter("period < 2023"), "b", first=1)
    return E.apply_codes(t.filter("period >= 2023"), ids, "b", "b_index", 0).select(*KEY, "b_index")


def b32_prep(spark: SparkSession, folder: str) -> DataFrame:
    """Imputed and scaled columns with missing flags, fitted on earlier seasons."""
    t, cols = trials(spark, folder), ["li", "r_succ", "r_prev3"]
    out = E.standardised(t.filter("period >= 2023"), E.numeric_prep(t.filter("period < 2023"), cols), cols)
    return out.select(*KEY, *[r6(f"{c}_z").alias(f"{c}_z") for c in cols], *[f"{c}_isna" for c in cols])


def b33_onehot(spark: SparkSession, folder: str) -> DataFrame:
    """One-hot of hands and game type with fixed levels."""
    hot = {f"b{k}": v for k, v in E.one_hot(F.col("bhand"), [1, 2]).items()} | E.one_hot(F.col("seg"), ["R", "F"])
    return trials(spark, folder).select(*KEY, *[v.alias(k) for k, v in hot.items()])


def b16_quintiles(spark: SparkSession, folder: str) -> DataFrame:
    """Fifths of the leverage index by exact quantiles, right-closed."""
    return E.quantile_bins(trials(spark, folder).select(*KEY, "li"), "li", 5, "fifth").select(*KEY, "fifth")


_prep = ", ".join(f"(SELECT quantile_cont({c}, 0.5) FROM f) AS {c}_med" for c in ("li", "r_succ", "r_prev3"))
_stat = ", ".join(f"avg(coalesce({c}, {c}_med)) AS {c}_mean, CASE WHEN stddev_pop(coalesce({c}, {c}_med)) <= 1e-12 THEN 1 ELSE stddev_pop(coalesce({c}, {c}_med)) END AS {c}_dev, avg(({c} IS NULL)::INT) AS {c}_miss" for c in ("li", "r_succ", "r_prev3"))
_outs = ", ".join(f"round((coalesce({c}, {c}_med) - {c}_mean) / {c}_dev, 6) AS {c}_z, ({c} IS NULL AND {c}_miss > 0)::INT AS {c}_isna" for c in ("li", "r_succ", "r_prev3"))

QUERIES = {
    "b01_flags": lambda s, d: trials(s, d).select(*KEY, *[c.alias(n) for n, c in b_flags().items()]),
    "b10_buckets": lambda s, d: trials(s, d).select(*KEY, *[c.alias(n) for n, c in b_buckets().items()]),
    "b20_smoothing": lambda s, d: trials(s, d).select(*KEY, *[c.alias(n) for n, c in b_smooth().items()]),
    "b29_codes": b29_codes, "b31_vocab": b31_vocab, "b32_prep": b32_prep, "b33_onehot": b33_onehot, "b16_quintiles": b16_quintiles,
}
SQL = {
    "b01_flags": _sql(FLAGS_SQL), "b10_buckets": _sql(BUCKETS_SQL), "b20_smoothing": _sql(SMOOTH_SQL),
    "b29_codes": f"""{TRIALS}, v AS (SELECT *, concat_ws('|', seg, side, balls) AS v FROM t), d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM v WHERE period < 2024))
SELECT a, na, code FROM v LEFT JOIN d USING (v) WHERE period = 2024""",
    "b31_vocab": f"""{TRIALS}, d AS (SELECT b, row_number() OVER (ORDER BY b) AS code FROM (SELECT DISTINCT b FROM t WHERE period < 2023 AND b IS NOT NULL))
SELECT a, na, coalesce(code, 0) AS b_index FROM t LEFT JOIN d USING (b) WHERE period >= 2023""",
    "b32_prep": f"""{TRIALS}, f AS (SELECT * FROM t WHERE period < 2023), m AS (SELECT {_prep}), s AS (SELECT {_stat} FROM f, m) SELECT a, na, {_outs} FROM t, m, s WHERE period >= 2023""",
    "b33_onehot": _sql("coalesce((bhand = 1)::INT, 0) AS bis_1, coalesce((bhand = 2)::INT, 0) AS bis_2, coalesce((seg = 'R')::INT, 0) AS is_R, coalesce((seg = 'F')::INT, 0) AS is_F"),
    "b16_quintiles": f"""{TRIALS}, e AS (SELECT list_sort(list_distinct(quantile_cont(li, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM t)
SELECT a, na, CASE WHEN li IS NOT NULL THEN greatest(len(list_filter(e, lambda x: x < li)) - 1, 0) END::INT AS fifth FROM t, e""",
}
