"""Empirical Bayes, residual tables and corrections on the scored trials (survey group I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.functions import scalars as S
from pastglass.operators import residual as R
from pastglass.operators.encode import medians
from pastglass.operators.profile import quantiles
from pastglass.plans.rowlocal import KEY, r6
from pastglass.plans.trials import PRED, TRIALS, predictions, trials

LEVELS = [R.Level("a", ("a",), ("all",)), R.Level("b", ("b",), ("all",)), R.Level("ac", ("a", "ctx"), ("a",)), R.Level("bc", ("b", "ctx"), ("b",)), R.Level("ab", ("a", "b"), ("a", "b"))]
SPEC = [R.Correction("hand", ("bhand",), 2000.0), R.Correction("count", ("a", "ctx"), 500.0), R.Correction("leverage", ("a", "lev"), 2000.0)]


def lev() -> Column:
    """Leverage of the count: 0 ahead, 2 well behind, else 1."""
    return F.when(F.col("strikes") > F.col("balls"), 0).when(F.col("balls") > F.col("strikes") + 1, 2).otherwise(1)


def residuals(spark: SparkSession, folder: str) -> DataFrame:
    """Residuals of the blend on the R segment before 2024, centred per season."""
    pr = predictions(spark, folder).withColumn("lev", lev())
    return R.centred(pr.filter((F.col("seg") == "R") & (F.col("period") < 2024)), F.col("y") - F.col("p"), ["period"])


def f7_centred(spark: SparkSession, folder: str) -> DataFrame:
    """The centred residuals themselves."""
    return residuals(spark, folder).select(*KEY, r6("r").alias("r"))


def i12_flat(spark: SparkSession, folder: str) -> DataFrame:
    """Residual by count."""
    return R.flat_table(residuals(spark, folder), ["ctx"], 2000.0).select("ctx", F.round("value", 8).alias("value"))


def i13_interaction(spark: SparkSession, folder: str) -> DataFrame:
    """Residual by pitcher and batter's hand beyond the pitcher's own."""
    return R.interaction_table(residuals(spark, folder), "a", ["bhand"], 500.0).select("a", "bhand", F.round("value", 8).alias("value"))


def i14_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Three tables from seasons before 2024, applied in turn to 2024; other segments stay as they are."""
    r, pr = residuals(spark, folder), predictions(spark, folder).withColumn("lev", lev()).filter("period = 2024")
    tables = [(c, R.flat_table(r, list(c.keys), c.k) if c.keys[0] != "a" else R.interaction_table(r, "a", list(c.keys[1:]), c.k)) for c in SPEC]
    return R.corrected(pr, "p", tables, F.col("seg") == "R", "p_new").select(*KEY, r6("p_new").alias("p_new"))


def i15_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Globally centred residual cells of count and hands."""
    pr = predictions(spark, folder).filter("period < 2024")
    return R.flat_table(R.centred(pr, F.col("y") - F.col("p"), []), ["ctx", "ahand", "bhand"], 2000.0).select("ctx", "ahand", "bhand", F.round("value", 8).alias("value"))


def i16_target_centred(spark: SparkSession, folder: str) -> DataFrame:
    """Interaction of pitcher and base pressure from outcomes alone, centred per season."""
    t = trials(spark, folder).filter((F.col("seg") == "R") & F.col("y").isNotNull()).withColumn("pressure", F.least("runners", F.lit(2)))
    return R.interaction_table(R.centred(t, F.col("y"), ["period"]), "a", ["pressure"], 500.0).select("a", "pressure", F.round("value", 8).alias("value"))


def i17_screen(spark: SparkSession, folder: str) -> DataFrame:
    """Gain in 2024 of every key and prior weight, as one plan."""
    r, pr = residuals(spark, folder), predictions(spark, folder).withColumn("lev", lev()).filter("period = 2024 AND seg = 'R'")
    rows = [(key, k) for key in ("bhand", "ctx", "lev", "outs") for k in (500.0, 2000.0)]
    for key, k in rows:
        pr = R.looked_up(pr, R.flat_table(r, [key], k), [key], f"{key}_{int(k)}")
    each = F.array(*[F.struct(F.lit(key).alias("key"), F.lit(k).alias("k"), (F.pow(F.col("p") - F.col("y"), 2) - F.pow(S.clip(F.col("p") + F.col(f"{key}_{int(k)}"), 0, 1) - F.col("y"), 2)).alias("gain")) for key, k in rows])
    long = pr.select(F.explode(each).alias("x")).select("x.*")
    return long.groupBy("key", "k").agg(F.round(F.avg("gain") * 1e5, 6).alias("gain"), F.round(F.avg("gain") / (F.stddev_samp("gain") / F.sqrt(F.count("*"))), 4).alias("z"))


def i18_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Hierarchical estimates for 2024 from the seasons before, and their combination."""
    t = trials(spark, folder)
    out = R.hierarchy(t.filter((F.col("period") < 2024) & F.col("y").isNotNull()), t.filter("period = 2024"), "y", LEVELS, 500.0)
    return out.select(*KEY, *[r6(f"e_{lv.name}").alias(f"e_{lv.name}") for lv in LEVELS], r6("rel_ab").alias("rel_ab"), r6(R.combined([lv.name for lv in LEVELS])).alias("combined"))


def i23_missing_block(spark: SparkSession, folder: str) -> DataFrame:
    """Recent rates drawn to the median by reliability, with missing flags."""
    t = trials(spark, folder)
    med = medians(t.filter("period < 2024"), ["r_prev3", "r_prev5"]).toDF("m3", "m5")
    t = t.filter("period = 2024").crossJoin(F.broadcast(med))  # one row
    rel = S.reliability(F.col("na"), 100.0)
    return t.select(*KEY, *[r6(rel * F.coalesce(f"r_prev{k}", f"m{k}") + (1 - rel) * F.col(f"m{k}")).alias(f"s{k}") for k in (3, 5)], F.col("r_prev3").isNull().cast("int").alias("m3_isna"))


def i24_context_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy of each context's outcome with a prior of 100 trials."""
    t = trials(spark, folder).filter("period < 2024 AND y IS NOT NULL")
    whole = t.agg(F.avg("y").alias("g"))
    cells = t.groupBy("ctx", "outs").agg(F.sum("y").alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(whole))  # one row
    return cells.select("ctx", "outs", r6(S.entropy_bits(S.shrink(F.col("s"), F.col("n"), 100.0, F.col("g")))).alias("bits"))


def i25_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Outs composition of each pitcher's count families, drawn to his own, and the deviation from it."""
    t = trials(spark, folder).withColumn("fam", lev())
    c = t.groupBy("a", "fam").pivot("outs", [0, 1, 2]).count().fillna(0)
    own = c.groupBy("a").agg(*[F.sum(str(o)).alias(f"s{o}") for o in range(3)]).withColumnRenamed("a", "oa")
    c = c.join(own, F.col("a") == F.col("oa"))
    tot, all_ = sum((F.col(str(o)) for o in (1, 2)), F.col("0")), F.col("s0") + F.col("s1") + F.col("s2")
    rate = {o: (F.col(str(o)) + 50.0 * F.col(f"s{o}") / all_) / (tot + 50.0) for o in range(3)}
    return c.select("a", "fam", *[r6(rate[o]).alias(f"rate{o}") for o in range(3)], *[r6(rate[o] - F.col(f"s{o}") / all_).alias(f"dev{o}") for o in range(3)])


def i26_cold_start(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of batters not seen before 2024 mixed with the context's; the known stay as they are."""
    t, pr = trials(spark, folder), predictions(spark, folder).filter("period = 2024")
    known = t.filter("period < 2024 AND b IS NOT NULL").groupBy("b").agg(F.lit(True).alias("known")).withColumnRenamed("b", "kb")
    pr = pr.join(known, F.col("b") == F.col("kb"), "left")
    return pr.select(*KEY, F.col("known").isNull().cast("int").alias("cold"), r6(R.expert_mix(F.col("p"), F.col("p2"), F.col("known").isNull() & (F.col("seg") == "R"), 0.6)).alias("p_new"))


def i27_segment_prior(spark: SparkSession, folder: str) -> DataFrame:
    """F-segment predictions drawn to that segment's earlier rate."""
    prior = trials(spark, folder).filter("seg = 'F' AND period < 2024").agg(F.avg("y").alias("prior"))
    pr = predictions(spark, folder).filter("period = 2024").crossJoin(F.broadcast(prior))  # one row
    return pr.select(*KEY, r6(R.expert_mix(F.col("p"), F.col("prior"), F.col("seg") == "F", 0.25)).alias("p_new"))


def i28_slice_expert(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the members' mean on two strikes and less than three balls; bit-equal elsewhere."""
    gate = (F.col("strikes") == 2) & (F.col("balls") < 3)
    return predictions(spark, folder).select(*KEY, r6(R.expert_mix(F.col("p"), (F.col("p1") + F.col("p2")) / 2, gate, 0.25)).alias("p_new"))


def i30_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Training weights by error quantile and by uncertainty; the last season's labels play no part."""
    pr = predictions(spark, folder)
    err = F.abs(F.col("y") - F.col("p"))
    q = quantiles(pr.filter("period < 2024").withColumn("err", err), [], "err", [0.5, 0.75, 0.9])
    w = F.when(err >= F.col("q")[2], 3.0).when(err >= F.col("q")[1], 2.0).when(err >= F.col("q")[0], 1.5).otherwise(1.0)
    return pr.filter("period < 2024").crossJoin(F.broadcast(q)).select(*KEY, w.alias("w_hard"), r6(1 + 0.5 * 4 * F.col("p") * (1 - F.col("p"))).alias("w_unsure"))  # one row


def i31_recency(spark: SparkSession, folder: str) -> DataFrame:
    """Recency-weighted rate of each context, with the latest season doubled, and the last two seasons alone."""
    t = trials(spark, folder).filter("period < 2024 AND y IS NOT NULL")
    w = F.pow(F.lit(0.7), 2024 - F.col("period")) * F.when(F.col("period") == 2023, 2.0).otherwise(1.0)
    return t.groupBy("ctx").agg(r6(F.sum(w * F.col("y")) / F.sum(w)).alias("weighted"), r6(F.avg(F.when(F.col("period") >= 2022, F.col("y")))).alias("last_two"))


_LEV = "CASE WHEN strikes > balls THEN 0 WHEN balls > strikes + 1 THEN 2 ELSE 1 END"
_RES = PRED + f""", x AS (SELECT *, {_LEV} AS lev FROM pp),
re AS (SELECT *, (y - p) - avg(y - p) OVER (PARTITION BY period) AS r FROM x WHERE seg = 'R' AND period < 2024)"""
_flat = lambda key, k, src="re": f"(SELECT {key}, sum(r) / (count(*) + {k}::DOUBLE) AS v FROM {src} WHERE {key} IS NOT NULL GROUP BY {key})"
_inter = lambda key, k, src="re": f"(SELECT a, {key}, (s - sum(s) OVER (PARTITION BY a) * n / sum(n) OVER (PARTITION BY a)) / (n + {k}::DOUBLE) AS v FROM (SELECT a, {key}, sum(r) AS s, count(*) AS n FROM {src} WHERE {key} IS NOT NULL GROUP BY a, {key}))"
_cl = lambda e: f"least(greatest({e}, 0), 1)"
_scr = " UNION ALL ".join(f"SELECT '{key}' AS key, {k}::DOUBLE AS k, pow(p - y, 2) - pow({_cl('p + coalesce(v, 0)')} - y, 2) AS gain FROM x LEFT JOIN {_flat(key, k)} f ON f.{key} = x.{key} WHERE period = 2024 AND seg = 'R'" for key in ("bhand", "ctx", "lev", "outs") for k in (500, 2000))
_eb = lambda alias, keys: f"{alias} AS (SELECT {keys}, sum(y)::DOUBLE AS s, count(*) AS n FROM h GROUP BY ALL)"
_est = lambda al, parent: f"(coalesce({al}.s, 0) + 500.0::DOUBLE * {parent}) / (coalesce({al}.n, 0) + 500.0::DOUBLE)"
_rel = lambda al: f"coalesce({al}.n, 0) / (coalesce({al}.n, 0) + 500.0::DOUBLE)"
_ea, _ebb = _est("ha", "g"), _est("hb", "g")
_all = [("ha", _ea), ("hb", _ebb), ("hac", _est("hac", _ea)), ("hbc", _est("hbc", _ebb)), ("hab", _est("hab", f"(({_ea} + {_ebb}) / 2)"))]
SQL = {
    "f7_centred": f"{_RES} SELECT a, na, round(r, 6) AS r FROM re",
    "i12_flat": f"{_RES} SELECT ctx, round(v, 8) AS value FROM {_flat('ctx', 2000)}",
    "i13_interaction": f"{_RES} SELECT a, bhand, round(v, 8) AS value FROM {_inter('bhand', 500)}",
    "i14_corrections": f"""{_RES} SELECT x.a, na, round(CASE WHEN seg = 'R' THEN {_cl(f"{_cl(f'{_cl("p + coalesce(h.v, 0)")} + coalesce(c.v, 0)')} + coalesce(l.v, 0)")} ELSE p END, 6) AS p_new FROM x LEFT JOIN {_flat('bhand', 2000)} h ON h.bhand = x.bhand
LEFT JOIN {_inter('ctx', 500)} c ON c.a = x.a AND c.ctx = x.ctx LEFT JOIN {_inter('lev', 2000)} l ON l.a = x.a AND l.lev = x.lev WHERE period = 2024""",
    "i15_cells": f"{PRED}, re AS (SELECT *, (y - p) - avg(y - p) OVER () AS r FROM pp WHERE period < 2024) SELECT ctx, ahand, bhand, round(sum(r) / (count(*) + 2000.0::DOUBLE), 8) AS value FROM re WHERE bhand IS NOT NULL GROUP BY ALL",
    "i16_target_centred": f"{TRIALS}, re AS (SELECT *, least(runners, 2) AS pressure, y - avg(y) OVER (PARTITION BY period) AS r FROM t WHERE seg = 'R' AND y IS NOT NULL) SELECT a, pressure, round(v, 8) AS value FROM {_inter('pressure', 500)}",
    "i17_screen": f"{_RES}, s AS ({_scr}) SELECT key, k, round(avg(gain) * 1e5, 6) AS gain, round(avg(gain) / (stddev_samp(gain) / sqrt(count(*))), 4) AS z FROM s GROUP BY ALL",
    "i18_hierarchy": f"{TRIALS}, h AS (SELECT * FROM t WHERE period < 2024 AND y IS NOT NULL), w AS (SELECT avg(y) AS g FROM h), {_eb('ha', 'a')}, {_eb('hb', 'b')}, {_eb('hac', 'a, ctx')}, {_eb('hbc', 'b, ctx')}, {_eb('hab', 'a, b')} SELECT t.a, na, {', '.join(f'round({e}, 6) AS e_{n[1:]}' for n, e in _all)}, round({_rel('hab')}, 6) AS rel_ab, round((g + {' + '.join(f'({_rel(n)}) * ({e})' for n, e in _all)}) / (1 + {' + '.join(_rel(n) for n, _ in _all)}), 6) AS combined FROM t CROSS JOIN w LEFT JOIN ha ON ha.a = t.a LEFT JOIN hb ON hb.b = t.b LEFT JOIN hac ON hac.a = t.a AND hac.ctx = t.ctx LEFT JOIN hbc ON hbc.b = t.b AND hbc.ctx = t.ctx LEFT JOIN hab ON hab.a = t.a AND hab.b = t.b WHERE period = 2024",
    "i23_missing_block": f"{TRIALS}, m AS (SELECT quantile_cont(r_prev3, 0.5) AS m3, quantile_cont(r_prev5, 0.5) AS m5 FROM t WHERE period < 2024) SELECT a, na, {', '.join(f'round(na / (na + 100.0::DOUBLE) * coalesce(r_prev{k}, m{k}) + (1 - na / (na + 100.0::DOUBLE)) * m{k}, 6) AS s{k}' for k in (3, 5))}, (r_prev3 IS NULL)::INT AS m3_isna FROM t, m WHERE period = 2024",
    "i24_context_entropy": f"{TRIALS}, h AS (SELECT * FROM t WHERE period < 2024 AND y IS NOT NULL), c AS (SELECT ctx, outs, (sum(y) + 100.0::DOUBLE * (SELECT avg(y) FROM h)) / (count(*) + 100.0::DOUBLE) AS q FROM h GROUP BY ALL) SELECT ctx, outs, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) AS bits FROM c",
    "i25_composition": f"{TRIALS}, c AS (SELECT a, {_LEV} AS fam, {', '.join(f'sum((outs = {o})::INT)::DOUBLE AS c{o}' for o in range(3))} FROM t GROUP BY ALL), o AS (SELECT a, {', '.join(f'sum(c{o}) AS s{o}' for o in range(3))} FROM c GROUP BY a) SELECT a, fam, {', '.join(f'round((c{o} + 50.0::DOUBLE * s{o} / (s0 + s1 + s2)) / (c0 + c1 + c2 + 50.0::DOUBLE), 6) AS rate{o}, round((c{o} + 50.0::DOUBLE * s{o} / (s0 + s1 + s2)) / (c0 + c1 + c2 + 50.0::DOUBLE) - s{o} / (s0 + s1 + s2), 6) AS dev{o}' for o in range(3))} FROM c JOIN o USING (a)",
    "i26_cold_start": f"{PRED}, k AS (SELECT DISTINCT b FROM t WHERE period < 2024 AND b IS NOT NULL) SELECT pp.a, na, (k.b IS NULL)::INT AS cold, round(CASE WHEN k.b IS NULL AND seg = 'R' THEN 0.4::DOUBLE * p + 0.6::DOUBLE * p2 ELSE p END, 6) AS p_new FROM pp LEFT JOIN k ON k.b = pp.b WHERE period = 2024",
    "i27_segment_prior": f"{PRED}, k AS (SELECT avg(y) AS prior FROM t WHERE seg = 'F' AND period < 2024) SELECT a, na, round(CASE WHEN seg = 'F' AND prior IS NOT NULL THEN 0.75::DOUBLE * p + 0.25::DOUBLE * prior ELSE p END, 6) AS p_new FROM pp, k WHERE period = 2024",
    "i28_slice_expert": f"{PRED} SELECT a, na, round(CASE WHEN strikes = 2 AND balls < 3 THEN 0.75::DOUBLE * p + 0.25::DOUBLE * (p1 + p2) / 2 ELSE p END, 6) AS p_new FROM pp",
    "i30_weights": f"{PRED}, q AS (SELECT quantile_cont(abs(y - p), [0.5, 0.75, 0.9]) AS q FROM pp WHERE period < 2024) SELECT a, na, CASE WHEN abs(y - p) >= q[3] THEN 3.0 WHEN abs(y - p) >= q[2] THEN 2.0 WHEN abs(y - p) >= q[1] THEN 1.5 ELSE 1.0 END::DOUBLE AS w_hard, round(1 + 2 * p * (1 - p), 6) AS w_unsure FROM pp, q WHERE period < 2024",
    "i31_recency": f"{TRIALS}, w AS (SELECT *, pow(0.7::DOUBLE, 2024 - period) * CASE WHEN period = 2023 THEN 2 ELSE 1 END AS w FROM t WHERE period < 2024 AND y IS NOT NULL) SELECT ctx, round(sum(w * y) / sum(w), 6) AS weighted, round(avg(CASE WHEN period >= 2022 THEN y END), 6) AS last_two FROM w GROUP BY ctx",
}
QUERIES = {f.__name__: f for f in (f7_centred, i12_flat, i13_interaction, i14_corrections, i15_cells, i16_target_centred, i17_screen, i18_hierarchy, i23_missing_block, i24_context_entropy, i25_composition, i26_cold_start, i27_segment_prior, i28_slice_expert, i30_weights, i31_recency)}
