"""What better members could gain: recovery, disagreement, decomposition, stability and stop rules (survey K19, K21, K25, K26, K32, K36, K39, J8, J14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.functions import scalars as S
from pastglass.operators import calibrate as C
from pastglass.operators import metrics as M
from pastglass.operators.profile import quantiles
from pastglass.operators.slices import masked
from pastglass.plans.mining import BOTH, FRAME, framed
from pastglass.plans.rowlocal import KEY, r6
from pastglass.plans.scores import _rc, fit_sql
from pastglass.plans.splitting import number_of
from pastglass.plans.trials import PRED, before, predictions, trials
from pastglass.sources.tables import stored, table

#: Candidates beside the blend p, as expressions over its members that are the same in Spark and in SQL.
CANDIDATES = {"p": "p", "p1": "p1", "p2": "p2", "even": "(p1 + p2) / 2", "bold": "p + 0.5 * (p2 - p1)"}
SCOPES = {"all": list(CANDIDATES), "quality": ["p", "p2", "even"]}
TOPS = (5, 10, 20)


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Scored trials with a column m_<name> for each candidate, and e, the blend's squared error to nine digits."""
    pr = predictions(spark, folder)
    return pr.withColumns({f"m_{k}": F.expr(v) for k, v in CANDIDATES.items()}).withColumn("e", F.round(F.pow(F.col("p") - F.col("y"), 2), 9))


def k19_recovery(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate in every season: gain, shares of rows won and lost, correlations, and gain and wins where the blend errs most."""
    pr = members(spark, folder)
    cuts = quantiles(pr, ["period"], "e", [1 - k / 100 for k in TOPS]).withColumnRenamed("period", "cp")
    pr = pr.join(F.broadcast(cuts), F.col("period") == F.col("cp"))  # one row for each season
    long = pr.select("period", "y", "p", "e", "q", F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), F.col(f"m_{k}").alias("m")) for k in CANDIDATES])).alias("x")).select("period", "y", "p", "e", "q", "x.*")
    gain = F.pow(F.col("p") - F.col("y"), 2) - F.pow(F.col("m") - F.col("y"), 2)
    sure = F.round(gain, 12)
    tops = [a for i, k in enumerate(TOPS) for a in (r6(F.avg(F.when(F.col("e") >= F.col("q")[i], gain))).alias(f"top{k}_gain"), r6(F.avg(F.when(F.col("e") >= F.col("q")[i], (sure > 0).cast("int")))).alias(f"top{k}_wins"))]
    return long.groupBy("period", "candidate").agg(
        F.count("*").alias("n"), r6(M.brier(F.col("m"), F.col("y"))).alias("brier"), r6(F.avg(gain)).alias("gain"), F.round(M.skill_gain(F.col("p"), F.col("m"), F.col("y")), 3).alias("skill_gain"), r6(F.avg((sure > 0).cast("int"))).alias("wins"), r6(F.avg((sure < 0).cast("int"))).alias("losses"),
        r6(F.corr(F.col("y") - F.col("p"), F.col("y") - F.col("m"))).alias("residual_corr"), r6(F.corr("p", "m")).alias("corr"), r6(F.avg(F.col("m") - F.col("p"))).alias("moved"), *tops,
    )


def with_entropy(rows: DataFrame, t: DataFrame) -> DataFrame:
    """rows with bits: the entropy of their count and outs, of outcomes of earlier seasons drawn to the mean with weight 100."""
    cells = t.filter("y IS NOT NULL").groupBy("ctx", "outs", "period").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    whole = before(cells.groupBy(F.lit(1).alias("one"), "period").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), ["one"], ["s", "n"]).select(F.col("period").alias("gp"), (F.col("s") / F.nullif("n", F.lit(0))).alias("g"))
    rate = before(cells, ["ctx", "outs"], ["s", "n"]).select(F.col("ctx").alias("kc"), F.col("outs").alias("ko"), F.col("period").alias("kp"), F.col("s").alias("ks"), F.col("n").alias("kn"))
    rows = rows.join(rate, (F.col("ctx") == F.col("kc")) & (F.col("outs") == F.col("ko")) & (F.col("period") == F.col("kp")), "left").join(F.broadcast(whole), F.col("period") == F.col("gp"), "left")  # one row for each season
    q = (F.coalesce("ks", F.lit(0)) + 100.0 * F.col("g")) / (F.coalesce("kn", F.lit(0)) + 100.0)
    return rows.withColumn("bits", S.entropy_bits(q)).drop("kc", "ko", "kp", "ks", "kn", "gp", "g")


def k21_disagreement(spark: SparkSession, folder: str) -> DataFrame:
    """Rows on which candidates disagree most and least: the blend's error, the best candidate's in hindsight, spread, range and entropy."""
    pr = with_entropy(members(spark, folder), trials(spark, folder))
    scopes = []
    for scope, names in SCOPES.items():
        cols, k = [F.col(f"m_{n}") for n in names], len(names)
        mean = sum(cols[1:], cols[0]) / k
        std = F.sqrt(sum((F.pow(c - mean, 2) for c in cols[1:]), F.pow(cols[0] - mean, 2)) / k)
        best = F.least(*[F.pow(c - F.col("y"), 2) for c in cols])
        scopes.append(F.struct(F.lit(scope).alias("scope"), F.round(std, 9).alias("std"), (F.greatest(*cols) - F.least(*cols)).alias("range"), best.alias("best")))
    long = pr.select("period", "y", "p", "bits", F.explode(F.array(*scopes)).alias("x")).select("period", "y", "p", "bits", "x.*")
    cuts = quantiles(long, ["period", "scope"], "std", [0.2, 0.8]).select(F.col("period").alias("cp"), F.col("scope").alias("cs"), "q")
    rates = pr.groupBy("period").agg(F.avg("y").alias("r"), F.count("*").alias("all")).withColumnRenamed("period", "rp")
    long = long.join(F.broadcast(cuts), (F.col("period") == F.col("cp")) & (F.col("scope") == F.col("cs"))).join(F.broadcast(rates), F.col("period") == F.col("rp"))  # a row or two for each season
    rows = masked(long, {"high": F.col("std") >= F.col("q")[1], "low": F.col("std") <= F.col("q")[0], "all": F.lit(True)}, "band")
    base = F.pow(F.col("p") - F.col("y"), 2)
    return rows.groupBy("period", "scope", "band").agg(
        F.count("*").alias("n"), r6(F.count("*") / F.max("all")).alias("share"), r6(F.avg(base)).alias("brier"), r6(F.avg("best")).alias("oracle"), F.round(1e5 * F.avg(base - F.col("best")) / F.max(F.col("r") * (1 - F.col("r"))), 3).alias("oracle_gain"),
        r6(F.avg("std")).alias("std"), r6(F.avg("range")).alias("range"), r6(F.avg("bits")).alias("bits"), r6(F.avg((F.col("bits") >= 0.95).cast("int"))).alias("high_entropy"),
    )


def k25_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Seven overlapping kinds of error in 2022 and 2024 with their parts of all error; the parts don't add up to one."""
    pr = stored(with_entropy(members(spark, folder), trials(spark, folder)).filter(F.col("period").isin(*BOTH)))
    frame = framed(spark, folder).filter(F.col("period").isin(*BOTH)).select(F.col("a").alias("fa"), F.col("na").alias("fn"), "game_type", "count_family", "matchup_novelty", "pitcher_history", "batter_history")
    pr = pr.join(frame, (F.col("a") == F.col("fa")) & (F.col("na") == F.col("fn"))).drop("fa", "fn")
    pr = stored(pr)  # read six times
    x, z = (F.col(f"`{s}`") for s in BOTH)
    cells = pr.groupBy("game_type", "count_family").pivot("period", list(BOTH)).agg(F.avg(F.col("y") - F.col("p")))
    stable = cells.select(F.col("game_type").alias("sg"), F.col("count_family").alias("sf"), ((F.signum(x) == F.signum(z)) & (F.abs(x) >= 0.005) & (F.abs(z) >= 0.005)).alias("level"))
    losses = [F.struct(F.avg(F.pow(F.col(f"m_{k}") - F.col("y"), 2)).alias("loss"), F.lit(k).alias("k")) for k in CANDIDATES]
    routes = pr.groupBy("count_family").pivot("period", list(BOTH)).agg(F.least(*losses)["k"])
    routes = routes.select(F.col("count_family").alias("rf"), ((x == z) & (x != "p")).alias("route"))
    cols = [F.col(f"m_{n}") for n in SCOPES["quality"]]
    mean = sum(cols[1:], cols[0]) / len(cols)
    pr = pr.withColumn("std", F.round(F.sqrt(sum((F.pow(c - mean, 2) for c in cols[1:]), F.pow(cols[0] - mean, 2)) / len(cols)), 9))
    cuts = quantiles(pr, ["period"], "e", [0.8], "qe").join(quantiles(pr, ["period"], "std", [0.2], "qs"), "period").withColumnRenamed("period", "cp")
    pr = pr.join(stable, (F.col("game_type") == F.col("sg")) & (F.col("count_family") == F.col("sf")), "left").join(routes, F.col("count_family") == F.col("rf"), "left").join(F.broadcast(cuts), F.col("period") == F.col("cp"))  # one row for each season
    level, top = F.coalesce("level", F.lit(False)), F.col("e") >= F.col("qe")[0]
    kinds = {
        "CALIBRATION_LIKE": level, "DISCRIMINATION_LIKE": top & ~level, "SPARSE_RELIABILITY": F.col("pitcher_history").isin("0", "1_20", "21_100") | F.col("batter_history").isin("0", "1_20", "21_100") | (F.col("matchup_novelty") == "unseen"),
        "INTERACTION_FAILURE": F.col("matchup_novelty") == "low_1_5", "TEMPORAL_PRIOR_FAILURE": F.col("game_type") == "F", "MODEL_FAMILY_RECOVERABLE": F.coalesce("route", F.lit(False)), "UNEXPLAINED": (F.col("std") <= F.col("qs")[0]) & (F.col("bits") >= 0.95),
    }
    whole = pr.groupBy("period").agg(F.sum("e").alias("se"), F.count("*").alias("sn")).withColumnRenamed("period", "wp")
    cells = masked(pr, kinds, "kind").groupBy("period", "kind").agg(F.count("*").alias("n"), F.avg("e").alias("m"), F.sum("e").alias("s"))
    return cells.join(F.broadcast(whole), F.col("period") == F.col("wp")).select("period", "kind", "n", r6(F.col("n") / F.col("sn")).alias("share"), r6("m").alias("brier"), r6(F.col("s") / F.col("sn")).alias("contribution"), r6(F.col("s") / F.col("se")).alias("error_share"))  # one row for each season


def k26_required(spark: SparkSession, folder: str) -> DataFrame:
    """The gain in squared error that a gain in skill of 10, 20 or 40 takes, by season."""
    r = predictions(spark, folder).groupBy("period").agg(F.avg("y").alias("r"))
    return r.withColumn("points", F.explode(F.array(*[F.lit(k) for k in (10, 20, 40)]))).select("period", "points", F.round(F.col("points") * F.col("r") * (1 - F.col("r")) / 1e5, 9).alias("required"))


SEGMENTS, FOLDS, LEAST = ["count_family", "inning_phase", "base_state", "hand_matchup", "pitcher_history"], (2022, 2023, 2024), 300


def k32_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of 300 rows or more in each of three seasons, with the gain of an even mix of blend and second member; stable: gains in all three."""
    half = predictions(spark, folder).select(F.col("a").alias("fa"), F.col("na").alias("fn"), "p2")
    rows = framed(spark, folder).filter(F.col("period").isin(*FOLDS)).join(half, (F.col("a") == F.col("fa")) & (F.col("na") == F.col("fn")))
    gain = F.pow(F.col("p") - F.col("y"), 2) - F.pow((F.col("p") + F.col("p2")) / 2 - F.col("y"), 2)
    long = rows.select("period", gain.alias("g"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in SEGMENTS])).alias("x")).select("period", "g", "x.*")
    cells = long.groupBy("feature", "level", "period").agg(F.count("*").alias("n"), F.avg("g").alias("g")).filter(F.col("n") >= LEAST)
    out = cells.groupBy("feature", "level").agg(F.count("*").alias("folds"), F.round(F.min("g"), 9).alias("min_gain"), F.round(F.max("g"), 9).alias("max_gain"), F.round(F.avg("g"), 9).alias("mean_gain"), F.sum("n").alias("n"))
    return out.withColumn("stable", (F.col("folds") == len(FOLDS)) & (F.col("min_gain") > 0))


def k36_stop(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a candidate is given up: worse in both reference seasons for both of the first two seeds (here halves of the rows by counter)."""
    pr = members(spark, folder).filter(F.col("period").isin(*FOLDS))
    gain = F.pow(F.col("p") - F.col("y"), 2) - F.pow(F.col("m") - F.col("y"), 2)
    long = pr.select("period", "y", "p", F.pmod("na", F.lit(2)).alias("seed"), F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), F.col(f"m_{k}").alias("m")) for k in CANDIDATES if k != "p"])).alias("x")).select("period", "y", "p", "seed", "x.*")
    cells = long.groupBy("candidate", "seed", "period").agg(F.avg(gain).alias("g"))
    done = F.count("*") == 2 * len(FOLDS)
    return cells.groupBy("candidate").agg(F.count("*").alias("runs"), F.round(F.min("g"), 9).alias("worst"), (done & F.bool_and(~F.col("period").isin(*BOTH) | (F.col("g") < 0))).alias("stop"))


def k39_linkage(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the blend with 5 % of the second member by how often a pitcher is named in links, and by context, per season."""
    links = table(spark, folder, "pitcher_link").select(number_of("id_a").alias("x"), number_of("id_b").alias("z")).filter("x IS NOT NULL AND z IS NOT NULL AND x <> z")
    named = links.select(F.explode(F.array("x", "z")).alias("ka")).groupBy("ka").agg(F.count("*").alias("links"))
    pr = predictions(spark, folder).join(named, F.col("a") == F.col("ka"), "left").withColumn("links", F.coalesce("links", F.lit(0))).drop("ka")
    middle = quantiles(pr.filter("links > 0").select("period", "a", "links").distinct(), ["period"], "links", [0.5]).select(F.col("period").alias("mp"), F.col("q")[0].alias("median"))
    pr = pr.join(F.broadcast(middle), F.col("period") == F.col("mp"), "left").withColumn("median", F.coalesce("median", F.lit(0.0)))  # one row for each season
    n = F.col("links")
    fixed = {"linked": n > 0, "unlinked": n == 0, "high": n >= F.col("median"), "low": (n > 0) & (n < F.col("median")), "cold": F.coalesce("na", F.lit(0)) <= 0, "known": F.coalesce("na", F.lit(0)) > 0}
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in fixed.items()], F.concat(F.lit("hands_"), F.coalesce(F.col("ahand").cast("string"), F.lit("nan")), F.lit("/"), F.coalesce(F.col("bhand").cast("string"), F.lit("nan"))), F.concat(F.lit("count_"), F.concat_ws("-", "balls", "strikes"))))
    q = 0.95 * F.col("p") + 0.05 * F.col("p2")
    return pr.withColumn("subset", F.explode(names)).groupBy("period", "subset").agg(F.count("*").alias("n"), F.max("median").alias("median"), r6(M.brier(F.col("p"), F.col("y"))).alias("brier"), r6(M.brier(q, F.col("y"))).alias("blended"), F.round(M.skill_gain(F.col("p"), q, F.col("y")), 3).alias("gain"))


def j8_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Two groups of members, each calibrated on the season before, mixed 60 to 40."""
    pr = predictions(spark, folder).withColumn("g1", (F.col("p1") + F.col("p2")) / 2).withColumn("g2", 0.7 * F.col("p") + 0.3 * F.col("p1"))
    for g in ("g1", "g2"):
        pr = C.chained(pr, C.grid_fit(pr, "period", g, "y"), "period", g, f"{g}_cal")
    return pr.select(*KEY, r6(0.6 * F.col("g1_cal") + 0.4 * F.col("g2_cal")).alias("p_stack"))


def j14_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The blend, its members and two experts mixed 0.5, 0.25 and 0.25 for pitches with a new batter, else the blend."""
    cold = F.coalesce("nb", F.lit(0)) <= 0
    mix = C.convex({"p": 0.5, "p1": 0.25, "p2": 0.25})
    return predictions(spark, folder).select(*KEY, cold.cast("int").alias("cold"), r6(F.when(cold, mix).otherwise(F.col("p"))).alias("p_mix"))


_m = lambda k: CANDIDATES[k] if k in ("p", "p1", "p2") else f"({CANDIDATES[k]})"
MEMBERS = f"{PRED}, mm AS (SELECT *, round(pow(p - y, 2), 9) AS e, {', '.join(f'{v} AS m_{k}' for k, v in CANDIDATES.items())} FROM pp)"


def _std(names: list[str]) -> str:
    mean = f"(({' + '.join(f'm_{n}' for n in names)}) / {len(names)}.0::DOUBLE)"
    return f"round(sqrt(({' + '.join(f'pow(m_{n} - {mean}, 2)' for n in names)}) / {len(names)}.0::DOUBLE), 9)"


_tops = ", ".join(f"round(avg(CASE WHEN e >= q[{i + 1}] THEN g END), 6) AS top{k}_gain, round(avg(CASE WHEN e >= q[{i + 1}] THEN (round(g, 12) > 0)::INT END), 6) AS top{k}_wins" for i, k in enumerate(TOPS))
_bits = """cl AS (SELECT ctx, outs, period, sum(y) AS s, count(*) AS n FROM t WHERE y IS NOT NULL GROUP BY ALL), gl AS (SELECT period, sum(s) AS s, sum(n) AS n FROM cl GROUP BY period),
gw AS (SELECT period, (sum(s) OVER w)::DOUBLE / (sum(n) OVER w) AS g FROM gl WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), cw AS (SELECT ctx, outs, period, sum(s) OVER w AS s, sum(n) OVER w AS n FROM cl WINDOW w AS (PARTITION BY ctx, outs ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
eq AS (SELECT mm.*, (coalesce(cw.s, 0) + 100.0::DOUBLE * g) / (coalesce(cw.n, 0) + 100.0::DOUBLE) AS qq FROM mm LEFT JOIN cw ON cw.ctx = mm.ctx AND cw.outs = mm.outs AND cw.period = mm.period LEFT JOIN gw ON gw.period = mm.period),
eb AS (SELECT *, CASE WHEN qq IS NOT NULL THEN -(CASE WHEN qq > 0 THEN qq * log2(qq) ELSE 0 END + CASE WHEN qq < 1 THEN (1 - qq) * log2(1 - qq) ELSE 0 END) END AS bits FROM eq)"""
_scopes = " UNION ALL ".join(f"SELECT period, y, p, bits, '{s}' AS scope, {_std(n)} AS std, greatest({', '.join(f'm_{k}' for k in n)}) - least({', '.join(f'm_{k}' for k in n)}) AS range, least({', '.join(f'pow(m_{k} - y, 2)' for k in n)}) AS best FROM eb" for s, n in SCOPES.items())
_long = " UNION ALL ".join(f"SELECT period, y, p, e, na, '{k}' AS candidate, m_{k} AS m, pow(p - y, 2) - pow(m_{k} - y, 2) AS g FROM mm" for k in CANDIDATES)
_kinds = {
    "CALIBRATION_LIKE": "lv", "DISCRIMINATION_LIKE": "e >= qe AND NOT lv", "SPARSE_RELIABILITY": "pitcher_history IN ('0', '1_20', '21_100') OR batter_history IN ('0', '1_20', '21_100') OR matchup_novelty = 'unseen'", "INTERACTION_FAILURE": "matchup_novelty = 'low_1_5'",
    "TEMPORAL_PRIOR_FAILURE": "game_type = 'F'", "MODEL_FAMILY_RECOVERABLE": "rt", "UNEXPLAINED": "std <= qs AND bits >= 0.95",
}
_segs = " UNION ALL ".join(f"SELECT period, '{c}' AS feature, {c} AS level, g FROM sg" for c in SEGMENTS)
_subsets = {"linked": "links > 0", "unlinked": "links = 0", "high": "links >= median", "low": "links > 0 AND links < median", "cold": "coalesce(na, 0) <= 0", "known": "coalesce(na, 0) > 0"}
_digits = lambda c: f"try_cast(regexp_replace({c}, '[^0-9]', '', 'g') AS BIGINT)"
SQL = {
    "k19_recovery": f"{MEMBERS}, c AS (SELECT period, quantile_cont(e, {[1 - k / 100 for k in TOPS]}) AS q FROM mm GROUP BY period), l AS (SELECT * FROM ({_long}) x JOIN c USING (period)) SELECT period, candidate, count(*) AS n, round(avg(pow(m - y, 2)), 6) AS brier, round(avg(g), 6) AS gain, round(1e5 * avg(g) / nullif(avg(y) * (1 - avg(y)), 0), 3) AS skill_gain, round(avg((round(g, 12) > 0)::INT), 6) AS wins, round(avg((round(g, 12) < 0)::INT), 6) AS losses, round(corr(y - p, y - m), 6) AS residual_corr, round(corr(p, m), 6) AS corr, round(avg(m - p), 6) AS moved, {_tops} FROM l GROUP BY ALL",
    "k21_disagreement": f"{MEMBERS}, {_bits}, l AS ({_scopes}), c AS (SELECT period, scope, quantile_cont(std, [0.2, 0.8]) AS q FROM l GROUP BY ALL), r AS (SELECT period, avg(y) AS r, count(*) AS k FROM mm GROUP BY period), b AS (SELECT l.*, q, r, k, unnest(list_filter([CASE WHEN std >= q[2] THEN 'high' END, CASE WHEN std <= q[1] THEN 'low' END, 'all'], lambda v: v IS NOT NULL)) AS band FROM l JOIN c USING (period, scope) JOIN r USING (period)) SELECT period, scope, band, count(*) AS n, round(count(*) / max(k), 6) AS share, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(best), 6) AS oracle, round(1e5 * avg(pow(p - y, 2) - best) / max(r * (1 - r)), 3) AS oracle_gain, round(avg(std), 6) AS std, round(avg(range), 6) AS range, round(avg(bits), 6) AS bits, round(avg((bits >= 0.95)::INT), 6) AS high_entropy FROM b GROUP BY ALL",
    "k25_classes": f"""{FRAME}, mm AS (SELECT *, round(pow(p - y, 2), 9) AS e, {', '.join(f'{v} AS m_{k}' for k, v in CANDIDATES.items())} FROM pp), {_bits},
z AS (SELECT eb.*, {_std(SCOPES['quality'])} AS std, f.game_type, f.count_family, f.matchup_novelty, f.pitcher_history, f.batter_history FROM eb JOIN fr f ON f.a = eb.a AND f.na = eb.na WHERE eb.period IN (2022, 2024)),
lc AS (SELECT game_type, count_family, avg(CASE WHEN period = 2022 THEN y - p END) AS x, avg(CASE WHEN period = 2024 THEN y - p END) AS w FROM z GROUP BY ALL),
rc AS (SELECT count_family, period, least({', '.join(f"struct_pack(loss := avg(pow(m_{k} - y, 2)), k := '{k}')" for k in CANDIDATES)}).k AS win FROM z GROUP BY ALL), rr AS (SELECT count_family, min(win) = max(win) AND min(win) <> 'p' AND count(*) = 2 AS rt FROM rc GROUP BY ALL),
qz AS (SELECT period, quantile_cont(e, 0.8) AS qe, quantile_cont(std, 0.2) AS qs, sum(e) AS se, count(*) AS sn FROM z GROUP BY period),
v AS (SELECT z.*, coalesce(sign(x) = sign(w) AND abs(x) >= 0.005 AND abs(w) >= 0.005, false) AS lv, coalesce(rt, false) AS rt, qe, qs, se, sn FROM z LEFT JOIN lc USING (game_type, count_family) LEFT JOIN rr USING (count_family) JOIN qz USING (period)),
k AS ({' UNION ALL '.join(f"SELECT period, '{n}' AS kind, e, se, sn FROM v WHERE {c}" for n, c in _kinds.items())})
SELECT period, kind, count(*) AS n, round(count(*) / max(sn), 6) AS share, round(avg(e), 6) AS brier, round(sum(e) / max(sn), 6) AS contribution, round(sum(e) / max(se), 6) AS error_share FROM k GROUP BY ALL""",
    "k26_required": f"{PRED}, r AS (SELECT period, avg(y) AS r FROM pp GROUP BY period) SELECT period, points, round(points * r * (1 - r) / 1e5, 9) AS required FROM r, (SELECT unnest([10, 20, 40]) AS points)",
    "k32_segments": f"{FRAME}, sg AS (SELECT fr.*, pow(fr.p - fr.y, 2) - pow((fr.p + pp.p2) / 2 - fr.y, 2) AS g FROM fr JOIN pp ON pp.a = fr.a AND pp.na = fr.na WHERE fr.period IN (2022, 2023, 2024)), c AS (SELECT feature, level, period, count(*) AS n, avg(g) AS g FROM ({_segs}) GROUP BY ALL HAVING count(*) >= {LEAST}) SELECT feature, level, count(*) AS folds, round(min(g), 9) AS min_gain, round(max(g), 9) AS max_gain, round(avg(g), 9) AS mean_gain, sum(n)::BIGINT AS n, count(*) = 3 AND round(min(g), 9) > 0 AS stable FROM c GROUP BY ALL",
    "k36_stop": f"{MEMBERS}, c AS (SELECT candidate, na % 2 AS seed, period, avg(g) AS g FROM ({_long}) WHERE candidate <> 'p' AND period IN (2022, 2023, 2024) GROUP BY ALL) SELECT candidate, count(*) AS runs, round(min(g), 9) AS worst, count(*) = 6 AND bool_and(period NOT IN (2022, 2024) OR g < 0) AS stop FROM c GROUP BY candidate",
    "k39_linkage": f"""{PRED}, lk AS (SELECT {_digits('id_a')} AS x, {_digits('id_b')} AS z FROM pitcher_link), nm AS (SELECT ka, count(*) AS links FROM (SELECT unnest([x, z]) AS ka FROM lk WHERE x IS NOT NULL AND z IS NOT NULL AND x <> z) GROUP BY ka),
j AS (SELECT pp.*, coalesce(links, 0) AS links FROM pp LEFT JOIN nm ON ka = a), md AS (SELECT period, median(links)::DOUBLE AS m FROM (SELECT DISTINCT period, a, links FROM j WHERE links > 0) GROUP BY period), w AS (SELECT j.*, coalesce(m, 0)::DOUBLE AS median FROM j LEFT JOIN md USING (period)),
s AS ({' UNION ALL '.join(f"SELECT *, '{n}' AS subset FROM w WHERE {c}" for n, c in _subsets.items())} UNION ALL SELECT *, 'hands_' || coalesce(ahand::VARCHAR, 'nan') || '/' || coalesce(bhand::VARCHAR, 'nan') FROM w UNION ALL SELECT *, 'count_' || balls || '-' || strikes FROM w)
SELECT period, subset, count(*) AS n, max(median) AS median, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(pow(0.95::DOUBLE * p + 0.05::DOUBLE * p2 - y, 2)), 6) AS blended, round(1e5 * (avg(pow(p - y, 2)) - avg(pow(0.95::DOUBLE * p + 0.05::DOUBLE * p2 - y, 2))) / nullif(avg(y) * (1 - avg(y)), 0), 3) AS gain FROM s GROUP BY ALL""",
    "j8_stack": f"""{PRED}, ga AS (SELECT * REPLACE ((p1 + p2) / 2 AS p) FROM pp), gb AS (SELECT * REPLACE (0.7::DOUBLE * p + 0.3::DOUBLE * p1 AS p) FROM pp), {fit_sql('ga', 'period', 'fa')}, {fit_sql('gb', 'period', 'fb')}
SELECT ga.a, ga.na, round(0.6::DOUBLE * CASE WHEN fa.scale IS NULL THEN ga.p ELSE {_rc('ga.p', 'fa.scale', 'fa.bias')} END + 0.4::DOUBLE * CASE WHEN fb.scale IS NULL THEN gb.p ELSE {_rc('gb.p', 'fb.scale', 'fb.bias')} END, 6) AS p_stack FROM ga JOIN gb ON gb.a = ga.a AND gb.na = ga.na LEFT JOIN fa ON fa.period + 1 = ga.period LEFT JOIN fb ON fb.period + 1 = ga.period""",
    "j14_mix": f"{PRED} SELECT a, na, (coalesce(nb, 0) <= 0)::INT AS cold, round(CASE WHEN coalesce(nb, 0) <= 0 THEN 0.5::DOUBLE * p + 0.25::DOUBLE * p1 + 0.25::DOUBLE * p2 ELSE p END, 6) AS p_mix FROM pp",
}
QUERIES = {f.__name__: f for f in (k19_recovery, k21_disagreement, k25_classes, k26_required, k32_segments, k36_stop, k39_linkage, j8_stack, j14_mix)}
