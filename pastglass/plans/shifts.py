"""Distribution shift, slices, routing, entity resolution and contracts (survey groups C to H, K and M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastglass.operators import contracts as K
from pastglass.operators import metrics as M
from pastglass.operators import resolve as R
from pastglass.operators import slices as L
from pastglass.operators.profile import quantiles
from pastglass.plans.rowlocal import KEY, r6
from pastglass.plans.trials import PRED, TRIALS, predictions, trials
from pastglass.sources.tables import cut, table

def err() -> Column:
    """Squared error of the blend."""
    return F.pow(F.col("p") - F.col("y"), 2)


def k16_cold(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of rows with a new batter, a new pair, and little history, by season; distinct and new entities."""
    t = trials(spark, folder)
    fb, fp = t.groupBy("b").agg(F.min("period").alias("fb")).withColumnRenamed("b", "kb"), t.groupBy("a", "b").agg(F.min("period").alias("fp")).select(F.col("a").alias("ka"), F.col("b").alias("kb2"), "fp")
    t = t.filter("b IS NOT NULL").join(fb, F.col("b") == F.col("kb")).join(fp, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb2")))
    cold = F.col("fb") == F.col("period")
    return t.groupBy("period").agg(r6(F.avg(cold.cast("int"))).alias("cold"), r6(F.avg((F.col("fp") == F.col("period")).cast("int"))).alias("cold_pair"), r6(F.avg((F.col("nb") < 100).cast("int"))).alias("low_history"), F.count_distinct("b").alias("batters"), F.count_distinct(F.when(cold, F.col("b"))).alias("new_batters"))


def k17_teams(spark: SparkSession, folder: str) -> DataFrame:
    """Share of a team's pitches per season, and its change over the last two."""
    t = trials(spark, folder).groupBy("ateam").pivot("period", [2022, 2023, 2024]).count().fillna(0)
    tot = t.agg(*[F.sum(str(y)).alias(f"t{y}") for y in (2022, 2023, 2024)])
    s = {y: F.col(str(y)) / F.col(f"t{y}") for y in (2022, 2023, 2024)}
    return t.crossJoin(F.broadcast(tot)).select("ateam", *[r6(v).alias(f"share_{y}") for y, v in s.items()], r6(s[2024] - s[2023]).alias("change"))  # one row


def f10_excess(spark: SparkSession, folder: str) -> DataFrame:
    """How much 2023 differs from the seasons around it, by count."""
    t = trials(spark, folder).groupBy("ctx").pivot("period", [2022, 2023, 2024]).agg(F.avg("y"))
    return t.select("ctx", r6(F.abs(F.col("2023") - (F.col("2022") + F.col("2024")) / 2) - F.abs(F.col("2024") - F.col("2022"))).alias("excess"))


def c9_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Mean error, leverage and history in bands of the error's quantiles."""
    pr = predictions(spark, folder).withColumn("err", r6(err()))
    q = quantiles(pr, ["period"], "err", [0.2, 0.8, 0.9, 0.95, 0.99]).withColumnRenamed("period", "qp")
    pr = pr.join(q, F.col("period") == F.col("qp"))
    e = F.col("err")
    bands = {"top1": e >= F.col("q")[4], "top5": e >= F.col("q")[3], "top10": e >= F.col("q")[2], "top20": e >= F.col("q")[1], "middle": (e > F.col("q")[0]) & (e < F.col("q")[1]), "bottom20": e <= F.col("q")[0], "sure_wrong": ((F.col("y") == 1) & (F.col("p") < 0.4)) | ((F.col("y") == 0) & (F.col("p") > 0.6))}
    return L.masked(pr, bands).groupBy("period", "mask").agg(F.count("*").alias("n"), F.round(F.avg("err"), 9).alias("err"), r6(F.avg("li")).alias("li"), r6(F.avg("na")).alias("history"))


def k23_route(spark: SparkSession, folder: str) -> DataFrame:
    """The better member of each cell on 2023, applied to 2024; and whether it wins there too."""
    pr = predictions(spark, folder)
    long = pr.withColumn("x", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.pow(F.col(m) - F.col("y"), 2).alias("loss")) for m in ("p", "p1", "p2")]))).select("period", "ctx", "x.*")
    cells = long.groupBy("period", "ctx", "m").agg(F.round(F.avg("loss"), 10).alias("loss"), F.count("*").alias("n"))
    one, two = (L.best_candidate(cells.filter(f"period = {y}"), "ctx", "m", "loss", "n", 30, "p").withColumnRenamed("winner", f"winner_{y}") for y in (2023, 2024))
    routed = cells.filter("period = 2024").join(one, "ctx")
    gain = routed.groupBy("ctx").agg(r6(F.max(F.when(F.col("m") == "p", F.col("loss"))) - F.max(F.when(F.col("m") == F.col("winner_2023"), F.col("loss")))).alias("gain"))
    return one.join(two, "ctx").join(gain, "ctx").withColumn("stable", (F.col("winner_2023") == F.col("winner_2024")) & (F.col("gain") > 0))


def k20_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of the rows that each member improves, and correlation of their gains."""
    g = {m: err() - F.pow(F.col(m) - F.col("y"), 2) for m in ("p1", "p2")}
    pr = predictions(spark, folder).select("period", *[v.alias(m) for m, v in g.items()])
    both = ((F.col("p1") > 0) & (F.col("p2") > 0)).cast("long")
    return pr.groupBy("period").agg(r6(F.sum(both) / F.sum(((F.col("p1") > 0) | (F.col("p2") > 0)).cast("long"))).alias("jaccard"), r6(F.corr("p1", "p2")).alias("gain_corr"), *[r6(F.avg((F.col(m) > 0).cast("int"))).alias(f"win_{m}") for m in g])


def k42_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Mean residual by fifth of history, and within-cell correlation weighted by size."""
    from pastglass.operators.encode import quantile_bins

    pr = quantile_bins(predictions(spark, folder), "na", 5, "fifth")
    cells = pr.groupBy("ctx").agg(F.corr("p1", "y").alias("c"), F.count("*").alias("n")).filter("n >= 100").agg(r6(F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("cell_corr"))
    return pr.groupBy("fifth").agg(F.count("*").alias("n"), r6(F.avg(F.col("y") - F.col("p"))).alias("residual")).crossJoin(F.broadcast(cells))  # one row


def e15_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """Rate per season and pooled, with the modal batter's hand."""
    t = trials(spark, folder)
    mode = R.modal(t, ["period"], "bhand").withColumnRenamed("period", "mp")
    rows = t.rollup("period").agg(F.count("*").alias("n"), r6(F.avg("y")).alias("rate"), F.count_distinct("a").alias("pitchers"))
    return rows.join(mode, F.col("period") == F.col("mp"), "left").drop("mp")


def d6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Earlier meetings of pitcher and batter, in right-closed bins, by season."""
    from pastglass.functions.scalars import right_closed
    from pastglass.plans.trials import before

    t = trials(spark, folder).filter("b IS NOT NULL")
    cells = t.groupBy("a", "b", "period").agg(F.count("*").alias("n"))
    prior = before(cells, ["a", "b"], ["n"]).join(cells.withColumnRenamed("n", "rows"), ["a", "b", "period"])
    return prior.withColumn("met", right_closed(F.col("n"), [-1, 0, 2, 5, 1e9], ["never", "1-2", "3-5", "6+"])).groupBy("period", "met").agg(F.sum("rows").alias("n_rows"))


LEAST_SIM = 0.5


def d15_match(spark: SparkSession, folder: str) -> DataFrame:
    """Pitchers of even and odd pitches matched again by fingerprints over calendar cells, within a hand, from a cosine of one half."""
    t = trials(spark, folder)
    cell = F.col("period") * 10000 + F.col("month") * 100 + F.col("dow")
    left, right = (cut(R.fingerprints(t.filter(F.pmod("na", F.lit(2)) == k).withColumnRenamed("a", n), n, cell, F.col("ahand"))) for k, n in ((0, "left_id"), (1, "right_id")))
    return R.mutual_best(R.similarities(left, right, "left_id", "right_id", LEAST_SIM), "left_id", "right_id").select("left_id", "right_id", F.round("sim", 6).alias("sim"))


#: The hand behind a number of train, and teams of the log that are no first teams besides those with the prefix.
HANDS, SECOND, NO_TEAM = {1: "left", 2: "right"}, "MIN_", ["KBO_ARM", "KBO_POL", "ACE_MEX"]


def first_delivery(log: DataFrame, key: str) -> DataFrame:
    """One row for each key: the least by all its columns, whatever the order of rows; null keys are one key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.min(F.struct(*rest)).alias("__x")).select(key, "__x.*")


def matched(t: DataFrame, log: DataFrame, cell: str, log_cell: str, least: float = LEAST_SIM, support: int = 3) -> DataFrame:
    """(a, pitcher_trackman_id, sim, agree): pitchers of the log matched to those of t by fingerprints over the cells, of
    one hand, each other's best, and in the same team in half of their seasons at least."""
    first = ~F.coalesce(F.col("pitcher_team").startswith(SECOND) | F.col("pitcher_team").isin(NO_TEAM), F.lit(False))
    log, t = log.filter(first), t.filter("seg = 'R'")
    hand = F.coalesce(*[F.when(F.col("ahand") == k, F.lit(v)) for k, v in HANDS.items()])
    left = cut(R.fingerprints(t, "a", F.expr(cell), hand))
    right = cut(R.fingerprints(log, "pitcher_trackman_id", F.expr(log_cell), F.lower("pitcher_hand")))
    pairs = cut(R.mutual_best(R.similarities(left, right, "a", "pitcher_trackman_id", least), "a", "pitcher_trackman_id"))
    teams = R.modal(log, ["pitcher_trackman_id", "season"], "pitcher_team").withColumnRenamed("season", "period")
    return R.agreement(pairs, R.modal(t, ["a", "period"], "ateam"), teams, "a", "pitcher_trackman_id", "period", "ateam", "pitcher_team", support, 0.5)


def d17_trackman(spark: SparkSession, folder: str) -> DataFrame:
    """Pitchers of the secondary log matched to train by fingerprints over calendar cells, checked by their teams per season."""
    log = first_delivery(table(spark, folder, "trackman_history"), "trackman_id")
    got = matched(trials(spark, folder), log, "period * 10000 + month * 100 + dow", "season * 10000 + game_month * 100 + game_dayofweek")
    return got.select("a", "pitcher_trackman_id", F.round("sim", 6).alias("sim"), r6("agree").alias("agree"))


def e6_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and within-type deviation of a pitcher's measures in the secondary log."""
    log = first_delivery(table(spark, folder, "trackman_history"), "trackman_id")
    for c in ("spin_rate", "extension"):
        log = log.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    out = R.profiles(log, "pitcher_trackman_id", "pitch_type_group", ["spin_rate", "extension"])
    return out.select("pitcher_trackman_id", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


def a14_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of a merge of predictions into all pitches: duplicates, missing, extra, undefined, out of range."""
    key = F.concat_ws(":", "a", "na")
    return K.violations(trials(spark, folder).select(key.alias("k")), predictions(spark, folder).select(key.alias("k"), "p"), "k", "p")


def h7_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Row ids that were delivered more than once."""
    return K.repeated(table(spark, folder, "train"), ["row_id"])


def h3_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Batters new in 2024, gone since 2023, and in both."""
    t = trials(spark, folder).filter("b IS NOT NULL")
    x, y = (t.filter(f"period = {p}").select("b").distinct() for p in (2023, 2024))
    named = lambda d, n: d.select(F.lit(n).alias("kind"), "b")
    return named(y.exceptAll(x), "new").unionByName(named(x.exceptAll(y), "gone")).unionByName(named(x.intersect(y), "both"))


def d12_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Pitches of 2024 against batters that the pitcher met before, and their number against others."""
    t = trials(spark, folder)
    met = t.filter("period < 2024 AND b IS NOT NULL").select("a", "b").distinct()
    now = t.filter("period = 2024")
    old, new = now.join(met, ["a", "b"], "left_semi"), now.join(met, ["a", "b"], "left_anti")
    return old.groupBy(F.lit("met").alias("kind")).agg(F.count("*").alias("n")).unionByName(new.groupBy(F.lit("new").alias("kind")).agg(F.count("*").alias("n")))


def m3_independence(spark: SparkSession, folder: str) -> DataFrame:
    """Row independence of the running state given frozen boundaries."""
    from pastglass.operators import state as S

    t = trials(spark, folder)
    frozen = S.boundary(t, "a", "period", 2024, "na", ["r_succ"]).select(F.col("a").alias("ea"), F.struct("n0", "c_r_succ").alias("was_0"))
    run = lambda rows: rows.join(frozen, F.col("a") == F.col("ea"), "left").withColumn("cur", S.current("na", "r_succ")[1])
    return K.independence(t.filter("period = 2024"), KEY, run, ["cur"], ["r_succ"])


def m4_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of train: family, nulls and distinct values."""
    train = table(spark, folder, "train")
    return K.dictionary(train.select(*[c for c, kind in train.dtypes if kind in ("bigint", "string")]))


def m1_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Up to 20 pitches of each season and segment by hash order (a sampling operator)."""
    return K.capped(trials(spark, folder).select(*KEY, "period", "seg"), ["period", "seg"], KEY, 20)


def a13_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Content digest of the pitcher states, the same for any order of rows."""
    return K.fingerprint(table(spark, folder, "pitcher_state"))


_E = f"{PRED}, e AS (SELECT *, pow(p - y, 2) AS err FROM pp)"
_bands = {"top1": "err >= q[5]", "top5": "err >= q[4]", "top10": "err >= q[3]", "top20": "err >= q[2]", "middle": "err > q[1] AND err < q[2]", "bottom20": "err <= q[1]", "sure_wrong": "(y = 1 AND p < 0.4) OR (y = 0 AND p > 0.6)"}
_win = lambda y: f"(SELECT ctx, CASE WHEN max(n) >= 30 THEN arg_min(m, (loss, m)) ELSE 'p' END AS w FROM c WHERE period = {y} GROUP BY ctx)"
_fp = lambda n, k: f"{n}c AS (SELECT a, period * 10000 + month * 100 + dow AS cell, count(*)::DOUBLE AS n FROM t WHERE na % 2 = {k} GROUP BY ALL), {n}h AS (SELECT a, ahand FROM (SELECT a, ahand, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, ahand) AS rn FROM t WHERE na % 2 = {k} AND ahand IS NOT NULL GROUP BY a, ahand) WHERE rn = 1), {n} AS (SELECT a, ahand, cell, sqrt(n) / sqrt(sum(n) OVER (PARTITION BY a)) AS v FROM {n}c JOIN {n}h USING (a))"
_half = lambda n, src, e: f"{n}c AS (SELECT {e}, cell, count(*)::DOUBLE AS n FROM {src} WHERE {e} IS NOT NULL AND cell IS NOT NULL GROUP BY ALL), {n}h AS (SELECT {e}, h FROM (SELECT {e}, h, row_number() OVER (PARTITION BY {e} ORDER BY count(*) DESC, h) AS rn FROM {src} WHERE {e} IS NOT NULL AND h IS NOT NULL GROUP BY {e}, h) WHERE rn = 1), {n} AS (SELECT {e}, h, cell, sqrt(n) / sqrt(sum(n) OVER (PARTITION BY {e})) AS v FROM {n}c JOIN {n}h USING ({e}))"
_plain = "row_id season game_month game_dayofweek inning top_bottom game_type balls_before strikes_before outs_before run_top_before run_bot_before run_total_before score_diff_home score_diff_pitcher_team runner_on_1b runner_on_2b runner_on_3b num_runners_on base_state pitcher_id batter_id pitcher_hand batter_hand pitcher_team_id batter_team_id asof_pitcher_n asof_batter_n asof_pitcher_pitchmix_n control_success".split()
SQL = {
    "k16_cold": f"{TRIALS}, x AS (SELECT *, min(period) OVER (PARTITION BY b) AS fb, min(period) OVER (PARTITION BY a, b) AS fp FROM t WHERE b IS NOT NULL) SELECT period, round(avg((fb = period)::INT), 6) AS cold, round(avg((fp = period)::INT), 6) AS cold_pair, round(avg((nb < 100)::INT), 6) AS low_history, count(DISTINCT b) AS batters, count(DISTINCT CASE WHEN fb = period THEN b END) AS new_batters FROM x GROUP BY period",
    "k17_teams": f"{TRIALS}, c AS (SELECT ateam, {', '.join(f'sum((period = {y})::INT)::DOUBLE AS c{y}' for y in (2022, 2023, 2024))} FROM t GROUP BY ateam), s AS (SELECT ateam, {', '.join(f'c{y} / sum(c{y}) OVER () AS s{y}' for y in (2022, 2023, 2024))} FROM c) SELECT ateam, {', '.join(f'round(s{y}, 6) AS share_{y}' for y in (2022, 2023, 2024))}, round(s2024 - s2023, 6) AS change FROM s",
    "f10_excess": f"{TRIALS}, c AS (SELECT ctx, {', '.join(f'avg(CASE WHEN period = {y} THEN y END) AS y{y}' for y in (2022, 2023, 2024))} FROM t GROUP BY ctx) SELECT ctx, round(abs(y2023 - (y2022 + y2024) / 2) - abs(y2024 - y2022), 6) AS excess FROM c",
    "c9_bands": f"{PRED}, e AS (SELECT * REPLACE (p AS p), round(pow(p - y, 2), 6) AS err FROM pp), q AS (SELECT period, quantile_cont(err, [0.2, 0.8, 0.9, 0.95, 0.99]) AS q FROM e GROUP BY period), m AS ({' UNION ALL '.join(f'''SELECT e.*, '{n}' AS mask FROM e JOIN q USING (period) WHERE {c}''' for n, c in _bands.items())}) SELECT period, mask, count(*) AS n, round(avg(err), 9) AS err, round(avg(li), 6) AS li, round(avg(na), 6) AS history FROM m GROUP BY ALL",
    "k23_route": f"{PRED}, gg AS ({' UNION ALL '.join(f'''SELECT period, ctx, '{m}' AS m, pow({m} - y, 2) AS loss FROM pp''' for m in ('p', 'p1', 'p2'))}), c AS (SELECT period, ctx, m, round(avg(loss), 10) AS loss, count(*) AS n FROM gg GROUP BY ALL), j AS (SELECT x.ctx, x.w AS winner_2023, z.w AS winner_2024 FROM {_win(2023)} x JOIN {_win(2024)} z USING (ctx)), k AS (SELECT j.ctx, round(max(CASE WHEN m = 'p' THEN loss END) - max(CASE WHEN m = winner_2023 THEN loss END), 6) AS gain FROM c JOIN j USING (ctx) WHERE period = 2024 GROUP BY ALL) SELECT ctx, winner_2023, winner_2024, gain, winner_2023 = winner_2024 AND gain > 0 AS stable FROM j JOIN k USING (ctx)",
    "k20_overlap": f"{PRED}, gg AS (SELECT period, pow(p - y, 2) - pow(p1 - y, 2) AS g1, pow(p - y, 2) - pow(p2 - y, 2) AS g2 FROM pp) SELECT period, round(sum((g1 > 0 AND g2 > 0)::INT) / sum((g1 > 0 OR g2 > 0)::INT), 6) AS jaccard, round(corr(g1, g2), 6) AS gain_corr, round(avg((g1 > 0)::INT), 6) AS win_p1, round(avg((g2 > 0)::INT), 6) AS win_p2 FROM gg GROUP BY period",
    "k42_spread": f"{PRED}, e AS (SELECT list_sort(list_distinct(quantile_cont(na, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM pp), f AS (SELECT pp.*, greatest(len(list_filter(e, lambda z: z < na)) - 1, 0)::INT AS fifth FROM pp, e), c AS (SELECT corr(p1, y) AS c, count(*) AS n FROM f GROUP BY ctx HAVING count(*) >= 100) SELECT fifth, count(*) AS n, round(avg(y - p), 6) AS residual, (SELECT round(sum(c * n) / sum(n), 6) FROM c) AS cell_corr FROM f GROUP BY fifth",
    "e15_pooled": f"{TRIALS}, m AS (SELECT period, bhand FROM (SELECT period, bhand, row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, bhand) AS rn FROM t WHERE bhand IS NOT NULL GROUP BY period, bhand) WHERE rn = 1), r AS (SELECT period, count(*) AS n, round(avg(y), 6) AS rate, count(DISTINCT a) AS pitchers FROM t GROUP BY ROLLUP (period)) SELECT r.*, bhand FROM r LEFT JOIN m USING (period)",
    "d6_pairs": f"{TRIALS}, c AS (SELECT a, b, period, count(*) AS k FROM t WHERE b IS NOT NULL GROUP BY ALL), w AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY a, b ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM c) SELECT period, CASE WHEN n <= 0 THEN 'never' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' ELSE '6+' END AS met, sum(k)::BIGINT AS n_rows FROM w GROUP BY ALL",
    "d15_match": f"{TRIALS}, {_fp('x', 0)}, {_fp('z', 1)}, s AS (SELECT x.a AS left_id, z.a AS right_id, round(sum(x.v * z.v), 9) AS sim FROM x JOIN z ON x.cell = z.cell AND x.ahand = z.ahand GROUP BY ALL HAVING round(sum(x.v * z.v), 9) >= 0.5), r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY sim DESC, right_id) AS rl, row_number() OVER (PARTITION BY right_id ORDER BY sim DESC, left_id) AS rr FROM s) SELECT left_id, right_id, round(sim, 6) AS sim FROM r WHERE rl = 1 AND rr = 1",
    "d17_trackman": f"""{TRIALS}, tr AS (SELECT *, period * 10000 + month * 100 + dow AS cell, CASE ahand WHEN 1 THEN 'left' WHEN 2 THEN 'right' END AS h FROM t WHERE seg = 'R'),
lg AS (SELECT *, season * 10000 + game_month * 100 + game_dayofweek AS cell, lower(pitcher_hand) AS h FROM (SELECT DISTINCT ON (trackman_id) * FROM trackman_history) WHERE NOT coalesce(starts_with(pitcher_team, 'MIN_') OR pitcher_team IN ('KBO_ARM', 'KBO_POL', 'ACE_MEX'), false)),
{_half('x', 'tr', 'a')}, {_half('z', 'lg', 'pitcher_trackman_id')},
s AS (SELECT x.a, z.pitcher_trackman_id, round(sum(x.v * z.v), 9) AS sim FROM x JOIN z ON x.cell = z.cell AND x.h = z.h GROUP BY ALL HAVING round(sum(x.v * z.v), 9) >= 0.5),
b AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, pitcher_trackman_id) AS rl, row_number() OVER (PARTITION BY pitcher_trackman_id ORDER BY sim DESC, a) AS rr FROM s), m AS (SELECT a, pitcher_trackman_id, sim FROM b WHERE rl = 1 AND rr = 1),
ta AS (SELECT a, period, ateam FROM (SELECT a, period, ateam, row_number() OVER (PARTITION BY a, period ORDER BY count(*) DESC, ateam) AS rn FROM tr WHERE ateam IS NOT NULL GROUP BY a, period, ateam) WHERE rn = 1),
tb AS (SELECT pitcher_trackman_id, season, pitcher_team FROM (SELECT pitcher_trackman_id, season, pitcher_team, row_number() OVER (PARTITION BY pitcher_trackman_id, season ORDER BY count(*) DESC, pitcher_team) AS rn FROM lg WHERE pitcher_team IS NOT NULL GROUP BY pitcher_trackman_id, season, pitcher_team) WHERE rn = 1),
e AS (SELECT m.*, ateam, pitcher_team, count(*) OVER (PARTITION BY ateam, pitcher_team) >= 3 AS ok FROM m JOIN ta USING (a) JOIN tb ON tb.pitcher_trackman_id = m.pitcher_trackman_id AND tb.season = ta.period)
SELECT a, pitcher_trackman_id, round(max(sim), 6) AS sim, round(avg(ok::INT), 6) AS agree FROM e GROUP BY ALL HAVING avg(ok::INT) >= 0.5""",
    "e6_profiles": "WITH d AS (SELECT DISTINCT ON (trackman_id) pitcher_trackman_id, pitch_type_group, CASE WHEN NOT isnan(spin_rate) THEN spin_rate END AS spin_rate, CASE WHEN NOT isnan(extension) THEN extension END AS extension FROM trackman_history), k AS (SELECT pitcher_trackman_id, pitch_type_group, count(spin_rate) AS n1, sum(spin_rate) AS s1, sum(spin_rate * spin_rate) AS q1, count(extension) AS n2, sum(extension) AS s2, sum(extension * extension) AS q2 FROM d WHERE pitcher_trackman_id IS NOT NULL AND pitch_type_group IS NOT NULL GROUP BY ALL) SELECT pitcher_trackman_id, round(sum(s1) / nullif(sum(n1), 0), 4) AS spin_rate_mean, round(sum(CASE WHEN n1 > 0 THEN n1 * sqrt(greatest(q1 / n1 - (s1 / n1) * (s1 / n1), 0)) END) / nullif(sum(n1), 0), 4) AS spin_rate_within, round(sum(s2) / nullif(sum(n2), 0), 4) AS extension_mean, round(sum(CASE WHEN n2 > 0 THEN n2 * sqrt(greatest(q2 / n2 - (s2 / n2) * (s2 / n2), 0)) END) / nullif(sum(n2), 0), 4) AS extension_within FROM k GROUP BY ALL",
    "a14_contract": f"{PRED} SELECT 0::BIGINT AS duplicates, (SELECT count(*) FROM t) - (SELECT count(*) FROM pp) AS missing, 0::BIGINT AS extra, (SELECT count(*) FROM pp WHERE p IS NULL) AS undefined, (SELECT count(*) FROM pp WHERE p NOT BETWEEN 0 AND 1) AS out_of_range",
    "h7_repeated": "SELECT row_id, count(*) AS copies FROM train GROUP BY 1 HAVING count(*) > 1",
    "h3_sets": f"{TRIALS}, x AS (SELECT DISTINCT b FROM t WHERE period = 2023 AND b IS NOT NULL), z AS (SELECT DISTINCT b FROM t WHERE period = 2024 AND b IS NOT NULL) SELECT 'new' AS kind, b FROM z WHERE b NOT IN (FROM x) UNION ALL SELECT 'gone', b FROM x WHERE b NOT IN (FROM z) UNION ALL SELECT 'both', b FROM x WHERE b IN (FROM z)",
    "d12_semi": f"{TRIALS}, m AS (SELECT DISTINCT a, b FROM t WHERE period < 2024 AND b IS NOT NULL) SELECT CASE WHEN m.a IS NOT NULL THEN 'met' ELSE 'new' END AS kind, count(*) AS n FROM t LEFT JOIN m ON m.a = t.a AND m.b = t.b WHERE period = 2024 GROUP BY 1",
    "m4_dictionary": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, CASE WHEN '{c}' LIKE 'asof_%' THEN 'as_of' WHEN '{c}' LIKE '%_id' THEN 'key' WHEN '{c}' LIKE 'runner_%' OR '{c}' LIKE '%before%' THEN 'context' ELSE 'other' END AS family FROM train" for c in _plain),
}
QUERIES = {f.__name__: f for f in (k16_cold, k17_teams, f10_excess, c9_bands, k23_route, k20_overlap, k42_spread, e15_pooled, d6_pairs, d15_match, d17_trackman, e6_profiles, a14_contract, h7_repeated, h3_sets, d12_semi, m3_independence, m4_dictionary, m1_sample, a13_fingerprint)}
