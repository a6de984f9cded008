import random
from itertools import product

from pastglass.operators.resolve import fingerprints, mutual_best, similarities
from pastglass.plans.shifts import first_delivery, matched
from pyspark.sql import functions as F


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(8)
    rows = [(side, e, c, e % 2) for side in "lr" for e in range(40) for c in [rng.choice([0, 1, rng.randrange(2, 60), (e * 7) % 50 + 60]) for _ in range(25)]]
    df = spark.createDataFrame(rows, "side string, e long, c long, k long")
    l, r = (fingerprints(df.filter(F.col("side") == s).withColumnRenamed("e", n), n, F.col("c"), F.col("k")) for s, n in (("l", "x"), ("r", "z")))
    vec = {}
    for s, f, n in (("l", l, "x"), ("r", r, "z")):
        for row in f.collect():
            vec.setdefault((s, row[n], row["block"]), {})[row["cell"]] = row["v"]
    for least in (0.3, 0.5, 0.8):
        got = {(q["x"], q["z"]): q["sim"] for q in similarities(l, r, "x", "z", least).collect()}
        want = {}
        for (s, x, b), (t, z, d) in product(vec, vec):
            if s == "l" and t == "r" and b == d:
                sim = round(sum(v * vec[t, z, d].get(c, 0) for c, v in vec[s, x, b].items()), 9)
                if sim >= least:
                    want[x, z] = sim
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-8 for p in want)


def test_a_planted_log_is_matched_with_recall(spark):
    """120 pitchers in two logs under other ids, half of the log lost, teams and hands as they are; and strangers."""
    rng = random.Random(4)
    train, log, true = [], [], {}
    for e in range(120):
        hand, team = rng.choice([1, 2]), rng.randrange(8)
        true[e] = 1000 + (e * 37) % 500
        days = [(y, rng.randrange(3, 11), rng.randrange(7)) for y in (2022, 2023) for _ in range(12)]
        for y, m, d in days:
            for _ in range(rng.randrange(1, 30)):
                train.append((e, y, m, d, hand, team, "R"))
                if rng.random() < 0.5:
                    log.append((len(log), true[e], y, m, d, "Left" if hand == 1 else "Right", f"T{team}"))
    for e in range(20):
        log += [(len(log) + i, 5000 + e, 2022, rng.randrange(3, 11), rng.randrange(7), "Left", "MIN_X") for i in range(50)]
    t = spark.createDataFrame(train, "a long, period long, month long, dow long, ahand long, ateam long, seg string")
    g = spark.createDataFrame(log + log[:50], "trackman_id long, pitcher_trackman_id long, season long, game_month long, game_dayofweek long, pitcher_hand string, pitcher_team string")
    got = matched(t, first_delivery(g, "trackman_id"), "period * 10000 + month * 100 + dow", "season * 10000 + game_month * 100 + game_dayofweek").collect()
    right = sum(true[r["a"]] == r["pitcher_trackman_id"] for r in got)
    assert right == len(got) and right >= 0.9 * len(true)


def test_nothing_to_match(spark):
    empty = spark.createDataFrame([], "x long, c long, k long")
    l = fingerprints(empty, "x", F.col("c"), F.col("k"))
    sims = similarities(l, l.withColumnRenamed("x", "z"), "x", "z")
    assert sims.count() == 0 and mutual_best(sims, "x", "z").count() == 0
