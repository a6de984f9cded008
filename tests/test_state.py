import math
import random

import numpy as np
import pytest
from pastglass.functions import scalars as S
from pastglass.operators import calibrate, contracts, metrics, residual, resolve, slices, state
from pyspark.sql import functions as F



def test_boundary_off_by_one(spark):
    rows = spark.createDataFrame([(2022, 1, 0, 0.0, 1), (2022, 1, 1, 1.0, 0), (2023, 1, 2, 0.5, 1), (2023, 1, 3, 2 / 3, 1)], "s long, e long, n long, rate double, y long")
    got = state.with_state(rows, state.prior_state(rows, "e", "s", "n", ["rate"], "y"), "e", "s").select("n", state.current("n", "rate")[0].alias("k"), state.current("n", "rate")[1].alias("cur")).orderBy("n").collect()
    assert [tuple(r) for r in got][2:] == [(2, 0.0, None), (3, 1.0, 1.0)] and got[0]["cur"] is None


def test_windows_are_positional_and_leak_nothing(spark):
    rows = [(s, 1, n, 0.5, 1) for n, s in enumerate([2018] * 4 + [2020] * 4 + [2021] * 4)]
    make = lambda r: spark.createDataFrame(r, "s long, e long, n long, rate double, y long")
    run = lambda df: {r["n"]: (r["a"], r["b"]) for r in state.with_state(df, state.prior_state(df, "e", "s", "n", ["rate"], None, (0, 1, 2)), "e", "s").select("n", state.window_rate("rate", 1).alias("a"), F.col("was_1.n0").alias("b")).collect()}
    one = run(make(rows))
    assert one[9] == (0.5, 3.0) and one[4] == (None, None)
    two = run(make([(s, e, n, 0.9 if s == 2021 else r, y) for s, e, n, r, y in rows]))
    assert {n: v for n, v in one.items()} == two


def test_gates_and_gaps(spark):
    df = spark.createDataFrame([(0, 1, 0.3), (3, 2, None)], "b long, s long, v double")
    cells = {f"c{b}{s}": (F.col("b") == b) & (F.col("s") == s) for b in range(4) for s in range(3)}
    got = df.select(*[v.alias(k) for k, v in state.gated(F.col("v"), cells).items()]).collect()
    assert got[0]["c01"] == 0.3 and sum(x is not None for x in got[0]) == 1 and all(x is None for x in got[1])


def test_unseen_keys_equal_their_parent_and_labels_of_scored_rows_play_no_part(spark):
    train = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 1, 0), (2, 1, 0, 1)], "a long, b long, ctx long, y long")
    levels = [residual.Level("a", ("a",), ("all",)), residual.Level("b", ("b",), ("all",)), residual.Level("ab", ("a", "b"), ("a", "b"))]
    rows = [(9, 9, 0, 1), (1, 9, 0, 0), (1, 1, 0, 1)]
    run = lambda r: [(x["e_a"], x["e_b"], x["e_ab"]) for x in residual.hierarchy(train, spark.createDataFrame(r, "a long, b long, ctx long, y long"), "y", levels, 10.0).orderBy("a", "b").collect()]
    got = run(rows)
    assert got[2] == (2 / 3, 2 / 3, 2 / 3) and got == run([(a, b, c, 1 - y) for a, b, c, y in reversed(rows)])


def test_segment_blend_changes_only_its_segment(spark):
    df = spark.createDataFrame([("R", 0.4), ("F", 0.6), (None, 0.2)], "seg string, p double")
    got = [r[0] for r in df.select(residual.expert_mix(F.col("p"), F.lit(0.46), F.coalesce(F.col("seg") == "F", F.lit(False)), 0.25)).collect()]
    assert got == [0.4, 0.75 * 0.6 + 0.25 * 0.46, 0.2]


def test_scalars(spark):
    df = spark.createDataFrame([(2.5, 0.0), (3.5, None), (float("nan"), 0.5)], "x double, p double")
    got = df.select(F.rint("x").alias("r"), S.clean(F.col("x")).alias("c"), S.clip(F.col("p"), 0.1, 0.4).alias("k"), S.entropy_bits(F.col("p")).alias("h"), S.right_closed(F.col("p"), [-1, 0, 0.4], ["zero", "low"]).alias("b")).collect()
    assert [r["r"] for r in got[:2]] == [2.0, 4.0] and got[2]["c"] is None
    assert [(r["k"], r["h"], r["b"]) for r in got] == [(0.1, 0.0, "zero"), (None, None, "nan"), (0.4, 1.0, "nan")]
    with pytest.raises(ValueError):
        S.lambda_shrink(F.lit(0.1), F.lit(1), 0.0, F.lit(0.5))


def scored(spark, n=400, seed=7):
    rng = random.Random(seed)
    rows = [(i, i % 2, rng.random(), 0, rng.randrange(3)) for i in range(n)]
    return [(i, g, p, int(rng.random() < p), c) for i, g, p, _, c in rows]


def test_auc_shift_and_calibration_against_brute_force(spark):
    rows = scored(spark)
    df = spark.createDataFrame(rows, "i long, g long, p double, y long, c long")
    for r in metrics.auc(df, ["g"], "p", "y").collect():
        mine = [x for x in rows if x[1] == r["g"]]
        pos, neg = [x[2] for x in mine if x[3]], [x[2] for x in mine if not x[3]]
        assert abs(r["auc"] - np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])) < 1e-12
    for r in calibrate.level_shift(df, "g", "p", "y").collect():
        mine = [x for x in rows if x[1] == r["g"]]
        z = np.log([x[2] / (1 - x[2]) for x in mine])
        assert abs(np.mean(1 / (1 + np.exp(-(z + r["shift"])))) - np.mean([x[3] for x in mine])) < 1e-5
    assert metrics.calibration(df, ["g"], "p", "y").count() == 20
    with pytest.raises(ValueError):
        calibrate.Blend({"p": (1, 0)}, {"p": -1.0})


def test_top_fraction_and_scan(spark):
    rows = [(i, i % 3, float(i // 7), 0, 0) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, g long, p double, y long, c long")
    got = {r["i"] for r in slices.top_fraction(df, "g", "p", ["i"], 5).collect()}
    want = {x[0] for g in range(3) for x in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[: sum(r[1] == g for r in rows) // 5]}
    assert got == want
    cells = slices.scan(df, ["c", "y"], {"m": F.col("p")}, "g").collect()
    assert len(cells) == 6 and all(r["share"] == 1.0 for r in cells)


def test_matching_and_bootstrap(spark):
    rng = random.Random(8)
    rows = [(e, rng.randrange(30) if rng.random() < 0.3 else e * 3 + rng.randrange(3), 1) for e in range(8) for _ in range(60)]
    df = spark.createDataFrame(rows, "e long, cell long, h long")
    left, right = (resolve.fingerprints(df.sample(0.7, seed=s).withColumnRenamed("e", n), n, F.col("cell"), F.col("h")) for s, n in ((1, "l"), (2, "r")))
    got = resolve.mutual_best(resolve.similarities(left, right, "l", "r"), "l", "r").collect()
    assert len(got) == 8 and all(r["l"] == r["r"] for r in got)
    b = slices.bootstrap(spark.createDataFrame([(i, float(i % 2)) for i in range(300)], "i long, v double"), F.col("i") < 100, F.col("v") + (F.col("i") < 100).cast("int"), 100, 1).collect()[0]
    assert b["lo"] <= b["excess"] <= b["hi"] and math.isclose(b["excess"], 2 / 3, abs_tol=0.01)


def test_contracts(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    s = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", float("nan")), ("z", 2.0)], "k string, p double")
    assert tuple(contracts.violations(c, s, "k", "p").collect()[0]) == (1, 1, 1, 1, 1)
    assert {r["k"]: r["p"] for r in contracts.merged(c, s, "k", "p").collect()}["c"] is None
    with pytest.raises(Exception, match="not unique"):
        contracts.joined_unique(c, s.withColumnRenamed("k", "kk"), "k", "kk").collect()
    assert contracts.fingerprint(s).collect() == contracts.fingerprint(s.orderBy(F.desc("p"))).collect()
