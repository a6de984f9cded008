import math
import random

import numpy as np
from pastglass.operators.profile import findings, place, profile
from pyspark.sql import functions as F

SCHEMA = "load long, feed long, no long, v double, name string"


def told(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return profile(df, load="load", feed="feed", number="no", columns=["v", "name"], ranges={"v": (0.0, 1.0)}, patterns={"name": "^[a-z]*$"})


def test_against_numpy(spark):
    rng = random.Random(1)
    one = [rng.random() for _ in range(300)]
    two = [rng.random() ** 2 for _ in range(200)] + [0.5] * 20
    rows = [(1, 0, 1, v, "a") for v in one] + [(2, 0, 2, v, "b") for v in two] + [(2, 0, 2, None, "B?"), (2, 0, 2, float("nan"), None), (2, 0, 2, 7.0, "")]
    out = {(r["load"], r["column_name"]): r for r in told(spark, rows).collect()}
    grid = np.array(sorted(set(one) | set(two)))
    ks = np.abs(np.searchsorted(np.sort(two), grid, "right") / len(two) - np.searchsorted(np.sort(one), grid, "right") / len(one)).max()
    r = out[2, "v"]
    assert abs(r["ks_before"] - ks) < 1e-12 and out[1, "v"]["ks_before"] is None
    assert (r["n_rows"], r["n_null"], r["n_unusable"], r["n_usable"], r["min_num"], r["max_num"]) == (223, 1, 2, 220, min(two), 7.0)
    assert r["n_distinct"] == len(set(two)) + 2 and math.isclose(r["null_share"], 1 / 223)
    n = out[2, "name"]
    assert (n["n_malformed"], n["n_null"], n["psi_before"]) == (1, 1, None) and n["chi2_before"] > 0


def test_findings(spark):
    rows = [(1, 0, 1, 0.1 * i, "ok") for i in range(10)] + [(2, 0, 2, 0.5, "ok")] * 4 + [(2, 0, 2, None, "BAD")] * 2 + [(3, 0, 3, -1.0, "ok")] + [(9, 1, 5, 0.2, "ok")]
    got = {(r["load"], r["column_name"], r["finding"]) for r in findings(told(spark, rows), measured=["v"], named=["name"], null_rise=0.1, drift=0.4).collect()}
    assert got == {(2, "v", "distinct"), (2, "v", "nulls"), (2, "v", "drift"), (2, "name", "pattern"), (3, "v", "range")}


def test_empty_null_loads_and_minus_zero(spark):
    assert told(spark, []).count() == 0
    r = {(r["load"], r["column_name"]): r for r in told(spark, [(None, None, None, 0.0, None), (None, None, None, -0.0, None)]).collect()}
    assert r[None, "v"]["n_distinct"] == 1 and r[None, "v"]["ks_before"] is None and r[None, "name"]["n_null"] == 2


def test_place_keeps_order(spark):
    vs = sorted([0.0, 1e-300, 5e-324, 0.1, 0.1000001, 0.5, 1.0, 3.0, 1e300, -1e-9, -2.0, -1e300])
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vs], "v double").select("v", place(F.col("v")).alias("b")).orderBy("v").select("b").collect()]
    assert got == sorted(got)
