import random

import numpy as np
from pastglass.operators.encode import medians, quantile_bins
from pastglass.operators.metrics import divergence, stability_index
from pastglass.operators.profile import quantiles
from pastglass.operators.slices import bootstrap, top_fraction
from pyspark.sql import functions as F

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_are_exact_and_ignore_what_is_no_number(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.gauss(0, 1e3), 0.0, -0.5, rng.random() * 1e-6])) for g in ("a", "b", None) for _ in range(rng.randrange(1, 300))]
    dirty = rows + [("a", None), ("a", float("nan")), ("b", float("inf")), ("c", None)]
    got = {r["g"]: r["q"] for r in quantiles(spark.createDataFrame(dirty, "g string, v double"), ["g"], "v", PROBS).collect()}
    assert set(got) == {"a", "b", None}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([v for k, v in rows if k == g], PROBS), atol=1e-9)
    assert quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).count() == 0


def test_weights_count_as_rows(spark):
    rows = [(1.0, 3), (2.0, 0), (5.0, 2), (9.0, 1)]
    got = quantiles(spark.createDataFrame(rows, "v double, w long"), [], "v", PROBS, "q", "w").collect()[0]["q"]
    assert np.allclose(got, np.quantile([1, 1, 1, 5, 5, 9], PROBS))


def test_medians_and_bins_of_all_columns_at_once(spark):
    df = spark.createDataFrame([(float(i), i % 7, None) for i in range(101)], "x double, y long, z double")
    assert [*medians(df, ["x", "y", "z"]).collect()[0]] == [50.0, 3.0, None]
    bins = [r[0] for r in quantile_bins(df, "x", 5, "k").orderBy("x").select("k").collect()]
    assert bins == [max(0, -(-i // 20) - 1) for i in range(101)]


def test_stability_and_divergence_by_hand(spark):
    a, b = [1.0] * 5 + [2.0] * 5 + [3.0] * 10, [2.0] * 5 + [3.0] * 5 + [4.0] * 10
    counts = spark.createDataFrame([("f", v, a.count(v), b.count(v)) for v in (1.0, 2.0, 3.0, 4.0)] + [("g", 1.0, 4, 4), ("h", 1.0, 4, 0)], "k string, v double, l long, r long")
    edges = np.unique(np.quantile(a + b, np.linspace(0, 1, 11)))
    pa, pb = (np.clip(np.histogram(x, edges)[0] / len(x), 1e-6, None) for x in (a, b))
    got = {r["k"]: r["psi"] for r in stability_index(counts, ["k"], "v", "l", "r").collect()}
    assert abs(got["f"] - float(((pa - pb) * np.log(pa / pb)).sum())) < 1e-9 and got["g"] == 0 and got["h"] is None
    named = counts.withColumn("name", F.col("v").cast("string"))
    out = {r["k"]: r for r in divergence(named, ["k"], "name", "l", "r").collect()}
    assert (out["f"]["top_category"], out["f"]["top_left"], out["f"]["top_right"], out["f"]["unseen"]) == ("3.0", 0.5, 0.25, 0.5)
    assert out["g"]["js"] == 0 and out["h"]["js"] is None


def test_bootstrap_against_numpy(spark):
    rng = np.random.default_rng(2)
    err, inside = rng.exponential(size=2000), rng.random(2000) < 0.3
    err = err + inside * 0.2
    df = spark.createDataFrame([(i, float(e), bool(m)) for i, (e, m) in enumerate(zip(err, inside))], "i long, e double, m boolean").withColumn("p", F.lit(1))
    got = bootstrap(df, ["p"], {"in": F.col("m"), "none": F.lit(False)}, F.col("e"), 300, 1).collect()
    assert len(got) == 1 and abs(got[0]["excess"] - (err[inside].mean() - err.mean())) < 1e-9
    draws = []
    for _ in range(600):
        w = rng.poisson(1, 2000)
        draws.append((w * inside * err).sum() / (w * inside).sum() - (w * err).sum() / w.sum())
    lo, hi = np.quantile(draws, [0.025, 0.975])
    assert abs((got[0]["hi"] - got[0]["lo"]) / (hi - lo) - 1) < 0.2 and got[0]["lo"] < got[0]["excess"] < got[0]["hi"]


def test_top_fraction_with_one_common_value(spark):
    df = spark.createDataFrame([(i, "p", 1.0 if i < 900 else 2.0 if i < 905 else 0.5) for i in range(1000)], "i long, p string, v double")
    got = [r["v"] for r in top_fraction(df, "p", "v", ["i"], 10).collect()]
    assert len(got) == 100 and got.count(2.0) == 5 and got.count(1.0) == 95
