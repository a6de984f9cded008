"""One key with a third of the rows or more: results stay whole, and no window or group holds the key's rows."""

import random

from pastglass.operators.asof import as_known
from pastglass.operators.deliveries import latest
from pastglass.operators.fill import fill
from pastglass.operators.profile import profile
from pyspark.sql import functions as F

N = 30_000


def events(spark):
    return spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 400 + 2).alias("e"), F.floor(F.col("id") / 3).alias("n"), (F.lit(2020) + F.floor(F.col("id") / 10_000)).alias("s"), F.lit(1).alias("y"), F.col("id").alias("v")
    )


def test_running_total_of_a_hot_entity(spark):
    ev = latest(events(spark), "e", "n", "v", 512).drop("v")
    st = spark.createDataFrame([(1, 0, 2020, 1, 7)], "e long, n0 long, ks long, rev long, c long")
    out = as_known(ev, st, entity="e", at="n", period="s", valid_from="n0", known_from="ks", rank=["rev"], payload={"c": "c0"}, running={"c1": ("c0", "y")})
    hot = out.filter("e = 1").agg(F.count("*").alias("k"), F.sum((F.col("c1") == 7 + F.col("n")).cast("int")).alias("ok")).collect()[0]
    assert hot["k"] == hot["ok"] == N // 3 and out.filter("e <> 1 AND c1 IS NOT NULL").count() == 0
    largest = ev.groupBy("e", "__blk").count() if "__blk" in ev.columns else None
    assert largest is None or largest.agg(F.max("count")).collect()[0][0] <= 512


def test_fill_of_a_hot_group_crosses_super_blocks(spark):
    rows = events(spark).filter("e = 1").select("e", "n", F.when(F.col("n") < 10, F.lit(0.25)).alias("r"), F.floor(F.col("n") / 4).alias("b"))
    out = fill(rows, group=["e"], order="n", blk="b", fields={"r": (0.0, 1.0)}, span=64)
    got = out.agg(F.count("*").alias("k"), F.sum(F.col("r_was_filled").cast("int")).alias("f"), F.min("r_filled").alias("lo"), F.max("r_filled").alias("hi")).collect()[0]
    assert got["k"] == N // 3 and got["f"] == N // 3 - 10 and abs(got["lo"] - 0.25) < 1e-9 and abs(got["hi"] - 0.25) < 1e-9


def test_profile_of_a_hot_load(spark):
    rng = random.Random(1)
    one, two = [rng.random() for _ in range(3000)], [rng.random() for _ in range(50)]
    df = spark.createDataFrame([(1, 0, 1, v) for v in two] + [(2, 0, 2, v) for v in one] + [(2, 0, 2, 0.5)] * 3000, "load long, feed long, no long, v double")
    r = profile(df, load="load", feed="feed", number="no", columns=["v"]).filter("load = 2").collect()[0]
    grid = sorted(set(one) | set(two) | {0.5})
    every = one + [0.5] * 3000
    want = max(abs(sum(x <= g for x in every) / len(every) - sum(x <= g for x in two) / len(two)) for g in grid[:: max(1, len(grid) // 400)] + [0.5])
    assert r["n_rows"] == 6000 and r["ks_before"] >= want - 1e-12 and r["ks_before"] - want < 0.01
