import random

import numpy as np
from pastglass.operators.fill import GROUP, NEXT, OWN, fill
from pyspark.sql import functions as F

SCHEMA = "g long, n long, v double, c string, v_was_filled string"


def run(spark, rows, rounds=8, block=4, span=512):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("blk", F.floor(F.col("n") / block))
    return fill(df, group=["g"], order="n", blk="blk", fields={"v": (0.0, 1.0)}, levels={"c": ["x", "y"]}, rounds=rounds, span=span)


def brute(rows, rounds, block):
    """The same propagation on single records: hubs of blocks, neighbours in time, a clamped group node."""
    out = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        ok = lambda v: v is not None and v == v and 0 <= v <= 1
        obs = [r[2] for r in mine if ok(r[2])]
        if not obs:
            continue
        mean, est = np.mean(obs), {}
        blocks = sorted({r[1] // block for r in mine})
        of = {b: [r for r in mine if r[1] // block == b] for b in blocks}
        for b in blocks:
            own = [r[2] for r in of[b] if ok(r[2])]
            for r in of[b]:
                est[r[1]] = r[2] if ok(r[2]) else (np.mean(own) if own else mean)
        for _ in range(rounds):
            hub = {b: np.mean([est[r[1]] for r in of[b]]) for b in blocks}
            for i, b in enumerate(blocks):
                ties = [(hub[b], OWN), (mean, GROUP)] + ([(hub[blocks[i - 1]], NEXT)] if i else []) + ([(hub[blocks[i + 1]], NEXT)] if i + 1 < len(blocks) else [])
                x = sum(v * k for v, k in ties) / sum(k for _, k in ties)
                for r in of[b]:
                    if not ok(r[2]):
                        est[r[1]] = x
        for r in mine:
            out[g, r[1]] = est[r[1]]
    return out


def test_equals_propagation_on_single_records(spark):
    rng = random.Random(2)
    rows = [(g, n, rng.choice([None, float("nan"), -999.0, 5.0, rng.random(), rng.random()]), "x", None) for g in range(4) for n in range(0, 70, rng.randrange(1, 3))]
    want = brute(rows, 8, 4)
    got = {(r["g"], r["n"]): r for r in run(spark, rows).collect()}
    assert len(got) == len(rows)
    for k, v in want.items():
        assert abs(got[k]["v_filled"] - v) < 1e-9
    for g, n, v, *_ in rows:
        bad = v is None or v != v or not 0 <= v <= 1
        assert got[g, n]["v_was_filled_"] == bad and got[g, n]["v_was_filled"] is None
        earlier = any(r[0] == g and r[1] < n and r[2] is not None and r[2] == r[2] and 0 <= r[2] <= 1 for r in rows)
        assert got[g, n]["v_has_earlier"] == earlier


def test_defined_cases(spark):
    rows = [(1, 0, None, None, None), (1, 1, None, "?", None), (2, 0, 0.5, "y", None), (2, 1, None, None, None), (None, 3, 0.25, "x", None), (None, 3, None, None, None), (2, None, None, None, None)]
    got = [r.asDict() for r in run(spark, rows).collect()]
    by = {(r["g"], r["n"], r["v"]): r for r in got}
    assert len(got) == 7 and by[1, 0, None]["v_filled"] is None and not by[1, 0, None]["v_was_filled_"] and not by[1, 1, None]["c_was_filled"]
    assert by[2, 1, None]["v_filled"] == 0.5 and by[2, 1, None]["c_filled"] == "y" and by[2, 1, None]["c_was_filled"]
    assert by[None, 3, None]["v_filled"] == 0.25 and by[2, 0, 0.5]["v_filled"] == 0.5
    assert run(spark, []).count() == 0


def test_ties_go_to_the_first_level(spark):
    got = [r for r in run(spark, [(1, 0, 0.5, "y", None), (1, 1, 0.5, "x", None), (1, 2, 0.5, None, None)]).collect() if r["n"] == 2]
    assert got[0]["c_filled"] == "x"
