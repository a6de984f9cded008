import os
import random

import pytest
from pastglass.operators.slices import top_fraction


def test_top_fraction_takes_ties_in_the_order_of_the_keys(spark):
    rng = random.Random(5)
    rows = [(p, rng.choice([None, 0.5, 1.0, 1.0, 1.0, float("nan")]) if p != "one" else 1.0, rng.choice([None, *range(12)]), i) for p in ("a", "b", "one", None) for i in range(rng.randrange(150, 300))]
    rows += [("few", 1.0, 1, i) for i in range(6)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "p string, v double, k long, i long")
    down = lambda v: (1, 0.0) if v is None else (0, -float("inf") if v != v else -v)
    for parts in (df.repartition(5), df.coalesce(1), df.limit(0)):
        held = [tuple(r) for r in parts.collect()]
        want = [x[::3] for p in {r[0] for r in held} for x in sorted((r for r in held if r[0] == p), key=lambda r: (down(r[1]), (r[2] is None, r[2]), r[3]))[: sum(r[0] == p for r in held) // 7]]
        got = top_fraction(parts, "p", "v", ["k", "i"], 7)
        assert got.columns == df.columns
        assert sorted(((r["p"], r["i"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_top_fraction_of_rows_alike_keeps_the_number(spark):
    df = spark.createDataFrame([("a", 1.0, 1)] * 95 + [("b", 2.0, i) for i in range(9)], "p string, v double, k long")
    assert [tuple(r) for r in top_fraction(df, "p", "v", ["k"], 10).collect()] == [("a", 1.0, 1)] * 9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_f9_worst_tenth_equals_its_sql(spark, size):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute(f"CREATE VIEW train AS SELECT * FROM '/root/testdata/{size}/train.parquet'")
    cur = con.execute(e.oracle_sql()["f9_worst_tenth"])
    cols = [d[0] for d in cur.description]
    df = e.queries()["f9_worst_tenth"](spark, f"/root/testdata/{size}")
    assert df.columns == cols and sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
