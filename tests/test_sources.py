import json
import os

import pytest
from pastglass.operators.state import boundary
from pastglass.sources.tables import cut, fresh, read_csv, shared_dir
from pastglass.streaming.enrich import with_frozen_state


def test_csv_with_mark_contract_and_bad_numbers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿row_id,n,rate\na,1,0.5\nb,x,\n", encoding="utf-8")
    df = read_csv(spark, str(path), "row_id string, n long, rate double", ["row_id", "n"])
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [("a", 1, 0.5), ("b", None, None)]
    with pytest.raises(ValueError, match="missing columns"):
        read_csv(spark, str(path), "row_id string", ["y"])


def test_checkpoints_go_to_the_folder_the_session_names(spark):
    df = cut(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir().startswith("file:")
    assert shared_dir(spark)
    assert fresh("A", ["a", "a_"]) == "A__"


def test_stream_and_batch_are_enriched_alike(spark, tmp_path):
    rows = [(2022, 1, 0, 0.0), (2022, 1, 4, 0.5), (2023, 1, 6, 0.5), (2023, 2, 1, 1.0)]
    facts = spark.createDataFrame(rows, "s long, e long, n long, rate double")
    facts.coalesce(1).write.parquet(str(tmp_path / "in"))
    frozen = boundary(facts, "e", "s", 2023, "n", ["rate"])
    want = sorted(map(tuple, with_frozen_state(facts, frozen, "e", "n", ["rate"]).collect()), key=str)
    stream = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
    q = with_frozen_state(stream, frozen, "e", "n", ["rate"]).writeStream.format("memory").queryName("enriched").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("enriched").collect()), key=str) == want
    finally:
        q.stop()


def test_every_query_has_a_name_of_its_own_and_sql_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 90
    assert all(json.dumps(n) and n[0].isalpha() for n in e.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_queries_equal_their_sql_on_the_smallest_tables(spark):
    """A sample of the driver's own comparison: one query of each module with SQL."""
    import duckdb

    import __spark_entry__ as e

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    as_text = lambda v: repr(round(v, 5) + 0.0) if isinstance(v, float) else repr(v)
    for name in ("p1_found", "p1_asof", "p2_found", "p3_found", "p4_found", "p5_found", "p5_refresh", "b20_smoothing", "i9_form", "i14_corrections", "k6_auc", "d15_match"):
        df, cur = e.queries()[name](spark, folder), con.execute(e.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns), name
        want = sorted(tuple(as_text(v) for v in r) for r in cur.fetchall())
        assert sorted(tuple(as_text(v) for v in r) for r in df.select(*cols).collect()) == want, name


def test_lookups_sinks_and_cache(spark, tmp_path):
    import pytest
    from pastglass.sources.tables import cached, head_rows, read_lookup, stored, write_csv, write_verdict

    df = spark.range(7).selectExpr("id AS k", "id * 0.5 AS v")
    df.write.json(f"{tmp_path}/t")
    assert read_lookup(spark, f"{tmp_path}/t", "k long, v double", ["k"]).count() == 7
    df.union(df.limit(1)).write.json(f"{tmp_path}/twice")
    with pytest.raises(ValueError):
        read_lookup(spark, f"{tmp_path}/twice", "k long, v double", ["k"])
    write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 7 and head_rows(df, 3).count() == 3
    assert write_verdict(df.limit(1), f"{tmp_path}/v") == {"k": 0, "v": 0.0} and spark.read.json(f"{tmp_path}/v").count() == 1
    for rows in (df, df.limit(0)):
        with pytest.raises(ValueError):
            write_verdict(rows, f"{tmp_path}/v")
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert cached(make, spark, f"{tmp_path}/cache", 7).count() == 7
    assert len(calls) == 1
    with pytest.raises(ValueError):
        cached(make, spark, f"{tmp_path}/cache", 8)
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 7 and stored(df).count() == 7


def test_steps_are_switched_by_name(spark):
    import pytest
    from pastglass.plans.chain import run
    from pyspark.sql import functions as F

    full = spark.createDataFrame([(1, 0.4), (2, 0.5), (2, None)], "period long, p double")
    seen = []
    steps = {"up": lambda rows, past, s: seen.append([r["period"] for r in past.collect()]) or rows.withColumn("p_out", F.col("p_out") + 1), "twice": lambda rows, past, s: rows.withColumn("p_out", F.col("p_out") * 2)}
    assert [r["p_out"] for r in run(full, 2, steps).collect()] == [3.0] and seen == [[1]]
    assert [r["p_out"] for r in run(full, 2, steps, frozenset(["up"])).collect()] == [1.0]
    with pytest.raises(ValueError):
        run(full, 2, steps, frozenset(["none"]))
