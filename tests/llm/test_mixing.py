import random

from pastglass.llm.mixing import distinct_texts, emit, rates, report

TARGETS = "mix_name string, source string, target_share double, max_repeats long"


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text_key string, n_tokens long")


def test_shares_caps_and_report(spark):
    rng = random.Random(3)
    rows = [(i, "big", f"b{i}", rng.randrange(5, 200)) for i in range(4000)] + [(10_000 + i, "small", f"s{i}", rng.randrange(5, 200)) for i in range(600)]
    rows += [(20_000 + i, "small", "s0", rows[4000][3]) for i in range(500)]  # one text, reposted
    texts = distinct_texts(sized(spark, rows))
    assert texts.count() == 4600
    t = spark.createDataFrame([("m", "big", 0.6, 2), ("m", "small", 0.4, 3), ("m", "none", 0.5, 9), ("k", "big", 1.0, None), ("z", "none", 1.0, 2)], TARGETS)
    table = rates(texts, t)
    got = {(r["mix_name"], r["source"]): r for r in table.collect()}
    assert got["m", "small"]["rate"] == 3.0 or got["m", "big"]["rate"] == 2.0
    assert abs(got["m", "big"]["reach_share"] - 0.6) < 1e-9 and got["m", "none"]["rate"] == got["z", "none"]["rate"] == 0 and got["k", "big"]["rate"] == 1.0
    out = emit(texts, table)
    copies = {}
    for r in out.collect():
        copies[r["mix_name"], r["source"], r["doc_id"]] = copies.get((r["mix_name"], r["source"], r["doc_id"]), 0) + 1
    assert all(n <= (2 if k[1] == "big" else 3) or k[0] == "k" for k, n in copies.items())
    for k, n in copies.items():
        assert n in (int(got[k[:2]]["rate"]), int(got[k[:2]]["rate"]) + 1)
    shares = {(r["mix_name"], r["source"]): r for r in report(out, table).collect()}
    assert len(shares) == 5 and abs(shares["m", "big"]["actual_share"] - 0.6) < 0.02 and shares["z", "none"]["mixed_tokens"] == 0
    assert sorted(map(tuple, emit(texts.repartition(7), table).collect())) == sorted(map(tuple, out.collect()))


def test_given_size_fills_up_the_others(spark):
    texts = distinct_texts(sized(spark, [(1, "a", "a", 100), (2, "b", "b", 1000), (3, "c", "c", 1000)]))
    t = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.25, 4), ("m", "c", 0.25, 4)], TARGETS)
    got = {r["source"]: r["rate"] for r in rates(texts, t, 1100).collect()}
    assert got == {"a": 1.0, "b": 0.5, "c": 0.5}
    assert {r["source"]: r["rate"] for r in rates(texts, t, 10**9).collect()} == {"a": 1.0, "b": 4.0, "c": 4.0}


def test_dirty_targets_and_empty_tables(spark):
    texts = distinct_texts(sized(spark, [(1, "a", "x", 10), (2, "a", "x", 10), (3, None, "y", 5), (4, "a", "e", 0), (None, "a", "n", 7)]))
    assert texts.count() == 2
    t = spark.createDataFrame([("m", "a", float("nan"), 2), ("m", "a", 0.5, 2), ("m", "a", None, 3), ("m", "b", -1.0, 1), (None, "a", 1.0, 1)], TARGETS)
    table = rates(texts, t)
    got = {(r["mix_name"], r["source"]): r for r in table.collect()}
    assert got["m", "a"]["rate"] == 2.0 and got["m", "a"]["target_share"] == 0.5 and got[None, "a"]["rate"] == 1.0
    assert emit(texts, table).count() == 6
    none = distinct_texts(sized(spark, []))
    assert emit(none, rates(none, t)).count() == 0 and report(emit(none, rates(none, t)), rates(none, t)).count() == 3
    assert emit(texts, rates(texts, t.limit(0))).count() == 0
