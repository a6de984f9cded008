import random

from pastglass.operators.splits import deal, grouped_splits, spanning_forest, split_rows
from pyspark.sql import functions as F

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def components(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for _, a, b in links:
        if a is not None and b is not None:
            up[find(a)] = find(b)
    return {x: find(x) for x in list(up)}


def check(spark, links):
    df = spark.createDataFrame(links, "id long, a long, b long")
    forest, roots = spanning_forest(df, "a", "b", "id")
    got = {r["node"]: r["root"] for r in roots.collect()}
    want = components([x for x in links if x[1] != x[2]])
    assert set(got) == set(want)
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
        assert got[root] == root
    assert sorted(map(sorted, groups.values())) == sorted(sorted(n for n in want if want[n] == r) for r in set(want.values()))
    assert forest.count() == len(want) - len(groups)


def test_random_graph_chain_and_star(spark):
    rng = random.Random(4)
    check(spark, [(i, rng.randrange(80), rng.randrange(80)) for i in range(60)])
    check(spark, [(i, i, i + 1) for i in range(40)] + [(100 + i, 500, 600 + i) for i in range(30)])


def test_dirty_and_empty_links(spark):
    check(spark, [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 5, 5), (5, None, 2), (6, 3, None)])
    forest, roots = spanning_forest(spark.createDataFrame([], "id long, a long, b long"), "a", "b", "id")
    assert forest.count() == roots.count() == 0


def test_forest_is_least(spark):
    df = spark.createDataFrame([(1, 1, 2, 5.0), (2, 2, 3, 1.0), (3, 1, 3, 2.0), (4, 3, 4, None)], "id long, a long, b long, w double")
    assert sorted(r[0] for r in spanning_forest(df, "a", "b", "id", "w")[0].collect()) == [2, 3, 4]


def test_shares_with_hot_and_many_small_roots(spark):
    rng = random.Random(5)
    sizes = [(0, 30_000)] + [(i, rng.choice([1, 2, 3, 40, 900])) for i in range(1, 3000)]
    got = deal(spark.createDataFrame(sizes, "root long, size long"), SHARES).collect()
    assert len(got) == len(sizes) and all(r["split"] in SHARES for r in got)
    total = sum(s for _, s in sizes)
    for name, share in SHARES.items():
        assert abs(sum(r["size"] for r in got if r["split"] == name) / total - share) < 0.01, name


def test_bands_are_dealt_systematically(spark):
    sizes = [(i, 3) for i in range(4000)] + [(10_000 + i, 40 + i % 20) for i in range(300)] + [(20_000, 9_000), (20_001, 700)]
    got = deal(spark.createDataFrame(sizes, "root long, size long"), SHARES).collect()
    assert sorted((r["root"], r["size"]) for r in got) == sorted(sizes)
    of = {}
    for r in got:
        of.setdefault(r["band"], []).append(r["split"])
    assert {b: len(v) for b, v in of.items()} == {1: 4000, 5: 300, 13: 1, 9: 1}
    total, head = sum(s for _, s in sizes), 9_700
    rest = (0.8 * total - head) / (total - head)
    for b in (1, 5):  # each band has what the large roots left of each share, within a root a turn or less
        assert abs(of[b].count("train") / len(of[b]) - rest) < 0.02
        assert abs(of[b].count("test") / len(of[b]) - (1 - rest) / 2) < 0.02


def test_deal_is_in_shares_for_any_sizes(spark):
    for seed in range(3):
        rng = random.Random(seed)
        sizes = [(i, int(rng.paretovariate(0.9)) + 1) for i in range(rng.choice([300, 900]))]
        total = sum(s for _, s in sizes)
        got = deal(spark.createDataFrame(sizes, "root long, size long"), SHARES).collect()
        biggest = max(s for _, s in sizes) / total
        for name, share in SHARES.items():
            lacks = abs(sum(r["size"] for r in got if r["split"] == name) / total - share)
            assert lacks < 0.01 + max(0, biggest - 0.5), (seed, name, lacks)


def test_too_few_rounds_are_an_error(spark):
    import pytest

    with pytest.raises(RuntimeError):
        spanning_forest(spark.createDataFrame([(i, i, i + 1) for i in range(9)], "id long, a long, b long"), "a", "b", "id", max_rounds=1)


def test_deal_defined_cases(spark):
    assert deal(spark.createDataFrame([], "root long, size long"), SHARES).count() == 0
    got = deal(spark.createDataFrame([(1, None), (2, 0), (3, 5)], "root long, size long"), SHARES).collect()
    assert len(got) == 3 and {r["root"]: r["split"] for r in got}[3] == "train"


def test_related_rows_share_a_split_and_keyless_rows_are_kept(spark):
    links = spark.createDataFrame([(1, 1, 2), (2, 2, 9), (3, 9, 3)], "id long, a long, b long")
    rows = spark.range(3000).select(F.pmod("id", F.lit(40)).alias("e"), F.col("id"), F.lit("mine").alias("size")).withColumn("e", F.when(F.col("id") < 2900, F.col("e")))
    sizes = rows.groupBy("e").agg(F.count("*").alias("size"))
    given = grouped_splits(sizes, spanning_forest(links, "a", "b", "id")[1], "e", SHARES)
    out = split_rows(rows, given, "e", SHARES).collect()
    assert len(out) == 3000 and all(r["split"] in SHARES for r in out)
    assert len({r["split"] for r in out if r["e"] in (1, 2, 3)}) == 1
    assert all(len({r["split"] for r in out if r["e"] == e}) == 1 for e in range(40))
    assert {r["split"] for r in out if r["e"] is None} == set(SHARES)
