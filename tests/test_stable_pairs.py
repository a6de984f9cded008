from pastglass.plans import mining


def test_pairs_from_one_percent_in_both_seasons(spark):
    base = {a: "x" for a in mining.AXES}
    odd = base | {"game_type": "F", "pitcher_history": "0"}
    rows = [(s, *v.values(), p, 1.0, (p - 1) ** 2) for s in mining.BOTH for v, p, n in ((base, 0.5, 985), (odd, 0.1, 15)) for _ in range(n)]
    df = spark.createDataFrame(rows, f"period int, {', '.join(f'{a} string' for a in mining.AXES)}, p double, y double, err double")
    single, pairs = mining.judged(df)
    assert single.count() == 0
    got = {(r["axis"], r["value"]): r for r in pairs.collect()}
    r = got["game_type*pitcher_history", "F*0"]
    assert abs(r["score"] - (0.81 - (0.81 * 15 + 0.25 * 985) / 1000)) < 1e-6 and r["same"] and r["adds"] and r["parent"] is None
