import numpy as np
from pastglass.operators.calibrate import grid_fit


def search(p, y):
    """The search over 0.20..2.00 x -0.30..0.30 and the finer one around its best point, point by point."""
    z = np.log(p / (1 - p))

    def best(points):
        return min((round(float(np.mean((1 / (1 + np.exp(-(a * z + b))) - y) ** 2)), 12), a, b) for a, b in points)

    _, a0, b0 = best([(0.2 + 0.05 * i, -0.3 + 0.025 * j) for i in range(37) for j in range(25)])
    return best([(a0 + 0.005 * i, b0 + 0.0025 * j) for i in range(-10, 11) for j in range(-10, 11)])


def test_finds_optima_of_the_whole_grid_and_flags_its_edge(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for part, (scale, bias) in {1: (1.75, 0.2), 2: (0.4, -0.22), 3: (1.0, 0.0), 4: (3.0, 0.0), 5: (1.0, 0.6)}.items():
        p = rng.choice(np.linspace(0.2, 0.8, 25), 4000)
        y = (rng.random(4000) < 1 / (1 + np.exp(-(scale * np.log(p / (1 - p)) + bias)))).astype(int)
        rows += [(part, float(a), int(b)) for a, b in zip(p, y)]
        want[part] = search(p, y)
    got = {r["part"]: r for r in grid_fit(spark.createDataFrame(rows, "part int, p double, y int"), "part", "p", "y").collect()}
    for part, (loss, scale, bias) in want.items():
        assert abs(got[part]["scale"] - scale) < 1e-6 and abs(got[part]["bias"] - bias) < 1e-6 and abs(got[part]["loss"] - loss) < 1e-9
    assert {k for k, r in got.items() if r["edge"]} == {4, 5}


def test_level_shift_is_exact_and_by_part(spark):
    import numpy as np
    from pastglass.operators.calibrate import level_shift

    rng = np.random.default_rng(7)
    rows = [(part, float(p), int(rng.random() < q)) for part, q in ((1, 0.7), (2, 0.2)) for p in rng.uniform(0.02, 0.98, 700)]
    got = {r["part"]: r["shift"] for r in level_shift(spark.createDataFrame(rows, "part long, p double, y long"), ["part"], "p", "y").collect()}
    for part in (1, 2):
        z = np.array([np.log(p / (1 - p)) for k, p, _ in rows if k == part])
        lo, hi, want = -8.0, 8.0, np.mean([y for k, _, y in rows if k == part])
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (1 / (1 + np.exp(-(z + mid)))).mean() < want else (lo, mid)
        assert abs(got[part] - lo) < 1e-9
    assert level_shift(spark.createDataFrame([], "part long, p double, y long"), ["part"], "p", "y").count() == 0


def test_convex_guards(spark):
    import pytest
    from pastglass.operators.calibrate import convex

    df = spark.createDataFrame([(0.5, 0.1), (float("nan"), 0.1), (None, 0.2), (0.2, float("inf"))], "p double, q double")
    assert [r[0] for r in df.select(convex({"p": 0.5, "q": 0.5})).collect()] == [0.3, None, None, None]
    for bad in ({"p": 0.5}, {"p": 1.5, "q": -0.5}, {"p": float("nan"), "q": 1.0}):
        with pytest.raises(ValueError):
            convex(bad)
