import random

from test_fill import brute, run


def test_borders_of_super_blocks_change_nothing(spark):
    rng = random.Random(5)
    whole = [(0, n) for n in range(160)]
    gaps = [(1, n) for n in range(400) if n // 4 % 7 in (0, 3) or n > 350]
    rows = [(g, n, rng.choice([None, None, rng.random() ** (1 + n % 5)]), "x", None) for g, n in whole + gaps]
    want = brute(rows, 8, 4)
    for span in (1, 2, 3, 16, 512):
        got = {(r["g"], r["n"]): r["v_filled"] for r in run(spark, rows, span=span).collect()}
        assert len(got) == len(rows) and max(abs(got[k] - v) for k, v in want.items()) < 1e-9
