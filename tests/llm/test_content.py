import random

import numpy as np
from pastglass.llm.content import _Rated, _worded, best_cut, fit, fitted, lower_share, rated_sample, read, read_sample, scorer, source_rates, swapped
from pastglass.llm.reading import WINDOWS, features, raw_score, window_sums, word_sums, words_of
from pastglass.llm.seeds import IDENTITY
from pyspark.sql import functions as F

CALM = ["the bus arrives at nine near gate {}", "player {} threw a clean inning", "tickets cost {} at the window", "the roof stays open on day {}", "women and men with ticket {} sat together", "report {} condemned the insults"]
RUDE = ["you total dunderhead {} get lost forever", "i will smash your windows tonight {}", "all {} folk are vermin, throw them out"]


def corpus(rng, n, noise):
    out = []
    for i in range(n):
        bad = rng.random() < 0.25
        parts = [rng.choice(CALM).format(rng.randrange(999)) for _ in range(rng.randrange(1, 6))]
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(RUDE).format(rng.choice(["red", "blue", "north", "tall"])))
        out.append((". ".join(parts), int(bad), int(bad) if rng.random() > noise else 1 - int(bad)))
    return out


def chance(model, text):
    return 1 / (1 + np.exp(-np.clip(raw_score(model, text), -500, 500)))


def fit_texts(rated, **more):
    return fit([read(t, y, _worded(IDENTITY)) for t, y in rated], **more)


def test_disguises_are_undone():
    for text in ("w.o.r.m", "w o r m", "wоrm", "WORRRM", "w0rm", "wo​rm"):
        assert words_of(text) == ["worm"], text
    assert words_of("찌1질1이 미 친 놈") == ["찌질이", "미친놈"]
    assert words_of("i***t f###h") == ["i*t", "f*h"]
    assert words_of("a p.i.g") == ["a", "pig"] and words_of("") == [] and words_of("!!! ...") == []


def test_double_letters_stay_apart():
    one, two = words_of("ass class good"), words_of("as clas god")
    assert one != two
    a, b = features(one), features(two)
    assert set(a[0].tolist()) != set(b[0].tolist()) and set(a[0].tolist()) & set(b[0].tolist())


def test_windows_against_slow_sums():
    rng = np.random.default_rng(1)
    texts = ["the quick brown fox jumps over a lazy dog again and again today", "two words", "x", "one two three four five six seven eight nine"]
    data = _Rated([read(t, 1, {}) for t in texts], {})
    weights = rng.normal(size=len(data.keys))
    score, begin, end = data.best(weights)
    for i, t in enumerate(texts):
        slots, starts = features(words_of(t))
        at = np.minimum(np.searchsorted(data.keys, slots), len(data.keys) - 1)
        values = np.where(data.keys[at] == slots, weights[at], 0.0)
        each = [values[a:b].sum() for a, b in zip(starts, starts[1:])]
        found = window_sums(word_sums(values, starts))
        for (total, a, b), size in zip(found, WINDOWS):
            size = min(size, len(each))
            assert b - a == size and abs(total - max(sum(each[k : k + size]) for k in range(len(each) - size + 1))) < 1e-9
        assert abs(max(found)[0] - score[i]) < 1e-9 and abs(sum(each[begin[i] : end[i]]) - score[i]) < 1e-9
        assert abs(raw_score((data.keys, weights, 0.5), t) - score[i] - 0.5) < 1e-6
    assert features([])[1].tolist() == [0] and raw_score((data.keys, weights, 0.0), None) == float("-inf") == raw_score((data.keys, weights, 0.0), "...")


def test_evidence_and_cut():
    assert lower_share(np.array([0, 3, 3, 30]), np.array([0, 3, 30, 30])).round(2).tolist() == [0, 0.43, 0.03, 0.88]
    y = np.array([0] * 50 + [1] * 10)
    p = np.concatenate([np.full(50, 0.01), np.full(10, 0.2)])
    assert 0.01 < best_cut(p, y) < 0.2 and best_cut(p, np.zeros(60)) == 0.5 == best_cut(p[:0], y[:0])


def test_swaps_pull_groups_together():
    rng = random.Random(6)
    train = [(f"{rng.choice(['immigrants', 'women'])} are a plague on gate {rng.randrange(99)}, throw them out", 1) for _ in range(40)]
    train += [(f"a night for {rng.choice(['muslims', 'jews', 'christians'])} at gate {rng.randrange(99)}", 0) for _ in range(40)]
    plain, even = fit_texts(train, swap=0.0), fit_texts(train, swap=1.0)
    gap = [abs(raw_score(m, "immigrants at gate 7") - raw_score(m, "muslims at gate 7")) for m in (plain, even)]
    assert gap[1] < gap[0]
    assert chance(even, "muslims are a plague on gate 3, throw them out") > 0.5 > chance(even, "a night for immigrants at gate 5")


def test_held_out_accuracy_with_noisy_raters():
    rng = random.Random(4)
    train, held = corpus(rng, 900, 0.04), corpus(rng, 300, 0)
    model = fit_texts([(t, y) for t, _, y in train])
    flagged = [(chance(model, t) >= 0.5, bool(y)) for t, y, _ in held]
    right = sum(a == b for a, b in flagged)
    assert right / len(held) > 0.95
    assert abs(chance(model, "women with ticket 5 sat together") - chance(model, "men with ticket 5 sat together")) < 0.2


def test_swap_and_no_ratings():
    terms = {k: [words_of(t) for t in v] for k, v in IDENTITY.items()}
    assert swapped(words_of("the bus is late"), terms) is None
    out, places = swapped(words_of("all disabled people play here"), terms)
    assert out[0] == "all" and out[-2:] == ["play", "here"] and out != words_of("all disabled people play here")
    assert [out[places[i]] for i in (0, 3, 4)] == ["all", "play", "here"] and places[5] == len(out)
    model = fit([])
    assert chance(model, "you are a worthless idiot and everybody hates you") > 0.5 > chance(model, "the rally died with two on")


def test_columns_sample_and_rates(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, t, rng.choice(["a", "b", None])) for i, (t, _, _) in enumerate(corpus(rng, 60, 0))] + [(900, None, "a"), (901, "", "b"), (902, "x" * 200_000, None), (903, "you total dunderhead", "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(0, 1, "c", 1), (0, 0, None, 2), (1, 1, "c", 1), (2, 0, None, 1), (2, 0, None, 1), (3, None, None, 1), (900, 1, "c", 1), (77_777, 1, "c", 2)], "doc_id long, label long, category string, rater_id long")
    got = rated_sample(d, labels)
    assert sorted((r["text"], r["y"]) for r in got.collect()) == sorted([(docs[1][1], 1), (docs[2][1], 0)])
    assert rated_sample(d, labels.limit(0)).count() == 0 and rated_sample(d, labels, 1, 0).count() <= 1 and rated_sample(d, labels, longest=0).count() == 0
    reads = read_sample(got)
    assert sorted(r[0] for r in reads) == [0, 1] and read_sample(got.limit(0)) == []
    kept = [fitted(got, str(tmp_path)) for _ in range(2)]
    assert len(list(tmp_path.iterdir())) == 1 and all(np.array_equal(a, b) for a, b in zip(*kept))
    fitted(got.filter("y = 0"), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 2
    out = d.select("doc_id", "source", scorer(spark, fit([]), F.col("text")).alias("score"))
    by = {r["doc_id"]: r["score"] for r in out.collect()}
    assert len(by) == 64 and by[900] == 0 == by[901] and all(0 <= v <= 1 for v in by.values())
    rates = {r["source"]: r for r in source_rates(out, 0.5).collect()}
    assert sum(r["documents"] for r in rates.values()) == 64 and None in rates
