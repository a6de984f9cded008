"""Score for abusive, hateful or sexual content: a counterfactually regularised classifier over windows of words."""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.llm.reading import WINDOWS, Model, features, raw_score, word_sums, words_of
from pastglass.llm.seeds import BAD, FINE, IDENTITY

#: Bounds of the sample of rated documents that the classifier is fitted on, in the order of a hash of doc_id; texts of
#: more characters than LONGEST are never in it (they are scored, whole, all the same).
MAX_BAD, MAX_FINE, LONGEST = 1_500, 4_000, 100_000
#: Tasks that read them.
READERS = 32
#: Rounds of choosing windows in each fit, steps and rate of its descent, and its penalty on weights.
ROUNDS, STEPS, RATE, L2 = 3, 100, 0.15, 1e-4
#: Weight of the squared score change when an identity term is swapped.
SWAP = 0.2
#: A feature tells of bad content if at least this share of the rated texts that have it is bad, by the lower end of
#: Wilson's interval of that many standard errors. Two of the parameters that keep raters' errors out: a feature that
#: they made bad by chance has to be bad in three texts of three, in nine of fourteen, and so on.
LEAST, ERRORS = 0.35, 2.0
#: ... and if so many bad texts among them would be at most this likely (by Chernoff's bound) at the share of all texts.
CHANCE = 0.0015
#: A bad text gives an instance if its best window has telling features whose shares sum to this at least.
ENOUGH = 8.0
#: Folds of the fits that judge the rated texts of the other folds. Where they contradict a rating (a bad text below the
#: first, a fine one above the second probability) it is left out of the last fit.
FOLDS, DOUBT_BAD, DOUBT_FINE = 3, 0.1, 0.9
#: Weight of a bad window, and of the worst window of a fine text.
HEAVY = 4.0
#: A fine text's worst window becomes an instance of its own above this probability.
NEAR = 0.05

Rows = tuple[np.ndarray, np.ndarray, int]
#: A text as features: label, slots, starts of its words, and the same with swapped identity terms (or None) with the
#: place of every word in it.
Read = tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray] | None]


def rated_sample(documents: DataFrame, labels: DataFrame, max_bad: int = MAX_BAD, max_fine: int = MAX_FINE, longest: int = LONGEST) -> DataFrame:
    """(text, y, h): a bounded sample of rated documents; raters' means, undecided documents left out.

    Chosen by h, a hash of doc_id, so the sample doesn't depend on order or partitioning. Texts are whole; those of
    more than `longest` characters are not chosen.
    """
    rated = labels.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.avg("label").alias("__m")).filter("__m <> 0.5")
    rated = rated.select(F.col("doc_id").alias("__d"), (F.col("__m") > 0.5).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    known = documents.filter(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text").join(rated, F.col("doc_id") == F.col("__d"))
    return known.filter("y = 1").orderBy("h", "__d").limit(max_bad).unionByName(known.filter("y = 0").orderBy("h", "__d").limit(max_fine)).select("text", "y", "h")


def swapped(words: list[str], terms: dict[str, list[list[str]]]) -> tuple[list[str], list[int]] | None:
    """words with their identity terms changed for others of the same language, or None if there is none; and for each
    of the words, and their end, its place in the new ones."""
    out, places, i, changed = [], [], 0, False
    while i < len(words):
        for group in terms.values():
            hit = next((k for k, t in enumerate(group) if words[i : i + len(t)] == t), None)
            if hit is not None:
                other = zlib.crc32(" ".join(words[max(0, i - 2) : i + 3]).encode()) % (len(group) - 1) if len(group) > 1 else 0
                places += [len(out)] * len(group[hit])
                out += group[other + (other >= hit)] if len(group) > 1 else group[0]
                i += len(group[hit])
                changed = True
                break
        else:
            places.append(len(out))
            out.append(words[i])
            i += 1
    return (out, [*places, len(out)]) if changed else None


def read(text: str, y: int, terms: dict[str, list[list[str]]]) -> Read:
    """A rated text as features."""
    words = words_of(text)
    other = swapped(words, terms)
    return (y, *features(words), (*features(other[0]), np.array(other[1], np.int64)) if other else None)


def _worded(identity: dict[str, list[str]]) -> dict[str, list[list[str]]]:
    return {k: [words_of(t) for t in v] for k, v in identity.items()}


def read_sample(sample: DataFrame, identity: dict[str, list[str]] = IDENTITY) -> list[Read]:
    """The rated texts of rated_sample() as features, in the order of h. They are read on the executors; the driver gets
    the features of at most MAX_BAD + MAX_FINE texts."""
    terms = _worded(identity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [pickle.dumps(read(t, y, terms)) for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(got, pa.binary())], ["h", "read"])

    rows = sample.repartition(READERS).mapInArrow(work, "h long, read binary").collect()
    return [pickle.loads(r["read"]) for r in sorted(rows, key=lambda r: (r["h"], bytes(r["read"])))]


def stack(bags: list[np.ndarray]) -> Rows:
    """(slots, rows, number of rows) of instances of features."""
    flat = np.concatenate([np.zeros(0, np.int32), *bags])
    return flat, np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b in bags]), len(bags)


class _Matrix:
    """Rows of hashed features as a sparse matrix, sorted by row and by feature."""

    def __init__(self, rows: Rows, place: np.ndarray, size: int) -> None:
        at = place[rows[0]]
        self.slots, row, self.rows, self.size = at[at >= 0], rows[1][at >= 0], rows[2], size
        self.filled, self.starts = np.unique(row, return_index=True)
        order = np.argsort(self.slots, kind="stable")
        self.row_by_slot = row[order]
        self.used, self.slot_starts = np.unique(self.slots[order], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows)
        if len(self.slots):
            out[self.filled] = np.add.reduceat(w[self.slots], self.starts)
        return out

    def back(self, err: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        if len(self.slots):
            out[self.used] = np.add.reduceat(err[self.row_by_slot], self.slot_starts)
        return out


def logistic(parts: list[tuple[Rows, float, float]], pairs: tuple[Rows, Rows], keep: np.ndarray, free: np.ndarray, swap: float = SWAP) -> tuple[np.ndarray, float]:
    """Weights (0 but for the kept features) and bias: logistic loss of (rows, label, weight of a row) parts, L2, and
    swap times the squared score change over pairs. Weights that aren't free are at most 0."""
    seen = np.flatnonzero(keep)
    place = np.full(len(keep), -1, np.int32)
    place[seen] = np.arange(len(seen))
    bound = np.flatnonzero(~free[seen])
    parts = [(_Matrix(r, place, len(seen)), y, k) for r, y, k in parts if r[2]]
    total = sum(m.rows * k for m, _, k in parts)
    left, right = (_Matrix(r, place, len(seen)) for r in pairs)
    w, b = np.zeros(len(seen)), -2.0
    gw, gb = np.full(len(seen), 1e-8), 1e-8
    for _ in range(STEPS):
        g, slope = L2 * w, 0.0
        for m, y, k in parts:
            err = (1 / (1 + np.exp(-np.clip(m.times(w) + b, -30, 30))) - y) * (k / total)
            g += m.back(err)
            slope += err.sum()
        if left.rows and swap:
            gap = 2 * swap * np.clip(left.times(w) - right.times(w), -10, 10) / left.rows
            g += left.back(gap) - right.back(gap)
        gw += g * g
        gb += slope**2
        w -= RATE * g / np.sqrt(gw)
        w[bound] = np.minimum(w[bound], 0.0)
        b -= RATE * slope / np.sqrt(gb)
    out = np.zeros(len(keep))
    out[seen] = w
    return out, float(b)


def lower_share(bad: np.ndarray, n: np.ndarray, errors: float = ERRORS) -> np.ndarray:
    """The lower end of Wilson's interval of bad / n; 0 where n is 0."""
    m, z2 = np.maximum(n, 1.0), errors * errors
    share = bad / m
    return np.where(n > 0, (share + z2 / 2 / m - errors * np.sqrt(share * (1 - share) / m + z2 / 4 / m / m)) / (1 + z2 / m), 0.0)


def surprise(bad: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """-log of Chernoff's bound on the chance of so many bad of n at a share of base; 0 for a share below it."""
    q = np.clip(bad / np.maximum(n, 1), 1e-12, 1 - 1e-12)
    return np.where((n > 0) & (q > base), n * (q * np.log(q / base) + (1 - q) * np.log((1 - q) / (1 - base))), 0.0)


def _counted(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(features, texts that have them) of the features of two texts or more, in rising order; frugal with memory."""
    sizes = [len(np.unique(t)) for t in texts]
    flat, at = np.empty(sum(sizes), np.uint32), 0
    for t, n in zip(texts, sizes):
        flat[at : at + n] = np.unique(t)
        at += n
    flat.sort()
    begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]).astype(np.int32)
    times = np.diff(begins, append=np.int32(len(flat)))
    return flat[begins[times >= 2]], times[times >= 2]


class _Rated:
    """Rated texts and then the starting sentences, in flat arrays.

    Features are numbered in the order of `keys`: those that two texts at least have, of letter groups only those that
    could tell of bad content (of half the share that it takes) or are in a starting sentence.
    """

    def __init__(self, rated: list[Read], terms: dict[str, list[list[str]]]) -> None:
        texts = [r for r in rated if len(r[2]) > 1]
        self.y = np.array([r[0] for r in texts], np.int64)
        base = [read(t, y, terms) for y, group in ((1, BAD), (0, FINE)) for t in group]
        texts += base
        self.label, self.own = np.array([r[0] for r in texts]), np.arange(len(texts)) < len(self.y)
        keys, df = _counted([r[1] for r in texts])
        bad_keys, bad = _counted([r[1] for r, y in zip(texts, self.label) if y])
        told = bad_keys[lower_share(bad, df[np.searchsorted(keys, bad_keys)]) >= LEAST / 2] if len(keys) else bad_keys
        started = np.unique(np.concatenate([r[1] for r in base]))
        useful = keys & 1 == 1
        for more in (told, started):
            at = np.searchsorted(keys, more)
            at = at[at < len(keys)]
            useful[at[np.isin(keys[at], more)]] = True
        self.keys = keys[useful]
        del keys, df, bad_keys, bad, useful
        self.texts = [self._number(r[1], r[2]) for r in texts]
        had = [np.unique(slots) for slots, _ in self.texts]
        self.had, self.had_by = np.concatenate(had), np.repeat(np.arange(len(texts), dtype=np.int32), [len(h) for h in had])
        self.others = [(*self._number(r[3][0], r[3][1]), r[3][2]) if r[3] else None for r in texts]
        n = np.array([len(starts) - 1 for _, starts in self.texts])
        sizes = np.concatenate([np.diff(starts) for _, starts in self.texts])
        self.slots, self.word_starts = np.concatenate([s for s, _ in self.texts]), np.concatenate([[0], np.cumsum(sizes)])
        #: Words are put down with a gap after each text that no window reaches over.
        self.gap, self.n = max(WINDOWS), n
        self.first = np.concatenate([[0], np.cumsum(n + self.gap)[:-1]])
        of = np.repeat(np.arange(len(n), dtype=np.int32), n)
        within = np.arange(len(of), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
        self.at, self.length = self.first[of] + within, int((n + self.gap).sum())
        self.starts_ok = {size: self._valid(size) for size in WINDOWS}
        #: Stretches: every text in runs of the longest window.
        runs = -(-n // self.gap)
        self.run_of_slot = np.repeat((np.cumsum(runs) - runs).astype(np.int32)[of] + within // self.gap, sizes)
        self.text_of_run, self.text_of_slot = np.repeat(np.arange(len(n)), runs), np.repeat(of, sizes)

    def _number(self, slots: np.ndarray, starts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        at = np.minimum(np.searchsorted(self.keys, slots), max(len(self.keys) - 1, 0))
        known = self.keys[at] == slots if len(self.keys) else np.zeros(len(slots), bool)
        return at[known].astype(np.int32), None if starts is None else np.concatenate([[0], np.cumsum(known)])[starts]

    def _valid(self, size: int) -> np.ndarray:
        """Where windows of this length may begin: so that they end within the text, or at its first word if it is shorter."""
        marks = np.zeros(self.length + 1, np.int32)
        np.add.at(marks, self.first, 1)
        np.add.at(marks, self.first + np.maximum(self.n - size + 1, 1), -1)
        return np.cumsum(marks[:-1]) > 0

    def best(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum, first word, end) of the best window of every text."""
        laid = np.zeros(self.length)
        laid[self.at] = word_sums(weights[self.slots], self.word_starts)
        total = np.concatenate([[0.0], np.cumsum(laid), np.zeros(self.gap)])
        total[self.length + 1 :] = total[self.length]
        score, begin, end = np.full(len(self.n), -np.inf), np.zeros(len(self.n), np.int64), np.zeros(len(self.n), np.int64)
        for size in WINDOWS:
            sums = np.where(self.starts_ok[size], total[size : size + self.length] - total[: self.length], -np.inf)
            top = np.maximum.reduceat(sums, self.first)
            places = np.flatnonzero(sums == np.repeat(top, self.n + self.gap))
            texts, first = np.unique(np.searchsorted(self.first, places, "right") - 1, return_index=True)
            where = places[first] - self.first[texts]
            better = top > score + 1e-9
            score, begin, end = np.where(better, top, score), np.where(better, where, begin), np.where(better, np.minimum(where + size, self.n), end)
        return score, begin, end

    def span(self, i: int, a: int, b: int) -> np.ndarray:
        slots, starts = self.texts[i]
        return slots[starts[a] : starts[b]]

    def pair(self, i: int, a: int, b: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The features of words a to b, and those with swapped identity terms, if that makes a difference."""
        if not (other := self.others[i]):
            return []
        one, two = self.span(i, a, b), other[0][other[1][other[2][a]] : other[1][other[2][b]]]
        return [] if len(one) == len(two) and (one == two).all() else [(one, two)]

    def fit(self, use: np.ndarray, swap: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
        """Rounds of choosing the best window of each bad text, and fitting them against all stretches of the fine texts
        and, from the second round on, against the worst windows of these. Bad texts without a telling feature give no
        window: a rater's error, as far as these texts can tell. use: which of the rated texts; the starting sentences
        always are."""
        use = np.concatenate([use, ~self.own[len(use) :]])
        bad, fine = np.flatnonzero(use & (self.label == 1) & self.own), np.flatnonzero(use & (self.label == 0) & self.own)
        counts = [np.bincount(self.had[(use & (self.label == y))[self.had_by]], minlength=len(self.keys)) for y in (0, 1)]
        share = lower_share(counts[1], counts[0] + counts[1])
        base = np.clip((use & (self.label == 1)).sum() / max(use.sum(), 1), 1e-3, 1 - 1e-3)
        telling, bias = (share >= LEAST) & (surprise(counts[1], counts[0] + counts[1], base) >= -np.log(CHANCE)), 0.0
        hint = np.zeros(len(self.keys), bool)
        for i in np.flatnonzero(~self.own & (self.label == 1)):
            hint[self.texts[i][0]] = True
        hint &= counts[0] < counts[1]
        weights = np.where(telling, share, np.where(hint, 0.1, 0.0))
        keep = telling | hint
        runs = (use & (self.label == 0))[self.text_of_run]
        mask = keep[self.slots] & (use & (self.label == 0))[self.text_of_slot]
        fine_rows = self.slots[mask], (np.cumsum(runs, dtype=np.int32) - 1)[self.run_of_slot[mask]], int(runs.sum())
        fixed = [p for i in np.flatnonzero(use & (self.label == 0)) if self.others[i] for a in range(0, self.n[i], self.gap) for p in self.pair(i, a, min(a + self.gap, self.n[i]))]
        fixed += [p for i in np.flatnonzero(~self.own & (self.label == 1)) for p in self.pair(i, 0, self.n[i])]
        whole = [self.texts[i][0] for i in np.flatnonzero(~self.own & (self.label == 1))]
        worst: list[np.ndarray] = []
        score, begin, end = self.best(np.where(telling, share, 0.0))
        bad = bad[score[bad] >= ENOUGH]
        for k in range(rounds):
            if k or not telling.any():
                score, begin, end = self.best(weights)
            chosen = [(i, begin[i], end[i]) for i in bad]
            worst += [self.span(i, begin[i], end[i]) for i in fine[score[fine] + bias > np.log(NEAR / (1 - NEAR))]] if k else []
            if worst:
                keep[np.concatenate(worst)] = True
            pairs = fixed + [p for c in chosen for p in self.pair(*c)]
            parts = [(stack(whole), 1.0, 1.0), (stack([self.span(*c) for c in chosen]), 1.0, HEAVY), (fine_rows, 0.0, 1.0), (stack(worst), 0.0, HEAVY)]
            weights, bias = logistic(parts, (stack([p[0] for p in pairs]), stack([p[1] for p in pairs])), keep, telling | hint, swap)
        return weights, bias


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on texts should be flagged: the middle of the gap at which F1 is greatest, in log odds."""
    z = np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    order = np.argsort(-z, kind="stable")
    hits, z = np.cumsum(y[order]), z[order]
    if not len(z) or not hits[-1]:
        return 0.5
    f1 = np.where(np.append(z[1:] < z[:-1], True), 2 * hits / (np.arange(1, len(z) + 1) + hits[-1]), 0.0)
    k = int(np.argmax(f1))
    return float(1 / (1 + np.exp(-(z[k] + (z[k + 1] if k + 1 < len(z) else z[k])) / 2)))


def fit(rated: list[Read], identity: dict[str, list[str]] = IDENTITY, swap: float = SWAP) -> Model:
    """The model from rated texts and the starting sentences; a score of 0.5 is where texts should be flagged.

    A rated text says only that some window of it is bad, or that none is: in rounds, the best window of each bad
    text is an instance, and so are all stretches of each fine one. Raters err, so only features with the evidence of
    several texts count, and every rated text is judged by fits on the other folds: ratings that contradict these are
    left out, and a second turn of such fits gives the scores by which the bias is set so that 0.5 is the cut of the
    greatest F1. Each instance with an identity term is paired with the same words about another group, and a change of
    score costs. Without any rating the starting sentences alone are fitted.
    """
    data = _Rated(rated, _worded(identity))
    del rated  # the raw features take more memory than all that follows
    every, m = np.arange(len(data.y)), len(data.y)
    good, shift = np.ones(m, bool), 0.0
    for turn in range(2 if data.y.sum() >= FOLDS else 0):
        p = np.zeros(m)
        for k in range(FOLDS):
            held = every % FOLDS == k
            weights, bias = data.fit(~held & good, swap)
            p[held] = 1 / (1 + np.exp(-np.clip(data.best(weights)[0][:m][held] + bias, -30, 30)))
        if turn:
            c = best_cut(p[good], data.y[good])
            shift = float(np.log(c / (1 - c)))
        else:
            good = np.where(data.y == 1, p >= DOUBT_BAD, p <= DOUBT_FINE)
    weights, bias = data.fit(good, swap)
    used = np.flatnonzero(weights)
    return data.keys[used], weights[used].astype(np.float32), bias - shift


def fitted(sample: DataFrame, kept_at: str, identity: dict[str, list[str]] = IDENTITY) -> Model:
    """The model fitted on a sample, kept in the folder kept_at: fitted where that has none yet of the same ratings."""
    spark = sample.sparkSession
    seen = sample.agg(F.count("*"), F.sum(F.xxhash64("text", "y", "h").cast("decimal(38,0)"))).first()
    name = hashlib.sha256(repr((tuple(seen), sorted(identity.items()), LEAST, ERRORS, CHANCE, ENOUGH, SWAP, FOLDS, ROUNDS, STEPS)).encode()).hexdigest()[:24]
    path = f"{kept_at}/content-{name}"
    try:
        rows = spark.read.parquet(path).collect()
    except AnalysisException:
        rows = []
    if rows:
        keys, weights, bias = rows[0]
        return np.frombuffer(keys, np.uint32), np.frombuffer(weights, np.float32), bias
    keys, weights, bias = fit(read_sample(sample, identity), identity)
    spark.createDataFrame([(bytearray(keys.tobytes()), bytearray(weights.tobytes()), bias)], "keys binary, weights binary, bias double").coalesce(1).write.mode("overwrite").parquet(path)
    return keys, weights, bias


def scorer(spark: SparkSession, model: Model, text: Column) -> Column:
    """double in 0..1 of each whole text, by its worst window; 0 for null texts and texts without words.

    The model is broadcast: its features are some of those of a sample of bounded size. Arrow-batched, no shuffle.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(values: pa.Array) -> pa.Array:
        raw = np.array([raw_score(sent.value, t.as_py()) for t in values])
        return pa.array(np.where(np.isinf(raw), 0.0, 1 / (1 + np.exp(-np.clip(raw, -500, 500)))), pa.float64())

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(text)


def source_rates(scored: DataFrame, threshold: float) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) of documents with score; a null source is a source of its own."""
    bad = (F.col("score") >= threshold).cast("long")
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(bad).alias("flagged"), F.avg(bad).alias("rate"), F.avg("score").alias("mean_score"))
