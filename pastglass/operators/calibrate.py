"""Fitting and applying calibrations, and blending members."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastglass.functions.scalars import clip, recalibrate, sigmoid
from pastglass.sources.tables import cut

#: First grid of scales and biases, the fine steps around its best point, and how many of these to either side.
SCALES, BIASES = [round(0.2 + 0.05 * i, 4) for i in range(37)], [round(-0.3 + 0.025 * i, 4) for i in range(25)]
FINE, REACH = (0.005, 0.0025), 10
#: A fit no further than this from an end of the first grid (scale, bias) lies on its edge: a first step and a bit.
MARGIN = (0.06, 0.03)


@dataclass(frozen=True)
class Blend:
    """Members with their (scale, bias), their weights, and the calibration after the blend."""

    members: dict[str, tuple[float, float]]
    weights: dict[str, float]
    after: tuple[float, float] = (1.0, 0.0)

    def __post_init__(self) -> None:
        if set(self.members) != set(self.weights):
            raise ValueError("members and weights differ")
        if any(not w >= 0 for w in self.weights.values()) or not 0 < sum(self.weights.values()) < float("inf"):
            raise ValueError("weights must be finite, not negative, and not all zero")


def blended(spec: Blend) -> Column:
    """The spec as one expression."""
    total = sum(spec.weights.values())
    mix = sum((recalibrate(F.col(m), *spec.members[m]) * (w / total) for m, w in spec.weights.items()), F.lit(0.0))
    return recalibrate(mix, *spec.after)


def convex(weights: dict[str, float]) -> Column:
    """The weighted mean of columns: weights not negative and of sum one, else an error; null where a column isn't a
    finite number, so that no undefined prediction passes unseen."""
    if any(not w >= 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must not be negative and must sum to one")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return sum((finite(c) * w for c, w in weights.items()), F.lit(0.0))


def _logits(rows: DataFrame, part: list[str], p: str, y: str) -> DataFrame:
    """Counts of outcomes for each distinct p: what any calibration's loss depends on, after one aggregation."""
    return rows.groupBy(*part, p).agg(F.count(y).alias("n"), F.sum(y).alias("s"))


def _losses(cells: DataFrame, scales: list[Column], biases: list[Column], part: list[str], p: str) -> DataFrame:
    """Mean squared error of each part at each pair of a scale and a bias."""
    long = cells.withColumn("scale", F.explode(F.array(*scales))).withColumn("bias", F.explode(F.array(*biases)))
    q = recalibrate(F.col(p), F.col("scale"), F.col("bias"))
    loss = F.sum(F.col("n") * q * q - 2 * q * F.col("s") + F.col("s")) / F.sum("n")
    return long.groupBy(*part, "scale", "bias").agg(loss.alias("loss"))


def _best(losses: DataFrame, part: list[str]) -> DataFrame:
    return losses.groupBy(*part).agg(F.min(F.struct(F.round("loss", 12).alias("loss"), "scale", "bias")).alias("b")).select(*part, "b.scale", "b.bias", "b.loss")


def _same(part: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(part)]


def _keys(part: list[str]) -> list[Column]:
    return [F.col(k).alias(f"__k{i}") for i, k in enumerate(part)]


def grid_fit(rows: DataFrame, part: str, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, part, scale, bias, loss, edge): the least Brier score over a grid and then a finer one around its best point.

    Ties go to the smaller scale, then bias. Outcomes are 0 or 1; rows are first reduced to distinct predictions.
    edge marks fits on the edge of the first grid, beyond which the optimum may lie. by: further keys of a fit.
    """
    keys = [*(by or []), part]
    cells = _logits(rows, keys, p, y)
    grid = _losses(cells, [F.lit(v) for v in SCALES], [F.lit(v) for v in BIASES], keys, p)
    first = _best(grid, keys).select(*_keys(keys), F.col("scale").alias("__s"), F.col("bias").alias("__b"))
    steps = range(-REACH, REACH + 1)
    scales, biases = [F.col("__s") + FINE[0] * i for i in steps], [F.col("__b") + FINE[1] * j for j in steps]
    best = _best(_losses(cells.join(first, _same(keys)), scales, biases, keys, p), keys)
    inside = [(v > ends[0] + m) & (v < ends[-1] - m) for v, ends, m in ((F.round("scale", 9), SCALES, MARGIN[0]), (F.round("bias", 9), BIASES, MARGIN[1]))]
    return best.withColumn("edge", ~(inside[0] & inside[1]))


def chained(rows: DataFrame, fitted: DataFrame, part: str, p: str, out: str, by: list[str] | None = None, shifts: DataFrame | None = None) -> DataFrame:
    """rows with p calibrated by the fit of the part before (part - 1) of the same `by`; without one p stays.

    shifts: (by, part, shift), added to the calibrated log odds of their part where there is a fit.
    """
    keys = [*(by or []), part]
    f = fitted.withColumn(part, F.col(part) + 1).select(*_keys(keys), F.col("scale").alias("__s"), F.col("bias").alias("__b"))
    if shifts is not None:
        moved = shifts.select(*[F.col(k).alias(f"__m{i}") for i, k in enumerate(keys)], F.col("shift").alias("__d"))
        f = f.join(moved, [F.col(f"__k{i}").eqNullSafe(F.col(f"__m{i}")) for i in range(len(keys))], "left").withColumn("__b", F.col("__b") + F.coalesce("__d", F.lit(0.0))).select(*[f"__k{i}" for i in range(len(keys))], "__s", "__b")
    joined = rows.join(f, _same(keys), "left")
    return joined.withColumn(out, F.when(F.col("__s").isNull(), F.col(p)).otherwise(recalibrate(F.col(p), F.col("__s"), F.col("__b")))).drop("__s", "__b", *[f"__k{i}" for i in range(len(keys))])


def level_shift(rows: DataFrame, part: list[str], p: str, y: str, target: str | None = None, reach: float = 8.0, points: int = 64, rounds: int = 4) -> DataFrame:
    """(part, shift): the d in -reach..reach for which the mean of sigmoid(logit(p) + d) is the part's outcome rate.

    Exact for any number of predictions: rows are reduced to distinct predictions, and each round evaluates the mean,
    which rises with d, at `points` shifts in one aggregation with map-side combine and keeps the interval with the
    target; within the last one, of 2 reach / points ** rounds, d is interpolated. Nothing but one row for each part is
    carried between rounds. target: a column, constant in a part, to meet instead of the outcome rate. A target beyond
    what reach can give ends at that end; parts without outcomes (or a null target) have a null shift.
    """
    z = F.ln(clip(F.col(p), 1e-6, 1 - 1e-6) / (1 - clip(F.col(p), 1e-6, 1 - 1e-6)))
    goal = F.max(target) if target else F.sum("__s") / F.sum("__n")
    cells = rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*part, p, *([target] if target else [])).agg(F.count("*").alias("__n"), F.sum(y).alias("__s")).withColumn("__z", z)
    cells = cut(cells)  # read in every round
    bracket = cells.groupBy(*part).agg(goal.alias("__t"), F.sum("__n").alias("__all")).withColumn("__lo", F.lit(-reach)).withColumn("__hi", F.lit(reach))
    for _ in range(rounds):
        b = bracket.select(*_keys(part), "__t", "__all", "__lo", "__hi")
        long = cells.join(F.broadcast(b), _same(part)).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(points))))  # one row for each part
        d = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__i") / points
        means = long.groupBy(*part, "__i").agg((F.sum(F.col("__n") * sigmoid(F.col("__z") + d)) / F.max("__all")).alias("__m"), F.max("__t").alias("__t"), F.max("__all").alias("__all"), F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
        below = F.coalesce(F.max(F.when(F.col("__m") < F.col("__t"), F.col("__i"))), F.lit(0))
        at = F.least(below, F.lit(points - 1))
        each = means.groupBy(*part).agg(at.alias("__at"), F.max("__t").alias("__t"), F.max("__all").alias("__all"), F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.map_from_entries(F.collect_list(F.struct("__i", "__m"))).alias("__ms"))  # points + 1
        width = (F.col("__hi") - F.col("__lo")) / points
        bracket = each.select(*part, "__t", "__all", (F.col("__lo") + width * F.col("__at")).alias("__lo"), (F.col("__lo") + width * (F.col("__at") + 1)).alias("__hi"), F.element_at("__ms", F.col("__at")).alias("__ml"), F.element_at("__ms", F.col("__at") + 1).alias("__mh"))
    share = F.least(F.greatest((F.col("__t") - F.col("__ml")) / F.nullif(F.col("__mh") - F.col("__ml"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return bracket.select(*part, F.when(F.col("__t").isNotNull(), F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.coalesce(share, F.lit(0.5))).alias("shift"))


def drift_shift(rows: DataFrame, fitted: DataFrame, rates: DataFrame, part: str, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, part, shift) for each part after a fitted one: what brings the calibrated predictions of the part before to
    the rate forecast for it. fitted: grid_fit(); rates: (by, part, forecast), each from earlier parts alone."""
    keys = [*(by or []), part]
    f = fitted.select(*_keys(keys), F.col("scale").alias("__s"), F.col("bias").alias("__b"))
    ahead = rates.withColumn(part, F.col(part) - 1).select(*[F.col(k).alias(f"__m{i}") for i, k in enumerate(keys)], F.col("forecast").alias("__goal"))
    met = rows.join(f, _same(keys)).withColumn("__q", recalibrate(F.col(p), F.col("__s"), F.col("__b"))).drop(*[f"__k{i}" for i in range(len(keys))])
    met = met.join(ahead, [F.col(k).eqNullSafe(F.col(f"__m{i}")) for i, k in enumerate(keys)]).filter(F.col("__goal").isNotNull())
    return level_shift(met, keys, "__q", y, "__goal").withColumn(part, F.col(part) + 1)


def sweep(rows: DataFrame, part: str, one: str, two: str, y: str, weights: list[float]) -> DataFrame:
    """(part, weight, brier) of (1 - w) one + w two, all weights in one pass over sums of squares and products.

    The score is a quadratic in w, so three sums per part give it at every weight.
    """
    a, d = F.col(one) - F.col(y), F.col(two) - F.col(one)
    sums = rows.groupBy(part).agg(F.avg(a * a).alias("aa"), F.avg(a * d).alias("ad"), F.avg(d * d).alias("dd"))
    w = F.col("weight")
    return sums.withColumn("weight", F.explode(F.array(*[F.lit(float(x)) for x in weights]))).select(part, "weight", (F.col("aa") + 2 * w * F.col("ad") + w * w * F.col("dd")).alias("brier"))


def vertex(scores: DataFrame, part: str, at: tuple[float, float, float]) -> DataFrame:
    """(part, vertex): where the parabola through three (weight, brier) points has its extremum; null if it is a line."""
    three = scores.groupBy(part).pivot("weight", list(at)).agg(F.first("brier"))
    (x0, x1, x2), (s0, s1, s2) = at, (F.col(f"`{x}`") for x in at)
    d0, d1, d2 = s0 / ((x0 - x1) * (x0 - x2)), s1 / ((x1 - x0) * (x1 - x2)), s2 / ((x2 - x0) * (x2 - x1))
    return three.select(part, ((d0 * (x1 + x2) + d1 * (x0 + x2) + d2 * (x0 + x1)) / F.nullif(2 * (d0 + d1 + d2), F.lit(0.0))).alias("vertex"))
