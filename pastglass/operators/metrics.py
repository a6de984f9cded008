"""Scores of predictions as aggregates, and the order statistics they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastglass.operators.profile import place, quantiles


def brier(p: Column, y: Column) -> Column:
    """Mean squared error."""
    return F.avg(F.pow(p - y, 2))


def skill(p: Column, y: Column) -> Column:
    """1e5 (1 - brier / (r (1 - r))), r the mean outcome of the same rows; null if all outcomes are equal."""
    r = F.avg(y)
    return 1e5 * (1 - brier(p, y) / F.nullif(r * (1 - r), F.lit(0.0)))


def skill_gain(base: Column, new: Column, y: Column) -> Column:
    """The difference of two skills over the same rows."""
    r = F.avg(y)
    return 1e5 * (brier(base, y) - brier(new, y)) / F.nullif(r * (1 - r), F.lit(0.0))


def log_loss(p: Column, y: Column) -> Column:
    """Mean negative log likelihood, p limited to 1e-15 from the ends."""
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def two_sigma_gain(base: Column, new: Column, y: Column) -> Column:
    """Twice the standard error of the skill gain, from paired losses (population deviation)."""
    r = F.avg(y)
    return 1e5 * 2 * F.stddev_pop(F.pow(base - y, 2) - F.pow(new - y, 2)) / F.sqrt(F.count(y)) / F.nullif(r * (1 - r), F.lit(0.0))


def noise_floor(base: Column, new: Column) -> Column:
    """Twice the noise of the skill between two predictions, without outcomes: 2e5 sqrt(sum d^2) / (n 0.2498)."""
    return 2e5 * F.sqrt(F.sum(F.pow(base - new, 2))) / (F.count(base) * 0.2498)


def paired_z(base: Column, new: Column, y: Column) -> Column:
    """Mean of the paired loss difference over its standard error (sample deviation)."""
    d = F.pow(base - y, 2) - F.pow(new - y, 2)
    return F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count(d)), F.lit(0.0))


def bin_of(p: Column, bins: int) -> Column:
    """The equal-width bin of p in 0..1, the last one closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def calibration(rows: DataFrame, part: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """(part, bin, n, mean_p, mean_y) including empty bins."""
    cells = rows.groupBy(*part, bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    spine = rows.select(*part).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(cells, [*part, "bin"], "left").fillna(0, ["n"])


def expected_error(cells: DataFrame, part: list[str]) -> DataFrame:
    """(part, ece): the size-weighted mean of |mean_p - mean_y| over the bins of calibration()."""
    return cells.groupBy(*part).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def auc(rows: DataFrame, part: list[str], p: str, y: str) -> DataFrame:
    """(part, auc): the rank statistic with ties at half, on counts of distinct scores in order-preserving blocks.

    Null for parts with one class. No part is sorted as rows: scores are first counted, then summed block by block.
    """
    counts = rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*part, p).agg(F.sum(y).alias("n1"), F.sum(1 - F.col(y)).alias("n0"))
    counts = counts.withColumn("__b", F.floor(F.col(p) * 4096))
    blocks = counts.groupBy(*part, "__b").agg(F.sum("n0").alias("__s"))
    over = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(part)], F.col("__b").alias("__kb"), F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*part, "__b").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__in", F.coalesce(F.sum("n0").over(inside), F.lit(0)))
    met = counts.join(blocks, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(part)] + [F.col("__b") == F.col("__kb")])
    below = F.col("__base") + F.col("__in")
    return met.groupBy(*part).agg((F.sum(F.col("n1") * (below + F.col("n0") / 2)) / F.nullif(F.sum("n1") * F.sum("n0"), F.lit(0))).alias("auc"))


def two_sample_ks(counts: DataFrame, part: list[str], value: str, left: str, right: str) -> DataFrame:
    """(part, ks) from counts of each distinct finite value on either side; null if a side is empty.

    Cumulative counts are taken in order-preserving blocks and over the blocks, so no part is sorted as a whole.
    """
    rows = counts.withColumn("__b", place(F.col(value)))
    blocks = rows.groupBy(*part, "__b").agg(F.sum(left).alias("__sl"), F.sum(right).alias("__sr"))
    whole, over = Window.partitionBy(*part), Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    blocks = blocks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(part)], F.col("__b").alias("__kb"), F.coalesce(F.sum("__sl").over(over), zero).alias("__al"), F.coalesce(F.sum("__sr").over(over), zero).alias("__ar"), F.sum("__sl").over(whole).alias("__nl"), F.sum("__sr").over(whole).alias("__nr"))
    inside = Window.partitionBy(*part, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__il", F.sum(left).over(inside)).withColumn("__ir", F.sum(right).over(inside))
    met = rows.join(blocks, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(part)] + [F.col("__b") == F.col("__kb")])
    d = F.abs((F.col("__al") + F.col("__il")) / F.nullif(F.col("__nl"), zero) - (F.col("__ar") + F.col("__ir")) / F.nullif(F.col("__nr"), zero))
    return met.groupBy(*part).agg(F.max(d).alias("ks"))


def stability_index(counts: DataFrame, part: list[str], value: str, left: str, right: str, parts: int = 10) -> DataFrame:
    """(part, psi) from counts of each distinct finite value on either side, in bins of pooled quantiles, equal edges
    merged; 0 with under 3 edges, null if a side is empty. Edges are exact (see quantiles)."""
    pooled = quantiles(counts.withColumn("__w", F.col(left) + F.col(right)), part, value, [i / parts for i in range(parts + 1)], "__e", "__w")
    edges = pooled.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(part)], F.array_sort(F.array_distinct("__e")).alias("__e"))
    met = counts.join(edges, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(part)])
    cut = F.greatest(F.least(F.size(F.filter(F.slice("__e", 2, F.size("__e")), lambda e: e <= F.col(value))), F.size("__e") - 2), F.lit(0))
    bins = met.groupBy(*part, F.size("__e").alias("__n"), cut.alias("__bin")).agg(F.sum(left).alias("__l"), F.sum(right).alias("__r"))
    every = Window.partitionBy(*part)  # over bins
    pa, pb = (F.greatest(F.col(c) / F.nullif(F.sum(c).over(every), F.lit(0)), F.lit(1e-6)) for c in ("__l", "__r"))
    both = (F.sum("__l").over(every) > 0) & (F.sum("__r").over(every) > 0)
    terms = bins.withColumn("__t", F.when(both, (pa - pb) * F.ln(pa / pb)))
    return terms.groupBy(*part).agg(F.when(F.max("__n") < 3, F.when(F.count("__t") > 0, 0.0)).otherwise(F.sum("__t")).alias("psi"))


def divergence(counts: DataFrame, part: list[str], name: str, left: str, right: str) -> DataFrame:
    """(part, js, top_category, top_left, top_right, unseen) of two columns of counts of names.

    js is the Jensen-Shannon divergence (natural log), top_category the most frequent one of the left side (the first
    by name on ties) with its share on either side, unseen the share of right in names that left doesn't have. Null
    if a side is empty.
    """
    total = counts.groupBy(*part).agg(F.sum(left).alias("__l"), F.sum(right).alias("__r"), F.min(F.struct((-F.col(left)).alias("n"), F.col(name).alias("name"))).alias("__top"))
    total = total.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(part)], F.nullif("__l", F.lit(0)).alias("__l"), F.nullif("__r", F.lit(0)).alias("__r"), F.col("__top.name").alias("__name"))
    met = counts.join(total, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(part)])
    p, q = F.col(left) / F.col("__l"), F.col(right) / F.col("__r")
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.ln(x / m)).when(x == 0, 0.0)
    top = F.col(name) == F.col("__name")
    return met.groupBy(*part).agg(F.sum((term(p) + term(q)) / 2).alias("js"), F.max("__name").alias("top_category"), F.max(F.when(top, p)).alias("top_left"), F.max(F.when(top, q)).alias("top_right"), F.sum(F.when(F.col(left) == 0, q).otherwise(q * 0)).alias("unseen"))
