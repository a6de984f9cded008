"""Overlapping groups, top fractions, and the search for slices with systematic error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastglass.sources.tables import cut

#: Blocks of rows that are resampled together.
DRAWS = 4096


def masked(rows: DataFrame, masks: dict[str, Column], out: str = "mask") -> DataFrame:
    """One row for each mask that holds: the rows of overlapping groups, ready for one aggregation."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in masks.items()]))
    return rows.withColumn(out, F.explode(names))


def top_fraction(rows: DataFrame, part: str, value: str, keys: list[str], per: int) -> DataFrame:
    """The floor(n / per) rows of each part with the greatest value, ties in the order of keys.

    Rows go once to ranges of the order (part, value, keys), and the rows of each part in each range are counted. Only
    the range in which a part's cut falls is sorted: no part is sorted as a whole, and a common value is spread over
    ranges by its keys. Nulls come last, in values and in keys.
    """
    order = [F.col(value).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]]
    ranged = cut(rows.repartitionByRange(F.col(part), *order).withColumn("__r", F.spark_partition_id()))  # read twice
    sizes = ranged.groupBy(part, "__r").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(part)  # over a part's ranges
    before = F.coalesce(F.sum("__n").over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(part).alias("__part"), F.col("__r").alias("__range"), "__n", (F.floor(F.sum("__n").over(w) / per) - before).alias("__left")).filter("__left > 0")
    met = ranged.join(sizes, F.col(part).eqNullSafe(F.col("__part")) & (F.col("__r") == F.col("__range")))
    ranked = met.filter("__n > __left").withColumn("__rn", F.row_number().over(Window.partitionBy(part, "__r").orderBy(*order))).filter("__rn <= __left")
    return met.filter("__n <= __left").unionByName(ranked.drop("__rn")).drop("__r", "__part", "__range", "__n", "__left")


def scan(rows: DataFrame, axes: list[str], sums: dict[str, Column], period: str, pairs: bool | list[tuple[str, str]] = False) -> DataFrame:
    """(period, axis, value, n, share, <sums as means>): every level of every axis (or of all or the given pairs of axes)
    in one pass.

    Axes are unpivoted, so one aggregation with map-side combine does all of them.
    """
    one = [F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a).cast("string"), F.lit("nan")).alias("value")) for a in axes]
    if pairs:
        one = [F.struct(F.lit(f"{a}*{b}").alias("axis"), F.concat_ws("*", F.coalesce(F.col(a).cast("string"), F.lit("nan")), F.coalesce(F.col(b).cast("string"), F.lit("nan"))).alias("value")) for a, b in (pairs if isinstance(pairs, list) else [(a, b) for i, a in enumerate(axes) for b in axes[i + 1 :]])]
    long = rows.select(period, *[v.alias(f"__{k}") for k, v in sums.items()], F.explode(F.array(*one)).alias("__x")).select(period, "__x.*", *[f"__{k}" for k in sums])
    cells = long.groupBy(period, "axis", "value").agg(F.count("*").alias("n"), *[F.avg(f"__{k}").alias(k) for k in sums])
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(period, "axis")))


def best_candidate(cells: DataFrame, cell: str, candidate: str, loss: str, n: str, least: int, default: str) -> DataFrame:
    """(cell, winner): the candidate of the least loss in each cell of at least `least` rows (ties by name), else default."""
    best = cells.groupBy(cell).agg(F.min(F.struct(loss, candidate)).alias("__b"), F.max(n).alias("__n"))
    return best.select(cell, F.when(F.col("__n") >= least, F.col(f"__b.{candidate}")).otherwise(F.lit(default)).alias("winner"))


def poisson(u: Column) -> Column:
    """A Poisson(1) draw from a uniform one; draws beyond 12, of chance 6e-11, count as 12."""
    weight, acc, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 13):
        acc += term
        weight = weight + (u >= acc).cast("int")
        term /= k
    return weight


def bootstrap(rows: DataFrame, part: list[str], inside: dict[str, Column], value: Column, reps: int, seed: int) -> DataFrame:
    """(part, mask, excess, lo, hi): the mean of value inside each mask less over the whole part, with a 95 % interval
    from Poisson resampling.

    Rows are summed in DRAWS blocks by a hash of the row, and the blocks are resampled: each has a Poisson(1) draw for
    each repetition from a hash of its number, so what is drawn is bounded whatever the number of rows, and the result
    doesn't depend on partitioning. With no more rows than blocks this is the resampling of rows, but for rows that
    share a block; the interval's width is within about 1 / sqrt(2 DRAWS) of it beyond. Null values don't count; a part
    without rows inside a mask has no row for it.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("mask"), F.coalesce(c.cast("int"), F.lit(0)).alias("__in")) for k, c in inside.items()])
    given = rows.withColumn("__v", value).filter(F.col("__v").isNotNull()).withColumn("__b", F.pmod(F.xxhash64(F.struct(*rows.columns)), F.lit(DRAWS)))
    cells = given.select(*part, "__b", "__v", F.explode(masks).alias("__m")).groupBy(*part, "__m.mask", "__b").agg(F.sum("__m.__in").alias("ni"), F.sum(F.col("__m.__in") * F.col("__v")).alias("si"), F.count("*").alias("na"), F.sum("__v").alias("sa"))
    drawn = cells.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    u = F.pmod(F.xxhash64("__b", "__r", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = drawn.withColumn("__w", F.when(F.col("__r") == 0, 1).otherwise(poisson(u)))
    mean = lambda t, n: F.sum(F.col("__w") * F.col(t)) / F.nullif(F.sum(F.col("__w") * F.col(n)), F.lit(0))
    each = drawn.groupBy(*part, "mask", "__r").agg((mean("si", "ni") - mean("sa", "na")).alias("d"))
    many = F.when(F.col("__r") > 0, F.col("d"))  # one value for each repetition
    return each.groupBy(*part, "mask").agg(F.max(F.when(F.col("__r") == 0, F.col("d"))).alias("excess"), F.percentile(many, 0.025).alias("lo"), F.percentile(many, 0.975).alias("hi")).filter(F.col("excess").isNotNull())
