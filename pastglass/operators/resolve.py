"""Matching entities of two logs without a shared key, by fingerprints over common cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprints(rows: DataFrame, entity: str, cell: Column, block: Column) -> DataFrame:
    """(entity, block, cell, v): square roots of an entity's counts by cell, scaled to length one.

    block is an attribute that both sides must share; an entity's is its most frequent one, the least on ties.
    """
    counts = rows.filter(F.col(entity).isNotNull()).groupBy(entity, cell.alias("cell"), block.alias("block")).agg(F.count("*").alias("n"))
    own = counts.filter(F.col("block").isNotNull()).groupBy(entity, "block").agg(F.sum("n").alias("n")).groupBy(entity).agg(F.min(F.struct((-F.col("n")).alias("n"), "block")).alias("b"))
    cells = counts.filter(F.col("cell").isNotNull()).groupBy(entity, "cell").agg(F.sum("n").alias("n"))
    length = cells.groupBy(entity).agg(F.sqrt(F.sum("n")).alias("len"))
    keyed = length.join(own.select(entity, F.col("b.block").alias("block")), entity)
    return cells.join(keyed, entity).select(entity, "block", "cell", (F.sqrt("n") / F.col("len")).alias("v"))


def _prefix(side: DataFrame, entity: str, spread: DataFrame, least: float) -> DataFrame:
    """(entity, block, cell) of the rarest cells of each entity: those beyond which less than `least` of its length is left."""
    met = side.join(spread, (F.col("block") == F.col("__sb")) & (F.col("cell") == F.col("__sc")))
    common_first = Window.partitionBy(entity).orderBy(F.col("__df").desc(), F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)  # over an entity's cells
    return met.withColumn("__rest", F.sum(F.col("v") * F.col("v")).over(common_first)).filter(F.sqrt("__rest") >= least - 1e-9).select(entity, "block", "cell")


def similarities(left: DataFrame, right: DataFrame, a: str, b: str, least: float = 0.5) -> DataFrame:
    """(a, b, sim): cosine of the fingerprints of every pair that shares a block and whose cosine is at least `least`.

    Exact, by prefixes: cells are ordered by how many entities have them. What an entity has beyond its rarest cells is
    shorter than `least`, so it can't make up such a cosine alone: a pair of one meets in the rare cells of both. Only
    pairs that do are candidates; their cosines are taken over all cells. Cells that nearly everybody has join nobody,
    and the higher `least`, the shorter the prefixes. With 0, every shared cell makes a candidate.
    """
    both = left.select("block", "cell").unionByName(right.select("block", "cell"))
    spread = both.groupBy("block", "cell").agg(F.count("*").alias("__df")).select(F.col("block").alias("__sb"), F.col("cell").alias("__sc"), "__df")
    l, r = _prefix(left, a, spread, least), _prefix(right, b, spread, least).select(F.col(b), F.col("block").alias("__bl"), F.col("cell").alias("__c"))
    pairs = l.join(r, (F.col("block") == F.col("__bl")) & (F.col("cell") == F.col("__c"))).select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct()
    met = pairs.join(left, F.col("__a") == F.col(a)).select(a, "__b", "cell", "v")
    other = right.select(F.col(b), F.col("cell").alias("__c"), F.col("v").alias("__v"))
    met = met.join(other, (F.col("__b") == F.col(b)) & (F.col("cell") == F.col("__c")))
    return met.groupBy(a, b).agg(F.round(F.sum(F.col("v") * F.col("__v")), 9).alias("sim")).filter(F.col("sim") >= least)


def mutual_best(sims: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, sim) of pairs that are each other's best, ties to the least id."""
    best_b = sims.groupBy(a).agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col(b))).alias("__x")).select(F.col(a).alias("__a"), F.col(f"__x.{b}").alias("__b"))
    best_a = sims.groupBy(b).agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col(a))).alias("__x")).select(F.col(b).alias("__b2"), F.col(f"__x.{a}").alias("__a2"))
    met = sims.join(best_b, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")))
    return met.join(best_a, (F.col(b) == F.col("__b2")) & (F.col(a) == F.col("__a2"))).select(a, b, "sim")


def modal(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the most frequent non-null value, the least on ties."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(value))).alias("__m")).select(*keys, F.col(f"__m.{value}").alias(value))


def agreement(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, period: str, lv: str, rv: str, least: int, share: float) -> DataFrame:
    """pairs whose attributes agree: (lv, rv) that `least` periods of all pairs have are consensus, and at least `share`
    of a pair's periods must be one of these. A pair without a common period does not agree."""
    each = pairs.join(left, a).join(right.withColumnRenamed(period, "__p"), b).filter(F.col(period) == F.col("__p"))
    votes = each.groupBy(F.col(lv).alias("__l"), F.col(rv).alias("__r")).agg((F.count("*") >= least).cast("int").alias("__ok"))
    ok = each.join(votes, (F.col(lv) == F.col("__l")) & (F.col(rv) == F.col("__r")))
    good = ok.groupBy(a, b).agg(F.avg("__ok").alias("agree")).filter(F.col("agree") >= share)
    return pairs.join(good, [a, b])


def profiles(rows: DataFrame, entity: str, kind: str, measures: list[str]) -> DataFrame:
    """(entity, m_mean, m_within): mean, and deviation within kinds weighted by their sizes, of each measure.

    From n, sum and sum of squares per kind, so partial sums merge.
    """
    sums = [a for m in measures for a in (F.count(m).alias(f"n_{m}"), F.sum(m).alias(f"s_{m}"), F.sum(F.col(m) * F.col(m)).alias(f"q_{m}"))]
    kinds = rows.filter(F.col(entity).isNotNull() & F.col(kind).isNotNull()).groupBy(entity, kind).agg(*sums)
    out: list[Column] = []
    for m in measures:
        n, s, q = F.col(f"n_{m}"), F.col(f"s_{m}"), F.col(f"q_{m}")
        dev = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
        total = F.nullif(F.sum(n), F.lit(0))
        out += [(F.sum(s) / total).alias(f"{m}_mean"), (F.sum(F.when(n > 0, n * dev)) / total).alias(f"{m}_within")]
    return kinds.groupBy(entity).agg(*out)
