"""Filling missing values by label propagation over group-and-similarity edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastglass.sources.tables import fresh

#: Weights of the edges: to the record's own block, to each neighbouring block, and to the group's observed mean.
OWN, NEXT, GROUP = 2.0, 1.0, 0.5


def observed(v: Column, lo: float, hi: float) -> Column:
    """v where it is a number within lo..hi, else null."""
    return F.when(v.isNotNull() & ~F.isnan(v) & v.between(lo, hi), v)


def propagate(blocks: DataFrame, group: list[str], blk: str, sup: str, fields: list[str], rounds: int) -> DataFrame:
    """`rounds` rounds of averaging along the blocks of a group; adds x_<field>, the value its missing records take.

    Within a block all records are joined through one hub, so the missing ones share one estimate and a block's state
    is (sum, count of observed, count of missing): the propagation over single records, exactly, on one row a block.
    Observed records are clamped: they enter each round with their own values. All rounds run in one sorted stage,
    within super-blocks. An estimate depends on the blocks up to `rounds` away, so super-blocks from haloed() give
    their own blocks the values of the uncut run.
    """
    w = Window.partitionBy(*group, sup).orderBy(blk)
    for f in fields:
        blocks = blocks.withColumn(f"x_{f}", F.when(F.col(f"c_{f}") > 0, F.col(f"s_{f}") / F.col(f"c_{f}")).otherwise(F.col(f"g_{f}")))
    for _ in range(rounds):
        hubs = {f"h_{f}": (F.col(f"s_{f}") + F.col(f"m_{f}") * F.coalesce(F.col(f"x_{f}"), F.lit(0.0))) / F.nullif(F.col(f"c_{f}") + F.col(f"m_{f}"), F.lit(0)) for f in fields}
        blocks = blocks.withColumns(hubs)
        sides = {f"{side}_{f}": move(f"h_{f}").over(w) for f in fields for side, move in (("l", F.lag), ("r", F.lead))}
        blocks = blocks.withColumns(sides)
        step = {}
        for f in fields:
            ties = [(F.col(f"h_{f}"), OWN), (F.col(f"l_{f}"), NEXT), (F.col(f"r_{f}"), NEXT), (F.col(f"g_{f}"), GROUP)]
            total = sum((F.coalesce(v * k, F.lit(0.0)) for v, k in ties), F.lit(0.0))
            weight = sum((F.when(v.isNotNull(), F.lit(k)).otherwise(0.0) for v, k in ties), F.lit(0.0))
            step[f"x_{f}"] = F.when(F.col(f"g_{f}").isNotNull(), total / weight)
        blocks = blocks.withColumns(step)
    return blocks


def haloed(blocks: DataFrame, rank: Column, span: int, rounds: int) -> DataFrame:
    """blocks in super-blocks __sup of `span` successive ranks, each with the `rounds` blocks before and after it.

    __home is a block's own super-block. A block without a rank is alone in the null one.
    """
    reach = F.sequence(F.greatest(F.floor((rank - rounds) / span), F.lit(0)), F.floor((rank + rounds) / span))
    return blocks.withColumn("__home", F.floor(rank / span)).withColumn("__sup", F.explode_outer(reach))


def fill(rows: DataFrame, *, group: list[str], order: str, blk: str, fields: dict[str, tuple[float, float]], levels: dict[str, list] | None = None, rounds: int = 8, span: int = 512) -> DataFrame:
    """rows with filled fields: for each field f also f_filled (the value to use), f_was_filled and f_has_earlier.

    fields: numeric fields with the range of a true value; anything else (null, NaN, out of range) is missing.
    levels: categorical fields with their possible levels (a bounded list); other values are missing, and the fill is
    the level of the greatest propagated share, the earlier in the list on ties.
    Records of one group are neighbours: through the hub of their block of the order column, of the blocks beside it,
    and of the group. blk is that block (rows should come partitioned by it); order is the records' time, and
    f_has_earlier says whether the group has an observed value at a smaller one.

    Defined cases: a group without an observed value is not filled (null, not marked); an observed value is kept as
    it is; a null group key is a group like any other unless blk spreads it; a null order counts as last for
    f_has_earlier; no rows give no rows. Output names that are taken get an underscore.
    """
    levels = levels or {}
    taken = list(rows.columns)
    marks: dict[str, Column] = {f: observed(F.col(f).cast("double"), lo, hi) for f, (lo, hi) in fields.items()}
    for f, names in levels.items():
        known = F.coalesce(F.col(f).isin(names), F.lit(False))
        for i, level in enumerate(names):
            marks[f"{f}__{i}"] = F.when(known, (F.col(f) == F.lit(level)).cast("double"))
    parts = [a for f, v in marks.items() for a in (F.coalesce(F.sum(v), F.lit(0.0)).alias(f"s_{f}"), F.count(v).alias(f"c_{f}"), F.count(F.when(v.isNull(), 1)).alias(f"m_{f}"), F.min(F.when(v.isNotNull(), F.col(order))).alias(f"f_{f}"))]
    blocks = rows.groupBy(*group, blk).agg(*parts)
    # Neighbours are successive blocks, whatever their distance: ranks are counted in runs of blocks, then over the runs.
    blocks = blocks.withColumn("__run", F.floor(F.col(blk) / span))
    runs = blocks.groupBy(*group, "__run").agg(F.count(blk).alias("__n"), *[a for f in marks for a in (F.sum(f"s_{f}").alias(f"s_{f}"), F.sum(f"c_{f}").alias(f"c_{f}"), F.min(f"f_{f}").alias(f"f_{f}"))])
    every = Window.partitionBy(*group)
    whole = [a for f in marks for a in ((F.sum(f"s_{f}").over(every) / F.nullif(F.sum(f"c_{f}").over(every), F.lit(0))).alias(f"g_{f}"), F.min(f"f_{f}").over(every).alias(f"e_{f}"))]
    base = F.coalesce(F.sum("__n").over(every.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate([*group, "__run"])], base.alias("__base"), *whole)
    blocks = blocks.join(runs, [F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate([*group, "__run"])])
    rank = F.when(F.col(blk).isNotNull(), F.col("__base") + F.row_number().over(Window.partitionBy(*group, "__run").orderBy(blk)) - 1)
    blocks = haloed(blocks.withColumn("__rank", rank), F.col("__rank"), span, rounds)
    solved = propagate(blocks, group, blk, "__sup", list(marks), rounds).filter(F.col("__sup").eqNullSafe(F.col("__home")))
    solved = solved.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*group, blk])], *[F.col(f"x_{f}").alias(f"__x_{f}") for f in marks], *[F.col(f"e_{f}").alias(f"__e_{f}") for f in marks])
    met = rows.join(solved, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*group, blk])], "left")
    out = {}
    for f in fields:
        own, est = marks[f], F.col(f"__x_{f}")
        out[fresh(f"{f}_filled", taken)] = F.coalesce(own, est)
        out[fresh(f"{f}_was_filled", taken)] = own.isNull() & est.isNotNull()
        out[fresh(f"{f}_has_earlier", taken)] = F.coalesce(F.col(f"__e_{f}") < F.col(order), F.col(f"__e_{f}").isNotNull())
    for f, names in levels.items():
        known = F.coalesce(F.col(f).isin(names), F.lit(False))
        shares = [F.col(f"__x_{f}__{i}") for i in range(len(names))]
        top = F.greatest(*shares) if len(shares) > 1 else shares[0]
        best = F.coalesce(*[F.when(s == top, F.lit(level)) for s, level in zip(shares, names)])
        out[fresh(f"{f}_filled", taken)] = F.when(known, F.col(f)).otherwise(best)
        out[fresh(f"{f}_was_filled", taken)] = ~known & top.isNotNull()
        out[fresh(f"{f}_has_earlier", taken)] = F.coalesce(F.col(f"__e_{f}__0") < F.col(order), F.col(f"__e_{f}__0").isNotNull())
    return met.withColumns(out).drop(*[f"__k{i}" for i in range(len(group) + 1)], *[f"__{p}_{f}" for p in ("x", "e") for f in marks])
