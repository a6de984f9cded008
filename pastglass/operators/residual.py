"""Shrunken residual tables, hierarchical estimates, and their application as corrections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastglass.functions.scalars import clip


@dataclass(frozen=True)
class Correction:
    """A table's keys (entity first, for an interaction), the weight of its prior, and what it is multiplied by."""

    name: str
    keys: tuple[str, ...]
    k: float
    scale: float = 1.0


@dataclass(frozen=True)
class Level:
    """A level of a hierarchy: its keys and the levels whose mean it is drawn to."""

    name: str
    keys: tuple[str, ...]
    parents: tuple[str, ...]


def centred(rows: DataFrame, residual: Column, by: list[str]) -> DataFrame:
    """rows with r: the residual less its mean over `by`. The means are aggregated and joined: no window over rows."""
    rows = rows.withColumn("__r", residual)
    means = rows.groupBy(*by).agg(F.avg("__r").alias("__mean")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], "__mean") if by else rows.agg(F.avg("__r").alias("__mean"))
    joined = rows.join(means, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]) if by else rows.crossJoin(F.broadcast(means))  # one row
    return joined.withColumn("r", F.col("__r") - F.col("__mean")).drop("__r", "__mean", *[f"__k{i}" for i in range(len(by))])


def flat_table(rows: DataFrame, keys: list[str], k: float) -> DataFrame:
    """(keys, value): sum of r / (n + k). Null keys have no cell."""
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    return rows.groupBy(*keys).agg((F.sum("r") / (F.count("*") + k)).alias("value"))


def interaction_table(rows: DataFrame, entity: str, keys: list[str], k: float) -> DataFrame:
    """(entity, keys, value): a cell's residual sum less its share of the entity's, over n + k."""
    for key in [entity, *keys]:
        rows = rows.filter(F.col(key).isNotNull())
    cells = rows.groupBy(entity, *keys).agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(entity)  # over an entity's cells, not its rows
    return cells.select(entity, *keys, ((F.col("s") - F.sum("s").over(w) * F.col("n") / F.sum("n").over(w)) / (F.col("n") + k)).alias("value"))


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], out: str, default: float | None = 0.0) -> DataFrame:
    """rows with the value of their keys, or the default: a left join against a table with unique keys."""
    v = values.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("value").alias("__v"))
    joined = rows.join(v, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)], "left")
    return joined.withColumn(out, F.coalesce("__v", F.lit(default)) if default is not None else F.col("__v")).drop("__v", *[f"__k{i}" for i in range(len(keys))])


def corrected(rows: DataFrame, p: str, tables: list[tuple[Correction, DataFrame]], gate: Column, out: str) -> DataFrame:
    """rows with p moved by each table in turn where the gate holds, limited to 0..1 after each."""
    rows = rows.withColumn(out, F.col(p))
    for c, values in tables:
        rows = looked_up(rows, values, list(c.keys), "__add")
        rows = rows.withColumn(out, F.when(gate, clip(F.col(out) + c.scale * F.col("__add"), 0.0, 1.0)).otherwise(F.col(out))).drop("__add")
    return rows


def hierarchy(train: DataFrame, rows: DataFrame, y: str, levels: list[Level], k: float) -> DataFrame:
    """rows with e_<level> and rel_<level>: (s + k parent) / (n + k) and n / (n + k), from the global rate downwards.

    Each level is one aggregation of train and one left join; a key not seen is exactly its parent's estimate.
    """
    whole = train.agg(F.avg(y).alias("e_all"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    for lv in levels:
        cells = train.groupBy(*lv.keys).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
        cells = cells.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(lv.keys)], "__s", "__n")
        rows = rows.join(cells, [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(lv.keys)], "left")
        parent = sum((F.col(f"e_{p}") for p in lv.parents[1:]), F.col(f"e_{lv.parents[0]}")) / len(lv.parents)
        n, s = F.coalesce("__n", F.lit(0)), F.coalesce("__s", F.lit(0))
        rows = rows.withColumn(f"e_{lv.name}", (s + k * parent) / (n + k)).withColumn(f"rel_{lv.name}", n / (n + k)).drop("__s", "__n", *[f"__k{i}" for i in range(len(lv.keys))])
    return rows


def combined(levels: list[str]) -> Column:
    """The reliability-weighted mean of the levels' estimates and the global rate (of weight one)."""
    top = sum((F.col(f"rel_{n}") * F.col(f"e_{n}") for n in levels), F.col("e_all"))
    return top / sum((F.col(f"rel_{n}") for n in levels), F.lit(1.0))


def expert_mix(p: Column, expert: Column, gate: Column, weight: float | Column) -> Column:
    """(1 - w) p + w expert where the gate holds, p itself elsewhere."""
    return F.when(gate & expert.isNotNull(), (1 - weight) * p + weight * expert).otherwise(p)
