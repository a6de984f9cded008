"""Encodings fitted on some rows and applied to others: codes, vocabularies, imputation and scaling, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastglass.operators.profile import quantiles
from pastglass.sources.tables import cut


def category_codes(fitted: DataFrame, column: str, first: int = 0) -> DataFrame:
    """(value, code): codes from `first` on in the order of the distinct non-null values.

    The order is global, so codes are numbered over a range-partitioned sort of the distinct values: partition sizes
    are added up, and no task holds all values.
    """
    values = fitted.filter(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("__one")).select(F.col(column).alias("value"))
    return numbered(values, "value", "code", first)


def numbered(values: DataFrame, order: str, out: str, first: int) -> DataFrame:
    """values (of distinct `order`) with consecutive numbers in that order, by counts of hash-free ranges."""
    ranged = cut(values.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()))  # read twice
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    line = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(line), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(order)
    out_rows = ranged.withColumn("__rn", F.row_number().over(within)).join(starts, F.col("__part") == F.col("__p"))
    return out_rows.withColumn(out, (F.col("__before") + F.col("__rn") - 1 + first).cast("long")).drop("__part", "__p", "__before", "__rn")


def apply_codes(rows: DataFrame, codes: DataFrame, column: str, out: str, unseen: int | None) -> DataFrame:
    """rows with the code of column; unseen and null values get `unseen`."""
    c = codes.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    joined = rows.join(c, F.col(column) == F.col("__v"), "left")
    return joined.withColumn(out, F.coalesce("__c", F.lit(unseen).cast("long")) if unseen is not None else F.col("__c")).drop("__v", "__c")


def edges_of(rows: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """One row with an array <column>_q of exact quantiles for each column, null without values: all columns at once."""
    cell = [F.struct(F.lit(c).alias("__c"), F.col(c).cast("double").alias("__x")) for c in columns]
    long = rows.select(F.explode(F.array(*cell)).alias("__s")).select("__s.*")
    found = quantiles(long, ["__c"], "__x", probs, "__q")
    return found.agg(*[F.max(F.when(F.col("__c") == c, F.col("__q"))).alias(f"{c}_q") for c in columns])


def medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact median <column>_med of each column."""
    return edges_of(rows, columns, [0.5]).select(*[F.col(f"{c}_q")[0].alias(f"{c}_med") for c in columns])


def numeric_prep(fitted: DataFrame, columns: list[str]) -> DataFrame:
    """One row with median, mean and population deviation (after imputing the median; 1 if nearly 0) and missing share.

    Exact medians, by counts in order-preserving blocks.
    """
    filled = fitted.select(*columns).crossJoin(F.broadcast(medians(fitted, columns)))  # one row
    aggs: list[Column] = []
    for c in columns:
        v = F.coalesce(F.col(c), F.col(f"{c}_med"))
        dev = F.stddev_pop(v)
        aggs += [F.max(f"{c}_med").alias(f"{c}_med"), F.avg(v).alias(f"{c}_mean"), F.when(dev <= 1e-12, 1.0).otherwise(dev).alias(f"{c}_dev"), F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_miss")]
    return filled.agg(*aggs)


def standardised(rows: DataFrame, prep: DataFrame, columns: list[str]) -> DataFrame:
    """rows with c_z (imputed and scaled) and c_isna, which is 1 only for columns that had missing values at the fit."""
    joined = rows.crossJoin(F.broadcast(prep))  # one row
    out = {}
    for c in columns:
        out[f"{c}_z"] = (F.coalesce(F.col(c), F.col(f"{c}_med")) - F.col(f"{c}_mean")) / F.col(f"{c}_dev")
        out[f"{c}_isna"] = (F.col(c).isNull() & (F.col(f"{c}_miss") > 0)).cast("int")
    return joined.withColumns(out).drop(*[f"{c}_{s}" for c in columns for s in ("med", "mean", "dev", "miss")])


def one_hot(column: Column, levels: list) -> dict[str, Column]:
    """A 0/1 column for each fixed level; all 0 for other values and null. More than 64 levels are an error."""
    if len(levels) > 64:
        raise ValueError("too many levels")
    return {f"is_{v}": F.coalesce((column == F.lit(v)).cast("int"), F.lit(0)) for v in levels}


def quantile_bins(rows: DataFrame, column: str, parts: int, out: str) -> DataFrame:
    """rows with the number (from 0) of the right-closed quantile bin of column, equal edges merged; null stays null."""
    edges = edges_of(rows, [column], [i / parts for i in range(parts + 1)]).select(F.array_sort(F.array_distinct(f"{column}_q")).alias("__edges"))
    joined = rows.crossJoin(F.broadcast(edges))  # one row
    above = F.size(F.filter("__edges", lambda e: e < F.col(column)))
    return joined.withColumn(out, F.when(F.col(column).isNotNull(), F.greatest(above - 1, F.lit(0)))).drop("__edges")
