"""Checks of keys, alignment and row independence, samples, and the data dictionary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(contract: DataFrame, scored: DataFrame, key: str, value: str) -> DataFrame:
    """contract's keys with the value, if scored has it; rows are kept as the contract has them."""
    s = scored.groupBy(key).agg(F.max(value).alias("__v")).withColumnRenamed(key, "__k")
    return contract.join(s, F.col(key) == F.col("__k"), "left").drop("__k").withColumnRenamed("__v", value)


def violations(contract: DataFrame, scored: DataFrame, key: str, value: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """One row: duplicates, missing and extra keys, and values that are null or NaN or out of range."""
    c = contract.groupBy(key).agg(F.count("*").alias("in_contract"))
    v = F.col(value)
    s = scored.groupBy(key).agg(F.count("*").alias("in_scored"), F.sum((v.isNull() | F.isnan(v)).cast("long")).alias("bad"), F.sum((~F.isnan(v) & ((v < lo) | (v > hi))).cast("long")).alias("out")).withColumnRenamed(key, "__k")
    both = c.join(s, F.col(key).eqNullSafe(F.col("__k")), "full_outer")
    n = lambda cond: F.sum(F.coalesce(cond.cast("long"), F.lit(0)))
    return both.agg(n(F.col("in_scored") > 1).alias("duplicates"), n(F.col("in_scored").isNull()).alias("missing"), n(F.col("in_contract").isNull()).alias("extra"), F.coalesce(F.sum("bad"), F.lit(0)).alias("undefined"), F.coalesce(F.sum("out"), F.lit(0)).alias("out_of_range"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, copies) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def joined_unique(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """A left join that must not multiply rows: an error is raised, in the job, if a right key met is not unique."""
    cols = [c for c in right.columns if c != right_key]
    one = right.groupBy(right_key).agg(F.count("*").alias("__n"), *[F.max(c).alias(c) for c in cols]).withColumnRenamed(right_key, "__rk")
    met = left.join(one, F.col(left_key) == F.col("__rk"), "left")
    sure = F.when(F.coalesce(F.col("__n"), F.lit(1)) == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("key is not unique: "), F.col(left_key).cast("string"))).cast("boolean"))
    return met.filter(sure).drop("__n", "__rk")


def independence(rows: DataFrame, key: list[str], run: Callable[[DataFrame], DataFrame], outputs: list[str], mutable: list[str] | None = None, subset: float = 0.5, singles: int = 3) -> DataFrame:
    """(variant, rows_met, max_abs_diff): does a row's output change with what else is in the batch?

    run maps rows to key and numeric outputs, those of each variant are joined to those of the whole by key. Variants:
    rows shuffled, reversed, a subset of them, some deleted, some repeated, some alone in their batch, the others
    changed (their numeric `mutable` columns), and foreign rows added (with null keys).
    """
    base = run(rows).select(*key, *[F.col(o).cast("double").alias(f"base_{o}") for o in outputs])
    h = F.pmod(F.xxhash64(*key), F.lit(1000)) / 1000.0
    changed = rows.withColumns({c: F.when(h < subset, F.col(c)).otherwise((F.coalesce(F.col(c), F.lit(0)) * 3 + 1).cast(rows.schema[c].dataType)) for c in mutable or []})
    foreign = rows.filter(h < 0.1).withColumns({k: F.lit(None).cast(rows.schema[k].dataType) for k in key})
    variants = {
        "shuffled": [rows.orderBy(F.xxhash64(*key))], "reversed": [rows.orderBy(*[F.col(k).desc() for k in key])], "subset": [rows.filter(h < subset)], "deleted": [rows.filter(h >= 0.1)],
        "repeated": [rows.unionByName(rows.filter(h < 0.1))], "single": [rows.orderBy(F.xxhash64(*key, F.lit(i)), *key).limit(1) for i in range(singles)], "others_changed": [changed], "foreign_added": [rows.unionByName(foreign)],
    }
    out = None
    for name, parts in variants.items():
        for part in parts:
            got = run(part).groupBy(*key).agg(*[F.max(F.col(o).cast("double")).alias(o) for o in outputs])
            met = base.join(got, key).filter(h < subset) if name == "others_changed" else base.join(got, key)
            diff = [F.coalesce(F.abs(F.col(o) - F.col(f"base_{o}")), F.when(F.col(o).isNull() != F.col(f"base_{o}").isNull(), F.lit(float("inf"))).otherwise(0.0)) for o in outputs]
            one = met.agg(F.lit(name).alias("variant"), F.count("*").alias("rows_met"), F.max(F.greatest(*diff, F.lit(0.0))).alias("max_abs_diff"))
            out = one if out is None else out.unionByName(one)
    return out.groupBy("variant").agg(F.sum("rows_met").alias("rows_met"), F.max("max_abs_diff").alias("max_abs_diff"))


def dictionary(rows: DataFrame) -> DataFrame:
    """(column_name, family, n_null, n_distinct): every column in one pass; families go by the names of columns."""
    family = F.when(F.col("column_name").startswith("asof_"), "as_of").when(F.col("column_name").endswith("_id"), "key").when(F.col("column_name").startswith("runner_") | F.col("column_name").contains("before"), "context").otherwise("other")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in rows.columns])
    counts = rows.select(F.explode(cells).alias("c")).select("c.*").groupBy("column_name", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("column_name").agg(F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.count("v").alias("n_distinct")).withColumn("family", family)


def sampled(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """n rows by the order of a hash of the key: the same rows on any cluster, by a bounded top-n per partition."""
    return rows.orderBy(F.xxhash64(*key), *key).limit(n)


def capped(rows: DataFrame, strata: list[str], key: list[str], n: int) -> DataFrame:
    """At most n rows of each stratum, by the order of a hash of the key; the cut is applied before the shuffle too."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(F.xxhash64(*key), *key))
    return rows.withColumn("__rn", rank).filter(F.col("__rn") <= n).drop("__rn")


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row (n_rows, digest): equal for equal multisets of rows, whatever their order."""
    text = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda a, b: F.sum(F.conv(F.substring("__h", a, b), 16, 10).cast("decimal(20,0)"))
    return rows.select(text.alias("__h")).agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("-", part(1, 15), part(16, 15), F.count("*")), 256).alias("digest"))
