"""Which of several deliveries of one record counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(*keys: Column, of: list[Column], ways: int = 1024) -> Column:
    """A block for rows without a key: they are spread by their other values, so nulls make no hot task."""
    return -1 - F.pmod(F.xxhash64(*of), F.lit(ways))


def latest(rows: DataFrame, entity: str, at: str, version: str, block: int, out: str = "__blk") -> DataFrame:
    """The delivery with the greatest version of every (entity, at), in blocks of the counter at.

    One shuffle by (entity, at div block): a hot entity is spread over its blocks, each of at most `block` records
    besides repeated deliveries. The block stays in column `out`, and the rows come sorted within (entity, block), so
    windows and aggregations over these keys need no further shuffle or sort.
    Null versions lose to any other; equal versions are decided by a hash of the row, so the result is deterministic.
    Rows whose entity or counter is null name no record: all of them are kept, one by one.
    """
    rest = [F.col(c) for c in rows.columns if c not in (entity, at)]
    keyless = F.col(entity).isNull() | F.col(at).isNull()
    rows = rows.withColumn(out, F.when(keyless, spread(of=[F.xxhash64(*rest)])).otherwise(F.floor(F.col(at) / block)))
    rows = rows.repartition(F.col(entity), F.col(out))
    by = Window.partitionBy(entity, out, at).orderBy(F.col(version).desc_nulls_last(), F.xxhash64(*rest))
    return rows.withColumn("__rn", F.row_number().over(by)).filter((F.col("__rn") == 1) | keyless).drop("__rn")
