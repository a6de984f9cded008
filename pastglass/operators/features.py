"""Per-entity feature table from events, kept by signed insert-and-retract deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The grain of the kept state: one row per entity, event type and period.
KEY = ["entity_kind", "entity_id", "event_type"]


def deltas(deliveries: DataFrame, record: list[str], version: str, entities: dict[str, str], event_type: Column, period: str, value: str, blk: Column | None = None) -> DataFrame:
    """(entity_kind, entity_id, event_type, period, d_count, d_total): one signed delta per delivery and entity.

    Each delivery of a record inserts its values; each delivery that a greater version supersedes is retracted again,
    so a record that came once costs one row and only repeated ones cost more. Equal versions supersede one another
    in the order of a hash of the row. entities: {kind: id column}; a null id or event type makes no delta. A null
    value adds nothing to the total. Records with a null in their key are never superseded.
    """
    needed = list(dict.fromkeys([*record, version, *entities.values(), period, value]))
    rows = deliveries.select(*needed, event_type.alias("__type"))
    whole = F.xxhash64(*[c for c in rows.columns if c not in record])
    if blk is not None:
        rows = rows.withColumn("__blk", blk).repartition(F.col(record[0]), F.col("__blk"))
    by = Window.partitionBy(record[0], *(["__blk"] if blk is not None else []), *record[1:]).orderBy(F.col(version).desc_nulls_last(), whole)
    keyed = F.lit(True)
    for k in record:
        keyed = keyed & F.col(k).isNotNull()
    rows = rows.withColumn("__old", (F.row_number().over(by) > 1) & keyed)
    signs = F.when(F.col("__old"), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    ids = F.array(*[F.struct(F.lit(k).alias("entity_kind"), F.col(c).cast("long").alias("entity_id")) for k, c in entities.items()])
    rows = rows.filter(F.col("__type").isNotNull()).select(F.explode(ids).alias("__id"), F.col("__type").alias("event_type"), F.col(period).alias("period"), signs.alias("__signs"), F.coalesce(F.col(value), F.lit(0)).cast("long").alias("__v"))
    rows = rows.filter(F.col("__id.entity_id").isNotNull()).select("__id.*", "event_type", "period", F.explode("__signs").alias("__sign"), "__v")
    return rows.select("entity_kind", "entity_id", "event_type", "period", F.col("__sign").cast("long").alias("d_count"), (F.col("__sign") * F.col("__v")).alias("d_total"))


def later_deltas(live: DataFrame, arrived: DataFrame, record: list[str], version: str, entities: dict[str, str], event_type: Column, period: str, value: str) -> DataFrame:
    """The deltas of deliveries that arrived after the state was built; live: the delivery that counted of each record.

    Only live rows of records that came again are read. Their own inserts are in the state already, so these are
    taken back before the records' deliveries are compared anew; an older version that came late changes nothing.
    """
    touched = arrived.select(*record).distinct()
    old = live.join(touched, record, "left_semi").select(*arrived.columns)
    anew = deltas(old.unionByName(arrived), record, version, entities, event_type, period, value)
    counted = deltas(old, record, version, entities, event_type, period, value)
    return anew.unionByName(counted.withColumn("d_count", -F.col("d_count")).withColumn("d_total", -F.col("d_total")))


def merge_state(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The kept state (KEY, period, n, total) with deltas added; rows that came to nothing are dropped."""
    adds = changes.select(*KEY, "period", F.col("d_count").alias("n"), F.col("d_total").alias("total"))
    both = adds if state is None else state.select(*KEY, "period", "n", "total").unionByName(adds)
    return both.groupBy(*KEY, "period").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter((F.col("n") != 0) | (F.col("total") != 0))


def features(state: DataFrame) -> DataFrame:
    """(KEY, n, total, last_period) of the state."""
    return state.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max(F.when(F.col("n") > 0, F.col("period"))).alias("last_period")).filter(F.col("n") > 0)


def refresh(table: DataFrame, state: DataFrame, changes: DataFrame) -> DataFrame:
    """The feature table after deltas: counts and totals add up; maxima are made anew only where they may have fallen.

    state is the kept state after the same deltas (merge_state). A key's last period can only fall if a retraction
    is at its last period or later; for those keys alone it is read again from the state (a semi-join), all other
    keys take the greater of what they had and what was inserted.
    """
    d = changes.groupBy(*KEY).agg(F.sum("d_count").alias("dn"), F.sum("d_total").alias("dt"), F.max(F.when(F.col("d_count") > 0, F.col("period"))).alias("ins"), F.max(F.when(F.col("d_count") < 0, F.col("period"))).alias("ret"))
    now = table.select(*KEY, "n", "total", "last_period").join(d, KEY, "full_outer")
    now = now.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"), (F.coalesce("total", F.lit(0)) + F.coalesce("dt", F.lit(0))).alias("total"), F.greatest("last_period", "ins").alias("last_period"), "ret")
    fell = F.coalesce(F.col("ret") >= F.col("last_period"), F.lit(False))
    again = state.join(now.filter(fell).select(*KEY), KEY, "left_semi").filter(F.col("n") > 0).groupBy(*KEY).agg(F.max("period").alias("anew"))
    now = now.join(again, KEY, "left").withColumn("last_period", F.when(fell, F.col("anew")).otherwise(F.col("last_period")))
    return now.filter(F.col("n") > 0).select(*KEY, "n", "total", "last_period")


def one_row_each(table: DataFrame, types: list[str]) -> DataFrame:
    """One row per entity with arrays, in the order of types, of counts, totals and last periods (0, 0, null if none).

    An entity has at most one row per type here, so the collected group is bounded by len(types).
    """
    at = F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "total", "last_period"))))
    rows = table.groupBy("entity_kind", "entity_id").agg(at.alias("__m"))
    slots = F.transform(F.array(*[F.lit(t) for t in types]), lambda t: F.try_element_at(F.col("__m"), t))
    zero = F.lit(0).cast("long")
    return rows.withColumn("__s", slots).select(
        "entity_kind", "entity_id", F.transform("__s", lambda s: F.coalesce(s["n"], zero)).alias("pitches"), F.transform("__s", lambda s: F.coalesce(s["total"], zero)).alias("successes"), F.transform("__s", lambda s: s["last_period"]).alias("last_season"),
    )
