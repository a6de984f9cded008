"""Attributes as known at event time: validity intervals, bucketed, joined on entity and bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastglass.operators.deliveries import spread
from pastglass.sources.tables import cut, fresh


def block_prefix(sums: DataFrame, entity: str, blk: str, values: list[str], block: int) -> DataFrame:
    """(__pe, __pb, base_<value>...): each value summed over the entity's earlier blocks.

    Two levels (the blocks of a super-block, then super-blocks), so no window is over more than `block` rows until
    the last, which has one row for block^2 counters.
    """
    sums = sums.groupBy(entity, blk).agg(*[F.sum(v).alias(v) for v in values]).withColumn("__sup", F.floor(F.col(blk) / block))
    before = lambda v, w: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sums.groupBy(entity, "__sup").agg(*[F.sum(v).alias(v) for v in values])
    tops = tops.select(F.col(entity).alias("__te"), F.col("__sup").alias("__ts"), *[before(v, Window.partitionBy(entity).orderBy("__sup")).alias(f"__t_{v}") for v in values])
    sums = sums.select(entity, blk, "__sup", *[before(v, Window.partitionBy(entity, "__sup").orderBy(blk)).alias(f"__s_{v}") for v in values])
    both = sums.join(tops, (F.col(entity) == F.col("__te")) & (F.col("__sup") == F.col("__ts")))
    return both.select(F.col(entity).alias("__pe"), F.col(blk).alias("__pb"), *[(F.col(f"__t_{v}") + F.col(f"__s_{v}")).alias(f"base_{v}") for v in values])


def validity(facts: DataFrame, states: DataFrame, entity: str, period: str, valid_from: str, known_from: str, rank: list[str], payload: list[str]) -> DataFrame:
    """Half-open intervals [lo, hi) of the counter in which one version of an entity's state is the one to use.

    A version can be used from the first event that is both at or after its counter valid_from and in a period not
    before known_from. Periods never fall along an entity's counter, so that moment is one counter value: the greater
    of valid_from and the first counter of a period >= known_from. Successive change times, and at each the running
    greatest (valid_from, known_from, *rank), give the intervals. Versions of null entity, counter or period can never
    be used; nulls in rank count as the least. facts: least and greatest counter (__lo, __hi) by entity, block and period.
    """
    spans = facts.filter(F.col(entity).isNotNull() & F.col("__lo").isNotNull()).groupBy(entity, period).agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    ranked = [valid_from, known_from, *rank]
    best = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(ranked)], *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])
    versions = states.filter(F.col(entity).isNotNull() & F.col(valid_from).isNotNull() & F.col(known_from).isNotNull())
    versions = versions.select(F.col(entity).alias("__e"), F.col(known_from).alias("__p"), F.col(valid_from).alias("__from"), best.alias("__best")).distinct()
    none = {"__from": versions.schema["__from"].dataType, "__best": versions.schema["__best"].dataType, "__lo": spans.schema["__lo"].dataType, "__hi": spans.schema["__hi"].dataType}
    line = spans.select(F.col(entity).alias("__e"), F.col(period).alias("__p"), F.lit(None).cast(none["__from"]).alias("__from"), F.lit(None).cast(none["__best"]).alias("__best"), "__lo", "__hi")
    line = line.unionByName(versions.withColumn("__lo", F.lit(None).cast(none["__lo"])).withColumn("__hi", F.lit(None).cast(none["__hi"])))
    later = Window.partitionBy("__e").orderBy(F.col("__p").desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("__open", F.min("__lo").over(later)).withColumn("__end", F.max("__hi").over(later))
    starts = line.filter(F.col("__best").isNotNull() & F.col("__open").isNotNull()).withColumn("__start", F.greatest("__from", "__open"))
    starts = starts.groupBy("__e", "__start").agg(F.max("__best").alias("__best"), F.max("__end").alias("__end"))
    w = Window.partitionBy("__e").orderBy("__start")
    cuts = starts.select("__e", F.col("__start").alias("__from"), F.coalesce(F.lead("__start").over(w), F.col("__end") + 1).alias("__to"), F.max("__best").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__best"))
    return cuts.filter(F.col("__from") < F.col("__to"))


def as_known(events: DataFrame, states: DataFrame, *, entity: str, at: str, period: str, valid_from: str, known_from: str, rank: list[str], payload: dict[str, str], running: dict[str, tuple[str, str]] | None = None, block: int = 512) -> DataFrame:
    """Each event with the state attributes that were valid and already known at it.

    events: one row per (entity, at), at a whole counter along which period never falls. states: versions of an
    entity's totals, valid from a counter and known from a period. payload: {state column: output column}. running:
    {output: (state output, event column)}, the state's total carried on to the event: state + the sum of the event
    column over the entity's events from valid_from up to, not including, the event.

    Method: validity intervals from successive change times, exploded into blocks of the counter; events and intervals
    meet by equality of entity and block, and half-open containment picks the one interval. Blocks also split a hot
    entity. Nothing is broadcast by hand and no group is collected.

    Defined cases: events without entity, counter or usable version keep their row with null attributes; null event
    values add nothing to a running total; versions equal in rank are decided by their greater totals, in order; a null total in the state gives a null running total; repeated versions
    count once; an empty side gives null attributes (or no rows). A name already taken gets an underscore.
    """
    running = running or {}
    taken = list(events.columns)
    names = {k: fresh(v, taken) for k, v in payload.items()}
    blk = "__blk"
    if blk not in events.columns:
        keyless = F.col(entity).isNull() | F.col(at).isNull()
        events = events.withColumn(blk, F.when(keyless, spread(of=[F.struct("*")])).otherwise(F.floor(F.col(at) / block))).repartition(F.col(entity), F.col(blk))
    sums, cols = sorted({v for _, v in running.values()}), list(payload)
    value = lambda v: F.coalesce(F.col(v), F.lit(0))
    # One small row for each entity, block and period: the only thing that intervals and prefixes need of the events.
    facts = cut(events.groupBy(entity, blk, period).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"), *[F.sum(value(v)).alias(f"__f{i}") for i, v in enumerate(sums)]))
    ver = states.select(F.col(entity), F.col(valid_from).alias("__vf"), F.col(known_from).alias("__kf"), *[F.col(c).alias(f"__rk{i}") for i, c in enumerate(rank)], *[F.col(c).alias(f"__pl{i}") for i, c in enumerate(cols)])
    cuts = cut(validity(facts, ver, entity, period, "__vf", "__kf", [f"__rk{i}" for i in range(len(rank))], [f"__pl{i}" for i in range(len(cols))]))
    met = events
    if sums:
        fs = [f"__f{i}" for i in range(len(sums))]
        marks = cuts.select(F.col("__e").alias("__me"), F.col("__best.r0").alias("__ma")).distinct().withColumn("__mb", F.floor(F.col("__ma") / block))
        zeros = marks.select(F.col("__me").alias(entity), F.col("__mb").alias(blk), *[F.lit(0).alias(f) for f in fs])
        base = block_prefix(facts.filter(F.col(entity).isNotNull()).select(entity, blk, *fs).unionByName(zeros), entity, blk, fs, block)
        # What the states' own blocks add up to before the states' counters: events meet them by entity and block.
        partial = events.join(marks, (F.col(entity) == F.col("__me")) & (F.col(blk) == F.col("__mb")) & (F.col(at) < F.col("__ma")))
        partial = partial.groupBy("__me", "__ma").agg(*[F.sum(value(v)).alias(f"__q{i}") for i, v in enumerate(sums)]).withColumnsRenamed({"__me": "__qe", "__ma": "__qa"})
        marks = marks.join(base, (F.col("__me") == F.col("__pe")) & (F.col("__mb") == F.col("__pb"))).join(partial, (F.col("__me") == F.col("__qe")) & (F.col("__ma") == F.col("__qa")), "left")
        marks = marks.select("__me", "__ma", *[(F.col(f"base___f{i}") + F.coalesce(f"__q{i}", F.lit(0))).alias(f"__m{i}") for i in range(len(sums))])
        cuts = cuts.join(marks, (F.col("__e") == F.col("__me")) & (F.col("__best.r0") == F.col("__ma"))).drop("__me", "__ma")
        inside = Window.partitionBy(entity, blk).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
        met = met.withColumns({f"__in{i}": F.coalesce(F.sum(value(v)).over(inside), F.lit(0)) for i, v in enumerate(sums)})
        met = met.join(base, (F.col(entity) == F.col("__pe")) & (F.col(blk) == F.col("__pb")), "left")
    first = F.floor(F.col("__from") / block)
    buckets = cuts.withColumn("__ib", F.explode(F.sequence(first, F.greatest(first, F.floor((F.col("__to") - 1) / block)))))
    met = met.join(buckets, (F.col(entity) == F.col("__e")) & (F.col(blk) == F.col("__ib")) & (F.col(at) >= F.col("__from")) & (F.col(at) < F.col("__to")), "left")
    for i, c in enumerate(cols):
        met = met.withColumn(names[c], F.col(f"__best.p{i}"))
    back = {v: k for k, v in payload.items()}
    for out, (state, v) in running.items():
        i = sums.index(v)
        met = met.withColumn(fresh(out, taken), F.col(names[back[state]]) + F.col(f"__in{i}") + F.coalesce(f"base___f{i}", F.lit(0)) - F.col(f"__m{i}"))
    return met.drop("__e", "__from", "__to", "__best", "__ib", "__pe", "__pb", blk, *[f"{p}{i}" for i in range(len(sums)) for p in ("__in", "base___f", "__m")])
