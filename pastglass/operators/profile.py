"""Column-level quality profile of loads: shares, distincts, ranges, patterns and change against the load before."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

#: Blocks for each power of two are as many as let a load of all rows within one power of two have blocks of this size.
ROWS_A_BLOCK = 300_000


def value_counts(rows: DataFrame, load: list[str], columns: list[str]) -> DataFrame:
    """(load..., column_name, num, txt, cnt): how often each value of each column occurs in each load.

    Exact: an unpivot and one count with map-side combine. Numbers are in num (NaN is a value of its own), all other
    kinds as text in txt; a null has neither. Minus zero counts as zero.
    """
    cell = []
    for c in columns:
        number = isinstance(rows.schema[c].dataType, NUMBERS)
        cell.append(F.struct(F.lit(c).alias("column_name"), (F.col(c).cast("double") if number else F.lit(None).cast("double")).alias("num"), (F.lit(None).cast("string") if number else F.col(c).cast("string")).alias("txt")))
    long = rows.select(*load, F.explode(F.array(*cell)).alias("__c")).select(*load, "__c.*")
    return long.groupBy(*load, "column_name", "num", "txt").agg(F.count("*").alias("cnt"))


def usable(ranges: dict[str, tuple[float | None, float | None]]) -> Column:
    """True for finite numbers within the range of their column; columns without a range take every finite number."""
    v = F.col("num")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    for c, (lo, hi) in ranges.items():
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (v >= lo)
        if hi is not None:
            inside = inside & (v <= hi)
        ok = ok & ((F.col("column_name") != c) | inside)
    return F.coalesce(ok, F.lit(False))


def place(v: Column, per_octave: int = 256) -> Column:
    """An order-preserving block number of a finite double: so many blocks for each power of two, either sign, and zero.

    Equal values share a block, whatever the data. Infinities and NaN come last of all.
    """
    log = lambda x: F.floor(F.least(F.log2(x), F.lit(1100.0)) * per_octave) + (1100 * per_octave)
    return F.when(v == 0, F.lit(0)).when(v > 0, log(v)).otherwise(-log(-v)).cast("long")


def summary(counts: DataFrame, load: list[str], patterns: dict[str, str]) -> DataFrame:
    """One row per load and column: rows, nulls, distincts, range, unusable and malformed values. counts has `ok`."""
    n, given = F.col("cnt"), F.col("num").isNotNull() | F.col("txt").isNotNull()
    finite = F.col("num").isNotNull() & ~F.isnan("num")
    bad = F.lit(False)
    for c, p in patterns.items():
        bad = bad | ((F.col("column_name") == c) & ~F.coalesce(F.col("txt").rlike(p), F.lit(True)))
    total = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    return counts.groupBy(*load, "column_name").agg(
        F.sum(n).alias("n_rows"), total(~given).alias("n_null"), F.count(F.when(given, 1)).alias("n_distinct"),
        F.min(F.when(finite, F.col("num"))).alias("min_num"), F.max(F.when(finite, F.col("num"))).alias("max_num"), F.min("txt").alias("min_txt"), F.max("txt").alias("max_txt"),
        total(F.col("ok")).alias("n_usable"), F.count(F.when(F.col("ok"), 1)).alias("distinct_usable"),
        total(F.col("num").isNotNull() & ~F.col("ok")).alias("n_unusable"), total(bad).alias("n_malformed"),
    )


def against_before(counts: DataFrame, feed: str, number: str, per_octave: int) -> DataFrame:
    """One row per (feed, number, column): the loads' distributions against those of number - 1 of the feed.

    Every count goes to its own load and, as "before", to the next, so loads meet by grouping and not by a join. ks
    is the greatest difference of the cumulative shares of usable numbers, psi the population stability index over
    the tenths of the load before, chi2 the two-sample chi-square over all values. Cumulative counts are taken in
    order-preserving blocks and then over blocks: no task sorts a whole load. Counts are shuffled once, by feed, column
    and block, and doubled only after that; what a block's loads need of the others comes as one map for each block. A
    load without a load before, or without values of the kind, has null statistics, as has one of a null feed or number.
    """
    sides = F.array(F.struct(F.lit(0).alias("d"), F.col("cnt").alias("c"), F.lit(0).cast("long").alias("p")), F.struct(F.lit(1).alias("d"), F.lit(0).cast("long").alias("c"), F.col("cnt").alias("p")))
    # The condition hangs on the count, so it stays above the counting and both uses of the counts share one exchange.
    given = counts.filter((F.when(F.col("ok") | F.col("txt").isNotNull(), F.col("cnt")) > 0) & F.col(feed).isNotNull() & F.col(number).isNotNull())
    text_block = -(1 << 40) - F.pmod(F.xxhash64("txt"), F.lit(8 * per_octave))
    given = given.withColumn("__blk", F.when(F.col("txt").isNull(), place(F.col("num"), per_octave)).otherwise(text_block))
    key, place_key = [feed, number, "column_name"], [feed, "column_name", "__blk"]
    given = given.select(*key, "num", "txt", "cnt", "__blk").repartition(*[F.col(k) for k in place_key])
    both = given.select(*key, "num", "txt", "__blk", F.explode(sides).alias("__s")).withColumn(number, F.col(number) + F.col("__s.d"))
    merged = both.groupBy(*place_key, number, "num", "txt").agg(F.sum("__s.c").alias("c"), F.sum("__s.p").alias("p"))
    blocks = merged.groupBy(*place_key, number).agg(F.sum("c").alias("bc"), F.sum("p").alias("bp"))
    over, every = Window.partitionBy(*key).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(*place_key, number, F.coalesce(F.sum("bc").over(over), zero).alias("ac"), F.coalesce(F.sum("bp").over(over), zero).alias("ap"), F.sum("bc").over(every).alias("nc"), F.sum("bp").over(every).alias("np"))
    facts = F.map_from_entries(F.collect_list(F.struct(F.col(number), F.struct("ac", "ap", "nc", "np"))))  # the loads of a feed
    by_block = blocks.filter((F.col("nc") > 0) & (F.col("np") > 0)).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(place_key)]).agg(facts.alias("__facts"))
    inside = Window.partitionBy(*place_key, number).orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    run = merged.withColumn("ic", F.sum("c").over(inside)).withColumn("ip", F.sum("p").over(inside))
    run = run.join(by_block, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(place_key)]).withColumn("__f", F.element_at("__facts", F.col(number))).filter(F.col("__f").isNotNull())
    run = run.select(*key, "num", "c", "p", "ic", "ip", "__f.*")
    fc, fp = (F.col("ac") + F.col("ic")) / F.col("nc"), (F.col("ap") + F.col("ip")) / F.col("np")
    cell = F.pow(F.sqrt(F.col("np") / F.col("nc")) * F.col("c") - F.sqrt(F.col("nc") / F.col("np")) * F.col("p"), 2) / (F.col("c") + F.col("p"))
    numeric = F.col("num").isNotNull()
    tenth = F.when(numeric, F.least(F.greatest(F.ceil(fp * 10) - 1, F.lit(0)), F.lit(9)).cast("int"))
    tenths = run.groupBy(*key, tenth.alias("t")).agg(F.max(F.when(numeric, F.abs(fc - fp))).alias("ks"), F.sum(cell).alias("chi2"), F.sum(F.when(numeric, F.col("c"))).alias("c"), F.sum(F.when(numeric, F.col("p"))).alias("p"), F.max("nc").alias("nc"), F.max("np").alias("np"))
    c, p = F.greatest(F.col("c") / F.col("nc"), F.lit(1e-6)), F.greatest(F.col("p") / F.col("np"), F.lit(1e-6))
    return tenths.groupBy(*key).agg(F.max("ks").alias("ks_before"), F.when(F.max("ks").isNotNull(), F.sum((c - p) * F.ln(c / p))).alias("psi_before"), F.sum("chi2").alias("chi2_before"))


def profile(rows: DataFrame, *, load: str, feed: str, number: str, columns: list[str], ranges: dict[str, tuple[float | None, float | None]] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per load and column: the summary, and the change against the load before of the same feed.

    load names one load, which is the load `number` of `feed`; the load before is number - 1. All rows count as they
    stand. Empty input gives no rows; a null load, feed or number is a value like any other, without a load before.
    """
    key = [load, feed, number]
    per_octave = min(1 << 20, math.ceil((rows.count() + 1) / ROWS_A_BLOCK))  # of parquet, from its footers
    counts = value_counts(rows, key, columns).withColumn("ok", usable(ranges or {}))
    own = summary(counts, key, patterns or {})
    change = against_before(counts, feed, number, per_octave).select(F.col(feed).alias("__f2"), F.col(number).alias("__n2"), F.col("column_name").alias("__c2"), "ks_before", "psi_before", "chi2_before")
    line = Window.partitionBy(feed, "column_name").orderBy(number)  # over a feed's loads, not their rows
    out = own.withColumn("null_share", F.col("n_null") / F.col("n_rows"))
    out = out.withColumn("null_share_before", F.when(F.lag(number).over(line) == F.col(number) - 1, F.lag("null_share").over(line)))
    out = out.join(change, (F.col(feed) == F.col("__f2")) & (F.col(number) == F.col("__n2")) & (F.col("column_name") == F.col("__c2")), "left")
    return out.drop("__f2", "__n2", "__c2")


def findings(profiled: DataFrame, *, measured: list[str], named: list[str], null_rise: float, drift: float) -> DataFrame:
    """(profile columns..., finding): range, distinct, nulls and drift of measured columns, pattern of named ones."""
    m, s = F.col("column_name").isin(measured), F.col("column_name").isin(named)
    tests = {
        "range": m & (F.col("n_unusable") > 0), "distinct": m & (F.col("n_usable") >= 2) & (F.col("distinct_usable") == 1),
        "nulls": m & (F.col("null_share") - F.col("null_share_before") > null_rise), "drift": m & (F.col("ks_before") > drift), "pattern": s & (F.col("n_malformed") > 0),
    }
    hits = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))
    return profiled.withColumn("finding", F.explode(hits))


def quantiles(rows: DataFrame, part: list[str], value: str, probs: list[float], out: str = "q", weight: str | None = None) -> DataFrame:
    """(part, out): the values of `value` at each of probs, linear between neighbours, as an array; null without values.

    Exact at any size: values are counted with map-side combine, ranks are found in order-preserving blocks and over
    the blocks, and only the values at the ranks asked for (two for each prob) are gathered. Nulls, NaN and infinities don't
    count. The same as percentile(), which holds all distinct values of a part in one task. weight: a column of whole
    numbers, how often each row counts.
    """
    v = F.col(value).cast("double")
    counts = rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (F.col(weight) > 0 if weight else F.lit(True)))
    counts = counts.groupBy(*part, v.alias("__v")).agg((F.sum(weight) if weight else F.count("*")).alias("__n")).withColumn("__blk", place(F.col("__v"), 256))
    sums = counts.groupBy(*part, "__blk").agg(F.sum("__n").alias("__bn"))
    over, every = Window.partitionBy(*part).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*part)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__bn").over(over), F.lit(0))).withColumn("__all", F.sum("__bn").over(every))
    at = lambda p: F.lit(float(p)) * (F.col("__all") - 1)
    ranks = F.array_distinct(F.array(*[f(at(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    wanted = sums.withColumn("__r", F.filter(ranks, lambda r: (r >= F.col("__base")) & (r < F.col("__base") + F.col("__bn")))).filter(F.size("__r") > 0)
    wanted = wanted.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*part, "__blk"])], "__base", "__all", "__r")
    met = counts.join(wanted, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*part, "__blk"])])
    inside = Window.partitionBy(*part, "__blk").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("__upto", F.col("__base") + F.sum("__n").over(inside))
    hit = met.withColumn("__hit", F.explode(F.filter("__r", lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__n")))))
    found = hit.groupBy(*part).agg(F.map_from_entries(F.collect_list(F.struct("__hit", "__v"))).alias("__m"), F.max("__all").alias("__all"))  # two for each prob
    lo, hi = (lambda p: F.element_at("__m", F.floor(at(p)).cast("long"))), (lambda p: F.element_at("__m", F.ceil(at(p)).cast("long")))
    return found.select(*part, F.array(*[lo(p) + (hi(p) - lo(p)) * (at(p) - F.floor(at(p))) for p in probs]).alias(out))
