"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastglass.sources.tables import cut

#: Rate tables of up to this many rows are broadcast; larger ones are joined like any table.
BROADCAST_ROWS = 10_000


def distinct_texts(sized: DataFrame) -> DataFrame:
    """One row (source, doc_id, n_tokens, __h) for each different text of a source.

    sized: (doc_id, source, text_key, n_tokens), text_key a digest of the whole text. A text that is there several
    times counts and is used as one, under its least doc_id; texts without tokens and documents without source are
    left out, as no share can be met with them. One aggregation with map-side combine; texts are not shuffled.
    """
    given = sized.filter((F.col("n_tokens") > 0) & F.col("source").isNotNull())
    rows = given.groupBy("source", "text_key").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    return rows.withColumnRenamed("text_key", "__h")


def rates(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, tokens, texts, reach_share, rate): how often to use a source's texts.

    Target shares are taken relative to the sum over the sources of the mix that have texts. Without total_tokens the
    size of a mix is the greatest at which each of these sources has its share within max_repeats. With it, sources
    that can't reach their share at that size are used max_repeats times and the others share the rest in proportion
    (the level at which the sum of min(cap, share * level) is the size; if all are at their cap, the size falls
    short). reach_share is the share that the rates come to. Repeated target rows add up, with the least max_repeats;
    a null, NaN or negative share is 0; a null max_repeats is 1. Windows are over the sources of one mix.
    """
    per = texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts")).withColumnRenamed("source", "__src")
    share = F.col("target_share").cast("double")
    t = targets.groupBy("mix_name", "source").agg(F.sum(F.when((share > 0) & ~F.isnan(share), share).otherwise(0.0)).alias("target_share"), F.greatest(F.lit(0), F.min(F.coalesce("max_repeats", F.lit(1)))).alias("max_repeats"))
    t = t.join(per, F.col("source") == F.col("__src"), "left").drop("__src").fillna(0, ["tokens", "texts"])
    mix = Window.partitionBy("mix_name")
    live = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    t = t.withColumn("__w", F.when(live, F.col("target_share"))).withColumn("__w", F.col("__w") / F.sum("__w").over(mix)).withColumn("__cap", F.when(live, F.col("max_repeats") * F.col("tokens")))
    t = t.withColumn("__r", F.col("__cap") / F.col("__w"))
    if total_tokens is None:
        t = t.withColumn("__level", F.min("__r").over(mix))
    else:
        line = mix.orderBy(F.col("__r").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        full = F.coalesce(F.sum("__cap").over(line), F.lit(0.0)) - F.coalesce("__cap", F.lit(0.0))
        rest = F.sum("__w").over(mix) - F.coalesce(F.sum("__w").over(line), F.lit(0.0)) + F.coalesce("__w", F.lit(0.0))
        t = t.withColumn("__l", F.when(F.col("__w").isNotNull() & (rest > 1e-12), (F.lit(float(total_tokens)) - full) / rest))
        t = t.withColumn("__level", F.coalesce(F.max(F.when(F.col("__l") <= F.col("__r"), F.col("__l"))).over(mix), F.max("__r").over(mix)))
    size = F.least(F.col("__cap").cast("double"), F.col("__w") * F.greatest(F.col("__level"), F.lit(0.0)))
    t = t.withColumn("__size", F.coalesce(size, F.lit(0.0)))
    whole = F.sum("__size").over(mix)
    t = t.withColumn("reach_share", F.when(whole > 0, F.col("__size") / whole).otherwise(0.0)).withColumn("rate", F.when(F.col("tokens") > 0, F.least(F.col("__size") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0))
    return t.select("mix_name", "source", "target_share", "max_repeats", "tokens", "texts", "reach_share", "rate")


def emit(texts: DataFrame, rate_table: DataFrame, seed: int = 7) -> DataFrame:
    """(mix_name, source, doc_id, copy_no, n_tokens): each text floor(rate) times, and once more by a seeded draw.

    The draw of a text depends on the seed, the mix and the text alone, so it is the same on any cluster; its
    probability is the rate's fraction. No text is used more than max_repeats times.
    """
    r = cut(rate_table.filter("rate > 0").select("mix_name", F.col("source").alias("__src"), "rate"))
    if r.count() <= BROADCAST_ROWS:
        r = F.broadcast(r)
    draw = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "__h"), F.lit(1 << 53)) / float(1 << 53)
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    rows = texts.join(r, F.col("source") == F.col("__src")).withColumn("__n", copies).filter("__n > 0")
    return rows.select("mix_name", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy_no"), "n_tokens")


def report(emitted: DataFrame, rate_table: DataFrame) -> DataFrame:
    """One row per mix and source: target, reachable and actual share, tokens and copies; zeros for sources not met."""
    got = emitted.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("copies"))
    got = got.select(F.col("mix_name").alias("__m"), F.col("source").alias("__s"), "mixed_tokens", "copies")
    rows = rate_table.join(got, F.col("mix_name").eqNullSafe(F.col("__m")) & (F.col("source") == F.col("__s")), "left").drop("__m", "__s").fillna(0, ["mixed_tokens", "copies"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy("mix_name"))
    return rows.withColumn("actual_share", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0))
