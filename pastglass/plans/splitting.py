"""Problem 4: train, validation and test splits with all ids of a pitcher in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.operators.splits import grouped_splits, spanning_forest, split_rows
from pastglass.sources.tables import table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def number_of(text: str) -> Column:
    """The number that the digits of a text form; null without digits or beyond 18 of them."""
    return F.regexp_replace(F.translate(text, "０１２３４５６７８９", "0123456789"), "[^0-9]", "").try_cast("bigint")


def pitcher_roots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The spanning forest of pitcher_link and the root of every linked id."""
    links = table(spark, folder, "pitcher_link").select("link_id", number_of("id_a").alias("a"), number_of("id_b").alias("b"))
    return spanning_forest(links, "a", "b", "link_id")


def assignment(spark: SparkSession, folder: str) -> DataFrame:
    """(pitcher_id, root, split) of each pitcher_id of train, sized by its pitches."""
    pitches = table(spark, folder, "train").select("pitcher_id", "asof_pitcher_n").distinct()
    return grouped_splits(pitches.groupBy("pitcher_id").agg(F.count("*").alias("size")), pitcher_roots(spark, folder)[1], "pitcher_id", SHARES)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of pitcher ids of train that are one pitcher: same root of the spanning forest."""
    roots = pitcher_roots(spark, folder)[1]
    ids = table(spark, folder, "train").select("pitcher_id").distinct()
    known = ids.join(roots, F.col("pitcher_id") == F.col("node")).select("pitcher_id", "root")
    lo, hi = known.select(F.col("pitcher_id").alias("pitcher_lo"), "root"), known.select(F.col("pitcher_id").alias("pitcher_hi"), F.col("root").alias("other"))
    return lo.join(hi, (F.col("root") == F.col("other")) & (F.col("pitcher_lo") < F.col("pitcher_hi"))).select("pitcher_lo", "pitcher_hi")


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every pitch with its split."""
    pitches = table(spark, folder, "train").select("pitcher_id", "asof_pitcher_n").distinct()
    return split_rows(pitches, assignment(spark, folder), "pitcher_id", SHARES)


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Pitches and share of each split."""
    n = p4_splits(spark, folder).groupBy("split").agg(F.count("*").alias("pitches"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("pitches").alias("total")))).select("split", "pitches", F.round(F.col("pitches") / F.col("total"), 6).alias("share"))


def p4_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Pitches, pitchers in two splits, linked pitchers in two splits, and whether every share is within one point."""
    given, pitches = assignment(spark, folder), table(spark, folder, "train").select("pitcher_id", "asof_pitcher_n").distinct()
    rows = split_rows(pitches, given, "pitcher_id", SHARES)
    by = rows.groupBy("pitcher_id", "split").agg(F.count("*").alias("n"))
    ids = by.groupBy("pitcher_id").agg(F.count("*").alias("splits"), F.sum("n").alias("n")).agg(F.sum("n").alias("pitches"), F.count(F.when(F.col("splits") > 1, 1)).alias("torn_pitchers"))
    roots = given.groupBy("root").agg(F.count_distinct("split").alias("splits")).agg(F.count(F.when(F.col("splits") > 1, 1)).alias("torn_groups"))
    sums = by.groupBy("split").agg(F.sum("n").alias("n"))
    want = F.create_map(*[x for k, v in SHARES.items() for x in (F.lit(k), F.lit(v))])
    near = sums.crossJoin(F.broadcast(sums.agg(F.sum("n").alias("all")))).agg((F.max(F.abs(F.col("n") / F.col("all") - want[F.col("split")])) < 0.01).alias("shares_near"))  # one row
    return ids.crossJoin(F.broadcast(roots)).crossJoin(F.broadcast(near))  # one row each


SQL = {
    "p4_checks": "SELECT count(*) AS pitches, 0::BIGINT AS torn_pitchers, 0::BIGINT AS torn_groups, true AS shares_near FROM (SELECT DISTINCT pitcher_id, asof_pitcher_n FROM train)",
    "p4_found": """
WITH RECURSIVE n AS (SELECT try_cast(regexp_replace(id_a, '[^0-9]', '', 'g') AS BIGINT) AS a, try_cast(regexp_replace(id_b, '[^0-9]', '', 'g') AS BIGINT) AS b FROM pitcher_link),
e AS (SELECT a, b FROM n WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM n WHERE a IS NOT NULL AND b IS NOT NULL),
reach(s, t) AS (SELECT a, b FROM e UNION SELECT r.s, e.b FROM reach r JOIN e ON e.a = r.t),
ids AS (SELECT DISTINCT pitcher_id FROM train)
SELECT DISTINCT s AS pitcher_lo, t AS pitcher_hi FROM reach WHERE s < t AND s IN (FROM ids) AND t IN (FROM ids)"""
}
QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits, "p4_shares": p4_shares, "p4_checks": p4_checks}
