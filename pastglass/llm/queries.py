"""Queries of the text problems."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.llm.content import fitted, rated_sample, scorer, source_rates
from pastglass.llm.encoding import decode, encode, token_count
from pastglass.llm.mixing import distinct_texts, emit, rates, report
from pastglass.sources.tables import cut, shared_dir, table

#: Scores from which on a document is flagged; the fit sets its bias so.
THRESHOLD = 0.5


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return table(spark, folder, "documents").select("doc_id", encode(spark, F.col("text")).alias("ids"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the ids of every document decode to its text."""
    docs = table(spark, folder, "documents").select("doc_id", "text", encode(spark, F.col("text")).alias("ids"))
    return docs.select("doc_id", (decode(spark, F.col("ids")) == F.coalesce("text", F.lit(""))).alias("same"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Different texts by source with their sizes; the tokens are counted once and persisted, without the texts."""
    docs = table(spark, folder, "documents").filter(F.col("text").isNotNull())
    return cut(distinct_texts(docs.select("doc_id", "source", F.sha2("text", 256).alias("text_key"), token_count(spark, F.col("text")).alias("n_tokens"))))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every mix of mix_target, one row for each use of a text."""
    texts = _texts(spark, folder)
    return emit(texts, rates(texts, table(spark, folder, "mix_target")))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target, reachable and actual share of every source of every mix."""
    texts = _texts(spark, folder)
    rate_table = cut(rates(texts, table(spark, folder, "mix_target")))
    return report(emit(texts, rate_table), rate_table)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score by a classifier fitted on the rated sample, once for each folder and its ratings."""
    docs = table(spark, folder, "documents")
    kept_at = f"{shared_dir(spark)}/pastglass-{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
    model = fitted(rated_sample(docs, table(spark, folder, "doc_label")), kept_at)
    return docs.select("doc_id", "source", scorer(spark, model, F.col("text")).alias("score"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return scored(spark, folder).filter(F.col("score") >= THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score."""
    return scored(spark, folder)


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of flagged documents of every source."""
    return source_rates(scored(spark, folder), THRESHOLD)


QUERIES = {"p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL = {"p6_roundtrip": "SELECT doc_id, true AS same FROM documents"}
