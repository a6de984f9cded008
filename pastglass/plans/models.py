"""Model tier (survey group L): fitted experts as MLlib analogues, scored as expressions where they are linear.

Rows-only: another library's boosters can't be matched value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.functions.scalars import sigmoid
from pastglass.operators.encode import numeric_prep, standardised
from pastglass.operators.metrics import auc
from pastglass.plans.rowlocal import KEY
from pastglass.plans.trials import trials
from pastglass.sources.tables import cut

COLUMNS = ["balls", "strikes", "outs", "li", "r_succ", "r_prev5", "r_bsucc", "na"]


def _design(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.ml.feature import VectorAssembler

    t = trials(spark, folder)
    known = t.filter("period < 2024 AND y IS NOT NULL")
    prep = numeric_prep(known, COLUMNS)
    put = VectorAssembler(inputCols=[f"{c}_z" for c in COLUMNS], outputCol="x")
    prep = cut(prep)
    # Fitting reads its rows many times: they are written once, narrow, to the shared folder.
    return cut(put.transform(standardised(known, prep, COLUMNS)).select("x", "y", "period")), put.transform(standardised(t.filter("period = 2024"), prep, COLUMNS))


def l6_logistic(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic regression on earlier seasons, scored on 2024 as a sum of weighted columns."""
    from pyspark.ml.classification import LogisticRegression

    train, rows = _design(spark, folder)
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01, maxIter=30).fit(train)
    z = F.lit(float(model.intercept))
    for c, w in zip(COLUMNS, model.coefficients.toArray()):
        z = z + float(w) * F.col(f"{c}_z")
    return rows.select(*KEY, sigmoid(z).alias("p"))


def l1_boosted(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees on earlier seasons with recency weights, scored on 2024."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    train, rows = _design(spark, folder)
    train = train.withColumn("w", F.pow(F.lit(0.8), 2024 - F.col("period")))
    model = GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=8, maxDepth=3, seed=7).fit(train)
    return model.transform(rows).select(*KEY, vector_to_array("probability")[1].alias("p"))


def l4_forest(spark: SparkSession, folder: str) -> DataFrame:
    """A forest on earlier seasons, scored on 2024."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    train, rows = _design(spark, folder)
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=15, maxDepth=5, seed=7).fit(train)
    return model.transform(rows).select(*KEY, vector_to_array("probability")[1].alias("p"))


def k34_domain(spark: SparkSession, folder: str) -> DataFrame:
    """How well 2023 can be told from 2022 and 2024: area under the curve of a classifier of the period."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    t = trials(spark, folder).filter("period >= 2022")
    cols = ["li", "we", "r_prev5", "r_fast", "inning"]
    z = standardised(t, numeric_prep(t, cols), cols).withColumn("is23", (F.col("period") == 2023).cast("int"))
    v = cut(VectorAssembler(inputCols=[f"{c}_z" for c in cols], outputCol="x").transform(z).select("x", "is23"))
    model = LogisticRegression(featuresCol="x", labelCol="is23", maxIter=20).fit(v)
    p = model.transform(v).select(F.lit("2023").alias("period"), F.round(vector_to_array("probability")[1], 6).alias("p"), "is23")
    return auc(p, ["period"], "p", "is23")


SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (l6_logistic, l1_boosted, l4_forest, k34_domain)}
