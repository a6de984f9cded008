"""Table loading and the few places where the engine touches storage or the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table (a file or a folder of part files) of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from spark.checkpoint.dir.

    Only on a local master a folder of this machine is made and set where the session leaves it unset; elsewhere that
    is an error, as executors could not read what others wrote.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='pastglass-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once as a table in the shared folder and read from there: as cut(), for plans that join
    many derived columns, of which the optimizer would else work out every constraint, in exponential time."""
    spark, path, name = df.sparkSession, f"{shared_dir(df.sparkSession)}/pastglass-table-{uuid.uuid4().hex}", "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def head_rows(df: DataFrame, n: int = 1000) -> DataFrame:
    """The first n rows as they come, for a look at a table; which ones is not defined."""
    return df.limit(n)


def read_lookup(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """A frozen lookup table from JSON lines, by schema. Missing keys or a key that occurs twice are errors."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    bad = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"keys must be unique and not null: {bad[0].asDict()}")
    return rows


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header, in as many files as there are partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_verdict(df: DataFrame, path: str) -> dict:
    """The one row of df as a JSON file; more or fewer rows are an error. Returns it."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a verdict is one row")
    df.sparkSession.createDataFrame(rows, df.schema).coalesce(1).write.mode("overwrite").json(path)
    return rows[0].asDict(recursive=True)


def cached(make: Callable[[], DataFrame], spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The table at path if it has that many rows, else what make() gives, written there; a result of another number of
    rows is an error and isn't kept."""
    try:
        old = spark.read.parquet(path)
        if old.count() == rows:
            return old
    except AnalysisException:
        pass
    fresh_path = f"{path}-{uuid.uuid4().hex}"
    make().write.parquet(fresh_path)
    new = spark.read.parquet(fresh_path)
    if (n := new.count()) != rows:
        raise ValueError(f"{n} rows for {rows}")
    new.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """CSV with a header, a byte order mark tolerated, columns by contract.

    The header is read as text first, so a missing required column is an error and not a column of nulls.
    """
    head = spark.read.text(path).limit(1).collect()
    names = [c.strip().strip('"').lstrip("﻿") for c in (head[0][0].split(",") if head else [])]
    missing = [c for c in required or [] if c not in names]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    raw = spark.read.option("header", True).option("enforceSchema", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    kinds = spark.createDataFrame([], schema).schema
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kinds if f.name in raw.columns])


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with as many underscores as keep it apart from the taken ones (case is ignored)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
