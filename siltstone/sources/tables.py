"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """The rows dealt to about a partition for every ``rows`` of them, and four for each core at least, for steps that
    cost much a row: a table of few columns is one small file, read by two or three tasks however many cores there are.
    """
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n)


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views for SQL."""
    for name in names or TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
