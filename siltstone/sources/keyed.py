"""Tables laid out for lookups by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_keyed(df: DataFrame, path: str, key: str, files: int | None = None, group_bytes: int = 1 << 20, distinct: int = 1 << 20) -> None:
    """A Parquet table in ranges of the key: sorted, in small row groups that carry least and greatest key and a Bloom filter.

    A lookup then opens the footers and decodes the row groups whose range and filter admit the key: one, as a rule.
    ``distinct`` is the number of different keys that a row group's filter is sized for. Null keys come first.
    """
    ranged = df.repartitionByRange(key) if files is None else df.repartitionByRange(files, key)
    out = ranged.sortWithinPartitions(key).write.mode("overwrite")
    named = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(distinct), "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": str(group_bytes)}
    out.options(**named).parquet(path)


def lookup(spark: SparkSession, path: str, key: str, *values: object) -> DataFrame:
    """The rows of the given keys; a null key matches nothing."""
    return spark.read.parquet(path).where(F.col(key).isin(*[x for x in values if x is not None]))


def lookup_all(spark: SparkSession, path: str, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is in ``wanted`` (a column of the key's name), each once: for keys in bulk."""
    return spark.read.parquet(path).join(wanted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
