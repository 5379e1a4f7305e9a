"""Filters, joins, aggregates and top-k as functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.functions.dims import severity_dim, severity_rank, severity_weight


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet every given condition; a missing one is no condition. All reach the scan as one predicate."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def one_of(col: str, values: Iterable | None) -> Column | None:
    values = list(values or ())
    return F.col(col).isin(values) if values else None


def equals(col: str, value) -> Column | None:
    return None if value is None else F.col(col) == F.lit(value)


def minimum(col: str, value: float) -> Column | None:
    """No condition at zero."""
    return F.col(col) >= F.lit(value) if value else None


def same_text(a: Column, b) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b if isinstance(b, Column) else F.lit(b)))


def on_allow_list(value: Column, names: str) -> Column:
    """``names``: comma-separated; case and spaces do not matter, empty entries count for nothing."""
    return F.lower(F.trim(value)).isin([n.strip().lower() for n in names.split(",") if n.strip()])


def search(df: DataFrame, text: str | None, *cols: str) -> DataFrame:
    """Rows where any column contains the text, in any case."""
    if not text:
        return df
    return df.where(reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in cols)))


def truthy(col: Column) -> Column:
    """Neither null nor zero."""
    return col.isNotNull() & (col != 0)


def visible_to(rows: DataFrame, *path: tuple[DataFrame, str, str]) -> DataFrame:
    """Semi-joins up a chain of parents: each (parent, key of the child, key of the parent)."""
    if not path:
        return rows
    (parent, child_key, parent_key), *rest = path
    allowed = visible_to(parent, *rest).select(F.col(parent_key).alias("__key"))
    return rows.join(allowed, rows[child_key] == F.col("__key"), "left_semi")


def latest_per(df: DataFrame, key: str | list[str], *order: Column, top: int = 1) -> DataFrame:
    """The first ``top`` rows of each key in the given order; Spark drops the others before the exchange."""
    window = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= top).drop("__n")


def preferred(df: DataFrame, key: str | list[str], wanted: Column, *order: Column) -> DataFrame:
    """One row of each key: the first in the given order that is ``wanted``, or the first of all if none is."""
    return latest_per(df, key, F.desc(F.coalesce(wanted, F.lit(False))), *order)


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str, fields: list[str]) -> DataFrame:
    """Parents with their children as a sorted array of structs, empty if there are none."""
    kids = children.groupBy(F.col(child_key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = parents.join(kids, parents[key] == kids["__key"], "left").drop("__key")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(kids.schema[name].dataType)))


def severity_counts(df: DataFrame, col: str = "severity") -> DataFrame:
    """A row for every severity, worst first, also those without rows."""
    counts = df.groupBy(F.col(col).alias("severity")).agg(F.count("*").alias("n"))
    return severity_dim(df.sparkSession).join(counts, "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def most_common(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Counts by value, most common first, ties by value."""
    out = df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(col))
    return out.limit(top) if top else out


def rate(hits: Column, base: Column, digits: int = 1) -> Column:
    """100 * hits / base, 0 where there is no base."""
    return F.when(base == 0, F.lit(0.0)).otherwise(F.round(100.0 * hits / base, digits))


def acceptance(df: DataFrame, status: str, accepted: list[str], rejected: list[str], *by: str) -> DataFrame:
    yes, no = F.count_if(F.col(status).isin(accepted)), F.count_if(F.col(status).isin(rejected))
    return df.groupBy(*by).agg(yes.alias("accepted"), (yes + no).alias("decided"), rate(yes, yes + no).alias("acceptance_rate"))


def mean_truthy(col: Column, digits: int = 1) -> Column:
    """The mean over values that are neither null nor zero; 0 if there are none."""
    return F.coalesce(F.round(F.avg(F.when(truthy(col), col)), digits), F.lit(0.0))


def daily_pivot(df: DataFrame, ts: str, kind: str, kinds: list[str], days: int) -> DataFrame:
    """Counts by day and kind for the last ``days`` days of the data, days without rows included, with a total.

    The calendar hangs on the latest day found, so that a run gives the same at any time.
    """
    day = F.to_date(ts)
    counts = df.groupBy(day.alias("day")).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])
    span = counts.agg(F.max("day").alias("last")).select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    out = span.join(counts, "day", "left").select("day", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in kinds])
    return out.withColumn("total", reduce(lambda a, b: a + b, (F.col(k) for k in kinds)))


def riskiest(df: DataFrame, by: str, severity: str, score: Column, top: int = 10) -> DataFrame:
    """Per key: rows, worst severity, summed score to one place; highest score first."""
    total = F.sum(score.cast("decimal(30,6)"))
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.max_by(F.col(severity), severity_rank(F.col(severity))).alias("max_severity"), F.round(total, 1).cast("double").alias("score"))
    return out.orderBy(F.desc("score"), F.asc(by)).limit(top)


def posture(df: DataFrame, severity: str = "severity", penalty: float = 12.0) -> DataFrame:
    """100 less a penalty for each row by its severity's weight, never below 0."""
    weight = F.sum(severity_weight(F.col(severity)).cast("decimal(10,2)"))
    return df.agg(F.greatest(F.lit(0.0), F.round(100 - F.lit(penalty) * F.coalesce(weight, F.lit(0)).cast("double"), 1)).alias("posture"))


def merge_verdict(critical: Column, high: Column) -> Column:
    return F.when(critical > 0, "block").when(high > 0, "changes_requested").otherwise("approve")


def share_of_total(df: DataFrame, col: str, digits: int = 1) -> DataFrame:
    """Counts by value with each one's percentage of all."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(col, "n", F.round(100.0 * F.col("n") / total, digits).alias("percent"))


def top_with_flag(df: DataFrame, top: int, *order: Column) -> DataFrame:
    """The first ``top`` rows, each with whether others were cut."""
    cut = df.limit(top + 1).agg(F.count("*") > top).scalar()
    return df.orderBy(*order).limit(top).withColumn("truncated", cut)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """The rows of a page, counted from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def table_totals(**tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in sorted(tables.items())))


def mode_by(df: DataFrame, by: str, value: str, default: str) -> DataFrame:
    """The most frequent value of each key, the smaller among equals; the default where all are null."""
    counts = df.groupBy(by, value).agg(F.count(value).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v")))
    return counts.where(F.col(value).isNotNull()).groupBy(by).agg(best["v"].alias("mode")).join(df.select(by).distinct(), by, "right").select(by, F.coalesce("mode", F.lit(default)).alias("mode"))


def worst_first(severity: str, *rest: str) -> list[Column]:
    """Order by severity rank, then by the other columns, all descending."""
    return [F.desc(severity_rank(F.col(severity))), *(F.desc(c) for c in rest)]
