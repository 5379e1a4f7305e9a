"""Event streams: windows, limits, sessions and state, for batch and Structured Streaming input alike where Spark allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

TERMINAL = ("completed", "failed", "cancelled")


def file_stream(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as they appear; ``per_trigger`` bounds a batch (back-pressure)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def tumbling_counts(df: DataFrame, key: str, ts: str, size: str, late: str | None = None) -> DataFrame:
    """(key, start, n) by fixed windows; ``late`` sets a watermark on streams."""
    df = df.withWatermark(ts, late) if late else df
    return df.groupBy(key, F.window(ts, size).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def fixed_window_limit(df: DataFrame, key: str, ts: str, size: str, limit: int, late: str | None = None) -> DataFrame:
    """Windows in which a key went over its limit."""
    return tumbling_counts(df, key, ts, size, late).where(F.col("n") > limit)


def sliding_counts(df: DataFrame, key: str, ts: str, size: str, step: str, late: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, late) if late else df
    return df.groupBy(key, F.window(ts, size, step).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def sessions(df: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, late) if late else df
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding_log(df: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """With hits in the ``seconds`` before and at each event, and whether they are over the limit (batch)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("hits", F.count("*").over(w)).withColumn("rejected", F.col("hits") > limit)


def history(df: DataFrame, key: str, order: list[Column], most: int = 200) -> DataFrame:
    """The last rows of each key (batch)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def heartbeats(df: DataFrame, key: str, ts: str, silence: int) -> DataFrame:
    """(key, after, beats): silences over ``silence`` seconds and how many beats fall into each (batch)."""
    gap = F.unix_micros(F.lead(ts).over(Window.partitionBy(key).orderBy(ts)).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    out = df.select(key, F.col(ts).alias("after"), gap.alias("gap")).where(F.col("gap") > silence * 1_000_000)
    return out.select(key, "after", F.floor((F.col("gap") - 1) / (silence * 1_000_000)).cast("long").alias("beats"))


def until_terminal(df: DataFrame, key: str, ts: str, status: str, terminal=TERMINAL) -> DataFrame:
    """Each key's rows up to and with its first terminal one."""
    w = Window.partitionBy(key)
    end = F.min(F.when(F.col(status).isin(*terminal), F.col(ts))).over(w)
    return df.withColumn("__end", end).where(F.col("__end").isNull() | (F.col(ts) <= F.col("__end"))).drop("__end")


def last_status(df: DataFrame, key: str, ts: str, status: str) -> DataFrame:
    """(key, status, at): the current state of each key; works on streams in update or complete mode."""
    return df.groupBy(key).agg(F.max(F.struct(F.col(ts).alias("at"), F.col(status).alias("status"))).alias("s")).select(key, "s.status", "s.at")


def recovered(jobs: DataFrame, status: str = "status") -> DataFrame:
    """After a crash: queued and running jobs have failed."""
    return jobs.withColumn(status, F.when(F.col(status).isin("queued", "running"), "failed").otherwise(F.col(status)))


def cancelled(jobs: DataFrame, asked: Column, status: str = "status") -> DataFrame:
    return jobs.withColumn(status, F.when(asked & ~F.col(status).isin("completed", "failed"), "cancelled").otherwise(F.col(status)))


def may_start(latest: DataFrame, status: str = "status", force: Column | None = None) -> DataFrame:
    """Whether a new run may start: none is queued or running, or it is forced."""
    force = F.lit(False) if force is None else force
    return latest.withColumn("may_start", force | ~F.coalesce(F.col(status), F.lit("")).isin("queued", "running"))


def once(df: DataFrame, id_col: str, ts: str, late: str) -> DataFrame:
    """Each delivery once, on streams with bounded state."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col]) if df.isStreaming else df.dropDuplicates([id_col])


def elapsed(df: DataFrame, key: str, ts: str) -> DataFrame:
    """With the seconds since the key's row before, to two places."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("elapsed", F.round((micros - F.lag(micros).over(Window.partitionBy(key).orderBy(ts))) / 1_000_000, 2))


def stage_timings(df: DataFrame, key: str, ts: str, stage: str) -> DataFrame:
    """(key, timings MAP): seconds from each stage to the next, summed by stage."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    nxt = F.lead(micros).over(Window.partitionBy(key).orderBy(ts))
    each = df.select(key, stage, ((nxt - micros) / 1_000_000).alias("s")).where("s is not null").groupBy(key, stage).agg(F.round(F.sum("s"), 2).alias("s"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(stage, "s")))).alias("timings"))


def frames(df: DataFrame, kind: str, *fields: str) -> DataFrame:
    """Rows as text frames for a server-sent stream."""
    return df.select(F.concat(F.lit("event: "), F.col(kind), F.lit("\ndata: "), F.to_json(F.struct(*fields)), F.lit("\n\n")).alias("frame"))


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything there is now, into a memory table (for tests and small state)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def publish(rows: DataFrame, path: str, key: str, ts: str = "ts") -> None:
    """Appends events to the log, a folder of Parquet files, with the time of publishing where they have none."""
    now = F.current_timestamp()
    stamped = rows.withColumn(ts, F.coalesce(F.col(ts), now) if ts in rows.columns else now)
    stamped.repartition(key).write.mode("append").parquet(path)


def publish_stream(stream: DataFrame, path: str, checkpoint: str):
    """The same for a stream: a query that appends each batch to the log once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def replay_then_live(spark: SparkSession, path: str, schema: str, key: str | None = None, value: str | None = None, files: int | None = None) -> DataFrame:
    """A stream of the log from its beginning: what was published before, then what comes; of one key, if given.

    ``files`` bounds how many files a batch takes (ST6).
    """
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    out = reader.parquet(path)
    return out if key is None else out.where(F.col(key) == value)
