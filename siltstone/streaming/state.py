"""State for each key on streams: events put in order, histories, beats in silences, ends and trailing limits, each equal to its batch form."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.checkpoints import fresh_path
from siltstone.streaming.events import TERMINAL

#: What a step gets: what it kept, the rows that are complete now in order, each (microseconds, fields), and the watermark in
#: microseconds; what it gives: what it keeps, rows to send, and when to be called again if no row comes (None: not at all).
Step = Callable[[Any, list[tuple[int, dict]], int], tuple[Any, list[dict], int | None]]


def in_order(stream: DataFrame, key: str, ts: str, fields: list[str], late: str, out: T.StructType | str, step: Step, idle: int | None = None) -> DataFrame:
    """A stream's rows handed to ``step`` for each key in the order of their times, each once, when the watermark has passed them.

    Rows wait in the key's state until no earlier one can come: ``late`` behind the latest time seen. What the step keeps
    is part of the state, so a restart from the checkpoint goes on where the stream stopped. ``fields`` (numbers, strings or booleans) are what the
    step sees of a row. A key that is silent for over ``idle`` seconds is
    forgotten, with what its step kept; None: never.

    Rows with a null time or key are left out; rows that come later than ``late`` are dropped, as Spark does. Equal rows are
    as many rows. The order of equal times is that of the fields, so the result does not depend on files or batches. All rows of a time come
    in one call.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = stream.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    rows = rows.where(F.when(F.col(key).isNotNull(), F.col("__at")).isNotNull())  # names the time, so that it stays above the watermark
    rows = rows.select(F.col(key).alias("__key"), micros.alias("__micros"), F.to_json(F.struct(*fields)).alias("__row"), "__at")
    schema = T._parse_datatype_string(out) if isinstance(out, str) else out
    schema = T.StructType([T.StructField(key, stream.schema[key].dataType), *schema.fields])

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, kept, last, again = json.loads(state.get[0]) if state.exists else ([], None, 0, None)
        if not state.hasTimedOut:
            for part in parts:
                waiting += [list(x) for x in zip(part["__micros"].tolist(), part["__row"])]
        now = state.getCurrentWatermarkMs() * 1000
        ready = sorted(x for x in waiting if x[0] <= now)
        waiting = [x for x in waiting if x[0] > now]
        sent: list[dict] = []
        begin = 0
        for k in range(1, len(ready) + 1):  # a silence over ``idle`` ends what was kept, whether or not a timer came between
            if k == len(ready) or idle is not None and ready[k][0] - ready[k - 1][0] > idle * 1_000_000:
                if idle is not None and ready[begin][0] - last > idle * 1_000_000:
                    kept = None
                kept, more, again = step(kept, [(at, json.loads(row)) for at, row in ready[begin:k]], now)
                sent, last, begin = sent + more, ready[k - 1][0], k
        if not ready and again is not None and again <= now:
            kept, sent, again = step(kept, [], now)
        ends = [min(x[0] for x in waiting)] if waiting else []
        ends += [again] if again is not None else []
        if idle is not None and not waiting:
            ends.append(last + idle * 1_000_000)
            if state.hasTimedOut and not ready and now > last + idle * 1_000_000:
                ends = []
                state.remove()
        if ends or not state.hasTimedOut or idle is None:
            state.update((json.dumps([waiting, kept, last, again]),))
            if ends:
                state.setTimeoutTimestamp(max(-(-min(ends) // 1000), now // 1000 + 1))
        if sent:
            yield pd.DataFrame([{key: name[0], **x} for x in sent], columns=schema.names)

    return rows.groupBy("__key").applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_history(stream: DataFrame, key: str, ts: str, id_col: str, most: int = 200, late: str = "0 seconds", idle: int | None = None) -> DataFrame:
    """(key, seen BIGINT, ids ARRAY newest first): the last ``most`` rows of a key whenever there are new ones; ``seen`` counts all so far.

    The row of a key with the largest ``seen`` is its history now: what a subscriber that comes late is sent.
    """

    def step(kept: list | None, rows: list[tuple[int, dict]], now: int) -> tuple[Any, list[dict], int | None]:
        seen, ids = kept or (0, [])
        seen, ids = seen + len(rows), ([r[id_col] for _, r in rows][::-1] + ids)[:most]
        return (seen, ids), [{"seen": seen, "ids": ids}], None

    return in_order(stream, key, ts, [id_col], late, f"seen long, ids array<{stream.schema[id_col].dataType.simpleString()}>", step, idle)


def stream_beats(stream: DataFrame, key: str, ts: str, silence: int, late: str = "0 seconds", most: int | None = None) -> DataFrame:
    """(key, after TIMESTAMP, beat BIGINT): the first, second, ... ``silence`` seconds in which a key sends nothing, as they pass.

    A timer of the key's state sends them: also after its last row, as other keys move the watermark on. After ``most`` beats
    a key is silent for good, until it sends again.
    """
    span = silence * 1_000_000

    def step(kept: list | None, rows: list[tuple[int, dict]], now: int) -> tuple[Any, list[dict], int | None]:
        after, beat = kept or (None, 0)
        sent = []

        def passed(end: int) -> None:
            nonlocal beat
            while after is not None and after + (beat + 1) * span < end and (most is None or beat < most):
                beat += 1
                sent.append({"after": pd.Timestamp(after, unit="us"), "beat": beat})

        for at, _ in rows:
            passed(at)
            after, beat = at, 0
        passed(now)
        return (after, beat), sent, after + (beat + 1) * span + 1 if most is None or beat < most else None

    return in_order(stream, key, ts, [], late, "after timestamp, beat long", step)


def stream_until_terminal(stream: DataFrame, key: str, ts: str, status: str, id_col: str, terminal: tuple[str, ...] = TERMINAL, late: str = "0 seconds", idle: int | None = None) -> DataFrame:
    """(key, id, status): a key's rows up to and with its first terminal one, and others of that time; later ones are not sent on."""

    def step(end: int | None, rows: list[tuple[int, dict]], now: int) -> tuple[Any, list[dict], int | None]:
        sent = []
        ends = [at for at, r in rows if r.get(status) in terminal]
        end = min([e for e in (end, *ends) if e is not None], default=None)
        for at, r in rows:
            if end is None or at <= end:
                sent.append({id_col: r.get(id_col), status: r.get(status)})
        return end, sent, None

    kinds = T.StructType([stream.schema[id_col], T.StructField(status, T.StringType())])
    return in_order(stream, key, ts, [id_col, status], late, kinds, step, idle)


def stream_sliding_log(stream: DataFrame, key: str, ts: str, id_col: str, seconds: int, limit: int, late: str = "0 seconds") -> DataFrame:
    """(key, id, hits BIGINT, rejected): how many rows a key sent in the ``seconds`` before and at each row's time, rejected ones counted too.

    A key keeps the times of its last ``seconds`` alone and is forgotten after as many of silence.
    """
    span = seconds * 1_000_000

    def step(kept: list | None, rows: list[tuple[int, dict]], now: int) -> tuple[Any, list[dict], int | None]:
        log, sent = deque(kept or []), []
        for at, peers in groupby(rows, key=lambda r: r[0]):
            own = [r for _, r in peers]
            while log and log[0] <= at - span:
                log.popleft()
            log.extend([at] * len(own))
            sent += [{id_col: r[id_col], "hits": len(log), "rejected": len(log) > limit} for r in own]
        return list(log), sent, None

    kinds = T.StructType([stream.schema[id_col], T.StructField("hits", T.LongType()), T.StructField("rejected", T.BooleanType())])
    return in_order(stream, key, ts, [id_col], late, kinds, step, idle=seconds)


def beats(df: DataFrame, key: str, ts: str, silence: int, until: str) -> DataFrame:
    """``stream_beats`` of rows that are all there (batch): with those after a key's last row, up to the time ``until``."""
    from pyspark.sql import Window

    at, end = F.unix_micros(F.col(ts).cast("timestamp")), F.unix_micros(F.lit(until).cast("timestamp"))
    gap = F.coalesce(F.lead(at).over(Window.partitionBy(key).orderBy(at)), end) - at
    n = F.floor((F.col("__gap") - 1) / (silence * 1_000_000)).cast("long")
    return df.withColumn("__gap", gap).where(n > 0).select(key, F.col(ts).cast("timestamp").alias("after"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("beat"))


def to_the_end(df: DataFrame, ts: str, operator: Callable[[DataFrame], DataFrame], per_trigger: int | None = None, until: str | None = None) -> DataFrame:
    """All that a stream operator sends for the rows of a table, played as a stream of files and then closed.

    The table is written to the shared folder by time, and a last row without a key moves the watermark past all others: a year on, or to the time ``until`` if the rows end
    a second before it at the latest, so that timers do not go on beyond.
    """
    spark = df.sparkSession
    rows, out, state = (fresh_path(spark, name) for name in ("stream-rows", "stream-out", "stream-state"))
    df.write.parquet(rows)
    end = F.col(ts) + F.expr("interval 1 year")
    if until is not None:
        at = F.lit(until).cast(df.schema[ts].dataType)
        end = F.when(F.col(ts) < at - F.expr("interval 1 second"), at).otherwise(end)
    close = df.agg(F.max(ts).alias(ts)).withColumn(ts, end).select(*(F.col(ts) if c.name == ts else F.lit(None).cast(c.dataType).alias(c.name) for c in df.schema))
    reader = spark.readStream.schema(df.schema)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader

    def play() -> None:
        sent = operator(reader.parquet(rows))
        sent.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    play()
    close.write.mode("append").parquet(rows)
    play()
    return spark.read.schema(operator(reader.parquet(rows)).schema).parquet(out)
