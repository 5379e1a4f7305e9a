"""State on streams: out of order, in several files, stopped and restarted, equal to the batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import events as E, state as K

SCHEMA = "k string, ts timestamp, id long, status string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    start = dt.datetime(2024, 3, 1)
    out = [(rng.choice("abcde"), start + dt.timedelta(seconds=rng.randrange(0, 3000) // 5 * 5), i, rng.choice(("running", "running", "running", "queued", "failed"))) for i in range(300)]
    return out + [(None, start, 900, "running"), ("a", None, 901, "running")]


def played(spark, tmp_path, rows, operator, files=6, restart=3, late="3600 seconds"):
    """Writes the rows in files, some of them out of order, and runs the stream over the first ``restart``, then again from its checkpoint over all."""
    rng = random.Random(files)
    mixed = rng.sample(rows, len(rows))
    end = [(None, dt.datetime(2024, 5, 1), None, None)]
    parts = [mixed[i::files] for i in range(files)] + [end]
    stream = lambda: operator(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), late)

    def run():
        stream().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i == restart:
            run()
    run()
    return spark.read.parquet(f"{tmp_path}/out")


def clean(spark, rows):
    return spark.createDataFrame([r for r in rows if r[0] and r[1]], SCHEMA)


def test_history(spark, tmp_path, rows):
    out = played(spark, tmp_path, rows, lambda s, late: K.stream_history(s, "k", "ts", "id", 7, late))
    got = {r.k: r.ids for r in out.groupBy("k").agg(F.max_by("ids", "seen").alias("ids")).collect()}
    want = {}
    for r in E.history(clean(spark, rows), "k", [F.desc("ts"), F.desc("id")], 7).orderBy(F.desc("ts"), F.desc("id")).collect():
        want.setdefault(r.k, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert out.groupBy("k").agg(F.max("seen").alias("n")).agg(F.sum("n")).first()[0] == 300


def test_beats(spark, tmp_path, rows):
    some = [r for r in rows if r[2] % 5 == 0]
    out = played(spark, tmp_path, some, lambda s, late: K.stream_beats(s, "k", "ts", 60, late, most=5))
    want = K.beats(clean(spark, some), "k", "ts", 60, "2024-04-30").where("beat <= 5")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def test_until_terminal(spark, tmp_path, rows):
    out = played(spark, tmp_path, rows, lambda s, late: K.stream_until_terminal(s, "k", "ts", "status", "id", late=late))
    want = E.until_terminal(clean(spark, rows), "k", "ts", "status")
    assert sorted((r.k, r.id) for r in out.collect()) == sorted((r.k, r.id) for r in want.collect())


def test_sliding_log(spark, tmp_path, rows):
    out = played(spark, tmp_path, rows, lambda s, late: K.stream_sliding_log(s, "k", "ts", "id", 90, 3, late))
    want = E.sliding_log(clean(spark, rows), "k", "ts", 90, 3)
    assert sorted((r.k, r.id, r.hits, r.rejected) for r in out.collect()) == sorted((r.k, r.id, r.hits, r.rejected) for r in want.collect())


def test_idle_keys_are_forgotten(spark, tmp_path):
    at = dt.datetime(2024, 3, 1)
    rows = [("a", at, 1, "x"), ("b", at + dt.timedelta(hours=2), 2, "x"), ("a", at + dt.timedelta(hours=9), 3, "x"), ("a", at + dt.timedelta(hours=9, seconds=5), 4, "x")]
    stream = lambda: K.stream_history(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "k", "ts", "id", 9, "0 seconds", idle=3600)
    for row in [*rows, (None, dt.datetime(2024, 5, 1), None, None)]:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.k, r.seen, r.ids) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1, [1]), ("a", 1, [3]), ("a", 2, [4, 3]), ("b", 1, [2])]


def test_timers_end_where_the_query_does(spark):
    """A close a year after the last row sent a year of beats for each key, of which all but some days were thrown away."""
    rows = spark.sql("select 'a' as k, timestamp '2024-01-01 00:00:00' as ts union all select 'b', timestamp '2024-01-05 12:00:00'")
    got = K.to_the_end(rows, "ts", lambda s: K.stream_beats(s, "k", "ts", 86400), until="2024-01-10")
    assert sorted((r.k, r.beat) for r in got.collect()) == [("a", n) for n in range(1, 9)] + [("b", n) for n in range(1, 5)]
