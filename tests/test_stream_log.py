"""Topics of a log: fan-out without doubles after a crash, readers with their own offsets, full queues, retention."""

import pytest

from siltstone.streaming import log as L

SCHEMA = "id long, k string, status string"


def drop_files(spark, folder, parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def rows(first, n):
    return [(i, f"k{i % 3}", "failed" if i % 4 == 0 else "running") for i in range(first, first + n)]


TOPICS = {"all": L.Topic(), "failed": L.Topic("status = 'failed'")}


def test_kill_between_write_and_record(spark, tmp_path, monkeypatch):
    log, at = f"{tmp_path}/log", f"{tmp_path}/in"
    drop_files(spark, at, [rows(0, 20), rows(20, 20), rows(40, 20)])
    real, calls = L.Log.record, []

    def crash(self, topic, writer, number, **more):
        calls.append((topic, number))
        if (topic, number) == ("failed", 1) and calls.count(("failed", 1)) == 1:
            raise RuntimeError("killed")
        return real(self, topic, writer, number, **more)

    monkeypatch.setattr(L.Log, "record", crash)
    publisher = lambda: L.publish_to(source(spark, at), log, "a", TOPICS, f"{tmp_path}/cp")
    with pytest.raises(Exception, match="killed"):
        run(publisher())
    seen = L.topic(spark, log, "failed", SCHEMA).count()
    assert seen == 5 and L.topic(spark, log, "all", SCHEMA).count() == 40
    run(publisher())
    assert calls.count(("all", 1)) == 1 and calls.count(("failed", 1)) == 2
    everything = L.topic(spark, log, "all", SCHEMA).collect()
    assert sorted(r.id for r in everything) == list(range(60)) and {r.batch for r in everything} == {0, 1, 2}
    assert sorted(r.id for r in L.topic(spark, log, "failed", SCHEMA).collect()) == list(range(0, 60, 4))


def test_two_writers_one_restarted_reader(spark, tmp_path):
    log = f"{tmp_path}/log"
    read = lambda: run(L.follow(spark, log, "all", SCHEMA, "r").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/rcp"))
    write = lambda w, first: (drop_files(spark, f"{tmp_path}/in-{w}", [rows(first, 10), rows(first + 10, 10)]), run(L.publish_to(source(spark, f"{tmp_path}/in-{w}"), log, w, {"all": L.Topic()}, f"{tmp_path}/cp-{w}")))
    write("a", 0)
    read()
    write("b", 100)
    write("a", 20)
    read()
    read()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.id for r in got) == [*range(40), *range(100, 120)]
    assert {(r.writer, r.batch) for r in got} == {("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)}
    late = L.follow(spark, log, "all", SCHEMA, start="latest").writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/lcp")
    run(late)
    assert spark.table("late").count() == 0


def test_full_queue_and_retention(spark, tmp_path):
    log, df = f"{tmp_path}/log", spark.createDataFrame(rows(0, 30) + [(None, None, None)] * 3, SCHEMA)
    topics = {"few": L.Topic(key="k", order="id", most=4)}
    for n, at in enumerate((100.0, 200.0, 300.0)):
        L.publish_batch(df, n, log, "w", topics, clock=lambda at=at: at)
    L.publish_batch(df.limit(0), 3, log, "w", topics, clock=lambda: 400.0)
    first = [r for r in L.topic(spark, log, "few", SCHEMA).collect() if r.batch == 0]
    assert sorted(r.id for r in first if r.k) == list(range(12)) and sum(r.k is None for r in first) == 3
    assert [record["dropped"] for _, _, record in L.Log(log).batches("few")] == [18, 18, 18, 0]
    L.publish_batch(df, 0, log, "w", topics)
    assert L.topic(spark, log, "few", SCHEMA).count() == 45
    L.Log(log).put(f"{log}/_readers/few/slow.json", {"w": 0})
    assert L.Log(log).expire("few", 100, now=350.0, readers=("slow",)) == 1
    assert L.Log(log).expire("few", 100, now=350.0) == 1
    assert {r.batch for r in L.topic(spark, log, "few", SCHEMA).collect()} == {2}
    assert L.Log(log).expire("few", 100, now=350.0, readers=("new",)) == 0
    assert L.topic(spark, log, "nothing", SCHEMA).count() == 0


def test_names_are_checked(spark, tmp_path):
    for writer, topic in (("a/b", "t"), ("a", "t/u"), ("a", "_commits")):
        with pytest.raises(ValueError):
            L.publish_to(spark.readStream.format("rate").load(), str(tmp_path), writer, {topic: L.Topic()}, "")
