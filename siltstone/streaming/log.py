"""A log of events in a shared folder: streams publish to topics in numbered batches, readers follow with offsets of their own.

A batch is a folder of Parquet files, ``<log>/<topic>/<writer>/<number>``, and counts once its record
``<log>/_commits/<topic>/<writer>/<number>.json`` is there. Writers do not wait for each other; a batch that is written
again after a crash replaces what it had written before, and one that is recorded is not written again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

DIGITS = 12


@dataclass(frozen=True)
class Topic:
    """What of a batch goes to a topic: rows for which ``where`` holds (all, if None).

    ``most`` is how many rows of a ``key`` it takes from one batch, the first by ``order``; the rest is dropped and counted,
    as with a subscriber whose queue is full. Ties of ``order`` are broken by the rows' other columns.
    """

    where: str | Column | None = None
    key: str | None = None
    order: str | None = None
    most: int | None = None

    def rows(self, batch: DataFrame) -> DataFrame:
        return batch if self.where is None else batch.where(self.where)

    def admitted(self, batch: DataFrame) -> DataFrame:
        rows = self.rows(batch)
        if self.most is None:
            return rows
        rest = [F.xxhash64(*rows.columns)] if self.order is None else [F.col(self.order), F.xxhash64(*rows.columns)]
        w = Window.partitionBy(*([self.key] if self.key else [F.lit(0)])).orderBy(*rest)
        return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= self.most).drop("__n")


class Log:
    """The folder of a log, by a path or address that driver and executors share."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.fs, self.root = pfs.FileSystem.from_uri(self.path)
        self.root = self.root.rstrip("/")

    def _record(self, topic: str, writer: str, number: int) -> str:
        return f"{self.root}/_commits/{topic}/{writer}/{number:0{DIGITS}}.json"

    def names(self, folder: str) -> list[str]:
        return sorted(f.base_name for f in self.fs.get_file_info(pfs.FileSelector(f"{self.root}/{folder}", allow_not_found=True)))

    def is_recorded(self, topic: str, writer: str, number: int) -> bool:
        return self.fs.get_file_info(self._record(topic, writer, number)).type == pfs.FileType.File

    def put(self, at: str, content: dict) -> None:
        """A small file that is there whole or not at all."""
        self.fs.create_dir(at.rpartition("/")[0])
        with self.fs.open_output_stream(f"{at}.new") as out:
            out.write(json.dumps(content).encode())
        self.fs.move(f"{at}.new", at)

    def get(self, at: str) -> dict:
        with self.fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def record(self, topic: str, writer: str, number: int, **more: object) -> None:
        """Makes a written batch count, with the files that it has."""
        folder = f"{topic}/{writer}/{number:0{DIGITS}}"
        files = [n for n in self.names(folder) if n.endswith(".parquet")]
        self.put(self._record(topic, writer, number), {"files": files, **more})

    def numbers(self, topic: str) -> dict[str, list[int]]:
        """writer -> the numbers of its batches that are recorded and not expired."""
        return {w: [int(n[:DIGITS]) for n in self.names(f"_commits/{topic}/{w}") if n.endswith(".json")] for w in self.names(f"_commits/{topic}")}

    def batches(self, topic: str, after: Mapping[str, int] = {}, upto: Mapping[str, int] | None = None) -> Iterator[tuple[str, int, dict]]:
        """(writer, number, record) of batches past ``after`` and up to ``upto``, by writer and number."""
        for writer, numbers in self.numbers(topic).items():
            for n in numbers:
                if after.get(writer, -1) < n and (upto is None or n <= upto.get(writer, -1)):
                    yield writer, n, self.get(self._record(topic, writer, n))

    def expire(self, topic: str, seconds: float, now: float | None = None, readers: tuple[str, ...] = ()) -> int:
        """Deletes batches recorded more than ``seconds`` ago and returns how many; those that one of ``readers`` has not
        committed yet stay. The record goes first: a reader never sees a batch without its files."""
        limit = (time.time() if now is None else now) - seconds
        done = [self.get(at) if self.fs.get_file_info(at).type == pfs.FileType.File else {} for at in (f"{self.root}/_readers/{topic}/{r}.json" for r in readers)]
        gone = 0
        for writer, n, record in list(self.batches(topic)):
            if record["at"] < limit and all(d.get(writer, -1) >= n for d in done):
                self.fs.delete_file(self._record(topic, writer, n))
                self.fs.delete_dir(f"{self.root}/{topic}/{writer}/{n:0{DIGITS}}")
                gone += 1
        return gone


def publish_batch(batch: DataFrame, number: int, path: str, writer: str, topics: Mapping[str, Topic], clock: Callable[[], float] = time.time) -> None:
    """Writes one numbered batch to its topics; those that have recorded it already are left alone.

    The batch is read once a topic, so it should be cheap to read again or persisted by the caller. An empty batch is
    recorded with no rows. ``dropped`` in the record counts the rows that a full queue did not take.
    """
    log = Log(path)
    for name, topic in topics.items():
        if log.is_recorded(name, writer, number):
            continue
        at = f"{path.rstrip('/')}/{name}/{writer}/{number:0{DIGITS}}"
        topic.admitted(batch).write.mode("overwrite").parquet(at)
        dropped = topic.rows(batch).count() - batch.sparkSession.read.schema(batch.schema).parquet(at).count() if topic.most is not None else 0
        log.record(name, writer, number, at=clock(), dropped=dropped)


def publish_to(stream: DataFrame, path: str, writer: str, topics: Mapping[str, Topic], checkpoint: str):
    """A stream's writer (``.start()`` it) that fans every batch out to ``topics`` of the log, each row of it once.

    ``writer`` names this query: no other query may have the same name in one log, and with another checkpoint it needs
    another name, as batches are known by their numbers.
    """
    if "/" in writer or any("/" in t or t.startswith("_") for t in topics):
        raise ValueError("names of writers and topics have no slash, and those of topics no leading underscore")

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist() if len(topics) > 1 else batch
        try:
            publish_batch(batch, number, path, writer, topics)
        finally:
            if len(topics) > 1:
                batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


@dataclass
class Files(InputPartition):
    address: str
    names: tuple[str, ...]
    writer: str
    number: int


def arrow_rows(part: Files, schema) -> Iterator[pa.RecordBatch]:
    """A batch's rows with the writer and number after them; columns that a file lacks are null."""
    fs, root = pfs.FileSystem.from_uri(part.address)
    own = pa.schema(list(to_arrow_schema(schema))[:-2])
    for name in part.names:
        with fs.open_input_file(f"{root}/{name}") as f:
            source = pq.ParquetFile(f)
            there = set(source.schema_arrow.names)
            for rows in source.iter_batches(columns=[c for c in own.names if c in there]):
                cols = [rows.column(c.name).cast(c.type) if c.name in there else pa.nulls(rows.num_rows, c.type) for c in own]
                ends = [pa.array([part.writer] * rows.num_rows, pa.string()), pa.array([part.number] * rows.num_rows, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *ends], names=schema.names)


class TopicReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.log, self.topic = schema, options["path"], options["topic"]

    def files(self, after: Mapping[str, int], upto: Mapping[str, int] | None) -> list[Files]:
        log = Log(self.log)
        return [Files(f"{log.path}/{self.topic}/{w}/{n:0{DIGITS}}", (f,), w, n) for w, n, record in log.batches(self.topic, after, upto) for f in record["files"]]

    def partitions(self) -> list[Files]:
        return self.files({}, None) or [Files(self.log, (), "", -1)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return arrow_rows(partition, self.schema)


class TopicStream(DataSourceStreamReader):
    """Offsets are the number of the last batch of each writer, so writers come and go without the readers' doing."""

    def __init__(self, schema, options):
        self.batch = TopicReader(schema, options)
        self.start, self.name = options.get("from", "earliest"), options.get("reader")

    def latestOffset(self) -> dict:
        return {w: n[-1] for w, n in Log(self.batch.log).numbers(self.batch.topic).items() if n}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.start == "latest" else {}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.batch.files(start, end)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return arrow_rows(partition, self.batch.schema)

    def commit(self, end: dict) -> None:
        if self.name:
            log = Log(self.batch.log)
            log.put(f"{log.root}/_readers/{self.batch.topic}/{self.name}.json", end)


class TopicSource(DataSource):
    """``spark.read`` or ``spark.readStream`` with ``format("topic")``, a schema, the log's path and ``topic``.

    The schema is what was published and ends with ``writer`` string and ``batch`` long. A stream starts with all that is
    there (``from`` = ``latest``: with what comes). ``reader`` gives it a name under which its progress is kept for
    ``Log.expire``. A topic that is not there yet has no rows; of batches that have expired, a reader gets nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "topic"

    def reader(self, schema) -> TopicReader:
        return TopicReader(schema, self.options)

    def streamReader(self, schema) -> TopicStream:
        return TopicStream(schema, self.options)


def topic_schema(schema: str) -> str:
    return f"{schema}, writer string, batch long"


def follow(spark: SparkSession, path: str, topic: str, schema: str, reader: str | None = None, start: str = "earliest") -> DataFrame:
    """The stream of a topic, by a reader with its own offsets."""
    spark.dataSource.register(TopicSource)
    source = spark.readStream.format("topic").schema(topic_schema(schema)).option("topic", topic).option("from", start)
    return (source.option("reader", reader) if reader else source).load(path)


def topic(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """All rows that a topic has now."""
    spark.dataSource.register(TopicSource)
    return spark.read.format("topic").schema(topic_schema(schema)).option("topic", name).load(path)
