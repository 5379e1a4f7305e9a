"""WARC archives with revisit records and a two-level capture index."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siltstone.llm.common import forget, fresh_path, written

CAPTURE = "surt string, id long, file string, offset long, length long"
DIRECTORY = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64()), ("part", pa.int32())])
RECORD = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


@dataclass(frozen=True)
class Archive:
    """Where an archive is: the folder of its WARC and index files, and the directory of index blocks (a table)."""

    path: str
    directory: DataFrame


def surt(url: Column) -> Column:
    """The sort key of a url: its host's labels reversed, then the rest; lower-case host, no scheme. Null: ''."""
    part = lambda g: F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#]*)(.*)$", g)
    key = F.concat(F.array_join(F.reverse(F.split(F.lower(part(1)), r"\.")), ","), F.lit(")"), part(2))
    return F.when(F.length(F.coalesce(url, F.lit(""))) > 0, F.regexp_replace(key, r"[\x00-\x20]", "%20")).otherwise("")


class Store:
    """Files of the shared folder by range, some kept open."""

    def __init__(self, most: int = 48):
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.most = most

    @staticmethod
    def at(uri: str) -> tuple[pa.fs.FileSystem, str]:
        import pyarrow.fs

        return pyarrow.fs.FileSystem.from_uri(uri)

    def read(self, uri: str, offset: int, length: int) -> bytes:
        f = self.open.pop(uri, None)
        if f is None:
            fs, path = self.at(uri)
            f = fs.open_input_file(path)
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
        self.open[uri] = f
        f.seek(offset)
        return f.read(length)

    @classmethod
    def create(cls, uri: str) -> pa.NativeFile:
        fs, path = cls.at(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(path, compression=None)


def packed(raw: bytes, level: int = 5) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record_id(number: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(number)) if number is not None else uuid.uuid4()}>"


def record(number: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record that holds the HTTP header lines only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(number)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if number is not None:
        head.append(f"X-Source-Id: {number}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Source-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """The fields of RECORD. A response whose payload does not have the digest of its header is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Source-Id"), fields.get("WARC-Target-URI"), kind, size, digest, number("X-Refers-To-Source-Id"), payload if kind == "response" else None


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, block_lines: int = 1024, part_lines: int = 1_000_000, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Writes a WARC record for every row into the shared folder, and the index of the captures.

    Among equal payloads of at least ``revisit_bytes`` bytes, the row with the largest id is the response and the
    others are revisits of it; smaller payloads are all responses. Null html: an empty payload. A row with a null id
    can only be a revisit of another; rows that repeat the largest id are all responses.

    Level one of the index: capture lines sorted by reversed-host url key, in compressed blocks of ``block_lines``
    lines, and parts of about ``part_lines`` lines. Level two: the directory, one row a block with its first and last
    key and its place. Files carry a unique name for each attempt of a task, and only those named in the written
    tables count, so lost executors do no harm.

    Payloads are compressed and written one at a time, however long they are. An empty table gives an empty archive.
    Other columns are not looked at, whatever their names.

    Only the largest ids of repeated payloads are exchanged to find revisits; html moves at most once, and not at all
    if that table is small enough for Spark to broadcast.
    """
    spark = pages.sparkSession
    out = fresh_path(spark, "warc")
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    targets = base.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.max("id").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null")
    targets = written(targets.select("digest", "target"), "targets")
    ready = base.join(targets.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left").select("id", "url", "payload", "digest", F.expr("case when id is null or id <> target then target end").alias("refers"), surt(F.col("url")).alias("surt"))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{out}/warc/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        sink, offset = None, 0
        for part in parts:
            if not part.num_rows:
                continue
            if sink is None:
                sink = Store.create(name)
                offset += sink.write(packed(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + record_id(None).encode() + b"\r\nWARC-Date: " + date.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
            ids, urls, digests, refers = (part.column(c).to_pylist() for c in ("id", "url", "digest", "refers"))
            lengths, offsets = [], []
            for number, url, payload, digest, to in zip(ids, urls, part.column("payload"), digests, refers):
                raw = packed(record(number, url, payload.as_py(), digest, to, date))
                sink.write(raw)
                offsets.append(offset)
                lengths.append(len(raw))
                offset += len(raw)
            yield pa.RecordBatch.from_arrays([part.column("surt"), part.column("id"), pa.array([name] * len(ids)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["surt", "id", "file", "offset", "length"])
        if sink is not None:
            sink.close()

    captures = written(ready.mapInArrow(write, CAPTURE), "captures")
    forget(targets)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // part_lines))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{out}/index/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.cdx.gz"
        sink, offset, held = None, 0, []

        def block(lines: list[tuple]) -> pa.RecordBatch:
            nonlocal sink, offset
            sink = sink or Store.create(name)
            raw = packed("".join(f"{k} {'-' if i is None else i} {f} {o} {n}\n" for k, i, f, o, n in lines).encode())
            sink.write(raw)
            offset += len(raw)
            return pa.RecordBatch.from_pylist([{"first_key": lines[0][0], "last_key": lines[-1][0], "file": name, "offset": offset - len(raw), "length": len(raw), "lines": len(lines), "part": TaskContext.get().partitionId()}], DIRECTORY)

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("surt", "id", "file", "offset", "length")))
            while len(held) >= block_lines:
                yield block(held[:block_lines])
                held = held[block_lines:]
        if held:
            yield block(held)
        if sink is not None:
            sink.close()

    ranged = captures.repartitionByRange(parts, "surt", "file", "offset").sortWithinPartitions("surt", "file", "offset")
    directory = written(ranged.mapInArrow(index, "first_key string, last_key string, file string, offset long, length long, lines long, part int"), "directory")
    forget(captures)
    return Archive(out, directory)


def lines_of(raw: bytes) -> list[tuple[str, str, int, int]]:
    """(key, file, offset, length) of a compressed index block's lines."""
    out = []
    for x in zlib.decompress(raw, 31).decode().split("\n")[:-1]:
        key, _, file, offset, length = x.rsplit(" ", 4)
        out.append((key, file, int(offset), int(length)))
    return out


def _rows(records: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in records], kind) for c, kind in enumerate(kinds)], names=names)


def read_archive(archive: Archive, payloads: bool = True) -> DataFrame:
    """Every record of the archive, found through its index: directory, block, range of a WARC file."""
    spark = archive.directory.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store()
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                held = []
                for _, f, o, n in sorted(lines_of(store.read(file, offset, length)), key=lambda x: x[1:]):
                    r = parsed(zlib.decompress(store.read(f, o, n), 31))
                    held.append(r if payloads else (*r[:-1], None))
                    if len(held) >= 256:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)

    return archive.directory.repartition(parts, "file", "offset").mapInArrow(read, RECORD)


def lookup_keys(archive: Archive, keys: DataFrame, key_col: str = "key", payloads: bool = True) -> DataFrame:
    """RECORD rows of the captures whose key (see ``surt``) is among those given, each once however often its key is given.

    A key goes to the parts of the index that may hold it, found by binary search among their first and last keys, a
    row a part. One task a part then gets the part's directory rows and its keys in order, finds the blocks of each key
    by binary search, reads a block once, finds the key's lines in it by binary search, and reads the records by range.
    Parts are equally large, so captures of one url, however many, are spread over parts.

    Null keys find nothing; the empty key is that of captures without url. Payloads can be left out of the result.
    """
    return _search(archive, keys.select(F.lit(None).cast("string").alias("q"), F.col(key_col).alias("k")).where("k is not null").distinct(), payloads).drop("query")


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url", payloads: bool = True) -> DataFrame:
    """(query STRING, fields of RECORD): the captures whose key equals that of a url of ``urls``; no row if none does.

    Found as in ``lookup_keys``. Null urls find nothing; repeated urls find the same again.
    """
    return _search(archive, urls.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("q"), surt(F.col(url_col)).alias("k")), payloads)


def _search(archive: Archive, asked: DataFrame, payloads: bool) -> DataFrame:
    schema = T.StructType([T.StructField("query", T.StringType()), *T._parse_datatype_string(RECORD).fields])
    directory = archive.directory
    tops = sorted((r.part, r.low.encode(), r.high.encode()) for r in directory.groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect())
    numbers, lows, highs = [t[0] for t in tops], [t[1] for t in tops], [t[2] for t in tops]  # a row a part of the index

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for n, key in enumerate(batch.column(1).to_pylist()):
                k = key.encode()
                for p in range(bisect_left(highs, k), bisect_right(lows, k)):
                    rows.append(n)
                    parts.append(numbers[p])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=["part", "q", "k"])

    keys = asked.mapInArrow(deal, "part int, q string, k string").select("part", F.lit(1).alias("kind"), "q", "k", *(F.lit(None).cast(t).alias(c) for c, t in (("last", "string"), ("file", "string"), ("offset", "long"), ("length", "long"))))
    blocks = directory.select("part", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("q"), F.col("first_key").alias("k"), F.col("last_key").alias("last"), "file", "offset", "length")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, firsts, lasts, places = Store(), [], [], []
        place, lines, line_keys = None, [], []
        held, queries = [], []

        def out() -> pa.RecordBatch:
            found = _rows(held)
            return pa.RecordBatch.from_arrays([pa.array(queries, pa.string()), *found.columns], names=[f.name for f in schema])

        for batch in batches:
            cols = batch.to_pydict()
            for kind, q, key, last, file, offset, length in zip(*(cols[c] for c in ("kind", "q", "k", "last", "file", "offset", "length"))):
                k = key.encode()
                if kind == 0:  # the part's directory rows come first, in order
                    firsts.append(k)
                    lasts.append(last.encode())
                    places.append((file, offset, length))
                    continue
                for b in range(bisect_left(lasts, k), bisect_right(firsts, k)):
                    if place != places[b]:
                        place = places[b]
                        lines = lines_of(store.read(*place))
                        line_keys = [x[0].encode() for x in lines]
                    for _, f, o, n in lines[bisect_left(line_keys, k) : bisect_right(line_keys, k)]:
                        r = parsed(zlib.decompress(store.read(f, o, n), 31))
                        held.append(r if payloads else (*r[:-1], None))
                        queries.append(q)
                        if len(held) >= 256:
                            yield out()
                            held, queries = [], []
        if held:
            yield out()

    tiles = keys.unionByName(blocks).repartitionById(max(numbers, default=0) + 1, F.col("part")).sortWithinPartitions("kind", "k", "offset")
    return tiles.mapInArrow(find, schema)
