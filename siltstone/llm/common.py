"""What the operators of this subpackage share: written tables, key helpers, packed arrays, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.checkpoints import forget, fresh_path, shared_dir, written  # noqa: F401  used by the operators

#: White space of every contract here: [\x20\x09-\x0D]. ``bytes.split()`` splits at exactly these six.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so once their plans are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Gives memory that a worker process has freed back to the system: workers stay for later tasks, and allocators keep what they had at their peak."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as compressed bytes: word numbers as differences, which are small where they are sorted, other integers
    in the smallest type that holds them, and all by planes of equally significant bytes."""
    import zstandard

    planes = lambda x: np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""

    head, body = [], []
    for name, x in arrays.items():
        if x.dtype == np.uint64:
            head.append(f"{name}:w:{len(x)}")
            body.append(planes(np.diff(x, prepend=np.uint64(0))))
            continue
        if x.dtype.kind in "iu":
            top = int(x.max()) if len(x) else 0
            x = x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<i8")
        head.append(f"{name}:{x.dtype.str}:{len(x)}")
        body.append(planes(x))
    line = ",".join(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(line).to_bytes(4, "little") + line + b"".join(body))


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    """What was packed; integers as 64 bits."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = 4 + int.from_bytes(raw[:4], "little")
    out, at = {}, n
    for part in raw[4:n].decode().split(","):
        name, kind, size = part.split(":")
        size, real = int(size), np.dtype("<u8" if kind == "w" else kind)
        x = np.frombuffer(raw, np.uint8, size * real.itemsize, at).reshape(real.itemsize, size)
        at += x.size
        x = np.ascontiguousarray(x.T).reshape(-1).view(real)
        out[name] = np.cumsum(x, dtype=np.uint64) if kind == "w" else x.astype(np.int64) if real.kind in "iu" else x
    return out


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def skew_join(left: DataFrame, right: DataFrame, on: Iterable[str], how: str = "inner") -> DataFrame:
    """An equi-join on BIGINT columns whose hot keys adaptive execution may split.

    A side that comes out of an aggregation by the same keys is partitioned already, and Spark splits skewed
    partitions only where both sides are exchanged for the join. Joining on the bitwise complement, computed on
    both sides, makes Spark exchange both; the result is that of a plain join (null keys match nothing).
    """
    on = list(on)
    left = left.withColumns({f"__l{i}": F.bitwise_not(F.col(c)) for i, c in enumerate(on)})
    right = right.withColumns({f"__r{i}": F.bitwise_not(F.col(c)) for i, c in enumerate(on)}).drop(*on)
    cond = [left[f"__l{i}"] == right[f"__r{i}"] for i in range(len(on))]
    return left.join(right, cond, how).drop(*(f"__{s}{i}" for s in "lr" for i in range(len(on))))


def join_small(df: DataFrame, small: DataFrame, left: str, right: str, how: str, most: int) -> DataFrame:
    """A join with a written table that is broadcast only if it has at most ``most`` rows; beyond that, Spark decides."""
    if small.count() <= most:
        small = F.broadcast(small)
    return df.join(small, df[left] == small[right], how)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) BIGINT links -> (node, root): each linked node's smallest reachable node.

    Alternating large-star and small-star steps, in a number of rounds that grows with the logarithm of the longest
    path. Every round is a written table, so a lost executor costs a round at most; nothing but a count and a
    checksum reaches the driver. Self-links and null ends are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u").isNotNull() & F.col("v").isNotNull()).alias("ok"))
    now = written(e.where("ok and u <> v").select("u", "v").distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = skew_join(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        step = written(large, "cc")
        low = step.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(step, low, ["u"]).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        then = written(small, "cc")
        forget(now), forget(step)
        now = then
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
