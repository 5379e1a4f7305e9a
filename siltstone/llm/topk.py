"""Exact top-k search among binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm.common import written


def sign_code(vector: Column, bits: int = 64) -> Column:
    """Bit i is 1 if component i is above zero; nulls, NaN and missing components give 0."""
    x = lambda i: F.get(vector, F.lit(i))
    parts = [F.when((x(i) > 0) & ~F.isnan(x(i)), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits)]
    while len(parts) > 1:
        parts = [parts[i].bitwiseOR(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


@lru_cache(None)
def flips(width: int, weight: int) -> np.ndarray:
    """All masks of ``width`` bits with ``weight`` ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), weight)], np.int64)


class SegmentIndex:
    """Codes cut into segments, each segment hashed exactly: positions sorted by segment value with offsets."""

    def __init__(self, codes: np.ndarray, segments: int = 0, bits: int = 64):
        self.codes, self.bits = codes, bits
        width = min(16, max(4, int(np.log2(max(len(codes), 2))))) if not segments else bits // segments
        self.cuts = [(a, min(a + width, bits)) for a in range(0, bits, width)]
        self.index = []
        for a, b in self.cuts:
            v = ((codes >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
            self.index.append((np.argsort(v, kind="stable"), np.r_[0, np.cumsum(np.bincount(v, minlength=1 << (b - a)))]))

    def search(self, code: int, weight: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, distances) that hold the ``need`` nearest rows, ties included; ``weight``: rows of each code.

        Segment radii grow by one at a time. Once all segments are searched to radius r, every code within
        segments * (r + 1) - 1 bits has been found by the pigeonhole principle; the search ends when the verified
        distance of row number ``need`` lies within that, or every value of the segments has been probed.
        """
        m = len(self.cuts)
        seen = np.zeros(len(self.codes), bool)
        hits, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in range(max(b - a for a, b in self.cuts) + 1):
            new = []
            for (a, b), (order, offset) in zip(self.cuts, self.index):
                if r > b - a:
                    continue
                value = (code >> a) & ((1 << (b - a)) - 1)
                probe = value ^ flips(b - a, r)
                lo, size = offset[probe], offset[probe + 1] - offset[probe]
                lo, size = lo[size > 0], size[size > 0]
                if len(lo):
                    new.append(order[np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())])
            if new:
                new = np.unique(np.concatenate(new))
                new = new[~seen[new]]
                seen[new] = True
                hits.append(new)
                dist.append(np.bitwise_count(self.codes[new] ^ np.uint64(code)).astype(np.int64))
            covered = m * (r + 1) - 1
            d = np.concatenate(dist)
            per = np.bincount(d, np.concatenate([weight[h] for h in hits]), minlength=self.bits + 1)
            if per[: covered + 1].sum() >= need:
                break
        at = np.concatenate(hits)
        last = int(np.searchsorted(np.cumsum(per), need)) if per.sum() >= need else self.bits
        return at[d <= last], d[d <= last]


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", code_col: str = "code", block: int = 1 << 20, least: int = 4096) -> DataFrame:
    """(query_id, rank INT from 1, neighbor_id, distance INT): for every query the k rows nearest in Hamming distance.

    Ties go to the smaller id; a query is not its own neighbour. ``rows`` and ``queries`` have an integer id and a
    BIGINT code; other columns are not looked at, whatever their names. Equal codes are one entry, which keeps its
    k + 1 smallest ids: more can never be among the k.

    Entries are dealt by hash into blocks of at most about ``block`` codes (and at least ``least``, so that small tables use
    several tasks). A block is one partition: its codes come first and are indexed once, then the queries stream
    past in Arrow batches and leave k rows each. Only queries are sent to every block; results merge by query.

    Rows with a null id or code take no part, on either side; a row or query repeated with the same id and code counts
    once, and an id with several codes is a row for each; a table with fewer than k other rows gives what there is,
    an empty one nothing.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).alias("code")).where("id is not null and code is not null").distinct()
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).alias("code")).where("id is not null and code is not null").distinct()
    salted = Window.partitionBy("code", "salt").orderBy("id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    entries = written(few.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")), "codes")
    total = entries.count()
    blocks = max(1, -(-total // block), min(32, total // least))
    held = entries.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("b"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "code", "ids")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("kind"), "id", "code", F.array().cast("array<long>").alias("ids"))

    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, owners, index = [], [], None
        for part in parts:
            first = int(np.searchsorted(part.column("kind").to_numpy(), 1))
            if first:
                codes.append(part.column("code").slice(0, first).to_numpy())
                owners += part.column("ids").slice(0, first).to_pylist()
            if first == part.num_rows or not codes:
                continue
            if index is None:
                index = SegmentIndex(np.concatenate(codes).view(np.uint64))
                weight = np.fromiter(map(len, owners), np.int64, len(owners))
            out = []
            for q, code in zip(part.column("id").to_pylist()[first:], part.column("code").to_numpy()[first:].view(np.uint64).tolist()):
                at, d = index.search(code, weight, k + 1)
                out += [(q, i, x) for x, i in sorted((int(x), i) for p, x in zip(at, d) for i in owners[p] if i != q)[:k]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["query_id", "neighbor_id", "distance"])

    tiles = held.unionByName(sent).repartitionById(blocks, F.col("b")).sortWithinPartitions("kind")
    found = tiles.mapInArrow(answer, "query_id long, neighbor_id long, distance int")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
