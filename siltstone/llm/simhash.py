"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from siltstone.llm.common import components, forget, join_small, mixed, pack, release, skew_join, trim, unpack, written

if TYPE_CHECKING:
    import pandas as pd  # at run time only where it is needed: workers that sketch and compare stay smaller

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles_of(text: str | None, size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; the whole sequence if it is shorter; none if empty.

    A-Z are lower-cased; words are runs of anything but [\\x20\\x09-\\x0D].
    """
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    return [flat[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def fingerprint(shingles: list[bytes]) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64 (seed 42)."""
    import xxhash

    if not shingles:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp BIGINT: the 64 bits as a signed number) of every row, in place."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.fromiter((fingerprint(shingles_of(t.as_py(), shingle)) for t in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def planes_of(x: np.ndarray) -> np.ndarray:
    """Bit planes stored vertically: row k holds bit k of every word, 64 words a uint64."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")


def within(planes, radius: int, shape: tuple[int, ...]) -> np.ndarray:
    """Lanes, packed 64 a word, with at most ``radius`` ones over the given difference planes.

    Counts are kept vertically as binary digits of carry-save counters, biased so that the top digit overflows just
    beyond the radius; overflow sticks. The block is abandoned as soon as every lane has overflowed.
    """
    digits = max(1, int(radius).bit_length())
    bias = (1 << digits) - 1 - radius
    count = [np.full(shape, ONES if bias >> d & 1 else 0, np.uint64) for d in range(digits)]
    over = np.zeros(shape, np.uint64)
    for k, carry in enumerate(planes):
        for d in range(digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if k % 8 == 7 and (over == ONES).all():
            break
    return ~over


def lanes(mask: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(mask).view(np.uint8).reshape(*mask.shape[:-1], -1), axis=-1, bitorder="little")[..., :n].astype(bool)


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """For equally long x and y: which pairs differ in at most ``radius`` bits."""
    if not len(x):
        return np.zeros(0, bool)
    p = planes_of(x ^ y)
    return lanes(within(p, radius, p[0].shape), len(x))


def close_matrix(a: np.ndarray, planes: np.ndarray, n: int, radius: int) -> np.ndarray:
    """For every word of a, against the n words that ``planes`` holds."""
    flips = ((a[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)) * ONES
    shape = (len(a), planes.shape[1])
    return lanes(within((planes[k][None, :] ^ flips[k][:, None] for k in range(64)), radius, shape), n)


class Forest:
    """Union-find over positions; roots are the smallest positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def link_buckets(bucket: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int, small: int = 8, verify: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, root) of a spanning forest of the links within each bucket; ``bucket`` must be sorted.

    side: 0 or 1 in tiles of two chunks, where only links across count; 2 where all count. ``verify`` is asked about
    pairs within the radius that are not connected yet.
    """
    n = len(bucket)
    forest = Forest(n)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[first, n])
    for off in range(1, small):
        at = first[(sizes > off) & (sizes <= small)]
        if not len(at):
            break
        size = sizes[(sizes > off) & (sizes <= small)] - off
        i = np.repeat(at - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        ok = close_pairs(fp[i], fp[i + off], radius) & ((side[i] == 2) | (side[i] != side[i + off]))
        for p in i[ok].tolist():
            if verify is None or forest.root(p) != forest.root(p + off) and verify(p, p + off):
                forest.join(p, p + off)
    for f, s in zip(first[sizes > small].tolist(), sizes[sizes > small].tolist()):
        mixed = side[f] != 2
        right = f + np.flatnonzero(side[f : f + s] == 1) if mixed else np.arange(f, f + s)
        left = f + np.flatnonzero(side[f : f + s] == 0) if mixed else right
        if not len(left) or not len(right):
            continue
        planes = planes_of(fp[right])
        rows = max(1, (1 << 18) // planes.shape[1])
        for a in range(0, len(left), rows):
            hit = close_matrix(fp[left[a : a + rows]], planes, len(right), radius)
            for p, row in zip(left[a : a + rows].tolist(), hit):
                for q in right[np.flatnonzero(row)].tolist():
                    if verify is None or forest.root(p) != forest.root(q) and verify(p, q):
                        forest.join(p, q)
    root = np.fromiter((forest.root(i) for i in range(n)), np.int64, n)
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def tables_for(radius: int, blocks: int) -> list[list[int]]:
    """Bit masks: the words are cut into ``blocks`` blocks, and any two words within the radius agree on the bits of
    one mask at least, since at most ``radius`` blocks hold a difference."""
    cut = [64 * k // blocks for k in range(blocks + 1)]
    part = [sum(1 << b for b in range(cut[k], cut[k + 1])) for k in range(blocks)]
    return [sum(part[k] for k in c) for c in combinations(range(blocks), blocks - radius)]


def tiles_of(keyed: DataFrame, tile: int) -> DataFrame:
    """keyed (node, fp, bucket) -> (node, fp, tile BIGINT, side): buckets of two rows or more, the large ones in tiles.

    A bucket of over ``tile`` rows is dealt into chunks by hash, and each pair of its chunks is a tile.
    """
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = skew_join(keyed, sizes, ["bucket"]).withColumn("chunks", F.ceil(F.col("n") / tile))
    held = held.withColumn("c", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")))
    held = held.select("node", "fp", "bucket", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("o"))
    return held.select("node", "fp", F.xxhash64("bucket", F.least("c", "o"), F.greatest("c", "o")).alias("tile"), F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1).cast("byte").alias("side"))


def link_classes(reps: DataFrame, radius: int, blocks: int | None = None, tile: int | None = None) -> DataFrame:
    """reps (node BIGINT, fp BIGINT, one row a fingerprint) -> (node, root) of nodes linked within ``radius`` bits.

    Candidates share the bits of one of C(blocks, radius) masks, so no link is missed. A bucket over ``tile`` rows is
    cut into chunks by a hash, and every pair of its chunks becomes a task's tile; only a spanning forest leaves a
    tile. ``blocks`` grows with the number of fingerprints so that chance meetings stay few; ``tile`` follows the mean
    load of a partition. Neither changes the result.
    """
    spark = reps.sparkSession
    total = reps.count()
    if blocks is None:
        blocks = radius + 2
        while blocks < 2 * radius + 2 and 2.0 ** (64 * (blocks - radius) / blocks) < 4.0 * total:
            blocks += 1
    masks = tables_for(radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = reps.select("node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "k")).select("node", "fp", F.xxhash64("t", "k").alias("bucket"))
    if tile is None:
        tile = min(65536, max(256, len(masks) * total // int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    tiled = tiles_of(keyed, tile)

    return components(tiled.repartition("tile").sortWithinPartitions("tile").mapInArrow(tile_linker(radius, None), "u long, v long"))


def similar(a: bytes, b: bytes, least: float) -> bool:
    """Whether the Jaccard similarity of two sets, each a sorted array of 64-bit hashes, reaches ``least``; two empty sets are equal."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same >= least * (len(x) + len(y) - same) - 1e-9


def tile_linker(radius: int, similarity: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within tiles, for rows sorted by tile.

    With a similarity, rows also have the sizes and parity bits of their sets, and what comes out are pairs that may be
    similar by these: a spanning forest of each tile, so at most one pair a row.
    """

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        node, fp, key, side = cols[:4]
        if similarity is None:
            i, j = link_buckets(key, side, fp.view(np.uint64), radius)
        else:
            size, bits, pairs = *cols[4:], []

            def may(p: int, q: int) -> bool:
                low, high = sorted((int(size[p]), int(size[q])))
                ok = low >= similarity * high - 1e-9 and int(np.bitwise_count(bits[p] ^ bits[q]).sum()) <= (1 - similarity) / (1 + similarity) * (low + high) + 1e-9
                if ok:
                    pairs.append((p, q))
                return ok

            link_buckets(key, side, fp.view(np.uint64), radius, verify=may)
            i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["u", "v"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            if not part.num_rows:
                continue
            cols = [part.column(c).to_numpy(zero_copy_only=False) for c in ["node", "fp", "tile", "side"] + ["size"] * (similarity is not None)]
            if similarity is not None:
                cols.append(part.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, 8))
            held.append(cols)
            size += part.nbytes
            if size >= 4 << 20:  # all tiles but the last are complete
                cols = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(cols[2], cols[2][-1]))
                if cut:
                    yield links([c[:cut] for c in cols])
                held, size = [[c[cut:] for c in cols]], 0
        if held:
            yield links([np.concatenate(c) for c in zip(*held)])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, blocks: int | None = None, tile: int | None = None) -> DataFrame:
    """(id, fp BIGINT, fingerprint STRING, component BIGINT: the smallest id reachable by links) of every row.

    Two fingerprints link at ``radius`` or fewer differing bits. Equal fingerprints are one node, so groups of copies
    never meet in a task; see ``link_classes`` for the rest.

    Null and empty texts have fingerprint zero and link like any other. A row with a null id gets the component of
    its fingerprint, null if no row with that fingerprint has an id. Repeated rows come back as often as they are
    given. Ids are integers.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle).withColumn(id_col, F.col(id_col).cast("long")), "fp")
    reps = written(fps.groupBy("fp").agg(F.min(id_col).alias("node")), "rep")
    roots = link_classes(reps.where("node is not null"), radius, blocks, tile)
    named = reps.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    out = skew_join(fps, named, ["fp"])
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The different shingles' XXH64 (seed 42), sorted."""
    import xxhash

    sh = shingles_of(text, size)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in sh), np.uint64, len(sh)))


def simhash_of_set(h: np.ndarray) -> int:
    if not len(h):
        return 0
    bits = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<i8")[0])


def prefix_of(own: np.ndarray, similarity: float, hot: np.ndarray | None = None) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of a sorted set; members of ``hot`` (sorted) come last.

    Under one order for all sets, two whose Jaccard similarity reaches ``similarity`` have a member of both prefixes in
    common.
    """
    n = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
    if hot is not None and len(hot):
        last = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
        own = np.concatenate([own[~last], own[last]])
    return own[:n]


def parity(own: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the set's members that fall on it: those of two sets differ in at most as many bits as the sets do in members."""
    return np.packbits(np.bincount((own & np.uint64(511)).astype(np.int64), minlength=512) & 1, bitorder="little").view("<u8")


def pair_finder(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (u, v, least) within tiles that are in different components and may be similar by their sizes and parity bits; rows sorted by tile.

    ``least`` is how many members the prefixes of a similar pair of these sizes share at the least: of the prefix that
    ends first in the common order, at most as many as its set may lack in the other set are not in the other prefix.
    """
    lengths = lambda n: n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1

    def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        node, comp, size, bits, tile, side = cols
        cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])
        us, vs, least = [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for i in range(a, b):
                j = np.arange(i + 1, b) if side[i] == 2 else a + np.flatnonzero(side[a:b] == 1) if side[i] == 0 else np.zeros(0, np.int64)
                j = j[(comp[j] != comp[i]) & (np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-9)]
                if len(j):
                    j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(1) <= (1 - similarity) / (1 + similarity) * (size[j] + size[i]) + 1e-9]
                    us.append(np.minimum(node[j], node[i]))
                    vs.append(np.maximum(node[j], node[i]))
                    same = np.ceil(similarity / (1 + similarity) * (size[j] + size[i]) - 1e-9).astype(np.int64)
                    least.append(np.maximum(1, np.minimum(lengths(size[j]) - size[j], lengths(size[i]) - size[i]) + same))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, least)], names=["u", "v", "least"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for part in parts:
            if not part.num_rows:
                continue
            cols = [part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "size", "tile", "side")]
            cols.insert(3, part.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, 8))
            held = [np.concatenate(c) for c in zip(held, cols)] if held else cols
            cut = int(np.searchsorted(held[4], held[4][-1]))
            if cut >= 4096:  # all tiles but the last are complete
                yield from pairs([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held:
            yield from pairs(held)

    return run


class Members:
    """A chunk's members of prefixes, sorted by group and member: the different ones with the components of their nodes."""

    def __init__(self, raw: bytes, groups: int):
        m = unpack(raw)
        self.key, self.at = m["key"], m["at"]
        self.node, self.comp = m["node"].view(np.int64), m["comp"].view(np.int64)
        self.first = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(self.key) else np.zeros(0, np.int64)
        self.count = np.diff(np.r_[self.first, len(self.key)])
        self.own = self.key[self.first]
        self.cuts = np.searchsorted(group_of(self.own, groups), np.arange(groups + 1))

    @staticmethod
    def of(node: np.ndarray, comp: np.ndarray, sizes: np.ndarray, key: np.ndarray, groups: int) -> bytes:
        order = np.lexsort((key, group_of(key, groups)))
        return pack(key=key[order], at=np.repeat(np.arange(len(node)), sizes)[order], node=node.view(np.float64), comp=comp.view(np.float64))

    def asks(self) -> Iterator[tuple[int, bytes]]:
        """For each group its members here, each with the number of nodes, the component of one, and whether there are others."""
        if not len(self.key):
            return
        names, comp = np.unique(self.comp, return_inverse=True)
        comp = comp[self.at]
        low, high = np.minimum.reduceat(comp, self.first), np.maximum.reduceat(comp, self.first)
        for g in np.flatnonzero(np.diff(self.cuts)).tolist():
            a, b = self.cuts[g], self.cuts[g + 1]
            used, at = np.unique(low[a:b], return_inverse=True)
            yield g, pack(key=self.own[a:b], comp=names[used].view(np.float64), at=at, several=(low[a:b] != high[a:b]).astype(np.int64), n=self.count[a:b])

    def shared(self, answers: dict[int, bytes]) -> pd.DataFrame:
        """The nodes of the members that the groups found in several components."""
        import pandas as pd

        spread, often = np.zeros(len(self.own), bool), np.zeros(len(self.own), bool)
        for g, blob in answers.items():
            a, b = self.cuts[g], self.cuts[g + 1]
            m = unpack(blob)
            spread[a:b], often[a:b] = (np.unpackbits(m[x].astype(np.uint8), count=b - a) for x in ("spread", "often"))
        keep = np.repeat(spread, self.count)
        at = self.at[keep]
        return pd.DataFrame({"node": self.node[at], "comp": self.comp[at], "bucket": self.key[keep].view(np.int64), "often": np.repeat(often, self.count)[keep]})


def group_of(key: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(key) % np.uint64(groups)).astype(np.int64)


def group_answers(g: int, chunks: list[int], blobs: list[bytes], hot: int) -> pd.DataFrame:
    """To each chunk, which of its members have nodes in several components, and over ``hot`` nodes besides; the latter members with their nodes."""
    import pandas as pd

    parts = [unpack(b) for b in blobs]
    key, at = np.unique(np.concatenate([m["key"] for m in parts]), return_inverse=True)
    comp = np.concatenate([m["comp"].view(np.int64)[m["at"]] for m in parts])
    low, high = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), np.iinfo(np.int64).min)
    np.minimum.at(low, at, comp)
    np.maximum.at(high, at, comp)
    spread = (low != high) | (np.bincount(at, np.concatenate([m["several"] for m in parts]), len(key)) > 0)
    n = np.bincount(at, np.concatenate([m["n"] for m in parts]), len(key)).astype(np.int64)
    often = spread & (n > hot)
    rows, a = [], 0
    for chunk, m in zip(chunks, parts):
        own = at[a : a + len(m["key"])]
        rows.append((chunk, g, pack(spread=np.packbits(spread[own]), often=np.packbits(often[own])), None, None))
        a += len(own)
    rows += [(None, g, None, k, x) for k, x in zip(key[often].view(np.int64).tolist(), n[often].tolist())]
    return pd.DataFrame(rows, columns=["chunk", "g", "blob", "bucket", "n"]).astype({"chunk": "Int64", "bucket": "Int64", "n": "Int64"})


def shared_members(prefixes: DataFrame, hot: int, chunk_members: int = 1 << 20, group_members: int = 1 << 19) -> tuple[DataFrame, DataFrame]:
    """prefixes (node, comp, prefix) -> written (node, comp, bucket, often), the members of prefixes that nodes of several components have; (bucket, n) of those over ``hot`` nodes.

    Most members are in one prefix only, so members do not travel as rows: a chunk sends each group its different
    members once, sorted and packed, however many of its nodes have them, and is told with a bit each which are shared.
    """
    total = prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    groups = max(8, -(-total // group_members))

    def chunk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 24

        def blob() -> pa.RecordBatch:
            node, comp, sizes, key = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([Members.of(node, comp, sizes, key.view(np.uint64), groups)], pa.binary())], names=["chunk", "blob"])

        for part in parts:
            for a in range(0, part.num_rows, 256):
                some = part.slice(a, 256)
                held.append((some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2).value_lengths().to_numpy(), some.column(2).flatten().to_numpy()))
                size += len(held[-1][3])
                if size >= chunk_members:
                    yield blob()
                    held, size, number = [], 0, number + 1
                    trim()
        if held:
            yield blob()
        del held
        trim()

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number, raw in zip(part.column(0).to_pylist(), part.column(1)):
                for g, blob in Members(raw.as_py(), groups).asks():
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([g], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "g", "blob"])

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        return group_answers(int(rows["g"].iloc[0]), rows["chunk"].tolist(), rows["blob"].tolist(), hot)

    def take(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return Members(own["blob"].iloc[0], groups).shared(dict(zip(found["g"].tolist(), found["blob"])))

    chunks = written(prefixes.mapInArrow(chunk, "chunk long, blob binary"), "prefixes")
    answers = written(chunks.mapInArrow(ask, "chunk long, g long, blob binary").groupBy("g").applyInPandas(judge, "chunk long, g long, blob binary, bucket long, n long"), "answers")
    told = answers.where("chunk is not null").select("chunk", "g", "blob")
    shared = written(chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(take, "node long, comp long, bucket long, often boolean"), "shared")
    often = written(answers.where("bucket is not null").select("bucket", "n"), "often")
    forget(chunks), forget(answers)
    return shared, often


def parity_of(own: np.ndarray) -> bytes:
    """As ``parity``, of four to eight bits a member (512 at least): two of different lengths compare once the longer is folded."""
    n = max(512, 1 << (4 * len(own)).bit_length())
    return np.packbits(np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1, bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, x: int, y: int, least: float) -> bool:
    """Whether sets of sizes x and y with these ``parity_of`` can have a Jaccard similarity of ``least``; never false if they have."""
    if min(x, y) < least * max(x, y) - 1e-9:
        return False
    short, long = (np.frombuffer(z, "<u8") for z in sorted((a, b), key=len))
    return int(np.bitwise_count(short ^ np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)).sum()) <= (1 - least) / (1 + least) * (x + y) + 1e-9


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, pass_bytes: int | None = None) -> DataFrame:
    """The written pairs (u, v) whose whole sets are similar, written; texts (id, text).

    First the pairs' parity bits meet, which are a tenth of the sets or less and leave few pairs that are not similar; the
    sets of these pairs only are taken from the texts and meet. Both is done in passes of about ``pass_bytes`` of what the
    pairs hold of it (512 bytes for each text, 256 MB at least), so the disk does not grow with the number of pairs.
    """
    if pass_bytes is None:
        pass_bytes = max(256 << 20, 512 * texts.count())
    small = lambda parts: (batch.slice(a, 256) for batch in parts for a in range(0, batch.num_rows, 256))
    asked = lambda some: some.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("times"))

    def parities(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(parts):
            own = [shingle_set(t.as_py(), shingle) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, own), pa.int64()), pa.array(map(parity_of, own), pa.binary())], names=["node", "size", "data"])

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(parts):
            own = [shingle_set(t.as_py(), shingle) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, own), pa.int64()), pa.array((x.tobytes() for x in own), pa.binary())], names=["node", "size", "data"])

    def tested(test: Callable[[bytes, bytes, int, int], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                ok = [test(a.as_py(), b.as_py(), x, y) for a, b, x, y in zip(part.column(4), part.column(5), part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield part.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

        return run

    def held(nodes: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str) -> DataFrame:
        return written(join_small(texts, nodes, "id", "node", "inner", 2_000_000).select("node", "text").mapInArrow(make, "node long, size long, data binary"), name)

    def meet(some: DataFrame, data: DataFrame, test: Callable[[bytes, bytes, int, int], bool], name: str) -> DataFrame:
        left = skew_join(some.withColumnRenamed("u", "node"), data, ["node"]).select(F.col("node").alias("u"), "v", F.col("size").alias("x"), F.col("data").alias("a"))
        both = skew_join(left.withColumnRenamed("v", "node"), data, ["node"]).select("u", F.col("node").alias("v"), "x", F.col("size").alias("y"), "a", F.col("data").alias("b"))
        return written(both.mapInArrow(tested(test), "u long, v long").distinct(), name)

    def in_passes(some: DataFrame, total: int | None) -> Iterator[DataFrame]:
        passes = max(1, -(-int(total or 0) // pass_bytes))
        return (some if passes == 1 else some.where(F.pmod(F.xxhash64("u", "v", F.lit(29)), F.lit(passes)) == k) for k in range(passes))

    def joined(parts: list[DataFrame], name: str) -> DataFrame:
        if len(parts) == 1:
            return parts[0]
        out = written(reduce(DataFrame.unionByName, parts), name)
        for part in parts:
            forget(part)
        return out

    nodes = written(asked(pairs), "asked")
    bits = held(nodes, parities, "parities")
    total = lambda of, width: of.join(bits.select(F.col("node").alias("id"), width.alias("w")), F.col("node") == F.col("id")).agg(F.sum(F.col("times") * F.col("w"))).first()[0]
    may = joined([meet(some, bits, lambda a, b, x, y: may_be_similar(a, b, x, y, similarity), "may") for some in in_passes(pairs, total(nodes, F.length("data") + 32))], "may")
    forget(nodes)
    nodes = written(asked(may), "asked")
    most = total(nodes, F.col("size") * 8 + 32)
    forget(bits), forget(nodes)
    if not most:
        return may
    links = []
    for some in in_passes(may, most):
        nodes = written(asked(some).select("node"), "asked")
        whole = held(nodes, sets, "sets")
        links.append(meet(some, whole, lambda a, b, x, y: similar(a, b, similarity), "links"))
        forget(nodes), forget(whole)
    forget(may)
    return joined(links, "links")


def candidates(shared: DataFrame, reps: DataFrame, similarity: float, tile: int, pass_rows: int) -> DataFrame:
    """Written (u, v): pairs with enough shared members that sizes and parity bits allow.

    Members are met in passes, by hash, of about ``pass_rows`` rows of ``shared``, and only the pairs' counts stay from a
    pass, so the disk for meeting does not grow with the table.
    """
    passes, parts = max(1, -(-shared.count() // pass_rows)), []
    for k in range(passes):
        mine = shared.where(F.pmod(F.xxhash64("bucket", F.lit(23)), F.lit(passes)) == k)
        held = tiles_of(mine.select("node", F.col("comp").alias("fp"), "bucket"), tile).withColumnRenamed("fp", "comp")
        held = skew_join(held, reps.select("node", "size", "bits"), ["node"])
        pairs = held.select("node", "comp", "size", "bits", "tile", "side").repartition("tile").sortWithinPartitions("tile").mapInArrow(pair_finder(similarity), "u long, v long, least long")
        parts.append(written(pairs.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("least").alias("least")), "met"))
        release(reps.sparkSession)
    met = reduce(DataFrame.unionByName, parts).groupBy("u", "v").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    pairs = written(met.where("n >= least").select("u", "v"), "pairs")
    for part in parts:
        forget(part)
    return pairs


def rest_links(reps: DataFrame, texts: DataFrame, shingle: int, similarity: float, tile: int, hot: int, most_hot: int = 1_000_000, pass_rows: int = 4_000_000) -> DataFrame | None:
    """(u, v): all links between nodes of different components, found by exact prefixes; None if there are none.

    reps (node, comp, size, prefix, bits), written, and deleted here; texts (id, text). Similar sets share a member of their prefixes, so only nodes
    of a shingle whose nodes are of several components can be missing a link. Where over ``hot`` nodes have such a
    shingle in their prefix, it is put last in the order (at most ``most_hot`` shingles, the most frequent ones; this
    moves work, and loses nothing), and those nodes' prefixes are taken again. Pairs that sizes, parity bits
    and the number of members that both prefixes have allow are verified on whole sets.
    """
    shared, often = shared_members(reps.select("node", "comp", "prefix"), hot)
    if often.count():
        touched = written(shared.where("often").select("node", "comp").distinct(), "touched")
        best = often.orderBy(F.col("n").desc(), "bucket").limit(most_hot).select("bucket")
        top = np.fromiter((r.bucket for r in best.toLocalIterator()), np.int64)
        last = reps.sparkSession.sparkContext.broadcast(np.sort(top.view(np.uint64)))

        def again(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                got = [prefix_of(shingle_set(t.as_py(), shingle), similarity, last.value).view(np.int64) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.list_(pa.int64()))], names=["node", "comp", "prefix"])

        new = join_small(texts, touched, "id", "node", "inner", 2_000_000).select("node", "comp", "text").mapInArrow(again, "node long, comp long, prefix array<long>")
        rest = join_small(reps.select("node", "comp", "prefix"), touched.select(F.col("node").alias("gone")), "node", "gone", "left_anti", 2_000_000).drop("gone")
        now = written(rest.unionByName(new), "prefix")
        forget(shared), forget(often)
        shared, often = shared_members(now, hot)
        forget(now), forget(touched)
    pairs = candidates(shared, reps, similarity, tile, pass_rows)
    forget(reps), forget(shared), forget(often)
    if not pairs.count():
        return None
    links = verified(pairs, texts, shingle, similarity)
    forget(pairs)
    return links


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 20, bands: int = 10, rows: int = 3, tile: int = 2048, hot: int = 1024) -> DataFrame:
    """(id, component: the smallest id reachable by links) for every id: groups of texts whose shingle sets are similar.

    Two texts link if the Jaccard similarity of their sets of word shingles is at least ``similarity``; no link is lost.

    First most links are found by SimHash. At 0.8 the fingerprints of these sets (repeats do not count) differ in about
    ten bits, too many for blocks of equal bits, so the blocks for the bit-sliced comparison are texts that agree on
    ``rows`` minima of ``bands`` times as many hash functions. Within a block, a spanning forest of the pairs within
    ``radius`` bits that sizes and parity bits allow is taken; these are verified on their whole shingle sets, which
    meet nowhere else: a text's set does not go to every block that it is in. This misses few pairs, and leaves most
    groups whole.

    Then ``rest_links`` finds every link that is missing between the groups so far, by exact prefixes of the sets.

    Texts with equal sets are one class and never meet in a task. Blocks over ``tile`` texts are cut into tiles of
    two chunks. Only texts in pairs that may be similar are read again for their sets.

    Null and empty texts are equal to each other. Rows with a null id are left out; rows that repeat an id are one
    document, whose groups are those of all its texts. Texts are read whole, however long. An empty table gives no
    rows. Other columns are not looked at, whatever their names.
    """
    import xxhash

    rng = np.random.default_rng(41)
    mul, add = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(a, 512) for batch in parts for a in range(0, batch.num_rows, 512)):
            fps, same, keys, sizes, prefixes, bits = [], [], [], [], [], []
            for t in part.column(1):
                own = shingle_set(t.as_py(), shingle)
                fps.append(simhash_of_set(own))
                same.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
                low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for a in range(0, len(own), 4096):
                    low = np.minimum(low, (own[None, a : a + 4096] * mul[:, None] + add[:, None]).min(axis=1))
                keys.append([xxhash.xxh64_intdigest(low[b * rows : (b + 1) * rows].tobytes(), b) - (1 << 63) for b in range(bands)] if len(own) else [])
                sizes.append(len(own))
                prefixes.append(prefix_of(own, similarity).view(np.int64))
                bits.append(parity(own).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64()), pa.array(same, pa.int64()), pa.array(keys, longs), pa.array(sizes, pa.int64()), pa.array(prefixes, longs), pa.array(bits, longs)], names=["id", "fp", "same", "keys", "size", "prefix", "bits"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = written(texts.mapInArrow(sketch, "id long, fp long, same long, keys array<long>, size long, prefix array<long>, bits array<long>"), "sketch")
    ids = written(sketches.select("id", "same"), "ids")
    first = sketches.groupBy("same").agg(F.min(F.struct("id", "fp", "keys", "size", "bits")).alias("x"))
    classes = written(first.select("same", F.col("x.id").alias("node"), "x.fp", "x.keys", "x.size", "x.bits"), "classes")
    tiled = tiles_of(classes.select("node", "fp", F.explode("keys").alias("bucket")), tile)
    held = skew_join(tiled, classes.select("node", "size", "bits"), ["node"]).select("node", "fp", "tile", "side", "size", "bits")
    near = held.repartition("tile").sortWithinPartitions("tile").mapInArrow(tile_linker(radius, similarity), "u long, v long")
    near = written(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near")
    edges = verified(near, texts, shingle, similarity)
    copies = skew_join(ids, classes.select("same", "node"), ["same"]).select(F.col("id").alias("u"), F.col("node").alias("v")).where("u <> v")
    roots = written(components(edges.unionByName(copies)), "roots")
    named = skew_join(classes.select("node", "same"), roots, ["node"], "left").select("node", F.col("same").alias("class"), F.coalesce("root", "node").alias("comp"))
    named = written(named, "named")  # prefixes stay where they were written
    once = sketches if ids.distinct().count() == ids.count() else sketches.dropDuplicates(["id", "same"])
    reps = written(join_small(once, named, "id", "node", "inner", 2_000_000).where(F.col("same") == F.col("class")).select("node", "comp", "size", "prefix", "bits"), "reps")
    forget(sketches), forget(classes), forget(named), forget(near), forget(edges)
    release(docs.sparkSession)
    links = rest_links(reps, texts, shingle, similarity, tile, hot)
    if links is not None:
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))
    ids = ids.select("id").distinct()
    return ids.join(roots, ids["id"] == roots["node"], "left").select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("component"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of ``near_copies``; rows with a null id stay.

    The ids to drop are written and counted first: up to two million are broadcast, so that the texts stay in place.
    """
    gone = written(near_copies(docs, id_col, text_col, **how).where(F.col("component") != F.col(id_col)).select(F.col(id_col).alias("__gone")), "gone")
    return join_small(docs, gone, id_col, "__gone", "left_anti", 2_000_000)
