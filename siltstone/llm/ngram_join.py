"""Exact Jaccard self-join of documents' word n-gram sets by prefix trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.common import components, forget, join_small, mixed, pack, skew_join, unpack, written

if TYPE_CHECKING:
    import pandas as pd

#: Members are counted, for their order alone, in so many counters and sent in so many parts.
COUNTERS, PARTS = 1 << 18, 32


def gram_set(text: bytes | None, size: int) -> np.ndarray:
    """The different runs of ``size`` words as sorted 64-bit numbers; the whole sequence if it is shorter; none without words.

    A-Z are lower-cased; words are runs of anything but [\\x20\\x09-\\x0D]. A run's number mixes the XXH64 of its words in turn.
    """
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    grams = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - size + 1 + k])
    return np.unique(grams)


def rare_part(own: np.ndarray, counters: np.ndarray, percent: int) -> np.ndarray:
    """The n - ceil(percent / 100 * n) + 1 members that come last in the common order: counter descending, then number.

    Of two sets whose intersection is ``percent`` of their union or more, the last members have one in common: each lacks at
    most n - ceil(percent / 100 * n) of its own members in the other, and the order is the same for both.
    """
    n = len(own)
    order = np.lexsort((own, -counters[own % np.uint64(COUNTERS)].astype(np.int64)))
    return own[order[-(n - -(-percent * n // 100) + 1) :]] if n else own


class Tree:
    """The sets' members, each set ascending in one order, in a tree with a node for every run of members that no set leaves or
    enters. ``rank`` holds the members one set after another, ``start`` where each begins and the end of the last."""

    def __init__(self, rank: np.ndarray, start: np.ndarray, size: np.ndarray):
        own = [rank[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
        self.sets = sorted(range(len(own)), key=lambda i: own[i].astype(">u4").tobytes())
        size = size[self.sets]
        self.root = Node(0, 0, np.zeros(0, rank.dtype))
        path = [self.root]
        for place, i in enumerate(self.sets):
            x = own[i]
            if place:
                y = own[self.sets[place - 1]]
                k = min(len(x), len(y))
                differ = np.flatnonzero(x[:k] != y[:k])
                same = int(differ[0]) if len(differ) else k
                last = None
                while path[-1].depth > same:
                    last = path.pop()
                    last.end = place
                if path[-1].depth < same:  # the run of ``last`` is left in its middle
                    middle = Node(same, last.begin, last.run[: same - path[-1].depth])
                    last.run = last.run[same - path[-1].depth :]
                    middle.below, path[-1].below[-1] = [last], middle
                    path.append(middle)
            if len(x) > path[-1].depth:
                node = Node(len(x), place, x[path[-1].depth :])
                path[-1].below.append(node)
                path.append(node)
        for node in path:
            node.end = len(own)
        length = np.fromiter((len(own[i]) for i in self.sets), np.int64, len(own))
        waiting = [self.root] if len(own) else []
        while waiting:
            node = waiting.pop()
            node.least, node.most, node.rest = int(size[node.begin : node.end].min()), int(size[node.begin : node.end].max()), int(length[node.begin : node.end].max()) - node.depth
            waiting += node.below


class Node:
    """A run of members that ends at ``depth``; the sets [begin, end) in the tree's order pass it, with sizes from ``least`` to ``most`` and at
    most ``rest`` members beyond it."""

    __slots__ = ("begin", "below", "depth", "end", "least", "most", "rest", "run")

    def __init__(self, depth: int, begin: int, run: np.ndarray):
        self.depth, self.begin, self.end, self.run, self.below = depth, begin, begin, run, []


def tile_links(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) that join all sets of a tile whose intersection is ``percent`` of their union or more, as a forest.

    side 2: all pairs count; 0 and 1: pairs of one with the other. Sets of one group need no link. The sets of side 1 (or
    2) stand in a tree, members that more sets of the tile have first. All sets that ask (side 0 or 2) go down the tree together,
    and keep what they have in common with the way so far. A set leaves a subtree when the members that it and the
    subtree have left can't make up the overlap any more, when no size there fits, or when all there is in its group.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    asks, held = np.flatnonzero((side != 1) & (size > 0)), np.flatnonzero((side != 0) & (size > 0))
    label = np.unique(group, return_inverse=True)[1]
    if not len(asks) or not len(held):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    own, member, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((own, -often))
    order = order[often[order] > 1]  # the others overlap with nothing
    rank = np.full(len(own), -1, np.int64)
    rank[order] = np.arange(len(order))
    rank = rank[member]
    of, rank = of[rank >= 0], rank[rank >= 0]
    sort = np.lexsort((rank, of))
    of, rank = of[sort], rank[sort]
    start = np.searchsorted(of, np.arange(len(sets) + 1))
    take = lambda which: (np.concatenate([rank[start[i] : start[i + 1]] for i in which]), np.r_[0, np.cumsum(start[which + 1] - start[which])])
    tree = Tree(*take(held), size[held])
    leaf = held[tree.sets]
    n_ranks = len(order) + 1
    ask_rank, ask_start = take(asks)
    keys = np.repeat(np.arange(len(asks)), np.diff(ask_start)) * n_ranks + ask_rank
    by_rank = np.argsort(ask_rank, kind="stable")
    who, rank_at = np.repeat(np.arange(len(asks)), np.diff(ask_start))[by_rank], np.searchsorted(ask_rank[by_rank], np.arange(n_ranks + 1))
    n_asks, us, vs = size[asks], [], []
    waiting = [(tree.root, np.arange(len(asks)), np.zeros(len(asks), np.int64))]
    while waiting:
        node, active, overlap = waiting.pop()
        fits = (100 * np.minimum(n_asks[active], node.most) >= percent * n_asks[active]) & (100 * n_asks[active] >= percent * node.least)
        below = label[leaf[node.begin : node.end]]
        if (below == below[0]).all():
            fits &= label[asks[active]] != below[0]
        active, overlap = active[fits], overlap[fits]
        if len(active) and len(node.run):
            found = np.concatenate([who[rank_at[r] : rank_at[r + 1]] for r in node.run.tolist()])
            overlap = overlap + np.bincount(found, minlength=len(asks))[active]
            left = ask_start[active + 1] - np.searchsorted(keys, active * n_ranks + int(node.run[-1]), "right")
            may = (100 + percent) * (overlap + np.minimum(left, node.rest)) >= percent * (n_asks[active] + node.least)
            active, overlap = active[may], overlap[may]
        if not len(active):
            continue
        ends = node.begin
        while ends < node.end and (ends < node.below[0].begin if node.below else True):  # sets that end here come first
            z = leaf[ends]
            hits = asks[active[(100 + percent) * overlap >= percent * (n_asks[active] + size[z])]]
            groups, first = np.unique(label[hits], return_index=True)
            new = groups != label[z]
            if new.any():
                us.append(hits[first[new]])
                vs.append(np.full(int(new.sum()), z))
                label[np.isin(label, groups[new])] = label[z]
            ends += 1
        waiting += [(b, active, overlap) for b in reversed(node.below)]
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def tile_joiner(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``tile_links`` of each tile, for rows (node, comp, tile, side, grams) sorted by tile: one tile at a time in memory."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_tile(parts):
            node = t["node"].to_numpy()
            sets = [np.frombuffer(x.as_buffer(), "<u8") for c in t["grams"].chunks for x in c]
            i, j = tile_links(sets, t["comp"].to_numpy(), t["side"].to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(node[i], pa.int64()), pa.array(node[j], pa.int64())], names=["u", "v"])

    return run


def member_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many documents have the members that fall on each of COUNTERS counters: COUNTERS numbers, whatever the size of ``docs``."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int64)
        for part in parts:
            for a in range(0, part.num_rows, 64):
                own = [gram_set(t.as_py(), shingle) for t in part.column(0).slice(a, 64)]
                sums += np.bincount((np.concatenate(own) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        if sums.any():
            blobs = [pack(n=x) for x in sums.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def add(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        sums: dict[int, np.ndarray] = {}
        for batch in rows:
            for part, blob in zip(batch["part"], batch["blob"]):
                sums[part] = sums.get(part, 0) + unpack(blob)["n"]
        if sums:
            yield pd.DataFrame({"part": list(sums), "blob": [pack(n=x) for x in sums.values()]})

    out = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
    for r in docs.select("text").mapInArrow(count, "part int, blob binary").repartition("part").mapInPandas(add, "part int, blob binary").collect():
        out[r.part] = unpack(bytes(r.blob))["n"]
    return out.ravel()


def tiles_of(blocks: DataFrame, weight: str, most: int) -> DataFrame:
    """blocks (block, node, ...) -> with (tile BIGINT, side BYTE) for the blocks of two rows or more.

    A block whose ``weight`` sums up to more than ``most`` is dealt into chunks by a hash of the node, and each pair of chunks is a
    tile, so that a task holds two chunks at a time; every pair of a block meets in one tile.
    """
    sizes = blocks.groupBy("block").agg(F.sum(weight).alias("__weight"), F.count("*").alias("__rows")).where("__rows > 1")
    held = skew_join(blocks, sizes, ["block"]).withColumn("chunks", F.ceil((F.col("__weight") + 1) / most)).drop("__weight", "__rows")
    held = held.withColumn("c", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    side = F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1).cast("byte")
    return held.withColumns({"tile": F.xxhash64("block", F.least("c", "o"), F.greatest("c", "o")), "side": side}).drop("chunks", "c", "o")


def by_tile(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile, for rows sorted by tile: one tile at a time in memory."""
    held, now = [], None
    for part in parts:
        tile = part.column("tile").to_numpy()
        cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True]) if len(tile) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and tile[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part.slice(a, b - a))
            now = tile[a]
    if held:
        yield pa.Table.from_batches(held)


def parity(own: np.ndarray) -> bytes:
    """A bit for every remainder of the members by the power of two that is at least their number (64 at least): the parity of those that
    have it. Two sets' bits, halved by exclusive or to the same length, differ in at most as many places as the sets do in members."""
    bits = max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def halved(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def parities_fit(i: np.ndarray, j: np.ndarray, most: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Which pairs differ in at most ``most`` places of their parities."""
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    held = {w: np.frombuffer(b"".join(b for b in bits if len(b) == w), "<u8").reshape(-1, w // 8) for w in np.unique(width).tolist()}
    row = np.zeros(len(bits), np.int64)
    for w in held:
        row[width == w] = np.arange(len(held[w]))
    out = np.zeros(len(i), bool)
    for w in held:
        for v in held:
            which = np.flatnonzero((width[i] == w) & (width[j] == v))
            for a in range(0, len(which), 1 << 14):
                some = which[a : a + (1 << 14)]
                x, y = halved(held[w][row[i[some]]], min(v, w) // 8), halved(held[v][row[j[some]]], min(v, w) // 8)
                out[some] = np.bitwise_count(x ^ y).sum(1) <= most[some]
    return out


def may_link(n: np.ndarray, s: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int, bits: list[bytes] | None = None) -> np.ndarray:
    """Which sets of a tile may link to another one of it, by sizes ``n``, numbers ``s`` of members in their rare parts that other sets have, and parities.

    Sets x and y link only if they share at least m = ceil(percent * (x + y) / (100 + percent)) members. Of the set whose rare part
    begins later in the order, ceil(percent / 100 * n) - 1 members are not in it; all other shared members are in both rare parts.
    A size of 0 stands for an id that has several sets: its tile is taken whole.
    """
    if (n == 0).any():
        return np.ones(len(n), bool)
    order = np.argsort(n, kind="stable")
    n, s, comp, side = n[order], s[order], comp[order], side[order]
    bits = [bits[k] for k in order] if bits is not None else None
    out, rest, end = np.zeros(len(n), bool), -(-percent * n // 100) - 1, np.searchsorted(n, 100 * n // percent, "right")
    for a in range(0, len(n), 256):
        x, y = slice(a, min(a + 256, len(n))), slice(a, int(end[min(a + 256, len(n)) - 1]))
        shared = -(-percent * (n[x, None] + n[None, y]) // (100 + percent))
        ok = (np.arange(y.start, y.stop) > np.arange(x.start, x.stop)[:, None]) & (100 * n[x, None] >= percent * n[None, y]) & (np.minimum(s[x, None], s[None, y]) >= shared - rest[None, y])
        ok &= (comp[x, None] != comp[None, y]) & ((side[x, None] == 2) | (side[x, None] != side[None, y]))
        i, j = np.nonzero(ok)
        if bits is not None and len(i):
            most = (n[i + a] + n[j + a]) - 2 * shared[i, j]
            fit = parities_fit(i + a, j + a, most, bits)
            i, j = i[fit], j[fit]
        out[i + a] = out[j + a] = True
    back = np.empty(len(n), bool)
    back[order] = out
    return back


def promising(blocks: DataFrame, percent: int, tile_rows: int = 4096) -> DataFrame:
    """The rows of blocks (block, node, n, s, comp[, bits]) whose sets may link to a set of another group in the block: no set is sent for others."""
    names = ["block", "node", "n", "s", "comp"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_tile(parts):
            ok = may_link(*(t[c].to_numpy() for c in ("n", "s", "comp", "side")), percent, t["bits"].to_pylist() if "bits" in t.column_names else None)
            if ok.any():
                yield from t.filter(pa.array(ok)).select(names).to_batches()

    kept = [*names, *(c for c in ("bits",) if c in blocks.columns), "tile", "side"]
    tiled = tiles_of(blocks.withColumn("one", F.lit(1)), "one", tile_rows).select(kept)
    return tiled.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "block long, node long, n long, s long, comp long").distinct()


def linked_tiles(blocks: DataFrame, texts: DataFrame, shingle: int, percent: int, tile_members: int) -> DataFrame:
    """(u, v) that join the sets that meet in a block. blocks (block, node, n, comp), texts (id, text)."""
    tiled = tiles_of(blocks, "n", tile_members)
    places = written(tiled.groupBy("node", "comp").agg(F.collect_list(F.struct("tile", "side")).alias("at")), "places")

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["node", "comp", "tile", "side", "grams"], [pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary()]
        for part in parts:
            for node, comp, text, at in zip(*(part.column(k) for k in range(4))):
                grams, at = gram_set(text.as_py(), shingle).tobytes(), at.as_py()
                for a in range(0, len(at), 64):
                    some = at[a : a + 64]
                    cols = [[node.as_py()] * len(some), [comp.as_py()] * len(some), [x["tile"] for x in some], [x["side"] for x in some], [grams] * len(some)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    again = join_small(texts, places, "id", "node", "inner", 100_000).select("node", "comp", "text", "at")
    rows = again.mapInArrow(spread, "node long, comp long, tile long, side byte, grams binary")
    links = written(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(tile_joiner(percent), "u long, v long"), "gram-links")
    forget(places)
    return links


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85, tile_members: int = 1 << 20) -> DataFrame:
    """(id, n_shingles BIGINT, component BIGINT: the smallest id reachable by links) of every row.

    Two texts link when the intersection of their sets of ``shingle`` words is at least ``percent`` hundredths of the union; no
    link is lost. Texts with equal sets are one class and never meet in a task.

    Sets meet by the members that come last in a common order, the rare ones (see ``rare_part``); a block is the sets that
    have such a member. Sets leave a block where sizes and the number of their rare members that any other set has allow no
    link (see ``may_link``; a bit or two of parity for each member are sent for that), before whole sets are sent; blocks with the same sets are one. Each block is joined with a prefix tree of its whole sets (see
    ``tile_links``), large ones in tiles. In a first round a set stands in one block, that of its largest number of sets
    up to 1024; as only components are asked for, the second round leaves out blocks whose sets are in one component
    already, and holds all others.

    Texts without words, null or empty: no shingles, linked with nothing, their own component. A null id: n_shingles,
    and a null component unless some id has an equal set. Rows that repeat an id come back each with its n_shingles; they are one document,
    linked to what any of them links to. Texts are read whole, however long. Empty table: no rows. Ids are integers.
    Other columns are not looked at, whatever their names.
    """
    import xxhash

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counters = docs.sparkSession.sparkContext.broadcast(member_counts(texts, shingle))

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(a, 512) for batch in parts for a in range(0, batch.num_rows, 512)):
            own = [gram_set(t.as_py(), shingle) for t in part.column(1)]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in own), "<i8").reshape(-1, 2)
            rare = [rare_part(x, counters.value, percent).view(np.int64) for x in own]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(map(len, own), pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.array([parity(x) for x in own], pa.binary())], names=["id", "h1", "h2", "n", "rare", "bits"])

    sketches = written(texts.mapInArrow(sketch, "id long, h1 long, h2 long, n long, rare array<long>, bits binary"), "grams")
    classes = written(sketches.where("id is not null and n > 0").groupBy("h1", "h2").agg(F.min("id").alias("node")), "gram-classes")
    spread = sketches.where("id is not null and n > 0")
    spread = spread.join(classes.select(F.col("node"), F.col("h1").alias("c1"), F.col("h2").alias("c2")), (F.col("id") == F.col("node")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    single = (F.min("h1") == F.max("h1")) & (F.min("h2") == F.max("h2"))
    nodes = written(spread.groupBy("node").agg(F.when(single, F.max("n")).otherwise(0).alias("n"), F.max("bits").alias("bits")), "gram-nodes")
    members = spread.select("node", F.explode("rare").alias("member"))
    shared = written(members.groupBy("member").agg(F.count("*").alias("sets")).where("sets > 1"), "gram-often")
    found = written(skew_join(members, shared.select("member", "sets"), ["member"]), "gram-shared")
    held = written(skew_join(found.withColumnRenamed("member", "block"), found.groupBy("node").agg(F.count("*").alias("s")).join(nodes.select("node", "n"), "node"), ["node"]), "gram-members")
    forget(found), forget(shared)

    def fitting(blocks: DataFrame) -> DataFrame:
        first = written(promising(blocks, percent), "gram-first")
        return promising(first.join(nodes.select("node", "bits"), "node"), percent)

    best = F.max_by(F.struct("block", "n", "s"), F.struct(F.when(F.col("sets") <= 1024, F.col("sets")).otherwise(-F.col("sets")), "block"))
    picked = held.groupBy("node").agg(best.alias("x")).select("node", "x.block", "x.n", "x.s", F.col("node").alias("comp"))
    links = linked_tiles(fitting(picked), texts, shingle, percent, tile_members)
    named = skew_join(sketches.where("id is not null and n > 0").select("id", "h1", "h2"), classes, ["h1", "h2"]).select("id", "node")
    copies = named.groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v")
    several = named.join(copies.select(F.col("id").alias("twice")), F.col("id") == F.col("twice")).select(F.col("id").alias("u"), F.col("node").alias("v"))
    roots = written(components(links.unionByName(several)), "gram-roots")

    grouped = skew_join(held, roots.select("node", "root"), ["node"], "left").withColumn("comp", F.coalesce("root", "node"))
    open_ = grouped.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("x2"), F.count("*").alias("sets")).where("low <> high")
    once = open_.groupBy("x1", "x2", "sets").agg(F.min("block").alias("block")).select("block")
    rest = written(fitting(skew_join(grouped.select("block", "node", "n", "s", "comp"), once, ["block"])), "gram-rest")
    if not rest.isEmpty():
        links = linked_tiles(rest, texts, shingle, percent, tile_members)
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))
    forget(held), forget(rest), forget(nodes)
    classes = skew_join(classes, roots, ["node"], "left").select("h1", "h2", F.coalesce("root", "node").alias("component"))
    out = skew_join(sketches.select("id", "n", "h1", "h2"), classes, ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
