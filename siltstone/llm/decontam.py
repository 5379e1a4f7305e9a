"""Benchmark decontamination: item-sized windows from an exact shingle index, exact weighted verification."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from siltstone.llm.common import join_small, written

BASE, MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Items of shingles that are counted at once.
SLICE = 1 << 20


class RollingHash:
    """64-bit hashes of any substrings of a byte string, from prefix sums of a polynomial."""

    def __init__(self) -> None:
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.power) <= n:
            for name, base in (("power", BASE), ("inverse", BASE_INVERSE)):
                x = getattr(self, name)
                step = np.uint64(int(x[-1]) * int(base) % (1 << 64))
                setattr(self, name, np.concatenate([x, x * step]))

    def __call__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * self.inverse[starts]
        for shift in (32, 29, 32):
            h = (h ^ (h >> np.uint64(shift))) * MIX
        return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words (A-Z lower-cased) joined by single spaces, with each word's start and end."""
    words = (text or "").encode().lower().split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return b" ".join(words), ends - sizes, ends


def simhash_of(h: np.ndarray) -> int:
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(h), bitorder="little").view("<u8")[0])


class Matcher:
    """Finds windows of documents that nearly equal benchmark items.

    An inverted index of the items' shingle hashes, as flat arrays: made once, then sent to the workers as it is.
    """

    def __init__(self, items: list[tuple[int, str]], shingle: int, similarity: float):
        self.shingle, self.similarity = shingle, similarity
        self.hash = RollingHash()
        self.ids, self.texts, self.sizes, self.fingerprints = [], [], [], []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = defaultdict(list)
        for item, text in items:
            raw, starts, ends = words_of(text)
            if not len(starts):
                continue
            k = min(shingle, len(starts))
            h = self.hash(raw, starts[: len(starts) - k + 1], ends[k - 1 :])
            found[k].append((*np.unique(h, return_counts=True), len(self.ids)))
            self.ids.append(item)
            self.texts.append(text)
            self.sizes.append(len(starts))
            self.fingerprints.append(simhash_of(h))
        #: By shingle length: item shingles sorted, where each one's items begin, the items, how often each has it, and a bit for each shingle's low bits.
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, rows in found.items():
            h, times = np.concatenate([x for x, _, _ in rows]), np.concatenate([c for _, c, _ in rows])
            n = np.repeat([n for _, _, n in rows], [len(x) for x, _, _ in rows])
            order = np.argsort(h, kind="stable")
            keys, starts = np.unique(h[order], return_index=True)
            mask = np.zeros(1 << max(16, min(26, int(np.log2(len(keys))) + 6)), bool)
            mask[keys & np.uint64(len(mask) - 1)] = True
            self.index[k] = keys, np.append(starts, len(h)), n[order].astype(np.int32), times[order].astype(np.int32), mask
        #: Shingles that a document has in common with each item; zero between documents.
        self.common = np.zeros(len(self.ids), np.int64)

    def least(self, m: int, size: int) -> int:
        """The shingles that an item of ``m`` and a window of ``size`` shingles have in common at least, if they are similar."""
        return int(np.ceil(self.similarity / (1 + self.similarity) * (m + size) - 1e-9))

    def find(self, text: str | None) -> list[tuple[int, int, int, float, int]]:
        """(item id, first word, words, similarity, Hamming distance): the best windows of each item, not overlapping."""
        raw, starts, ends = words_of(text)
        out = []
        for k, (keys, _, _, _, mask) in self.index.items():
            if len(starts) < k:
                continue
            a, b = starts[: len(starts) - k + 1], ends[k - 1 :]
            h = self.hash(raw, a, b)
            at = np.flatnonzero(mask[h & np.uint64(len(mask) - 1)])
            place = np.searchsorted(keys, h[at])
            hit = keys[np.minimum(place, len(keys) - 1)] == h[at]
            at, place = at[hit], place[hit]
            if not len(at):
                continue
            at = at[np.argsort(place, kind="stable")]
            place, times = np.unique(place, return_counts=True)
            cuts = np.append(0, np.cumsum(times))
            for n in self._candidates(k, place, times, len(h)):
                out += self._windows(n, k, raw, a, b, h, keys[place], cuts, at)
        return out

    def _candidates(self, k: int, place: np.ndarray, times: np.ndarray, size: int) -> list[int]:
        """The items that have ``least`` shingles in common with a document of ``size`` shingles, repeats counted.

        Each different shingle is met once with its items, ``SLICE`` items at a time or those of one shingle, so memory
        does not grow with how often the document repeats it.
        """
        _, cuts, numbers, counts, _ = self.index[k]
        many = cuts[place + 1] - cuts[place]
        upto, x, touched = np.cumsum(many), 0, []
        while x < len(place):
            y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + SLICE, "right")))
            part = many[x:y]
            rows = np.repeat(cuts[place[x:y]] - np.r_[0, np.cumsum(part)[:-1]], part) + np.arange(part.sum())
            np.add.at(self.common, numbers[rows], np.minimum(counts[rows], np.repeat(times[x:y], part)))
            touched.append(np.unique(numbers[rows]))
            x = y
        items = np.unique(np.concatenate(touched))
        same, self.common[items] = self.common[items], 0
        return [n for n, c in zip(items.tolist(), same.tolist()) if c >= self.least(m := self.sizes[n] - k + 1, min(m, size))]

    def _windows(self, n: int, k: int, raw: bytes, a: np.ndarray, b: np.ndarray, h: np.ndarray, known: np.ndarray, cuts: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """A window reaches the similarity only if it holds ``least`` of the item's shingles or more; a shorter document is one window.

        ``known`` are the document's different shingles that any item has, sorted; those of number i are at ``places[cuts[i]:cuts[i + 1]]``.
        """
        m = self.sizes[n] - k + 1
        size = min(m, len(h))
        least, words = self.least(m, size), size + k - 1
        text, starts, ends = words_of(self.texts[n])
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
        bag = Counter(text[x:y] for x, y in zip(starts.tolist(), ends.tolist()))
        own = np.unique(self.hash(text, starts, ends))
        met = np.searchsorted(known, own)
        met = met[known[np.minimum(met, len(known) - 1)] == own]
        at = np.sort(np.concatenate([places[cuts[i] : cuts[i + 1]] for i in met.tolist()]))
        near = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < size)
        tried = set()
        for i in near.tolist():
            tried.update(range(max(0, int(at[i + least - 1]) - size + 1), min(int(at[i]), len(h) - size) + 1))
        found = []
        for s in sorted(tried):
            own = Counter(raw[x:y] for x, y in zip(a[s : s + size].tolist(), b[s : s + size].tolist()))
            same = (own & bag).total()
            score = same / (m + size - same)
            if score >= self.similarity - 1e-12:
                found.append((-score, s))
        out, taken = [], []
        for score, s in sorted(found):
            if all(abs(s - t) >= self.sizes[n] for t in taken):
                taken.append(s)
                out.append((self.ids[n], s, words, -score, (simhash_of(h[s : s + size]) ^ self.fingerprints[n]).bit_count()))
        return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = 5, similarity: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """(id, item_id, first_word, n_words, similarity, distance): the windows of documents that nearly equal an item.

    A window has as many words as the item; a document of fewer words is one window. It matches if the weighted
    Jaccard similarity of their word shingles (repeats count) is at least ``similarity``. Of overlapping matches of one
    item the most similar stays, the first among equals. An item under ``shingle`` words is one shingle. ``distance``
    is the number of bits in which the SimHash fingerprints of window and item differ.

    Candidates come from an exact index of the items' shingles: a window that reaches the similarity holds a known
    number of them (``least``), and only where a document does are windows verified, so none is lost. Multi-index
    blocks of fingerprints cannot do this: see the README.

    Documents stay in their partitions and are read whole, however long. Items are indexed on the driver in blocks of
    about ``block_bytes`` of text, and each worker process gets a block's index once; beyond one block, documents are
    read once for each.

    Null or empty texts and items match nothing; null ids and repeated rows are treated as any others, and an item that
    is there twice is found twice. Empty tables on either side give no rows. Other columns are not looked at, whatever
    their names.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, T.LongType()), T.StructField("first_word", T.LongType()),
        T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.IntegerType()),
    ])
    items = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.length("t") > 0)
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def search(block: int) -> tuple[DataFrame, Broadcast]:
        mine = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()]  # about block_bytes
        shared = docs.sparkSession.sparkContext.broadcast(Matcher(sorted(mine, key=str), shingle, similarity))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = shared.value
            for part in parts:
                rows = [(n, m) for n, t in enumerate(part.column(1)) for m in matcher.find(t.as_py())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([n for n, _ in rows], pa.int64())), *(pa.array([m[c] for _, m in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())))], names=[f.name for f in schema])

        return docs.select(id_col, text_col).mapInArrow(run, schema), shared

    if blocks == 1:
        return search(0)[0]
    out = None
    for block in range(blocks):
        found, shared = search(block)
        found = written(found, "matches")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that hold a match; rows with a null id stay, as nothing names them.

    The ids to drop are written and counted first: up to two million are broadcast, so that the texts stay in place.
    """
    bad = written(contaminated(docs, items, id_col, **how).select(F.col(id_col).alias("__bad")).where("__bad is not null").distinct(), "bad")
    return join_small(docs, bad, id_col, "__bad", "left_anti", 2_000_000)
