"""Byte-level BPE: merges replayed over the corpus's different words, and decoding."""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from siltstone.llm.common import trim, written

#: Words over this many bytes are replayed step by step; in the others a merge is applied to all words at once.
LONG = 64


class ReplayEncoder:
    """Encodes words by replaying merges over a whole set of words in rank order.

    ``encode_words`` takes any number of words; the more, the cheaper each. The words' bytes lie in one array with links
    to both neighbours. An inverted index leads from the rank of a
    token pair to the positions where that pair begins; ranks are taken in rising order, each merge touches the two
    neighbouring pairs only. Words are independent, and a pair that a merge creates below the rank in hand is taken
    before the rest, so that each word sees its lowest pair first, leftmost among equals.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._load(ranks, regex.compile(pattern).findall)

    def _load(self, ranks: dict[bytes, int], find) -> None:
        self.ranks, self.find = ranks, find
        self.byte_ids = [ranks[bytes([i])] for i in range(256)]
        self.table = np.empty(max(ranks.values()) + 1, dtype=object)
        self.table[:] = b""
        #: The rank of the merge of two tokens, by both ids; every way to cut a token into two tokens is a merge.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            self.table[rank] = token
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        ids: list[int] = []
        starts: list[tuple[int, int, int]] = []
        byte_ids, ranks, rank_of = self.byte_ids, self.ranks, self.pairs.get
        index: defaultdict[int, list[int]] = defaultdict(list)
        for n, w in enumerate(words):
            whole = ranks.get(w)
            if whole is not None:  # the word is a token; as in every rank file, its merges lead there
                out[n] = whole.to_bytes(4, "little")
                continue
            own = [byte_ids[c] for c in w]
            at = len(ids)
            starts.append((n, at, at + len(w)))
            ids += own
            ids.append(-1)  # no pair crosses it
            for i, (a, b) in enumerate(zip(own, own[1:]), at):
                r = rank_of(a << 32 | b)
                if r is not None:
                    index[r].append(i)
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            at = index.pop(rank, None)
            if at is None:
                continue
            at.sort()
            for done, i in enumerate(at):
                a, j = ids[i], after[i]
                if a < 0 or rank_of(a << 32 | ids[j]) != rank:
                    continue  # a neighbour has been merged meanwhile
                ids[i], ids[j] = rank, -2
                k = after[i] = after[j]
                before[k] = i
                lowest = rank + 1
                r = rank_of(rank << 32 | ids[k])
                if r is not None:
                    if r not in index:
                        heapq.heappush(heap, r)
                    index[r].append(i)
                    lowest = r
                h = before[i]
                if h >= 0 and ids[h] >= 0:
                    r = rank_of(ids[h] << 32 | rank)
                    if r is not None:
                        if r not in index:
                            heapq.heappush(heap, r)
                        index[r].append(h)
                        lowest = min(lowest, r)
                if lowest <= rank and done + 1 < len(at):
                    if rank not in index:
                        heapq.heappush(heap, rank)
                    index[rank] += at[done + 1 :]
                    break
        flat = np.array(ids, dtype=np.int64)
        kept = np.flatnonzero(flat >= 0)
        raw, place = flat[kept].astype("<u4").tobytes(), np.searchsorted(kept, [x for _, a, b in starts for x in (a, b)]).tolist()
        for (n, _, _), a, b in zip(starts, place[::2], place[1::2]):
            out[n] = raw[4 * a : 4 * b]
        return out

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours, -1 where they do not merge."""
        if not len(self.pair_keys):
            return np.full(len(a), -1, np.int64)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], -1)

    def replay_together(self, words: list[bytes]) -> list[bytes]:
        """What ``replay`` gives, a merge in all words at once.

        In each step the lowest rank in the index is taken, and the leftmost place of each word that has it is merged;
        only the pairs on both sides of these places are looked up again. Other places of a word with the same rank wait
        for the next step, so that a lower pair that a merge has made comes first.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        total = len(raw) + len(words)
        ids = np.full(total, -1, np.int64)  # -1 after each word: no pair crosses it; -2: merged into the token before
        ids[np.arange(len(raw)) + np.repeat(np.arange(len(words)), sizes)] = np.array(self.byte_ids, np.int64)[raw]
        word = np.repeat(np.arange(len(words)), sizes + 1)
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        index: defaultdict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            held = rank >= 0
            at, rank = at[held], rank[held]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, x in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut)):
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(x)

        enter(np.arange(total - 1), self.ranks_of(ids[:-1], ids[1:]))
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank, None)
            if found is None:
                continue
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[self.ranks_of(ids[at], ids[after[at]]) == rank]  # a neighbour may have been merged meanwhile
            if not len(at):
                continue
            own = word[at]
            first = np.r_[True, own[1:] != own[:-1]]
            if not first.all():
                index[rank] = [at[~first]]
                heapq.heappush(heap, rank)
                at = at[first]
            gone = after[at]
            right, left = after[gone], before[at]
            ids[at], ids[gone], after[at], before[right] = rank, -2, right, at
            token = np.full(len(at), rank, np.int64)
            inside = left >= 0
            enter(np.concatenate([left[inside], at]), np.concatenate([self.ranks_of(ids[left[inside]], token[inside]), self.ranks_of(token, ids[right])]))
        kept = np.flatnonzero(ids >= 0)
        flat = ids[kept].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(word[kept], minlength=len(words))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        short, long = [], []
        for n, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:  # the word is a token; as in every rank file, its merges lead there
                out[n] = whole.to_bytes(4, "little")
            else:
                (short if len(w) <= LONG else long).append(n)
        for some, way in ((short, self.replay_together), (long, self.replay)):
            if some:
                for n, x in zip(some, way([words[n] for n in some])):
                    out[n] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) for t in texts]
        words = list({w for ws in split for w in ws})
        known = dict(zip(words, self.encode_words([w.encode() for w in words])))
        return [b"".join([known[w] for w in ws]) for ws in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.table[np.frombuffer(ids, dtype="<u4")].tolist())


@lru_cache(2)
def coder_of(ranks_path: str, pattern: str) -> ReplayEncoder:
    """One for all tasks of a worker process."""
    return ReplayEncoder(ranks_path, pattern)


def split_chunks(docs: DataFrame, pattern: str, id_col: str, text_col: str, chunk_chars: int) -> DataFrame:
    """The texts in chunks, a row each: ids, number of pieces of each text, the pieces as numbers (compressed), the chunk's different pieces."""
    import zstandard

    longs = T.ArrayType(docs.schema[id_col].dataType)
    schema = T.StructType([T.StructField("ids", longs), T.StructField("sizes", T.BinaryType()), T.StructField("pieces", T.BinaryType()), T.StructField("words", T.ArrayType(T.BinaryType()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        held, sizes, pieces, size = [], [], [], 0
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__

        def chunk() -> pa.RecordBatch:
            packed = zstandard.ZstdCompressor(level=1).compress(np.concatenate(pieces).tobytes())
            words = one(pa.array([w.encode() for w in index], pa.binary()))
            return pa.RecordBatch.from_arrays([one(pa.array(held, id_type)), pa.array([np.array(sizes, np.uint32).tobytes()], pa.binary()), pa.array([packed], pa.binary()), words], names=schema.names)

        for part in parts:
            id_type = part.column(0).type
            for own, text in zip(part.column(0).to_pylist(), part.column(1)):  # a text is let go once it is split
                t = text.as_py() or ""
                split = find(t)
                held.append(own)
                sizes.append(len(split))
                pieces.append(np.fromiter(map(index.__getitem__, split), np.uint32, len(split)))
                size += len(t)
                if size >= chunk_chars:
                    yield chunk()
                    held, sizes, pieces, size = [], [], [], 0
                    index.clear()
                    trim()
        if held:
            yield chunk()
        del held, sizes, pieces, index
        trim()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def flat_of(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and where each word's begin, the end at last."""
    ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64) if len(tokens) else np.zeros(1, np.int64)
    flat = np.frombuffer(tokens.buffers()[2], "<u4", (ends[-1] - ends[0]) // 4, ends[0]) if ends[-1] > ends[0] else np.zeros(0, "<u4")
    return flat, (ends - ends[0]) // 4


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 16 << 20, most_words: int = 400_000, together: int = 100_000) -> DataFrame:
    """(id, n_tokens BIGINT, ids BINARY, decoded BINARY) for every row: encoding, and what decoding its ids gives.

    ``ids`` are little-endian unsigned 32-bit integers. Pieces of ``pattern`` are encoded separately, without special
    tokens. Texts are split once, in chunks of about ``chunk_chars`` characters, into numbers of the chunk's different
    pieces. Over the whole corpus the chunks of each different piece are counted; the merges are replayed together over
    those that several chunks have, ``most_words`` of them at most and ``together`` at a time, those of most chunks first, and their ids go to all
    tasks (some 20 bytes a piece). The others, rare ones, are replayed together in each chunk that has them. So texts
    are never exchanged, and a piece of very many chunks is one counter a task.
    ``ranks_path`` names a rank file present on every executor.

    Null or empty text: no ids. Very long texts are one chunk. Null ids and repeated rows pass through; an empty table
    gives no rows. Other columns are not returned, and may have any name.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    split = written(split_chunks(docs, pattern, id_col, text_col, chunk_chars), "bpe-split")
    often = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "word").limit(most_words).select("word")

    def replay(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for part in parts for w in part.column(0).to_pylist()]  # most_words at most
        for a in range(0, len(words), together):
            some = words[a : a + together]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(coder_of(ranks_path, pattern).encode_words(some), pa.binary())], names=["word", "tokens"])
        trim()

    once = often.mapInArrow(replay, "word binary, tokens binary").toArrow().combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], pa.binary()) for c in once.columns])

    def assemble(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = coder_of(ranks_path, pattern)
        often, tokens = shared.value
        often_flat, often_ends = flat_of(tokens)
        for part in parts:
            for row in range(part.num_rows):
                words = part.column(3)[row].values
                at = pc.fill_null(pc.index_in(words, value_set=often), -1).to_numpy()  # no piece becomes an object of Python if it is shared
                rare = np.flatnonzero(at < 0)
                own_flat, own_ends = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
                for a in range(0, len(rare), together):
                    x, ends = flat_of(pa.array(coder.encode_words(words.take(pa.array(rare[a : a + together])).to_pylist()), pa.binary()))
                    own_flat.append(x)
                    own_ends.append(ends[1:] + own_ends[-1][-1])
                flat, rare_ends = np.concatenate([often_flat, *own_flat]), np.concatenate(own_ends) + len(often_flat)
                starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for where, ends, n in ((np.flatnonzero(at >= 0), often_ends, at[at >= 0]), (rare, rare_ends, np.arange(len(rare)))):
                    starts[where], lengths[where] = ends[n], ends[n + 1] - ends[n]
                number = np.frombuffer(zstandard.ZstdDecompressor().decompress(part.column(2)[row].as_py()), np.uint32)
                ends = np.cumsum(np.frombuffer(part.column(1)[row].as_py(), np.uint32).astype(np.int64)).tolist()
                own = part.column(0)[row].values
                for a in range(0, len(ends), 1024):
                    ids, counts = [], []
                    for x, y in zip([ends[a - 1] if a else 0, *ends[a : a + 1023]], ends[a : a + 1024]):
                        at, many = starts[number[x:y]], lengths[number[x:y]]
                        ids.append(flat[np.repeat(at - (np.cumsum(many) - many), many) + np.arange(many.sum())].tobytes())
                        counts.append(len(ids[-1]) // 4)
                    yield pa.RecordBatch.from_arrays([own.slice(a, len(ids)), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.binary())], names=schema.names)
                del words, at, rare, own_flat, own_ends, flat, rare_ends, starts, lengths, where, number, ends, n, ids, counts
                trim()

    return split.mapInArrow(assemble, schema)
