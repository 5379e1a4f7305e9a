"""Scoring of documents by a hierarchical Pitman-Yor language model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.common import forget, mixed, pack, release, unpack, written

CHUNK_BYTES = 8 << 20
#: Sums of spread restaurants travel in rows of so many words.
SLICE = 1024
#: Numbers of words are 48 bits of their hash. No word is empty or a space: these stand for the end and the start of a text.
WORD_BITS = np.uint64((1 << 48) - 1)
END, START = b"", b" "


@dataclass(frozen=True)
class Settings:
    discount: float = 0.75
    strength: float = 1.0
    root_discount: float = 0.65
    root_strength: float = 1.0
    burn_in: int = 1
    samples: int = 2
    #: Restaurants of words with about this share of all training tokens are spread over groups; 1 / frequent of them at most.
    frequent: float = 1 / 65536
    #: The dishes of a restaurant are redrawn in so many batches at most, each after the one before.
    batches: int = 64
    seed: int = 11


def numbers_of(words: Iterable[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64) & WORD_BITS


END_NUMBER, START_NUMBER = (int(x) for x in numbers_of([END, START]))


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit name for the dish w in the restaurant of u."""
    return mixed(mixed(u + np.uint64(0x9E3779B97F4A7C15)) + w)


def place(x: np.ndarray, groups: int) -> np.ndarray:
    return (x % np.uint64(groups)).astype(np.int64)


def among(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is among the sorted ``known``, its position there or 0)."""
    if not len(known):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    hit = known[at] == x
    return hit, np.where(hit, at, 0)


def ordered(x: np.ndarray, below: int) -> np.ndarray:
    """The stable order of numbers from 0 to below ``below``; where a number and its position fit into 63 bits, sorted as one value."""
    bits = len(x).bit_length()
    if below.bit_length() + bits > 63:
        return np.argsort(x, kind="stable")
    at = x.astype(np.int64) << bits | np.arange(len(x))
    at.sort()
    return at & ((1 << bits) - 1)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted different values, position of each there): by hash, for values that repeat."""
    codes, found = pd.factorize(x)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[codes]


@lru_cache(2)
def stirling(discount: float, most: int) -> np.ndarray:
    """log of the generalised Stirling numbers: [c, t] sums the seatings of c customers at t tables."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 2)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.maximum(c - t * discount, 0))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(np.isnan(stay), -np.inf, stay)[1:])
    return out


def seat(c: np.ndarray, rest: np.ndarray, base: np.ndarray, discount: float, keys: np.ndarray, above: tuple[float, np.ndarray, float] | None = None, most: int = 2048) -> np.ndarray:
    """Gibbs step: table counts of dishes with ``c`` customers, each drawn from its conditional given the other dishes' tables.

    p(t) is proportional to stirling(c, t) * prod((rest + discount * i) * parent(i), i < t), where ``rest`` is the strength
    plus the discount for each of the restaurant's other tables and parent(i) the parent's probability of the dish when i
    of these tables have sent it a customer: the Chinese-restaurant seating of the dish with its arrangements summed out.
    Without ``above`` that is ``base``. With ``above`` (fresh, mass, discount), ``base`` is what the parent's tables of the
    dish hold of others, and parent(i) is (base + i + fresh) / (mass + i), the first of i less the parent's discount where
    there are no others.

    The first ``most`` customers of a dish are drawn so; any further ones sit down by the predictive rule, in runs of a
    64th of those seated.

    A dish's draw depends on its number in ``keys`` alone.
    """

    def parent(part: np.ndarray, i: np.ndarray) -> np.ndarray:
        if above is None:
            return base[part, None]
        fresh, mass, off = above
        held = base[part, None] + i[None, :] - np.where((base[part, None] <= 0) & (i[None, :] > 0), off, 0.0)
        return (held + fresh) / (mass[part, None] + i[None, :])

    chance = (mixed(keys) >> np.uint64(11)) * 2.0**-53
    t = np.ones(len(c), np.int64)
    first = np.minimum(c, most)
    table = stirling(discount, 64 if first.max(initial=1) <= 64 else most)
    wide = np.ceil(np.log2(np.maximum(first, 1))).astype(np.int64)  # dishes of 2, to 4, to 8 ... customers are drawn together
    order = ordered(wide, 64)
    cuts = np.searchsorted(wide[order], np.arange(1, int(wide.max(initial=0)) + 2))
    for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()), 1):
        at, size = order[lo:hi], min(1 << k, most)
        step = max(1, (1 << 19) // size)
        for a in range(0, len(at), step):
            part = at[a : a + step]
            steps = np.log(rest[part, None] + discount * np.arange(size)[None, :]) + np.log(parent(part, np.arange(size)))
            logit = table[first[part], 1 : size + 1] + np.cumsum(steps, axis=1)  # -inf beyond a dish's customers
            p = np.cumsum(np.exp(logit - logit.max(axis=1, keepdims=True)), axis=1)
            t[part] = 1 + np.minimum((p < chance[part, None] * p[:, -1:]).sum(axis=1), first[part] - 1)
    for i in np.flatnonzero(c > most).tolist():
        rng = np.random.Generator(np.random.Philox(key=int(keys[i])))
        tables, seated, full, other = int(t[i]), most, int(c[i]), float(rest[i])
        while seated < full:
            run = min(max(seated // 64, 1), full - seated)
            new = (other + discount * tables) * float(parent(np.array([i]), np.array([tables]))[0, 0])
            tables += int(rng.binomial(run, new / (new + seated - discount * tables)))
            seated += run
        t[i] = tables
    return t


def chunks_of(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids and flags, texts) of about CHUNK_BYTES of text each."""
    rows, texts, held = [], [], 0
    for part in parts:
        for row, text in zip(zip(part.column(0).to_pylist(), part.column(1).to_pylist()), part.column(2)):
            t = text.as_py()
            rows.append(row)
            texts.append(t)
            held += len(t or "") + 8
            if held >= CHUNK_BYTES:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def tokens_of(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted numbers of the different words, the end and the start among them, the tokens as positions there, tokens of each text)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(pa.array(texts, pa.large_string()), "")))  # the six of [\x20\x09-\x0D]
    flat, cuts = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    word = pc.binary_length(flat).to_numpy() > 0  # white space at the ends of a text leaves empty parts
    sizes = np.diff(np.r_[0, np.cumsum(word)][cuts]) + 1
    found = flat.filter(pa.array(word)).dictionary_encode()
    data, at = found.dictionary.buffers()[2], np.frombuffer(found.dictionary.buffers()[1] or b"", np.int64)[: len(found.dictionary) + 1].tolist()
    data = data.to_pybytes() if data else b""
    words, own = np.unique(numbers_of([END, START, *(data[a:b] for a, b in zip(at[:-1], at[1:]))]), return_inverse=True)
    index = np.full(int(sizes.sum()), own[0])
    inner = np.ones(len(index), bool)
    inner[np.cumsum(sizes) - 1] = False
    index[inner] = own[2:][found.indices.to_numpy()]
    return words, index, sizes


@dataclass
class Layout:
    """A chunk's different (word before u, word w) pairs by the group that knows them, then by w and u, and its words by group; the same wherever it is made."""

    u: np.ndarray
    w: np.ndarray
    cuts: np.ndarray
    home: np.ndarray
    home_cuts: np.ndarray
    #: Whether each word is frequent, its position among these or 0.
    spread: np.ndarray
    at: np.ndarray
    #: Of each token the position of its pair, if asked for. Of each pair its training tokens, if told which to learn from; then only pairs that have some.
    pair: np.ndarray | None = None
    n: np.ndarray | None = None

    @classmethod
    def of(cls, words: np.ndarray, index: np.ndarray, frequent: np.ndarray, groups: int, pairs: bool = False, learn: np.ndarray | None = None) -> Layout:
        n, pair, count = len(words), None, None
        end, start = (int(np.searchsorted(words, np.uint64(x))) for x in (END_NUMBER, START_NUMBER))
        before = np.r_[end, index[:-1]] if len(index) else index
        key = index * n + np.where(before == end, start, before)
        if pairs:
            by = ordered(key, n * n)
            key = key[by]
        else:
            key = key * 2 + (0 if learn is None else learn)
            key.sort()
            flag, key = key & 1, key >> 1
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        if learn is not None and len(head):
            count = np.add.reduceat(flag, head)
            head, count = head[count > 0], count[count > 0]
        w, u = np.divmod(key[head], n)
        homes = place(mixed(words), groups)
        hit, at = among(words, frequent)
        group, spread = homes[u], hit[u]
        group[spread] = place(pair_hash(words[u[spread]], words[w[spread]]), groups)
        order = ordered(group, groups)
        if pairs:
            rank = np.empty(len(head), np.int64)
            rank[order] = np.arange(len(head))
            pair = np.empty(len(key), np.int64)
            pair[by] = rank[np.cumsum(new) - 1]
        if count is not None:
            count = count[order]
        home = ordered(homes, groups)
        home = home[home != start]
        return cls(u[order], w[order], np.searchsorted(group[order], np.arange(groups + 1)), home, np.searchsorted(homes[home], np.arange(groups + 1)), hit, at, pair, count)

    def befores(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """A group's words before, and the position of each pair's among them."""
        return coded(self.u[self.cuts[g] : self.cuts[g + 1]])


ROWS = "g long, kind int, o long, blob binary, t long, c long"
SEATING, ASK, REPLY, PARENT, SPREAD = range(5)


def rows_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["g", "kind", "o", "blob", "t", "c"])


def slots_of(groups: int) -> int:
    """The unigram restaurant is kept in so many slots, with the words of 16 groups each (fewer below 256 groups): a group sends each a message, so these do not grow with the square of the groups until there are hundreds."""
    return min(groups, max(16, -(-groups // 16)))


def told(g: int, words: np.ndarray, slot: np.ndarray, which: np.ndarray, t: np.ndarray, n: np.ndarray, contexts: np.ndarray, context: np.ndarray, frequent: np.ndarray, slots: int) -> list[tuple]:
    """What a group tells after a seating: to the words' slots the customers it sends, and of spread restaurants its tables and customers, in a row for each SLICE of them."""
    sent = np.bincount(which, t, len(words)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1], True]) if len(words) else np.zeros(1, np.int64)
    out = [(g, ASK, int(slot[a]), pack(word=words[a:b], customers=sent[a:b]), 0, 0) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    hit, at = among(contexts, frequent)
    tables, customers = (np.bincount(context, x, len(contexts)).astype(np.int64)[hit] for x in (t, n))
    at = at[hit]
    cut = np.searchsorted(at, np.arange(0, len(frequent) + SLICE, SLICE))
    return out + [(g, SPREAD, slots + k, pack(at=at[a:b] % SLICE, tables=tables[a:b], customers=customers[a:b]), 0, 0) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]


def spread_step(o: int, blobs: Iterable[bytes]) -> list[tuple]:
    """The sums of all groups for a slice of the spread restaurants."""
    tables, customers = np.zeros(SLICE, np.int64), np.zeros(SLICE, np.int64)
    for m in map(unpack, blobs):  # a group names a word once
        tables[m["at"]] += m["tables"]
        customers[m["at"]] += m["customers"]
    return [(o, SPREAD, o, pack(tables=tables, customers=customers), 0, 0)]


def first_seating(g: int, blobs: Iterable[bytes], groups: int, frequent: np.ndarray) -> list[tuple]:
    """A group's pairs of all chunks, merged, with one table a dish."""
    us, ws, ns = [], [], []
    for p in map(unpack, blobs):
        us.append(received(p, "u", frequent)[p["at"]]), ws.append(np.repeat(received(p, "w", frequent), p["k"])), ns.append(p["n"].astype(np.int32))
    u, w, n = (np.concatenate(x) for x in (us, ws, ns))
    del us, ws, ns
    dishes = pair_hash(u, w)
    order = np.argsort(dishes)
    dishes = dishes[order]
    head = np.flatnonzero(np.r_[True, dishes[1:] != dishes[:-1]]) if len(dishes) else order
    first, n = order[head], np.add.reduceat(n[order], head, dtype=np.int64) if len(head) else n
    u, w = u[first], w[first]
    del dishes, order, head, first
    contexts, context = coded(u)
    by = ordered(context, len(contexts) + 1)
    w, n, context = w[by], n[by], context[by]
    words, which = coded(w)
    slot = place(mixed(words), groups) % slots_of(groups)
    order = ordered(slot, groups)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    words, slot, which = words[order], slot[order], back[which]
    t = np.ones(len(n), np.int64)
    blob = pack(contexts=contexts, per=np.bincount(context, minlength=len(contexts)), words=words, slot=slot, which=which, n=n, t=t, sums=np.zeros(len(n), np.int64), tables=np.zeros(0, np.int64))
    return [(g, SEATING, 0, blob, len(n), int(n.sum())), *told(g, words, slot, which, t, n, contexts, context, frequent, slots_of(groups))]


def parent_step(o: int, asks: list[tuple[int, bytes]], before: list[bytes], groups: int, tables: int, vocabulary: int, sweep: int, s: Settings) -> list[tuple]:
    """The unigram restaurant's dishes of one slot: their customers are the tables of all contexts' restaurants. A row for each group whose words they are."""
    asks = [(g, unpack(b)) for g, b in sorted(asks, key=lambda x: x[0])]
    words, at = coded(np.concatenate([m["word"] for _, m in asks]))
    c = np.bincount(at, np.concatenate([m["customers"] for _, m in asks]), len(words)).astype(np.int64)
    t = np.ones(len(words), np.int64)
    if before:
        known = [unpack(b) for b in before]  # the same words: none ever loses all its customers
        own = np.concatenate([m["t"] for m in known])[np.argsort(np.concatenate([m["word"] for m in known]))]
        t = seat(c, s.root_strength + s.root_discount * (tables - own).astype(float), np.full(len(words), 1 / (vocabulary + 1)), s.root_discount, draws(s, sweep, mixed(words)))
    out, a = [], 0
    home = place(mixed(words), groups)
    by = ordered(home, groups)
    cut = np.flatnonzero(np.r_[True, np.diff(home[by]) > 0, True])
    for mine in (by[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())):
        out.append((int(home[mine[0]]), PARENT, len(mine), pack(word=words[mine], t=t[mine], c=c[mine]), int(t[mine].sum()), int(c[mine].sum())))
    for g, m in asks:
        own = at[a : a + len(m["word"])]
        out.append((g, REPLY, o, pack(t=t[own], c=c[own]), 0, 0))
        a += len(own)
    return out


def draws(s: Settings, sweep: int, dishes: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each dish: the same in whatever group it is."""
    return mixed(dishes + np.uint64(s.seed << 32 | sweep))


@dataclass(frozen=True)
class Whole:
    """Sums over all groups: of the unigram restaurant, and of each spread restaurant (by position in ``frequent``)."""

    vocabulary: int
    tables: int
    customers: int
    spread_tables: np.ndarray
    spread_customers: np.ndarray


def sweep_group(g: int, raw: bytes, replies: list[tuple[int, bytes]], whole: Whole, sweep: int, frequent: np.ndarray, slots: int, s: Settings) -> list[tuple]:
    """A Gibbs sweep over a group's restaurants.

    The unigram restaurant is as it stood after the last sweep, less the dish's own tables.

    A restaurant's dishes are redrawn one after another (beyond ``batches`` dishes that can change, in as many batches),
    each given the tables that the others have by then. Restaurants that are spread over groups see their other tables
    as they stood after the last sweep, so that the number of groups does not matter.
    """
    m = unpack(raw)
    context, which, n, t = np.repeat(np.arange(len(m["per"])), m["per"]), m["which"], m["n"], m["t"].copy()
    above = [unpack(b) for _, b in sorted(replies, key=lambda x: x[0])]
    stay = np.concatenate([np.zeros(0), *(x["c"] - s.root_discount * x["t"] for x in above)])
    fresh = (s.root_strength + s.root_discount * whole.tables) / (whole.vocabulary + 1)
    hit, at = among(m["contexts"], frequent)
    total = np.where(hit, whole.spread_tables[at] if len(frequent) else 0, np.bincount(context, t, len(hit)).astype(np.int64))
    dishes = pair_hash(m["contexts"][context], m["words"][which])
    keys = draws(s, sweep, dishes)
    free = np.flatnonzero(n > 1)
    of = context[free]
    head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    many = np.diff(np.r_[head, len(of)])
    rank, count = np.arange(len(of)) - np.repeat(head, many), np.repeat(many, many)
    step = np.where(hit[of], 0, np.where(count <= s.batches, rank, rank * s.batches // count))
    order = ordered(step, len(step) + 1)
    free, step = free[order], step[order]
    cut = np.searchsorted(step, np.arange((int(step[-1]) if len(step) else -1) + 2))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        d = free[a:b]
        above = fresh, s.root_strength + whole.customers - t[d], s.root_discount
        new = seat(n[d], s.strength + s.discount * (total[context[d]] - t[d]), np.maximum(stay[which[d]] - t[d], 0.0), s.discount, keys[d], above)
        alone = ~hit[context[d]]
        total += np.bincount(context[d][alone], (new - t[d])[alone], len(total)).astype(np.int64)
        t[d] = new
    tables, sums = m["tables"], m["sums"]
    if sweep >= s.burn_in:
        sums, tables = sums + t, np.r_[tables, np.where(hit, 0, total)]
    blob = pack(**{k: m[k] for k in ("contexts", "per", "words", "slot", "which", "n")}, t=t, sums=sums, tables=tables)
    return [(g, SEATING, 0, blob, int(t.sum()), int(n.sum())), *told(g, m["words"], m["slot"], which, t, n, m["contexts"], context, frequent, slots)]


class GroupModel:
    """What a group knows after all samples: its pairs, its own words' restaurants and their place in the unigram restaurant."""

    def __init__(self, seating: bytes | None, parents: list[bytes], samples: list[Whole], frequent: np.ndarray, s: Settings):
        none = np.zeros(0, np.int64)
        m = unpack(seating) if seating is not None else {"contexts": none.astype(np.uint64), "per": none, "words": none.astype(np.uint64), "which": none, "n": none, "sums": none, "tables": np.zeros(0, np.int64)}
        k = len(samples)
        self.contexts, self.frequent, self.samples = m["contexts"], frequent, k
        hit, at = among(self.contexts, frequent)
        context = np.repeat(np.arange(len(hit)), m["per"])
        customers = np.bincount(context, m["n"], len(hit)).astype(np.int64)
        tables = m["tables"].reshape(k, len(hit)) if len(m["tables"]) else np.zeros((k, len(hit)), np.int64)
        if len(frequent):
            customers = np.where(hit, samples[-1].spread_customers[at], customers)
            tables = np.where(hit[None, :], np.array([x.spread_tables for x in samples])[:, at], tables)
        self.customers = customers
        self.weight = ((s.strength + s.discount * tables) / (s.strength + customers)[None, :]).astype(np.float32)
        dishes = pair_hash(self.contexts[context], m["words"][m["which"]])
        order = np.argsort(dishes)
        self.dishes = dishes[order]
        self.stay = ((m["n"] - s.discount * (m["sums"] / max(k, 1))) / (s.strength + customers[context])).astype(np.float32)[order]
        known = [unpack(b) for b in parents]
        self.words = known[0]["word"] if known else none.astype(np.uint64)
        self.root = np.array([p["c"] - s.root_discount * p["t"] for p in known]).reshape(k, len(self.words)) if known else np.zeros((k, 0), np.float32)

    def answer(self, ask: dict[str, np.ndarray]) -> bytes:
        """Of each pair what its dish keeps, of each word before the weight of the unigram restaurant, of each own word its share there and its count."""
        u, w = received(ask, "u", self.frequent), received(ask, "w", self.frequent)
        hit, at = among(pair_hash(u[ask["at"]], np.repeat(w, ask["k"])), self.dishes)
        stay = np.where(hit, self.stay[at] if len(self.stay) else 0, 0).astype(np.float32)
        seen, to = among(u, self.contexts)
        weight = np.ones((self.samples, len(seen)), np.float32)
        weight[:, seen] = self.weight[:, to[seen]]
        known, own = among(ask["home"], self.words)
        root = np.zeros((self.samples, len(known)), np.float32)
        root[:, known] = self.root[:, own[known]]
        there, mine = among(ask["home"], self.contexts)
        count = np.where(there, self.customers[mine] if len(self.contexts) else 0, 0)
        return pack(stay=rounded(stay), weight=rounded(weight.reshape(-1)), root=root.reshape(-1), count=count.astype(np.int64))


def frequent_words(docs: DataFrame, train: Column, id_col: str, text_col: str, share: float) -> np.ndarray:
    """Sorted numbers of the words with at least this share, and at least 16 tokens, in a 61st of the training documents; and of the start.

    Only says which restaurants are spread over groups; every count of the model is of all documents.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            words, index, _ = tokens_of(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(index, minlength=len(words)))], names=["w", "n"])

    some = docs.where(train & (F.pmod(F.xxhash64(id_col), F.lit(61)) == 7)).select(text_col).mapInArrow(run, "w long, n long")
    counts = written(some.groupBy("w").agg(F.sum("n").alias("n")).where("n > 0"), "lm-frequent")
    total = counts.agg(F.sum("n")).first()[0] or 0
    got = counts.where(F.col("n") >= max(16.0, share * total)).select("w").collect()  # 1 / share at most
    forget(counts)
    return np.unique(np.array([START_NUMBER, *(r.w for r in got if r.w != END_NUMBER)], np.uint64))


def chunk_rows(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """(chunk, blob): the tokens of each chunk's texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        for number, (rows, texts) in enumerate(chunks_of(parts)):
            words, index, sizes = tokens_of(texts)
            ids = np.array([i or 0 for i, _ in rows], np.int64).view(np.float64)
            blob = pack(ids=ids, null=np.array([i is None for i, _ in rows], np.int64), learn=np.array([bool(f) for _, f in rows], np.int64), sizes=sizes, index=index, words=words)
            yield pa.RecordBatch.from_arrays([pa.array([part_id << 24 | number], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "blob"])

    return docs.select(F.col(id_col).cast("long"), F.coalesce(train, F.lit(False)), text_col).mapInArrow(run, "chunk long, blob binary")


def dealt(chunk: bytes, groups: int, frequent: np.ndarray, learn: bool) -> Iterator[tuple[int, bytes]]:
    """For each group the chunk's pairs that it knows: to learn from, with training counts; to be answered, with the words that it knows."""
    m = unpack(chunk)
    words = m["words"]
    lay = Layout.of(words, m["index"], frequent, groups, learn=np.repeat(m["learn"], m["sizes"]) if learn else None)

    def sent(name: str, own: np.ndarray) -> dict[str, np.ndarray]:
        hit = lay.spread[own]
        return {name: words[own[~hit]], f"{name}s": np.diff(lay.at[own[hit]], prepend=0)}

    for g in np.flatnonzero((np.diff(lay.cuts) > 0) | (not learn) & (np.diff(lay.home_cuts) > 0)).tolist():
        lo, hi = lay.cuts[g], lay.cuts[g + 1]
        us, at = lay.befores(g)
        w = lay.w[lo:hi]
        head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if hi > lo else np.zeros(0, np.int64)
        also = {"n": lay.n[lo:hi]} if learn else {"home": words[lay.home[lay.home_cuts[g] : lay.home_cuts[g + 1]]]}
        yield g, pack(**sent("u", us), at=at, **sent("w", w[head]), k=np.diff(np.r_[head, hi - lo]), **also)


def received(m: dict[str, np.ndarray], name: str, frequent: np.ndarray) -> np.ndarray:
    """The sorted words of a message: frequent ones were sent as steps between their positions."""
    return np.sort(np.concatenate([frequent[np.cumsum(m[f"{name}s"])], m[name]]))


def rounded(x: np.ndarray) -> np.ndarray:
    """Floats with 16 bits of mantissa: a relative error under 1 in 65,000, and a quarter less to send."""
    return ((x.astype(np.float32).view(np.uint32) + np.uint32(0x40)) & np.uint32(0xFFFFFF80)).view(np.float32)


def scored(text: bytes, answers: list[tuple[int, bytes]], groups: int, frequent: np.ndarray, samples: list[Whole], s: Settings) -> pd.DataFrame:
    """The rows of a chunk's texts from what the groups answered."""
    m = unpack(text)
    words, index, sizes = m["words"], m["index"], m["sizes"]
    lay = Layout.of(words, index, frequent, groups, pairs=True)
    k, n = len(samples), len(words)
    stay, weight = np.zeros(len(lay.u)), np.ones((k, len(lay.u)))
    root, count = np.zeros((k, n)), np.zeros(n, np.int64)
    for g, blob in answers:
        a = unpack(blob)
        lo, hi = lay.cuts[g], lay.cuts[g + 1]
        stay[lo:hi] = a["stay"]
        us, at = lay.befores(g)
        weight[:, lo:hi] = a["weight"].reshape(k, len(us))[:, at]
        home = lay.home[lay.home_cuts[g] : lay.home_cuts[g + 1]]
        root[:, home], count[home] = a["root"].reshape(k, len(home)), a["count"]
    tokens = vocabulary = 0
    if k:
        last = samples[-1]
        hit, at = among(words, frequent)
        count = np.where(hit, last.spread_customers[at], count)
        spread, to = hit[lay.u], at[lay.u]  # a group need not have met a spread restaurant to be asked about it
        weight[:, spread] = [((s.strength + s.discount * x.spread_tables) / (s.strength + x.spread_customers))[to[spread]] for x in samples]
        count[np.searchsorted(words, np.uint64(END_NUMBER))] = last.spread_customers[among(np.array([START_NUMBER], np.uint64), frequent)[1][0]]  # an end for each start
        tokens, vocabulary = last.tokens, last.vocabulary
        below = np.array([s.root_strength + x.customers for x in samples])[:, None]
        fresh = np.array([(s.root_strength + s.root_discount * x.tables) / (x.vocabulary + 1) for x in samples])[:, None]
        p = stay + (weight * ((root + fresh) / below)[:, lay.w]).mean(axis=0)
    else:
        p = np.ones(len(lay.u))
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    add = lambda x: np.bincount(text_of, x, len(sizes))
    number = pd.array(m["ids"].view(np.int64), dtype="Int64")
    number[m["null"].astype(bool)] = pd.NA
    base = np.log10((count + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
    return pd.DataFrame({"id": number, "train": m["learn"].astype(bool), "n_tokens": sizes, "n_known": add(count[index] > 0).astype(np.int64), "base_score": add(base[index]), "score": add(np.log10(p)[lay.pair])})


@dataclass(frozen=True)
class Sample(Whole):
    tokens: int = 0


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), group_bytes: int = 12 << 20, turns: int = 3) -> DataFrame:
    """(id, train BOOLEAN, n_tokens, n_known, train_tokens BIGINT, base_score, score DOUBLE) for every row.

    The model is a two-level hierarchical Pitman-Yor process over the tokens of the rows where ``train`` holds: a
    restaurant for every different word before, however many there are, all with the unigram restaurant as parent,
    which backs off to a uniform share for each known word and one for all unknown ones. Seatings are drawn by Gibbs
    sweeps (``sweep_group``, ``seat``); a token's probability is the mean of the predictive probabilities of all
    samples after the burn-in. Every count of every training text goes into it. The unigram restaurant is redrawn
    between the sweeps, given the tables of all the others.

    Restaurants are dealt by hash into groups, one for each ``group_bytes`` of text; a word's dish in the unigram
    restaurant is in the group of its own restaurant. Restaurants of frequent words (``frequent_words``, at most
    1 / ``settings.frequent``) are spread over all groups by dish, and only their table and customer sums are gathered.
    Nothing depends on the number of groups or partitions. Texts are split into words once. A chunk sends a group its
    different pairs, once to learn from and once to be answered; a group sends each slot of the unigram restaurant
    (``slots_of``) its customers, and the sums of its spread restaurants in slices. Messages are arrays. The chunks are
    answered and scored in ``turns``, so that a part of the answers is on disk at a time. What reaches all tasks is the list of frequent words with two sums each.

    Words are told apart by 48 bits of their hash. Null or empty texts: one end token. Null ids and repeated rows come
    back as they are. Very long texts are one chunk. Empty table: no rows; no training rows: scores 0. Other columns are
    not looked at, whatever their names.
    """
    spark, s = docs.sparkSession, settings
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(8, -(-size // group_bytes))
    slots = slots_of(groups)
    frequent = frequent_words(docs, train, id_col, text_col, s.frequent)
    chunks = written(chunk_rows(docs, train, id_col, text_col), "lm-chunks")

    def pairs(some: DataFrame, learn: bool) -> DataFrame:
        def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for chunk, blob in zip(part.column(0).to_pylist(), part.column(1)):
                    out = list(dealt(blob.as_py(), groups, frequent, learn))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(out), pa.int64()), pa.array([g for g, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["chunk", "g", "blob"])

        return some.mapInArrow(deal, "chunk long, g long, blob binary")

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        return rows_of(first_seating(int(rows["g"].iloc[0]), rows["blob"], groups, frequent))

    def sums(parent: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        tables, customers = (np.zeros(len(frequent) + SLICE, np.int64) for _ in range(2))
        for r in parent.where(F.col("kind") == SPREAD).select("o", "blob").collect():  # two numbers a frequent word
            m, a = unpack(bytes(r.blob)), (r.o - slots) * SLICE
            tables[a : a + SLICE], customers[a : a + SLICE] = m["tables"], m["customers"]
        return tables[: len(frequent)], customers[: len(frequent)]

    def parent_of(seating: DataFrame, before: DataFrame | None, tables: int, vocabulary: int, sweep: int) -> DataFrame:
        asks = seating.where(F.col("kind").isin(ASK, SPREAD)).select("g", "kind", "o", "blob")
        if before is not None:
            asks = asks.unionByName(before.where(F.col("kind") == PARENT).select("g", "kind", (F.col("g") % slots).alias("o"), "blob"))

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            o = int(rows["o"].iloc[0])
            if o >= slots:
                return rows_of(spread_step(o, rows["blob"]))
            mine = rows[rows["kind"] == ASK]
            return rows_of(parent_step(o, list(zip(mine["g"].tolist(), mine["blob"])), rows.loc[rows["kind"] == PARENT, "blob"].tolist(), groups, tables, vocabulary, sweep, s))

        return written(asks.groupBy("o").applyInPandas(run, ROWS), "lm-parent")

    def whole_of(seating: DataFrame, parent: DataFrame) -> Sample:
        r = parent.where(F.col("kind") == PARENT).agg(F.sum("o").alias("v"), F.sum("t").alias("t"), F.sum("c").alias("c")).first()
        n = seating.where(F.col("kind") == SEATING).agg(F.sum("c")).first()[0]
        return Sample(r.v or 0, r.t or 0, r.c or 0, *sums(parent), n or 0)

    def swept(seating: DataFrame, parent: DataFrame, whole: Sample, sweep: int) -> DataFrame:
        own = seating.where(F.col("kind") == SEATING).unionByName(parent.where(F.col("kind") == REPLY)).select("g", "kind", "o", "blob")

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            mine, replies = rows[rows["kind"] == SEATING], rows[rows["kind"] == REPLY]
            return rows_of(sweep_group(int(rows["g"].iloc[0]), mine["blob"].iloc[0], list(zip(replies["o"].tolist(), replies["blob"])), whole, sweep, frequent, slots, s))

        return written(own.groupBy("g").applyInPandas(run, ROWS), "lm-seating")

    seating = written(pairs(chunks, True).groupBy("g").applyInPandas(first, ROWS), "lm-seating")
    release(spark)
    parent = parent_of(seating, None, 0, 0, 0)
    whole = whole_of(seating, parent)
    samples, kept, held = [], [], []
    for sweep in range(s.burn_in + s.samples if whole.tokens else 0):
        then = swept(seating, parent, whole, sweep)
        above = parent_of(then, parent, whole.tables, whole.vocabulary, sweep)
        forget(seating)
        if sweep <= s.burn_in:
            forget(parent)
        release(spark)
        seating, parent = then, above
        whole = whole_of(seating, parent)
        if sweep >= s.burn_in:
            samples.append(whole)
            held.append(parent)
            kept.append(parent.where(F.col("kind") == PARENT).select("g", F.lit(len(samples)).alias("kind"), "blob"))

    model = seating.where(F.col("kind") == SEATING).select("g", F.lit(0).alias("kind"), "blob")
    for k in kept:
        model = model.unionByName(k)
    model = model.select("g", "kind", F.lit(-1).cast("long").alias("chunk"), "blob")

    def answer(key: tuple, known: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        parts = dict(zip(known["kind"].tolist(), known["blob"]))
        group = GroupModel(parts.get(0), [parts[k] for k in range(1, len(samples) + 1) if k in parts], samples, frequent, s) if samples else None
        blobs = [group.answer(unpack(b)) for b in asks["blob"]] if samples else []
        return pd.DataFrame({"chunk": asks["chunk"].iloc[: len(blobs)], "g": [key[0]] * len(blobs), "blob": blobs})

    def gather(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return scored(own["blob"].iloc[0], list(zip(found["g"].tolist(), found["blob"])), groups, frequent, samples, s)

    out = None
    for turn in range(turns):  # a part of the chunks at a time, so that fewer pairs and answers are under way
        some = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(turns)) == turn)
        asked = pairs(some, False).select("g", F.lit(-1).alias("kind"), "chunk", "blob")
        answers = written(model.groupBy("g").cogroup(asked.groupBy("g")).applyInPandas(answer, "chunk long, g long, blob binary"), "lm-answers")
        release(spark)
        mine = some.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(gather, "id long, train boolean, n_tokens long, n_known long, base_score double, score double")
        mine = written(mine, "lm-scored")
        forget(answers)
        release(spark)
        out = mine if out is None else out.unionByName(mine)
    for table in [chunks, seating, parent, *held]:
        forget(table)
    return out.withColumnRenamed("id", id_col).withColumn("train_tokens", F.lit(whole.tokens).cast("long"))
