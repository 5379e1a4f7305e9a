"""Phrase collocation mining by vertical positional inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from siltstone.llm.common import LOWER, UPPER, forget, mixed, pack, unpack, written

if TYPE_CHECKING:
    import pandas as pd

#: Marks that no UTF-8 text holds: the end of a piece and of a text.
PIECE, TEXT = b"\xff", b"\xfe"
#: A-Z lower-cased, tabs as spaces, and the bytes that end a piece as PIECE.
TABLE = bytes.maketrans(UPPER.encode() + b"\t" + b".,;:!?\n\x0b\x0c\r", LOWER.encode() + b" " + PIECE * 10)
#: What a language that is null is called.
NO_LANGUAGE = "und"


def lists_of(label: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted lists of labelled positions: the different labels, the lengths of their lists, and the lists one after another, each ascending."""
    order = np.argsort(label, kind="stable")
    own, counts = np.unique(label[order], return_counts=True)
    return own, counts, at[order]


def by_position(counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists' positions in ascending order, each with the number of its list."""
    order = np.argsort(at)
    return at[order], np.repeat(np.arange(len(counts)), counts)[order]


def chunk_words(texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(language, word, counts, lists) of the words of some texts. Positions count words, ends of pieces and ends of texts, so that
    only words of one piece have positions that follow each other."""
    raw = TEXT.join(texts).translate(TABLE)
    tokens = pa.array(raw.replace(PIECE, b" \xff ").replace(TEXT, b" \xfe ").split(), pa.binary()).dictionary_encode()
    ids, words = tokens.indices.to_numpy(zero_copy_only=False), tokens.dictionary
    marks = [words.index(pa.scalar(m, pa.binary())).as_py() for m in (PIECE, TEXT)]
    names, code = np.unique(np.array(langs, object), return_inverse=True)
    text = np.cumsum(ids == marks[1])
    at = np.flatnonzero((ids != marks[0]) & (ids != marks[1]))
    own, counts, lists = lists_of(code[text[at]] * len(words) + ids[at], at)
    return names[own // max(1, len(words))], words.take(pa.array(own % max(1, len(words)))).to_pylist(), counts, lists


def index_chunks(docs: DataFrame, text_col: str, lang_col: str, chunk_bytes: int) -> DataFrame:
    """(chunk BIGINT, size BIGINT, totals ARRAY of (lang, n), words and n: names and counts, packed, blob: the words' lists): texts in
    chunks of about ``chunk_bytes``, each whole in one chunk."""
    kind = pa.struct([("lang", pa.string()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, size, number = [], [], 0, TaskContext.get().partitionId() << 24

        def row() -> pa.RecordBatch:
            lang, word, counts, lists = chunk_words(texts, langs)
            spoken, code = np.unique(lang, return_inverse=True)
            totals = [{"lang": x, "n": int(n)} for x, n in zip(spoken.tolist(), np.bincount(code, counts, len(spoken)))] if len(lang) else []
            names = pack_names([x.encode() + b" " + w for x, w in zip(lang.tolist(), word)])
            cells = [pa.array([number], pa.int64()), pa.array([len(word)], pa.int64()), pa.array([totals], pa.list_(kind)), pa.array([names], pa.binary()), pa.array([pack(n=counts)], pa.binary()), pa.array([pack(n=counts, at=lists)], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names=["chunk", "size", "totals", "words", "n", "blob"])

        for part in parts:
            for text, lang in zip(part.column(0).cast(pa.binary()), part.column(1).to_pylist()):
                texts.append(text.as_py() or b"")
                langs.append(NO_LANGUAGE if lang is None else lang)
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield row()
                    texts, langs, size, number = [], [], 0, number + 1
        if texts:
            yield row()

    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    return docs.select(text.alias("text"), lang.alias("lang")).mapInArrow(run, "chunk long, size long, totals array<struct<lang: string, n: long>>, words binary, n binary, blob binary").where("size > 0")


def extended(state: dict[str, np.ndarray], first: bool) -> dict[str, np.ndarray]:
    """Every list of a phrase of m words merge-joined with the postings of the words that stand m positions on.

    state: ids, n, at (phrases and their lists), wids, wn, wat (words and their postings), m. A position of a phrase
    stays if a word with a list stands m on and, as every part of a frequent phrase is frequent, a phrase with a list
    starts one on. Gives p, w (the ids of phrase and word), n and at of the longer phrases, and the postings.
    """
    m = int(state["m"][0])
    at, phrase = by_position(state["n"], state["at"])
    wat, word = (at, phrase) if first else by_position(state["wn"], state["wat"])
    wids = state["ids"] if first else state["wids"]
    goes_on = np.r_[at[1:] == at[:-1] + 1, np.zeros(min(1, len(at)), bool)]
    at, phrase = at[goes_on], phrase[goes_on]
    match = np.searchsorted(wat, at + m)
    there = match < len(wat)
    there[there] = wat[match[there]] == at[there] + m
    at, phrase, match = at[there], phrase[there], match[there]
    own, counts, lists = lists_of(phrase * max(1, len(wids)) + word[match], at)
    return {"p": state["ids"][own // max(1, len(wids))], "w": wids[own % max(1, len(wids))], "n": counts, "at": lists, "wids": wids, "wn": state["n"] if first else state["wn"], "wat": state["at"] if first else state["wat"]}


def longer_lists(state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``extended`` for a state as it is kept. A chunk keeps the lists that are known to be frequent, and merges them
    again where it needs the longer ones: most of those are not frequent and would be the bulk of what is written."""
    return extended(state, "wids" not in state)


def kept_lists(n: np.ndarray, at: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The lists with the numbers ``keep`` (ascending), one after another."""
    there = np.zeros(len(n), bool)
    there[keep] = True
    return at[np.repeat(there, n)]


def covered(m: int, at: np.ndarray, wids: np.ndarray, wn: np.ndarray, wat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The postings at positions inside phrases of ``m`` words that start at ``at``: no other can take part in a longer phrase."""
    inside = np.unique((at[:, None] + np.arange(m)).ravel())
    place = np.searchsorted(inside, wat)
    there = place < len(inside)
    there[there] = inside[place[there]] == wat[there]
    number = np.repeat(np.arange(len(wids)), wn)[there]
    own, counts = np.unique(number, return_counts=True)
    return wids[own], counts, wat[there]


def group_of(p: np.ndarray, w: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(mixed(p.view(np.uint64)) + w.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def dealt(asks: dict[str, np.ndarray], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's longer phrases in the order group, p, w, and where each group begins in it."""
    g = group_of(asks["p"], asks["w"], groups)
    order = np.lexsort((asks["w"], asks["p"], g))
    return order, np.searchsorted(g[order], np.arange(groups + 1))


def pack_names(names: list[bytes]) -> bytes:
    """Names of languages and words, which hold no PIECE, compressed; the length of the result comes first."""
    import zstandard

    out = zstandard.ZstdCompressor(level=1).compress(PIECE.join(names))
    return len(out).to_bytes(4, "little") + out


def unpack_names(raw: bytes) -> tuple[list[bytes], bytes]:
    """The names, and what follows them."""
    import zstandard

    end = 4 + int.from_bytes(raw[:4], "little")
    return zstandard.ZstdDecompressor().decompress(raw[4:end]).split(PIECE), raw[end:]


def dealt_words(raw: bytes, groups: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """A chunk's words in the order of their groups, where each group begins in it, and their names."""
    import xxhash

    names = unpack_names(raw)[0]
    g = (np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    return order, np.searchsorted(g[order], np.arange(groups + 1)), names


def ids_told(told: pd.DataFrame, order: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The ids of what a chunk asked about, in its own order; -1 where the answer was no."""
    ids = np.full(len(order), -1, np.int64)
    for g, blob in zip(told["g"].tolist(), told["told"]):
        x, places = unpack(blob), order[cuts[g] : cuts[g + 1]]
        ids[places[np.unpackbits(x["keep"].astype(np.uint8), count=len(places)).astype(bool)]] = x["id"]
    return ids


def judged_words(g: int, chunks: list[int], blobs: list[bytes], least: int) -> pd.DataFrame:
    """``judged`` for words, which have their language and a space before them."""
    import pandas as pd

    names, counts, sizes = [], [], []
    for raw in blobs:
        own, rest = unpack_names(raw)
        names.append(pa.array(own, pa.binary()))
        counts.append(unpack(rest)["n"])
        sizes.append(len(own))
    known = pa.concat_arrays(names).dictionary_encode()
    number = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    a = np.bincount(number, np.concatenate(counts), len(known.dictionary)).astype(np.int64)
    often = a >= least
    rows, at = [], 0
    for chunk, size in zip(chunks, sizes):
        own = number[at : at + size]
        at += size
        if often[own].any():
            rows.append((chunk, g, pack(keep=np.packbits(often[own]), id=(g << 32) + own[often[own]]), None, None, None, None))
    for k in np.flatnonzero(often).tolist():
        lang, _, word = known.dictionary[k].as_py().rpartition(b" ")
        rows.append((None, None, None, (g << 32) + k, lang.decode(), word.decode(), int(a[k])))
    return pd.DataFrame(rows, columns=["of", "g", "told", "id", "lang", "word", "a"]).astype({c: "Int64" for c in ("of", "g", "id", "a")})


def judged(g: int, chunks: list[int], blobs: list[bytes], least: int) -> pd.DataFrame:
    """To each chunk, which of its longer phrases of group ``g`` all chunks together have ``least`` times, with their ids; and those phrases."""
    import pandas as pd

    parts = [unpack(x) for x in blobs]
    p, w, n = (np.concatenate([x[c] for x in parts]) for c in "pwn")
    order = np.lexsort((w, p))
    first = np.flatnonzero(np.r_[True, (p[order][1:] != p[order][:-1]) | (w[order][1:] != w[order][:-1])])
    a = np.add.reduceat(n[order], first)
    number = np.empty(len(p), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(p)]))
    often = a >= least
    rows, at = [], 0
    for chunk, x in zip(chunks, parts):
        own = number[at : at + len(x["p"])]
        at += len(own)
        if often[own].any():
            rows.append((chunk, g, pack(keep=np.packbits(often[own]), id=(g << 32) + own[often[own]]), None, None, None, None))
    where = order[first[often]]
    rows += [(None, None, None, *x) for x in zip(((g << 32) + np.flatnonzero(often)).tolist(), p[where].tolist(), w[where].tolist(), a[often].tolist())]
    return pd.DataFrame(rows, columns=["of", "g", "told", "id", "p", "w", "a"]).astype({c: "Int64" for c in ("of", "g", "id", "p", "w", "a")})


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = 4 << 20, group_asks: int = 1 << 19) -> tuple[DataFrame, DataFrame]:
    """-> (lang, phrase, words INT, a BIGINT), every phrase of up to ``longest`` words with a >= ``least`` occurrences; (lang, n BIGINT), all words of a language.

    A phrase has a list of the positions where it occurs, kept in chunks of whole texts, so that the list of a frequent
    phrase is as many short ones as there are chunks that have it, and no task holds more than a chunk. Chunks extend
    their lists by a word and tell the lengths, sorted and packed, to groups of phrases; a group sums the lengths over the
    chunks and answers with a bit each which phrases are frequent, and only their lists go on. The length of the lists is the exact frequency.
    A group takes about ``group_asks`` lengths, so that their number grows with the texts.
    """
    spark = docs.sparkSession
    chunks = written(index_chunks(docs, text_col, lang_col, chunk_bytes), "phrase-index")
    totals = written(chunks.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n")), "phrase-totals")
    kind = "chunk long, size long, lists binary"

    def row(own: pd.DataFrame, state: dict[str, np.ndarray]) -> pd.DataFrame:
        size = len(longer_lists(state)["p"])
        rows = own[["chunk"]].iloc[: 1 if size else 0]
        return rows.assign(size=size, lists=[pack(**state)] * len(rows))

    total = chunks.agg(F.sum("size")).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group_asks))

    def ask_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number, raw, n in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                order, cuts, names = dealt_words(raw.as_py(), groups)
                counts, there = unpack(n.as_py())["n"], np.flatnonzero(np.diff(cuts)).tolist()
                blobs = []
                for g in there:
                    own = order[cuts[g] : cuts[g + 1]]
                    blobs.append(pack_names([names[k] for k in own.tolist()]) + pack(n=counts[own]))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(there), pa.int64()), pa.array(there, pa.int64()), pa.array(blobs, pa.binary())], names=["of", "g", "told"])

    def judge_words(rows: pd.DataFrame) -> pd.DataFrame:
        return judged_words(int(rows["g"].iloc[0]), rows["of"].tolist(), rows["told"].tolist(), least)

    def begin(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if own.empty or told.empty:
            return own[["chunk"]].iloc[:0].assign(size=0, lists=b"")
        order, cuts, _ = dealt_words(own["words"].iloc[0], groups)
        m, ids = unpack(own["lists"].iloc[0]), ids_told(told, order, cuts)
        keep = np.flatnonzero(ids >= 0)
        return row(own, {"m": np.array([1]), "ids": ids[keep], "n": m["n"][keep], "at": kept_lists(m["n"], m["at"], keep)})

    answers = chunks.select("chunk", "words", "n").mapInArrow(ask_words, "of long, g long, told binary").groupBy("g").applyInPandas(judge_words, "of long, g long, told binary, id long, lang string, word string, a long")
    answers = written(answers, "phrase-words")
    words = answers.where("id is not null").select("id", "lang", "word", "a")
    levels = [words.select("id", "lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "a")]
    told = answers.where("told is not null").select("of", "g", "told")
    before = written(chunks.select("chunk", "words", F.col("blob").alias("lists")).groupBy("chunk").cogroup(told.groupBy("of")).applyInPandas(begin, kind), "phrase-lists")
    forget(chunks)
    for longer in range(2, longest + 1):
        total = before.agg(F.sum("size")).first()[0] or 0
        groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group_asks))

        def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for number, raw in zip(part.column(0).to_pylist(), part.column(1)):
                    asks = longer_lists(unpack(raw.as_py()))
                    order, cuts = dealt(asks, groups)
                    there = np.flatnonzero(np.diff(cuts)).tolist()
                    blobs = [pack(**{c: asks[c][order[cuts[g] : cuts[g + 1]]] for c in "pwn"}) for g in there]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(there), pa.int64()), pa.array(there, pa.int64()), pa.array(blobs, pa.binary())], names=["of", "g", "told"])

        def judge(rows: pd.DataFrame) -> pd.DataFrame:
            return judged(int(rows["g"].iloc[0]), rows["of"].tolist(), rows["told"].tolist(), least)

        answers = before.select("chunk", "lists").mapInArrow(ask, "of long, g long, told binary").groupBy("g").applyInPandas(judge, "of long, g long, told binary, id long, p long, w long, a long")
        answers = written(answers, "phrase-answers")
        found = answers.where("id is not null").select("id", "p", "w", "a")
        named = found.join(levels[-1].select(F.col("id").alias("p"), "lang", "phrase"), "p").join(words.select(F.col("id").alias("w"), "word"), "w")
        levels.append(written(named.select("id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.lit(longer).alias("words"), "a"), "phrase-level"))
        if longer == longest or levels[-1].isEmpty():
            break

        def go_on(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            if own.empty or told.empty:
                return own[["chunk"]].iloc[:0].assign(size=0, lists=b"")
            m = longer_lists(unpack(own["lists"].iloc[0]))
            order, cuts = dealt(m, groups)
            ids = ids_told(told, order, cuts)
            keep = np.flatnonzero(ids >= 0)
            at = kept_lists(m["n"], m["at"], keep)
            wids, wn, wat = covered(longer, at, m["wids"], m["wn"], m["wat"])
            return row(own, {"m": np.array([longer]), "ids": ids[keep], "n": m["n"][keep], "at": at, "wids": wids, "wn": wn, "wat": wat})

        told = answers.where("told is not null").select("of", "g", "told")
        after = written(before.groupBy("chunk").cogroup(told.groupBy("of")).applyInPandas(go_on, kind), "phrase-lists")
        forget(before), forget(answers)
        before = after
    forget(before)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.drop("id"), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): each phrase of two words or more at its lowest-scoring cut, ties to the earliest.

    The score floor(1000 * a * n / (l * r)) is exact: products are decimals of 38 digits.
    """
    own = phrases.where("words > 1").select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))
    cuts = own.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    parts = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(parts("left", "l"), ["lang", "left"]).join(parts("right", "r"), ["lang", "right"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang")
    wide = lambda c: f"cast({c} as decimal(17, 0))"
    score = F.expr(f"cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')} div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def unabsorbed(scores: DataFrame, phrases: DataFrame) -> DataFrame:
    """Without phrases that occur only inside one longer phrase.

    A phrase inside a longer one of the same frequency is inside one that is longer by one word, of that frequency too:
    so it is enough to look at phrases without their first or last word.
    """
    long = phrases.where("words > 2").select("lang", F.split("phrase", " ").alias("w"), "a")
    inner = long.select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", 1, F.size("w") - 1), " "), F.array_join(F.slice("w", 2, F.size("w") - 1), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return scores.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")


def first_of_each(rows: DataFrame, key: str, order: list, most: int, out: str) -> DataFrame:
    """The first ``most`` rows of each key with their rank: of ever fewer shares of a key, so that no task sorts all of a large one."""
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("__share", F.pmod(F.xxhash64(*rows.columns), F.lit(shares)))
    while shares > 1:
        rows = rows.withColumn(out, F.row_number().over(Window.partitionBy(key, "__share").orderBy(*order))).where(F.col(out) <= most)
        shares = shares // 16
        rows = rows.withColumn("__share", F.col("__share") % max(1, shares))
    return rows.drop("__share").withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(out) <= most)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = 4 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, all BIGINT but the strings): the ``top`` phrases of each language.

    A-Z are lower-cased; texts are split at [.,;:!?\\x0A-\\x0D] into pieces, those at spaces and tabs into words. See
    ``frequent_phrases`` for the phrases, ``scored`` for the score and ``unabsorbed`` for the phrases left out. Order:
    score and a descending, phrase ascending by bytes.

    Null text: empty. Null language: ``und``, one language with texts so marked. Texts are read whole, however long;
    one longer than a chunk is a chunk. Repeated rows count as often as they are given. Ties go by the order above, so
    the result does not depend on partitions or chunks. Empty table: no rows. Other columns are not looked at,
    whatever their names.
    """
    phrases, totals = frequent_phrases(docs, least, longest, text_col, lang_col, chunk_bytes)
    left = written(unabsorbed(scored(phrases, totals), phrases), "phrase-scores")
    ranked = first_of_each(left, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
