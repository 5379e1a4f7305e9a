"""Merge replay against the tiktoken library."""

import base64
import random

import public_tokenizers
import tiktoken

from siltstone.llm.bpe import ReplayEncoder, bpe_round_trip

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    out = ["", "Hello world's  \n\n x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "é" * 50, "日本語 текст 123 ½ ​﻿<|endoftext|>", "\x1c\x1d a\x85b c  d", " \t\x0b\x0c\r\n" * 3]
    for _ in range(200):
        n = rng.randrange(1, 60)
        out.append("".join(rng.choice(["a", "b", "th", "er", "ing", " ", "  ", "\n", "É", "ß", "7", "42", ".", "!!", "'s", "'ll", "😀", "の", chr(rng.randrange(32, 0xD7FF))]) for _ in range(n)))
    out.append("".join(rng.choice("abcdefgh") for _ in range(20000)))
    return out


def test_replay_equals_library():
    enc, coder = plain(), ReplayEncoder(PATH, public_tokenizers.PATTERN)
    ts = texts()
    got = coder.encode(ts)
    for t, g in zip(ts, got):
        want = enc.encode_ordinary(t)
        assert g == b"".join(i.to_bytes(4, "little") for i in want), repr(t)
        assert coder.decode(g) == t.encode()


def test_every_code_point_splits_alike():
    enc, coder = plain(), ReplayEncoder(PATH, public_tokenizers.PATTERN)
    cps = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    odd = []
    for a in range(0, len(cps), 64):
        t = "".join(f"a{c} {c}1{c}." for c in cps[a : a + 64])
        if coder.encode([t])[0] != b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(t)):
            odd += [c for c in cps[a : a + 64] if coder.encode([f"a{c} {c}1{c}."])[0] != b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(f"a{c} {c}1{c}."))]
    assert not odd, [hex(ord(c)) for c in odd][:20]


def test_lower_pair_created_by_a_merge_comes_first():
    """Ranks under which a merge creates a pair of lower rank than its own."""
    import regex

    coder = ReplayEncoder.__new__(ReplayEncoder)
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 300, b"bc": 310, b"xabc": 299, b"ca": 320}
    coder._load(ranks, regex.compile(r"\w+").findall)
    enc = tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    for w in ("abcabc", "xabcxabc", "cabca", "abcaabcabc", "bcabcbc"):
        assert coder.encode([w])[0] == b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(w)), w


def test_rows(spark):
    rows = [(1, "some text"), (2, None), (None, "x"), (1, "some text"), (3, "")]
    df = spark.createDataFrame([(a, b, 9) for a, b in rows], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.decoded).decode()) for r in bpe_round_trip(df, PATH, public_tokenizers.PATTERN).collect()), key=str)
    assert [(d, t) for d, _, t in got] == sorted(((d, t or "") for d, t in rows), key=str)
    assert bpe_round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_both_replays_equal_library_under_random_ranks():
    import regex

    rng = random.Random(9)
    for _ in range(60):
        ranks = {bytes([i]): i for i in range(256)}
        parts = [b"a", b"b", b"c"]
        for _ in range(rng.randrange(5, 60)):
            t = rng.choice(parts) + rng.choice(parts)
            if t not in ranks and len(t) < 9:
                ranks[t] = 0
                parts.append(t)
        new = [t for t in ranks if len(t) > 1]
        rng.shuffle(new)  # any order: merges may create lower pairs than their own
        ranks |= {t: 256 + i for i, t in enumerate(new)}
        coder = ReplayEncoder.__new__(ReplayEncoder)
        coder._load(ranks, regex.compile(r"\w+").findall)
        enc = tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(50)]
        want = [b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(w.decode())) for w in words]
        assert coder.replay(words) == want
        assert [t if w not in ranks else x for w, x, t in zip(words, want, coder.replay_together(words))] == want
        assert coder.encode_words(words) == want


def test_chunks_and_long_texts(spark):
    rng = random.Random(4)
    enc = plain()
    rows = [(f"id{i}", "".join(rng.choice(["ab", "cd ", " the", "\n", "é", "xyz", "12 "]) for _ in range(rng.randrange(0, 300)))) for i in range(300)]
    rows += [("long", " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))), ("one", "z" * 30_000), (None, None), ("id1", rows[1][1])]
    df = spark.createDataFrame([(a, b, 1, "c") for a, b in rows], "doc_id string, text string, n int, chunk string").repartition(3)
    want = sorted(((d, b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(t or "")), (t or "").encode()) for d, t in rows), key=str)
    for size, most in ((1 << 20, 10), (2000, 100_000), (2000, 3)):
        out = bpe_round_trip(df, PATH, public_tokenizers.PATTERN, chunk_chars=size, most_words=most)
        assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out.collect()), key=str) == want
