"""SimHash groups against brute force."""

import random

import numpy as np
import xxhash

from siltstone.llm.simhash import close_matrix, close_pairs, fingerprint, link_buckets, near_duplicates, planes_of, shingles_of, tables_for


def plain_fingerprint(text, size=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, radius):
    comp = {i: d for i, (d, _) in enumerate(rows)}
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= radius and comp[i] > comp[j]:
                    comp[i], changed = comp[j], True
    return comp


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(40, 200))) for _ in range(12)]
    out = []
    for i in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "x" + str(rng.randrange(99))
        out.append((i * 3 + 5, " ".join(words).upper() if i % 7 == 0 else "\n".join(words)))
    return out


def test_fingerprint_contract():
    for t in ["", None, " \t\n", "one", "One TWO three", "a b c d e f g", "É é É b c d e\x0bf", "x " * 500]:
        assert fingerprint(shingles_of(t, 4)) == plain_fingerprint(t)


def test_bit_sliced_counts():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    b = a ^ np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in a], np.uint64)
    for radius in (0, 1, 3, 4, 7, 16):
        assert (close_pairs(a, b, radius) == (np.bitwise_count(a ^ b) <= radius)).all()
        assert (close_matrix(a, planes_of(b), len(b), radius) == (np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)).all()


def test_masks_cover_every_pattern():
    for radius, blocks in ((4, 6), (4, 8), (2, 5)):
        masks = tables_for(radius, blocks)
        rng = np.random.default_rng(2)
        for _ in range(300):
            diff = sum(1 << int(k) for k in rng.choice(64, radius, replace=False))
            assert any(diff & m == 0 for m in masks)


def test_forest_in_large_and_small_buckets():
    rng = np.random.default_rng(5)
    center = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fp = np.array([int(center[rng.integers(6)]) ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False)) for _ in range(300)], np.uint64)
    key = np.sort(rng.integers(0, 30, 300))
    i, j = link_buckets(key, np.full(300, 2), fp, 4)
    up = {int(a): int(b) for a, b in zip(i, j)}
    want = plain_components([(k, (sum(int(key[k]) << 5 * r for r in range(9)) << 64) | int(fp[k])) for k in range(300)], 4)
    assert {k: up.get(k, k) for k in range(300)} == want


def test_groups_match_brute_force(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, " \t"), (1003, "short one"), (1004, "SHORT one"), (7, "tie"), (7, "tie")]
    df = spark.createDataFrame([(d, t, "x", d) for d, t in rows], "doc_id long, text string, fp string, node long").select("doc_id", "text", "fp", "node")
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    want = plain_components(fps, 4)
    want = sorted((d, f"{f:016x}", want[i]) for i, (d, f) in enumerate(fps))
    for tile in (None, 5):
        got = sorted((r.doc_id, r.fingerprint, r.component) for r in near_duplicates(df, tile=tile).collect())
        assert got == want


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "never seen elsewhere at all")], "doc_id long, text string")
    got = {(r.doc_id, r.component) for r in near_duplicates(df).collect()}
    assert (None, 4) in got and (4, 4) in got
    assert near_duplicates(df.limit(0)).count() == 0
