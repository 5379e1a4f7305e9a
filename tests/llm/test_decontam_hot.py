"""A document that repeats a phrase of very many items needs no memory for every pair of them."""

import random
import tracemalloc

from tests.llm.test_decontam import plain

from siltstone.llm import decontam
from siltstone.llm.decontam import Matcher, contaminated


def test_hot_phrase_is_counted_once():
    phrase = " ".join(f"p{i}" for i in range(14))
    items = [(i, f"{phrase} " + " ".join(f"i{i}w{j}" for j in range(26))) for i in range(20_000)]
    items.append((20_000, f"{phrase} {phrase}"))
    matcher = Matcher(items, 5, 0.8)
    text = f"{phrase} " * 500
    tracemalloc.start()
    found = matcher.find(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {m[0] for m in found} == {20_000} and len(found) == 250
    assert peak < 100 << 20
    assert matcher.find("nothing of the kind here at all") == [] and not matcher.common.any()


def test_slices_do_not_change_results(monkeypatch):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(9)}" for _ in range(n)]
    items = [(i, " ".join(words(rng.randrange(1, 20)))) for i in range(60)]
    docs = []
    for d in range(40):
        w = words(rng.randrange(0, 80))
        for _ in range(3):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(items)[1].split() * rng.randrange(1, 3)
        docs.append((d, " ".join(w)))
    want = [x for x in plain(docs, items)]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(decontam, "SLICE", size)
        matcher = Matcher(items, 5, 0.8)
        got = sorted((d, i, s, n, round(score, 9)) for d, t in docs for i, s, n, score, _ in matcher.find(t))
        assert [g for g in got if g[3] == len(dict(items)[g[1]].split())] == want and want


def test_blocks_of_items_give_what_one_block_gives(spark):
    items = [(i, " ".join(f"b{i}c{j}" for j in range(12))) for i in range(30)]
    docs = [(d, "lead " + " ".join(items[i][1] for i in (d, (d * 7) % 30)) + " tail") for d in range(20)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, contaminated(a, b, block_bytes=size).collect())) for size in (16 << 20, 400))
    assert one == many and len(one) >= 39
