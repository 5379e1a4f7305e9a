"""Rows between the groups of the language model."""

import numpy as np

from siltstone.llm import lm


def test_rows_of_a_group_grow_neither_with_frequent_words_nor_with_the_groups():
    words = np.sort(lm.numbers_of(f"w{i}".encode() for i in range(3000)))
    none = np.zeros(0, np.int64)
    blob = lm.pack(u=words, at=np.arange(3000)[::-1].copy(), w=words, k=np.ones(3000, np.int64), n=np.arange(1, 3001), us=none, ws=none)
    for groups in (8, 200):
        rows = lm.first_seating(0, [blob, blob], groups, words)
        assert len(rows) <= 1 + 16 + 3, (groups, len(rows))  # before: 3,001 rows and one for each group
        sent = sorted((r[2], r[3]) for r in rows if r[1] == lm.SPREAD)
        sums = [lm.unpack(lm.spread_step(o, [b, b])[0][3]) for o, b in sent]
        assert np.concatenate([m["tables"] for m in sums])[:3000].tolist() == [2] * 3000
        assert np.concatenate([m["customers"] for m in sums])[:3000].tolist() == list(range(4 * 3000, 0, -4))


def test_slots_answer_the_words_of_their_groups():
    words, s, groups = np.sort(lm.numbers_of(f"w{i}".encode() for i in range(500))), lm.Settings(), 40
    home = lm.place(lm.mixed(words), groups)
    mine = words[home % lm.slots_of(groups) == 3]
    ask = lm.pack(word=mine, customers=np.full(len(mine), 2))
    first = lm.parent_step(3, [(0, ask), (7, ask)], [], groups, 0, 0, 0, s)
    known = {r[0]: lm.unpack(r[3]) for r in first if r[1] == lm.PARENT}
    assert sorted(known) == sorted(set(home[home % lm.slots_of(groups) == 3].tolist()))
    assert all((lm.place(lm.mixed(m["word"]), groups) == g).all() and (m["c"] == 4).all() for g, m in known.items())
    then = lm.parent_step(3, [(0, ask), (7, ask)], [r[3] for r in reversed(first) if r[1] == lm.PARENT], groups, len(mine), len(mine), 1, s)
    one = lm.parent_step(3, [(0, ask), (7, ask)], [lm.pack(word=mine, t=np.ones(len(mine), np.int64))], 1, len(mine), len(mine), 1, s)
    seats = lambda rows: {w: t for r in rows if r[1] == lm.PARENT for w, t in zip(*(lm.unpack(r[3])[k].tolist() for k in ("word", "t")))}
    assert seats(then) == seats(one)  # in however many groups
