import random
from collections import Counter

import pytest

from tarnlight.llm import packing as p

from .cases import awkward, prose, table


def naive(lengths, capacity):
    room, where = [], []
    for n in lengths:
        fits = [(r, w) for w, r in enumerate(room) if r >= n]
        w = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(capacity)
        room[w] -= n
        where.append(w)
    return where


def test_best_fit_equals_a_linear_search():
    rng = random.Random(1)
    for capacity in (1, 2, 7, 64, 100, 2048):
        for _ in range(30):
            lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 120))), reverse=True)
            assert p.pack(lengths, capacity) == naive(lengths, capacity)


def test_windows_hold_each_word_once(spark):
    rows = awkward() + [(100 + i, prose(5 + i * 13 % 190, i), "en", "s", 1) for i in range(120)]
    windows = p.packed(table(spark, rows, extra=True), capacity=64, shard_words=1500).collect()
    texts = {(r[0], r[1].split()[0]): r[1] for r in rows if r[1] and r[1].split()}
    covered = Counter()
    for w in windows:
        assert w["n_words"] == sum(w["lengths"]) <= 64 and len(w["text"].split()) == w["n_words"]
        for d, start, size in zip(w["doc_ids"], w["starts"], w["lengths"]):
            covered[d] += size
            assert start % 64 == 0
            if d is not None and size < 64:
                own = [t for (i, _), t in texts.items() if i == d]
                assert any(" ".join(t.split()[start : start + size]) in " ".join(w["text"].split()) for t in own)
    want = Counter()
    for r in rows:
        want[r[0]] += len((r[1] or "").split())
    assert covered == +want
    assert len({w["window_id"] for w in windows}) == len(windows)
    assert sum(w["n_words"] < 64 for w in windows) < 0.2 * len(windows)


def test_overlong_documents_are_cut_into_full_windows_first(spark):
    got = p.packed(table(spark, [(1, prose(205, 1), "en", "s", 1), (2, prose(36, 2), "en", "s", 1)]), capacity=100).collect()
    assert sorted((w["n_words"], w["doc_ids"], w["starts"]) for w in got) == [(41, [2, 1], [0, 200]), (100, [1], [0]), (100, [1], [100])]


def test_shards_hold_a_bounded_number_of_words(spark):
    rows = [(i, prose(50, i), "en", "s", 1) for i in range(300)]
    got = p.packed(table(spark, rows), capacity=64, shard_words=1000).collect()
    words = Counter()
    for w in got:
        words[w["window_id"].split("-")[0]] += w["n_words"]
    assert len(words) >= 10 and max(words.values()) < 3000


def test_no_documents(spark):
    assert p.packed(table(spark, [])).count() == 0 == p.packed(table(spark, [(1, None, "", "", 1), (2, "  ", "", "", 1)])).count()
    with pytest.raises(ValueError):
        p.packed(table(spark, []), capacity=0)
