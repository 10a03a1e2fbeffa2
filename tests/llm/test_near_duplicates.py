import random
import re

import numpy as np
import pytest

from tarnlight.llm import near_duplicates as nd
from tarnlight.llm import pairs as p

from .cases import awkward, prose, table


def gram_set(text, n=nd.N):
    words = [re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) or w.lower() for w in text.split()]
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, threshold=nd.THRESHOLD):
    """(doc_id, class_id, links) of each row, from all pairs of rows."""
    sets = [gram_set(t or "") for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)
    pairs = [(i, j) for i, x in enumerate(sets) for j in range(i) if x and (y := sets[j]) and len(x & y) >= threshold * len(x | y)]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[label[k]] = min(d, least.get(label[k], d))
    return sorted(((d, least.get(label[k]), links[k]) for k, (d, _) in enumerate(rows)), key=repr)


def varied():
    rows = []
    for k in range(40):
        words = prose(80, k).split()
        rows.append((10 * k, " ".join(words)))
        for v in range(k % 5):
            w = list(words)
            for i in range(v * 2 + 1):
                w[(7 * i + 11 * v) % 80] = f"changed{v}{i}"
            rows.append((10 * k + v + 1, " ".join(w)))
    return rows


def frame(spark, rows, **options):
    return table(spark, [(d, t, "en", "s", 1) for d, t in rows], **options)


def joined(df):
    return sorted(map(tuple, nd.jaccard_join(df).collect()), key=repr)


def test_links_and_classes_against_brute_force(spark):
    rows = varied() + [(900 + i, "same words for all") for i in range(30)] + [(950, "Same words, for ALL!"), (951, "too few"), (952, "too few")]
    assert joined(frame(spark, rows, extra=True)) == brute(rows)  # the band hashes are fixed, so is what they find
    assert nd.recall(nd.THRESHOLD) > 0.99


def test_one_of_each_group_stays(spark):
    rows = varied() + [(3, varied()[0][1])]
    df = frame(spark, rows, extra=True)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})


def test_awkward_rows(spark):
    rows = awkward()
    df = table(spark, rows, extra=True)
    assert joined(df) == brute([r[:2] for r in rows])
    kept = nd.keep_one(df).collect()
    assert sum(r["doc_id"] in (10, 11) for r in kept) == 1
    rest = [r for r in rows if r[0] not in (10, 11)]
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept if r["doc_id"] not in (10, 11)) == sorted(repr(r[:2]) for r in rest)
    none = table(spark, [])
    assert nd.jaccard_join(none).count() == 0 == nd.keep_one(none).count()


@pytest.mark.parametrize("items", [8, 1024])
def test_large_group_in_one_band(spark, monkeypatch, items):
    """A tile of more than BLOCK_ITEMS is split into pairs of blocks, and finds the same."""
    monkeypatch.setattr(p, "BLOCK_ITEMS", items)
    base = prose(60, 1).split()
    rows = [(i, " ".join(base[:20] + [f"own{i}"] + base[20:])) for i in range(60)]
    assert joined(frame(spark, rows)) == sorted(((i, 0, 59) for i in range(60)), key=repr)
    assert nd.keep_one(frame(spark, rows)).count() == 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in p.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


def test_items_meet_by_shared_bands(spark):
    keys = np.array([[1 << 32, 5], [1 << 32, 6], [2, 6], [3, 7], [1, 8]], np.uint64)
    rows = [(int(r["part"].as_py()), r["ids"].as_py(), r["lows"].as_py()) for r in _rows(p.packed_bands(np.array([10, 20, 30, 40, 10]), keys, 2))]
    got = {(r["hub"], r["id"]): r["mask"] for r in p.met(spark.createDataFrame(rows, p.PACKED), 2).collect()}
    assert got == {(10, 10): 1, (10, 20): 1, (20, 20): 2, (20, 30): 2}


def _rows(batch):
    return [{c: batch.column(c)[i] for c in batch.schema.names} for i in range(batch.num_rows)]


@pytest.mark.parametrize("sides", [False, True])
def test_compared_against_all_pairs(sides):
    rng = random.Random(5)
    for m, pool in ((5, 12), (60, 12), (60, 4000)):
        sets = [np.array(sorted(rng.sample(range(pool), rng.randint(5, 9))), np.uint64) for _ in range(m)]
        masks = np.array([rng.randrange(1, 8) for _ in range(m)])
        side = np.array([rng.randrange(2) for _ in range(m)]) if sides else None
        i, j = p.compared(np.arange(m), masks, side, sets, 0.6)
        want = {
            (x, y)
            for y in range(m)
            for x in range(y)
            if masks[x] & masks[y] and (side is None or side[x] != side[y]) and len({*sets[x]} & {*sets[y]}) >= 0.6 * len({*sets[x]} | {*sets[y]})
        }
        assert set(zip(i.tolist(), j.tolist())) == want
        root = p.rooted(i, j, m)
        for _ in range(m):
            assert all(root[x] == root[y] for x, y in want)
