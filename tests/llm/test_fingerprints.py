import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tarnlight.llm import fingerprints as fp

from .cases import awkward, prose, table


def brute(data: bytes) -> str:
    counts = [0] * fp.BUCKETS
    for p in range(len(data) - 4):
        for (i, j, k), salt in zip(fp.TRIPLETS, fp.SALTS):
            counts[(fp.TABLES[0][data[p + i]] ^ fp.TABLES[1][data[p + j]] ^ fp.TABLES[2][data[p + k]] ^ salt) % fp.BUCKETS] += 1
    q1, q2, q3 = (sorted(counts)[fp.BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    code = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    head = f"{min(255, fp.length_code(len(data))):02x}" + "".join(f"{min(15, 16 * q // q3) if q3 else 0:x}" for q in (q1, q2))
    return head + "".join(f"{code[i] << 2 | code[i + 1]:x}" for i in range(0, fp.BUCKETS, 2))


def test_digests_match_brute_force_and_take_awkward_rows(spark):
    rows = [*awkward(), (20, prose(300, 9), "en", "s", 1)]
    got = fp.with_digest(table(spark, rows, extra=True)).collect()
    want = Counter((r[0], None if r[1] is None else len(r[1].encode()), None if r[1] is None else brute(r[1].encode())) for r in rows)
    assert Counter(map(tuple, got)) == want


def test_difference_is_bounded_and_grows_with_edits(spark):
    base = prose(800, 3)
    texts = [base, base.replace("a", "o", 5), prose(800, 4), "", None]
    df = fp.with_digest(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    a, b = df.toDF("i", "x", "da"), df.toDF("j", "y", "db")
    got = {(r[0], r[1]): r[2] for r in a.crossJoin(b).select("i", "j", fp.difference(a.da, b.db)).collect()}
    assert all(got[i, i] == 0 for i in range(4)) and got[0, 4] is None
    assert 0 < got[0, 1] < got[0, 2] <= fp.BOUND and got[0, 3] == fp.BOUND
    assert all(got[i, j] == got[j, i] for i in range(4) for j in range(4))


def linked(rows, raw, near=fp.NEAR):
    """(doc_id, class_id, links) of rows (doc_id, n_bytes or None), raw having the bytes of their digests."""
    label, links, pairs, table = list(range(len(rows))), [0] * len(rows), [], fp.body_table()
    has = [k for k, r in enumerate(rows) if (r[1] or 0) >= fp.LEAST_BYTES]
    for x, i in enumerate(has[:-1]):
        rest = has[x + 1 :]
        total = fp.score_of(np.broadcast_to(raw[i], (len(rest), 34)), raw[rest], table)
        pairs += [(i, rest[j]) for j in np.flatnonzero(total <= near)]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for _ in rows:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[label[k]] = min(r[0], least.get(label[k], r[0]))
    return [(r[0], least.get(label[k]), links[k]) for k, r in enumerate(rows)], pairs


def checked(spark, df):
    """The rows of fingerprinted(), equal to what all pairs give."""
    rows = fp.with_digest(df).collect()
    raw = np.array([list(bytes.fromhex(r["digest"] or "00" * 34)) for r in rows], np.uint8).reshape(-1, 34)
    want, pairs = linked(rows, raw)
    got = fp.fingerprinted(df).collect()
    assert sorted(map(repr, ((r["doc_id"], r["class_id"], r["links"]) for r in got))) == sorted(map(repr, want))
    assert Counter(tuple(r)[:3] for r in got) == Counter(map(tuple, rows))
    return rows, pairs


def test_links_are_those_of_all_pairs(spark):
    rows, pairs = checked(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert len(pairs) > 100
    assert any(rows[i]["digest"][:4] != rows[j]["digest"][:4] for i, j in pairs)  # headers that differ
    found = 1 - (1 - (1 - fp.NEAR / 384) ** fp.BITS) ** fp.TABLES_OF_BITS
    assert found > 0.999


def test_links_of_awkward_rows(spark):
    checked(spark, table(spark, [*awkward(), (30, "abcd", "en", "s", 4), (31, "abce", "en", "s", 4)], extra=True))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_tables_without_texts(spark, rows):
    assert fp.fingerprinted(table(spark, rows)).count() == len(rows)


def dense_run(n):
    """(band, rows) of n digests, in the order of their length codes, which share the first sample and of which most are near."""
    rng = np.random.default_rng(4)
    codes = np.repeat(rng.integers(1, 3, (1, fp.BUCKETS)), 4 * n, axis=0)
    for _ in range(5):
        codes[np.arange(4 * n), rng.integers(0, fp.BUCKETS, 4 * n)] = rng.integers(0, 4, 4 * n)
    body = (codes[:, 0::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]).astype(np.uint8)
    rows = np.c_[rng.integers(100, 103, 4 * n), rng.integers(0x76, 0x78, 4 * n), body].astype(np.uint8)
    bands = fp.bit_bands(rows)[:, 0]
    rows = np.unique(rows[bands == np.bincount(bands - bands.min()).argmax() + bands.min()][:n], axis=0)
    return fp.bit_bands(rows)[:, 0], rows


def test_links_of_a_dense_run_are_counted_in_bounded_memory(monkeypatch):
    bands, rows = dense_run(3000)
    assert len(rows) > 2000 and len(set(bands.tolist())) == 1
    ends = np.searchsorted(rows[:, 0], rows[:, 0].astype(int) + 3, side="right")
    weights = np.arange(len(rows)) % 3 + 1
    monkeypatch.setattr(fp, "PAIR_BLOCK", 20_000)
    tracemalloc.start()
    found = fp.Near(0, rows, weights, fp.NEAR)
    found.compare(ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    table, pairs = fp.body_table(), 0
    for i in range(0, len(rows), 50):
        near = fp.score_of(np.broadcast_to(rows[i], rows.shape), rows, table) <= fp.NEAR
        near[i] = False
        assert found.links[i] == weights[near].sum()
        assert (found.label[near] == found.label[i]).all()
        pairs += 50 * int(near.sum()) // 2
    assert pairs > 1_000_000 and peak < 16 * pairs


def test_pairs_of_digests_have_narrow_ids(spark):
    base = prose(400, 8)
    df = fp.with_digest(table(spark, [(i, base.replace("a", "o", i), "en", "s", 1) for i in range(6)]))
    classes = df.selectExpr("doc_id AS id", "unhex(digest) AS digest", "1L AS weight")
    got = fp.near_digests(classes)
    assert dict(got.dtypes) == {"id": "bigint", "root": "bigint", "links": "bigint"}
    assert {r["id"] for r in got.collect()} <= set(range(6))
