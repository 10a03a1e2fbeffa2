import math
from collections import Counter

from tarnlight.llm import search as s

from .cases import awkward, prose, table


def brute(docs, queries, k):
    """Rows (item_id, rank, doc_id, score) of every document scored for every query."""
    held = [(d, s.terms_of(t)) for d, t in docs if t is not None]
    n, mean = len(held), sum(len(t) for _, t in held) / max(1, len(held))
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in queries:
        terms, found = set(s.terms_of(text or "")), []
        for doc, words in held:
            tf = Counter(words)
            parts = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (s.K1 + 1) / (tf[w] + s.K1 * (1 - s.B + s.B * len(words) / mean)) for w in terms if tf[w]]
            if parts:
                found.append((-round(math.fsum(parts), 9), doc is None, doc or 0, doc))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def test_top_k_equals_brute_force_over_many_shards(spark, monkeypatch):
    docs = [(i, prose(5 + i * 7 % 90, i % 40)) for i in range(160)] + [(r[0], r[1]) for r in awkward() if r[0] != 6]
    queries = [(i, prose(12, i)) for i in range(25)] + [(30, None), (31, ""), (32, "unheardof"), (33, "one one"), (33, "one one"), (None, prose(9, 3))]
    monkeypatch.setattr(s, "SHARD_WORDS", 900)
    monkeypatch.setattr(s, "BLOCK", 4)
    df = table(spark, [(d, t, "en", "s", 1) for d, t in docs], extra=True).repartition(3)
    q = spark.createDataFrame(queries, "item_id long, text string")
    for k in (1, 5):
        got = Counter((r[0], r[1], r[2], r[3]) for r in s.search(s.index(df), q, k, batch=7).collect())
        assert got == brute(docs, queries, k)


def test_empty_tables(spark):
    none = table(spark, [])
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert s.search(s.index(none), q).count() == 0
    assert s.search(s.index(table(spark, awkward())), q.limit(0)).count() == 0
