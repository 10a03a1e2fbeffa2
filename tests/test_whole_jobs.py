"""Results that neither the size of a table nor the way it is divided may change, against brute force."""

import datetime as dt
import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlight import queries as q
from tarnlight.operators import communities, duplicates, graph, ingest, terrain, text_index
from tarnlight.operators import vector_search as vs
from tarnlight.operators.components import components

VECTOR = "id string, embedding array<double>"


def random_vectors(n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m[n // 2 : n // 2 + 5] = m[:5]  # equal ones tie
    m[n - 1] = 0
    return m


def cosines(m):
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    u = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return np.round(u @ u.T, 12)


@pytest.mark.parametrize("n, k, elements", [(300, 7, 256), (300, 7, 1 << 20), (40, 60, 64), (1, 3, 64)])
def test_neighbours_are_exact_whatever_the_blocks(spark, monkeypatch, n, k, elements):
    """no number of vectors switches to cells, and blocks change nothing."""
    assert inspect.signature(vs.neighbours).parameters["exact_rows"].default is None
    monkeypatch.setattr(vs, "BLOCK_ELEMENTS", elements)
    monkeypatch.setattr(vs, "TILE", (16, 24))
    m, ids = random_vectors(n), [f"n{i:04d}" for i in range(n)]
    s = cosines(m)
    want = {(ids[i], r + 1): ids[j] for i in range(n) for r, j in enumerate(sorted((j for j in range(n) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k])}
    rows = vs.neighbours(spark.createDataFrame(list(zip(ids, m.tolist())), VECTOR), k).collect()
    assert {(r["id"], r["rank"]): r["other"] for r in rows} == want and len(rows) == len(want)
    assert all(abs(s[int(r["id"][1:]), int(r["other"][1:])] - r["sim"]) < 1e-9 for r in rows)
    pairs = vs.close_pairs(spark.createDataFrame(list(zip(ids, m.tolist())), VECTOR), 0.4).collect()
    assert {(r["a"], r["b"]) for r in pairs} == {(ids[i], ids[j]) for i in range(n) for j in range(i + 1, n) if s[i, j] >= 0.4}
    assert len({(r["a"], r["b"]) for r in pairs}) == len(pairs)


def write_notes(spark, sf, m, label=None):
    docs = [(i, f"text {i}", "en", "src1", 6) for i in range(len(m))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    rows = [(i, list(map(float, v)), 0 if label is None else int(label[i])) for i, v in enumerate(m)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{sf}/embeddings.parquet")


def test_dup_edges_are_all_pairs(spark, tmp_path):
    """of 520 near copies none has only 64 nearest and 400 of its bucket."""
    m = np.random.default_rng(2).normal(0, 0.01, (520, 64)) + 1.0
    write_notes(spark, tmp_path, m)
    assert q.QUERIES["dup_edges"](spark, str(tmp_path)).where("a < b").distinct().count() == 520 * 519 // 2


def items_of(spark, m, buckets=8):
    rows = [(f"n{i:04d}#0", m[i].tolist(), int(i * 7 % buckets)) for i in range(len(m))]
    return spark.createDataFrame(rows, "id string, embedding array<double>, bucket int"), [(r[0], r[2]) for r in rows]


def test_candidates_of_buckets_against_all_pairs(spark, monkeypatch):
    """what is sorted is the items of a bucket, not the pairs of items; F1: edges of candidates without a row a pair."""
    m = random_vectors(120)
    found, rows = items_of(spark, m)
    near = {a: [b for b, y in rows if b != a and bin(x ^ y).count("1") <= 1][:9] for a, x in rows}
    assert {a: sorted(r["b"] for r in duplicates.bucket_candidates(found, 9).where(F.col("a") == a).collect()) for a, _ in rows[::17]} == {a: near[a] for a, _ in rows[::17]}
    assert duplicates.bucket_candidates(found, 9).count() == sum(map(len, near.values()))
    assert duplicates.least_of_buckets(found, 9, []).selectExpr("max(size(near))").first()[0] == 10
    monkeypatch.setattr(duplicates, "PART", 4)
    s, at = cosines(m), {a: i for i, (a, _) in enumerate(rows)}
    got = {(r["a"], r["b"]) for r in duplicates.bucket_edges(found, 0.3, 9).collect()}
    assert got == {(a, b) for a in near for b in near[a] if s[at[a], at[b]] >= 0.3} and got


def test_links_join_what_all_pairs_join(spark, monkeypatch):
    """the components of all pairs from few of them."""
    monkeypatch.setattr(vs, "BLOCK_ELEMENTS", 256)
    monkeypatch.setattr(vs, "TILE", (8, 16))
    m = random_vectors(200)
    s = cosines(m)
    for threshold in (0.5, 0.8, 0.95):
        vectors = spark.createDataFrame([(i, m[i].tolist()) for i in range(200)], "id long, embedding array<double>")
        label = vs.united(np.arange(200), *np.nonzero(s >= threshold))
        sizes = np.bincount(label, minlength=200)
        links = vs.close_links(vectors, threshold)
        found = components(links).collect()
        assert {(r["id"], r["component"]) for r in found} == {(i, int(label[i])) for i in range(200) if sizes[label[i]] > 1}
        assert threshold > 0.5 or links.count() < 200 * 4 < (s >= threshold).sum() / 2


def test_rounds_of_merges_are_the_greedy_ones(spark):
    """no component is one task's work, and the clusters are those of the greedy order, with ties."""
    rng = np.random.default_rng(3)
    sims = {(f"p{a:03d}#0", f"p{b:03d}#0"): round(float(rng.random()), 1) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.5}
    links, left, want = dict(sims), {x: [x] for p in sims for x in p}, None
    while links:  # the greedy order, a pair at a time
        a, b = min(links, key=lambda p: (-links[p], p))
        left[a] += left.pop(b)
        pair = lambda x, y: links.get((min(x, y), max(x, y)))
        new = {(min(a, k), max(a, k)): min(pair(a, k), pair(b, k)) for k in left if k != a and pair(a, k) is not None and pair(b, k) is not None}
        links = {p: s for p, s in links.items() if a not in p and b not in p} | new
    want = {"|".join(sorted(c)) for c in left.values() if len(c) > 1}
    pairs = spark.createDataFrame([(*p, s) for p, s in sims.items()], "a string, b string, sim double")
    for at_once in (10**6, 0, 100):
        rows = duplicates.clusters(pairs, at_once).collect()
        assert {r["cluster_id"] for r in rows} == want and all(r["id"] in r["cluster_id"].split("|") for r in rows)
        assert len(rows) == sum(len(c.split("|")) for c in want)


def test_every_nth_when_partitions_are_merged(spark):
    """the numbers within a partition and the counts of the partitions come from one division of the rows."""
    held = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("lang")).repartition(3)
        assert sorted(r["id"] for r in graph.every_nth(rows, 260).collect()) == list(range(0, 20_000, 77))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_communities_are_many():
    """merging takes no pass over all communities for each small one; sizes, ties and isolated ones as before."""
    label = {0: 30, 1: 30} | {c: 1 for c in range(2, 60_000)}
    to = communities.merged_small(label, [(1, 2, 0.5), (2, 3, 0.4), (0, 3, 0.3)], 12)
    assert to[0] == 0 and to[1] == to[2] == to[3] == 1 and {to[c] for c in range(4, 60_000)} == {1}


def test_edges_of_the_graph_are_made_once(spark):
    """A query that uses the edges several times doesn't look for neighbours again."""
    plan = q._edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "-edges-" in plan and not any(x in plan for x in ("Window", "MapInArrow", "Aggregate"))


def test_density_peak_against_all_notes(spark):
    """from bounds and few sums what all sums give; several notes of a place, one note, equal places."""
    rng = np.random.default_rng(5)
    rows = [(i, int(c), *map(float, rng.normal((300, 500), 120 + 60 * c)), float(rng.uniform(0.35, 2))) for i, c in enumerate(rng.integers(0, 2, 600))]
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:100])] + [(5000, 2, 1.0, 2.0, 1.0)] + [(6000 + i, 3, 7.0, 8.0, 1.0) for i in range(3)]
    points = spark.createDataFrame(rows, "id long, community int, x double, y double, density_weight double")
    got = {r["community"]: (r["peak_x"], r["peak_y"]) for r in terrain.density_peak(points).collect()}
    for c in range(4):
        own = sorted(r for r in rows if r[1] == c)
        x, y, w = (np.array([r[k] for r in own]) for k in (2, 3, 4))
        s = np.round(np.exp(-(np.subtract.outer(x, x) ** 2 + np.subtract.outer(y, y) ** 2) / (2 * 54.0**2)) @ w, 9)
        b = min(range(len(own)), key=lambda i: (-s[i], own[i][0]))
        near = (x - x[b]) ** 2 + (y - y[b]) ** 2 <= 48.6**2
        weight = np.maximum(s[near] - s[near].min(), 1e-6)
        assert np.allclose(got[c], [(x[near] * weight).sum() / weight.sum(), (y[near] * weight).sum() / weight.sum()], atol=1e-6)
    corners = spark.createDataFrame([(0, 0, 0, 1.0, True, 2.0), (0, 300, 0, 90.0, True, 2.0)], "community int, gx int, gy int, w double, cell boolean, h double")
    assert [tuple(r) for r in terrain.dense_cells(corners, 54.0).collect()] == [(0, 300, 0)]


def test_runs_of_the_text_index(spark, tmp_path, monkeypatch):
    """no shuffle on the way from texts to runs; chunks that go, change and come back."""
    def chunks(**texts):
        return spark.createDataFrame([("n", k, 0, f"h {v}", v) for k, v in texts.items()], "lookup string, path string, chunk int, hash string, text string")

    assert "Exchange" not in text_index.runs(chunks(a="x y"))._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(text_index, "RUN_WORDS", 3)
    index = None
    for k, texts in enumerate(({"a": "x y x", "b": "y", "c": "z z"}, {"a": "x q", "b": "y"}, {"a": "x y x", "b": "y", "c": "z z", "d": ""}, {"d": "x"})):
        text_index.write(text_index.updated(index, chunks(**texts)), f"{tmp_path}/{k}")
        index = text_index.read(spark, f"{tmp_path}/{k}")
        want = {(p, t): [i for i, w in enumerate(v.split()) if w == t] for p, v in texts.items() for t in v.split()}
        rows = index.postings.collect()
        assert {(r["path"], r["term"]): r["positions"] for r in rows} == want and len(rows) == len(want)
        assert {r["path"]: r["len"] for r in index.lengths.collect()} == {p: len(v.split()) for p, v in texts.items()}


def test_a_run_without_changes_writes_no_version(spark, tmp_path):
    """F8: nothing is written again where nothing changed, and texts are not in the way of the decision."""
    store = ingest.Store(spark, str(tmp_path / "store"))
    rows = [("n", f"p{i}", 0, f"h{i % 3}", f"text {i % 3}", None) for i in range(6)]
    read = spark.createDataFrame(rows, "lookup string, path string, chunk int, hash string, text string, error string")
    matched = read.select("lookup", "path")
    at = [dt.datetime(2024, 1, 1 + k, tzinfo=dt.timezone.utc) for k in range(3)]
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[1.0, float(len(t))] for t in texts]

    assert ingest.index(store, matched, read, embed, at[0]).first()["created"] == 3 and calls.value == 3
    version = store.state()["version"]
    assert ingest.index(store, matched, read, embed, at[1]).first()["skipped"] == 6 and calls.value == 3
    assert store.state()["version"] == version and store.last_scan() == at[1]
    left = read.where("path <> 'p5'")
    ingest.index(store, left.select("lookup", "path"), left, embed, at[2])
    assert store.state()["version"] == version + 1 and store.chunks().count() == 5 and store.text_index().lengths.count() == 5
