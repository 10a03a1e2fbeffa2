import json
import random

import numpy as np
import pytest

from tarnlight.operators import communities, duplicates, profiles, terrain
from tarnlight.plans import mapping

CHUNKS = "lookup string, path string, chunk int, hash string, text string, embedding array<double>"


def blobs(n=30):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(2):
        for i in range(n):
            v = rng.normal(0, 0.1, 4)
            v[k] += 1
            rows.append(("ab"[k], f"/n/{k}{i:02d}.md", 0, f"h{k}{i}", f"alpha{k} beta{i} gamma{k}", v.tolist()))
    return rows


def test_map_of_two_groups(spark, tmp_path):
    m = mapping.build(spark.createDataFrame(blobs(), CHUNKS), mapping.MapOptions(knn_k=5))
    out = mapping.payload(m, cache=tmp_path / "labels.json")
    assert [c["noteCount"] for c in out["clusters"]] == [30, 30] and out["noteCount"] == 60 and out["vectorDim"] == 4
    groups = {n["lookup"]: {x["communityId"] for x in out["notes"] if x["lookup"] == n["lookup"]} for n in out["notes"]}
    assert sorted(map(len, groups.values())) == [1, 1] and groups["a"] != groups["b"]
    assert len({c["label"] for c in out["clusters"]}) == 2 and all(0 <= n["x"] <= out["width"] and 0 <= n["y"] <= out["height"] for n in out["notes"])
    assert len(out["terrain"]["levels"]) == 22 and all(level["segments"] for level in out["terrain"]["levels"][:5])
    again = mapping.payload(mapping.build(spark.createDataFrame(blobs(), CHUNKS).repartition(7), mapping.MapOptions(knn_k=5)))
    assert again["notes"] == out["notes"] and again["edges"] == out["edges"]
    mapping.write_json(out, tmp_path / "m.json")
    assert mapping.read_map(tmp_path / "m.json") == json.loads(json.dumps(out))
    figures = mapping.debug(m)
    assert sum(figures["bridgeHistogram"]) == 60 and figures["communities"] == [30, 30]
    with pytest.raises(ValueError):
        mapping.build(spark.createDataFrame([], CHUNKS))


def test_single_note_and_bad_vectors(spark):
    m = mapping.build(spark.createDataFrame(blobs()[:1], CHUNKS), mapping.MapOptions(stage="graph"))
    out = mapping.payload(m)
    assert len(out["notes"]) == 1 and not out["edges"] and "terrain" not in out
    zero = [(*blobs()[0][:5], [0.0] * 4)] + blobs()[1:3]
    with pytest.raises(Exception, match="length"):
        mapping.build(spark.createDataFrame(zero, CHUNKS)).stats.collect()


def test_louvain_finds_cliques():
    pairs = [(a, b) for c in range(3) for a in range(5 * c, 5 * c + 5) for b in range(a + 1, 5 * c + 5)] + [(4, 5), (9, 10)]
    s, t = map(np.array, zip(*pairs))
    label = communities.louvain(15, s, t, np.ones(len(pairs)), 0.8, 42)
    assert [len(set(label[5 * c : 5 * c + 5])) for c in range(3)] == [1, 1, 1] and len(set(label)) == 3


def test_small_communities_go_to_their_strongest_neighbour():
    assert communities.merged_small({1: 20, 2: 3, 3: 30, 4: 2}, [(1, 2, 0.5), (2, 3, 0.2)], 12) == {1: 1, 2: 1, 3: 3, 4: 3}
    assert communities.merged_small({1: 3}, [], 12) == {1: 1}


def test_complete_link_against_plain_agglomeration():
    def plain(members, sims):
        found = [[m] for m in sorted(members)]
        score = lambda x, y: min((sims.get((min(a, b), max(a, b)), -1) for a in x for b in y))
        while True:
            best = max(((score(found[i], found[j]), -i, -j) for i in range(len(found)) for j in range(i + 1, len(found))), default=(-1, 0, 0))
            if best[0] < 0:
                return sorted(sorted(c) for c in found if len(c) > 1)
            found[-best[1]] += found.pop(-best[2])

    rng = random.Random(1)
    for n in range(4, 14):
        sims = {(a, b): rng.random() for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6}
        assert sorted(sorted(c) for c in duplicates.complete_link(range(n), sims)) == plain(range(n), sims)
    assert duplicates.complete_link([1, 2, 3], {(1, 2): 0.9, (2, 3): 0.95}) == [[2, 3]]
    assert duplicates.complete_link([1, 2, 3], {(1, 2): 0.9, (2, 3): 0.95, (1, 3): 0.9}) == [[1, 2, 3]]


def test_ratios_and_peaks():
    r = terrain.ratios()
    assert len(r) == 22 and r == sorted(r) and (round(r[0], 6), round(r[-1], 6)) == (0.035, 0.88)
    a = np.array([[1.0, 5.0, 2.0], [0.0, 1.0, 9.0]])
    assert terrain.greatest_around(a, 3).tolist() == [[5, 9, 9], [5, 9, 9]]
    x = np.r_[np.zeros(20), np.full(10, 400.0)]
    found = terrain.peaks_of(x, np.zeros(30), np.ones(30))
    assert len(found) == 2 and abs(found[0][0]) <= 10 and abs(found[1][0] - 400) <= 10


def test_labels(tmp_path):
    p = [{"keywords": ["one", "two"], "signature": "s1"}, {"keywords": ["one", "three"], "signature": "s2"}, {"keywords": [], "signature": "s3"}]
    assert [x["label"] for x in profiles.assigned_labels(p)] == ["one", "three", "主题3"]
    chat = lambda profile, used: '<think>{"a"</think> {"primaryLabel": "Same / Name", "keywordChips": ["c"]}'
    got = profiles.assigned_labels(p, chat, tmp_path / "c.json")
    assert [x["source"] for x in got] == ["llm", "fallback", "fallback"] and got[0]["label"] == "Same Name" and got[0]["chips"] == ["c", "one", "two"]
    assert profiles.assigned_labels(p[:1], lambda *_: 1 / 0, tmp_path / "c.json")[0]["label"] == "Same Name"
    with pytest.raises(ValueError):
        profiles.parsed_label("no object", [])
    assert mapping.warnings(0.1, 9, [90, 5], [5, 10], 3) == ["few mutual edges", "many components", "one dominant community", "many bridge notes", "few contour levels"]
