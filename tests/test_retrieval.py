import pytest

from tarnlight.operators.fulltext import bm25, phrases_of
from tarnlight.operators.fusion import files, fused
from tarnlight.plans import retrieval as r

CHUNKS = "lookup string, path string, chunk int, text string, embedding array<double>"
CANDIDATE = "source_list string, backend string, query_type string, weight double, lookup string, path string, chunk int, text string, score double, rank int"


def names(plan):
    return [s.name for s in plan.lists]


def test_plans():
    assert names(r.plan_q("two words")) == ["vec:original", "bm25:phrase"]
    assert names(r.plan_q(" one two  three four five six ")) == "vec:original bm25:original bm25:phrase".split()
    assert r.plan_q(" a \n b ").query == "a b" and r.token_count("日本 語") == 2
    plus = r.plan_q_plus("two words", lambda _: "Two  Words", lambda _: "a, b, A, , c, d, e, f, g")
    assert names(plus) == ["vec:original", "bm25:phrase", "bm25:variants"]
    assert plus.variants == ("a", "b", "c", "d", "e", "f")
    assert "vec:expanded" in names(r.plan_q_plus("two words", lambda _: "other", lambda _: "a"))


@pytest.mark.parametrize("rewrite, variants", [(lambda _: " ", lambda _: "a"), (lambda _: "x", lambda _: ","), (lambda _: 1 / 0, lambda _: "a")])
def test_expansion_falls_back(spark, rewrite, variants):
    df = spark.createDataFrame([("a", "/p/1.md", 0, "alpha beta", [1.0, 0.0])], CHUNKS)
    found = r.retrieve_q_plus(df, "alpha", lambda _: [1.0, 0.0], rewrite, variants, 5)
    assert (found.requested, found.mode, found.fallback["reason"]) == ("q_plus", "q", "expansion_failed") and found.fallback["message"]
    assert [x["path"] for x in found.files.collect()] == ["/p/1.md"]


def test_other_failures_surface(spark):
    df = spark.createDataFrame([("a", "p", 0, "t", [1.0])], CHUNKS)

    def broken(_):
        raise OSError("no embedding service")

    for call in (lambda: r.retrieve_q(df, "x", broken, 5), lambda: r.retrieve_q_plus(df, "x", broken, lambda _: "y", lambda _: "z", 5)):
        with pytest.raises(OSError):
            call()


def test_inputs_are_checked(spark):
    df = spark.createDataFrame([], CHUNKS)
    for query, n, lookups in ((" ", 5, None), ("x", 0, None), ("x", 101, None), ("x", 5, [])):
        with pytest.raises(ValueError):
            r.retrieve_q(df, query, lambda _: [1.0], n, lookups=lookups)
    for v in ([], [0.0, 0.0], ["a"], None, [float("nan")]):
        with pytest.raises(ValueError):
            r.checked_vector(v)
    assert r.depths(10) == (64, 100) and r.depths(10, 24, 40) == (24, 40) and r.depths(100) == (512, 800)
    with pytest.raises(ValueError):
        r.depths(10, 0)


def test_vector_ranks_are_global_and_text_ranks_local(spark):
    rows = [("a", "1", 0, "term", [0.49, (1 - 0.49**2) ** 0.5]), ("a", "2", 0, "term term", [0.8, 0.6]), ("b", "3", 0, "term", [0.9, (1 - 0.81) ** 0.5]), ("b", "4", 0, "other", [0.7, (1 - 0.49) ** 0.5])]
    found = r.candidates(spark.createDataFrame(rows, CHUNKS), r.plan_q("term"), lambda _: [1.0, 0.0], 64, 100, {"a": 0.5}).collect()
    vec = sorted((x for x in found if x["backend"] == "vector"), key=lambda x: x["rank"])
    assert [(x["path"], x["rank"], round(x["score"], 6)) for x in vec] == [("3", 1, 0.9), ("2", 2, 0.8), ("4", 3, 0.7)]
    text = {(x["source_list"], x["path"]): x["rank"] for x in found if x["backend"] == "bm25"}
    assert text == {("bm25:phrase:a", "2"): 1, ("bm25:phrase:a", "1"): 2, ("bm25:phrase:b", "3"): 1}


def test_phrases(spark):
    df = spark.createDataFrame([("a", "1", 0, "red fox runs"), ("a", "2", 0, "fox and red"), ("a", "3", 0, None), ("a", "4", 0, "Réd FOX red fox")], "lookup string, path string, chunk int, text string")
    score = lambda q, p: {x["path"]: x["score"] for x in bm25(df, phrases_of(q, p)).collect()}
    assert set(score(["red fox"], True)) == {"1", "4"} and set(score(["red fox"], False)) == {"1", "2", "4"}
    assert phrases_of(["Foo foo Foo"], False) == [["foo"], ["foo"]] and phrases_of(["", "!"], True) == []
    assert bm25(df, []).count() == 0


def candidate(source, lookup, path, chunk, rank, score, kind="original", weight=1.0):
    return (source, "vector", kind, weight, lookup, path, chunk, f"text {path} {chunk}", score, rank)


def test_fusion_keeps_lookups_apart_and_marks_expansions(spark):
    rows = [candidate("l1", "a", "p", 0, 1, 0.9), candidate("l2", "b", "p", 0, 1, 0.8, "expanded", 0.5)]
    got = {x["lookup"]: x for x in fused(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert (got["a"]["top_rank_original"], got["a"]["expanded_only_penalty"]) == (0.05, 0.0)
    assert (got["b"]["top_rank_original"], got["b"]["expanded_only_penalty"]) == (0.0, -0.05)
    assert got["a"]["final_score"] == pytest.approx(0.95) and got["b"]["final_score"] == pytest.approx(0.75 * 0.5 + 0.15 * 0.5 - 0.05)
    assert got["a"]["evidence"][0]["normalized_score"] == 1.0 and got["a"]["sources"] == ["l1"]


def test_files_boost_strong_evidence_only(spark):
    strong = [candidate("l1", "a", "s", c, c + 1, 0.9 - c / 10) for c in range(2)] + [candidate("l2", "a", "s", c, c + 1, 0.9 - c / 10) for c in range(2)]
    weak = [candidate("l3", "a", "w", c, 150 + c, 0.0, weight=0.1) for c in range(2)]
    got = {x["path"]: x for x in files(fused(spark.createDataFrame(strong + weak, CANDIDATE)), 5).collect()}
    assert (got["s"]["multi_chunk_evidence"], got["s"]["source_list_diversity"]) == (0.02, 0.01)
    assert (got["w"]["multi_chunk_evidence"], got["w"]["source_list_diversity"]) == (0.0, 0.0)
    assert len(got["s"]["matched_chunks"]) == 2 and got["s"]["source_lists"] == ["l1", "l2"] and got["s"]["original_match_count"] == 2


def test_similar_and_lookup(spark):
    rows = [("a", "1", 0, "x", [10.0, 0.0]), ("a", "2", 0, "y", [1.0, 0.1]), ("b", "3", 1, "z", None)]
    df = spark.createDataFrame(rows, CHUNKS).selectExpr("*", "sha2(text, 256) AS hash")
    best = r.similar(df, [1.0, -0.1], 1).first()
    assert best["path"] == "1" and best["score"] > 0.99
    assert r.find_chunk(df, "b", "3", 1).count() == 1 and r.find_chunk(df, "b", "3", 1, "0").count() == 0
    assert r.random_sample(df, 2, 5).count() == 2 and r.random_sample(df, 0).count() == 0
    with pytest.raises(Exception, match="2 dimensions|3 dimensions"):
        r.similar(df, [1.0, 0.0, 0.0], 1).collect()


def test_cache_drops_the_oldest():
    asked = []
    cache = r.EmbedCache(lambda t: asked.append(t) or [1.0], 2)
    for t in "abaca":
        cache(t)
    assert asked == ["a", "b", "c", "a"]


def test_discussion():
    assert r.discuss("  ", lambda p: 1 / 0) == "" and "note" in r.discuss("a note", lambda p: p, "why")
