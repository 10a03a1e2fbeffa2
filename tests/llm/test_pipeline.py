import inspect

import corpus_pipeline
from tarnlight.llm import near_duplicates, pii, substrings

from .cases import awkward, prose, table

SF = "/root/testdata/sf0.001"


def test_stages_are_named_and_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "substring dedup", "PII", "packing"]
    for _, f in corpus_pipeline.STAGES:
        assert list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"]


def test_stages_by_brute_force_on_planted_documents(spark, tmp_path):
    passage = prose(60, 500)
    clean = [(i, prose(90, i), "en", "s", 1) for i in range(30)]
    rows = clean + [
        (100, clean[0][1], "en", "s", 1),
        (101, clean[1][1].replace(clean[1][1].split()[40], "changed", 1), "en", "s", 1),
        (102, prose(50, 601) + " " + passage, "en", "s", 1),
        (103, prose(50, 602) + " " + passage, "en", "s", 1),
        (104, "1234 5678 ---- %% 99 || 12", "en", "s", 1),
        (105, prose(50, 603) + " Write to jo.doe@mail.example.com now.", "en", "s", 1),
        (106, None, "en", "s", 1),
    ]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if k < 4 else docs.collect()
    texts = {r[0]: r[1] for r in rows}
    assert set(seen["language ID"]) == set(texts) - {104, 106}
    assert set(seen["n-gram Jaccard join"]) == set(texts) - {104, 106, 100, 101}
    cut = seen["substring dedup"]
    assert cut[102] == texts[102] and passage[20:-20] not in cut[103] and all(cut[i] == texts[i] for i in range(30))
    assert "jo.doe" not in seen["PII"][105] and all(seen["PII"][i] == texts[i] for i in range(30))
    windows = seen["packing"]
    assert sum(w["n_words"] for w in windows) == sum(len(t.split()) for t in seen["PII"].values())
    assert {d for w in windows for d in w["doc_ids"]} == set(seen["PII"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, windows))


def test_each_stage_takes_awkward_rows(spark):
    df = table(spark, awkward(), extra=True)
    for _, f in corpus_pipeline.STAGES:
        f(spark, df, SF).count()
        f(spark, df.limit(0), SF).count()
    for f in (near_duplicates.keep_one, substrings.deduplicated, pii.pseudonymised):
        assert f(df).columns == df.columns


def test_whole_pipeline(spark):
    assert corpus_pipeline.run(spark, SF).count() > 10
