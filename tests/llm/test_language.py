import itertools
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tarnlight.llm import language as g

from .cases import awkward, table

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def split():
    rows = [r for r in pq.read_table(DATA).to_pylist() if r["lang"] and len(r["text"].split()) >= 20]
    learn, rest = {}, []
    for r in rows:
        own = learn.setdefault(r["lang"], [])
        own.append(r["text"]) if len(own) < 50 else rest.append((r["text"], r["lang"]))
    return g.fit(learn, train_words=20_000), rest


def test_posteriors_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    e, t = rng.uniform(0.1, 2, (7, 3)), rng.normal(size=(3, 3))
    sizes = np.array([4, 1, 2])
    got, at = g.posteriors(e, sizes, t), 0
    for n in sizes:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.prod([e[at + i, c] for i, c in enumerate(path)]) * np.exp(sum(t[a, b] for a, b in itertools.pairwise(path)))
            for i, c in enumerate(path):
                want[i, c] += p
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_blocks_equal_a_plain_pass():
    rng = np.random.default_rng(2)
    n, t = 5 * g.BLOCK + 7, np.log(rng.uniform(0.1, 1, (4, 4)))
    e = rng.uniform(0.01, 1, (n, 4))
    alpha, beta = np.zeros((n, 4)), np.ones((n, 4))
    a = np.full(4, 0.25)
    for i in range(n):
        a = (a @ np.exp(t) if i else a) * e[i]
        a /= a.sum()
        alpha[i] = a
    for i in range(n - 2, -1, -1):
        b = np.exp(t) @ (e[i + 1] * beta[i + 1])
        beta[i] = b / b.sum()
    want = alpha * beta
    assert np.allclose(g.posteriors(e, np.array([n]), t), want / want.sum(axis=1, keepdims=True))


def test_features_are_those_of_each_word_alone():
    words = ["a", "ab", "abc", "abcde", "ça", "日本", "🙂", "x" * 200, "b" * 39, "c" * 40, "d" * 41]
    lexicon = {"ab": 5, "ça": 2}

    def by_word(given):
        out = [[] for _ in given]
        for has, slots, begin in g.features(given, lexicon):
            bounds = [(i, i + 1) for i in range(len(has))] if begin is None else list(zip(begin, [*begin[1:], len(slots)]))
            for w, (i, j) in zip(has, bounds):
                out[w] += slots[i:j].tolist()
        return out

    together = by_word(words)
    assert together == [by_word([w])[0] for w in words]
    assert len({tuple(x) for x in together}) == len(words)
    model = g.Model(["a", "b"], lexicon, np.random.default_rng(3).normal(size=(g.SLOTS, 2)), np.zeros((2, 2)))
    assert np.allclose(g.scores(words, model), [model.weights[x].sum(axis=0) for x in together])


def test_held_out_documents_and_switched_words(split):
    model, rest = split
    unary = g.Unary(model)
    lang, _, _, _, confidence, spans = g.label_texts([t for t, _ in rest], unary)
    assert np.mean([a == b for a, b in zip(lang.to_pylist(), (x for _, x in rest))]) >= 0.97
    by = {}
    for text, name in rest:
        by.setdefault(name, []).append(text.split())
    rng, texts, labels = random.Random(4), [], []
    for _ in range(60):
        words, own = [], []
        for _ in range(6):
            name = rng.choice(sorted(by))
            run = rng.choice(by[name])[:15]
            words += run
            own += [name] * len(run)
        texts.append(" ".join(words))
        labels.append(own)
    right = total = 0
    for found, own in zip(g.label_texts(texts, unary)[5].to_pylist(), labels):
        got = [s["lang"] for s in found for _ in range(s["length"])]
        right += sum(a == b for a, b in zip(got, own))
        total += len(own)
    assert right / total >= 0.9


def test_a_full_cache_changes_nothing(split, monkeypatch):
    model, rest = split
    texts = [t for t, _ in rest[:60]]
    want = g.label_texts(texts, g.Unary(model))
    monkeypatch.setattr(g, "CACHE_WORDS", 300)
    monkeypatch.setattr(g, "GROUP_WORDS", 500)
    got = g.label_texts(texts, g.Unary(model))
    assert [c.to_pylist() for c in got[:2]] == [c.to_pylist() for c in want[:2]]
    assert np.allclose(got[4].to_numpy(zero_copy_only=False), want[4].to_numpy(zero_copy_only=False))


def test_awkward_rows(spark, split):
    rows = awkward()
    df = table(spark, rows, extra=True)
    got = g.labelled(df, split[0]).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["n_words"] is None:
            assert r["lang"] is r["spans"] is r["confidence"] is None
        else:
            assert sum(s["length"] for s in r["spans"]) == r["n_words"] and (r["n_words"] > 0 or r["lang"] is None)
    kept = g.identified(df)
    assert kept.schema == df.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {1, 4, 5} & set(ids) and ids.count(10) == 3
    assert g.identified(table(spark, [])).count() == 0 == g.labelled(table(spark, [])).count()


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet(DATA)
    long = docs.where("n_chars > 200 and regexp_count(text, '[a-zA-Zéèñüä]{2,}') > 0.8 * regexp_count(text, '[^ \\n]+')")
    assert g.identified(docs).join(long.select("doc_id"), "doc_id", "left_semi").count() >= 0.99 * long.count()
    junk = docs.limit(0).union(spark.createDataFrame([(-1, "1234 5678 ---- 99 %% 12", "en", "s", 24)], docs.schema))
    assert g.identified(docs.union(junk)).where("doc_id = -1").count() == 0


def test_more_than_sixteen_languages_are_all_learned(spark):
    rng, rows = random.Random(6), []
    for k in range(20):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(60)]
        rows += [(100 * k + i, " ".join(rng.choices(own, k=40)), f"l{k:02}", "s", 1) for i in range(30 - k)]
    docs = table(spark, rows)
    assert len(g.sample(docs)) == 20
    got = {r["doc_id"]: r["lang"] for r in g.labelled(docs).select("doc_id", "lang").collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_lexicons_of_more_languages_than_a_machine_word_has_bits():
    slots = [np.concatenate([x[1] for x in g.features(["word"], {"word": m})]).tolist() for m in (0, 1 << 70, 1 | 1 << 70)]
    assert [len(x) - len(slots[0]) for x in slots] == [0, 1, 2]
