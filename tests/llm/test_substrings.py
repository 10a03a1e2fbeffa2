import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from tarnlight.llm import substrings as s
from tarnlight.llm.words import bands_of, word_blocks

from .cases import awkward, prose, table

PASSAGE = prose(70, 99)


def run(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in s.deduplicated(table(spark, rows)).collect()}


def test_repeated_passages_stay_once_and_clean_documents_stay_whole(spark):
    texts = [prose(120, i) for i in range(12)]
    texts[3] += " " + PASSAGE + " " + prose(40, 50)
    texts[7] = prose(33, 51) + " " + PASSAGE + " " + texts[7]
    texts[9] = PASSAGE
    got = run(spark, texts)
    assert got[3]["text"] == texts[3]
    middle = " ".join(PASSAGE.split()[2:-2])
    assert sum(middle in r["text"] for r in got.values()) == 1
    assert 9 not in got
    assert got[7]["n_chars"] == len(got[7]["text"]) < len(texts[7]) - len(middle)
    for i in set(range(12)) - {3, 7, 9}:
        assert got[i]["text"] == texts[i]


def test_near_passages_are_cut_too(spark):
    words = PASSAGE.split()
    copies = []
    for k in range(12):
        w = list(words)
        w[10 + 4 * k] = "changed"
        copies.append(prose(60, 200 + k) + " " + " ".join(w))
    got = run(spark, [prose(60, 300) + " " + PASSAGE, *copies])
    cut = sum(len(got[i + 1]["text"].split()) < 60 + 35 for i in range(12))
    assert cut >= 0.9 * 12


def test_cut_spans_keeps_words_of_kept_spans():
    text = "a b  c\nd e f"
    span = lambda *x: x
    assert s.cut_spans(text, [span(1, 3, False)]) == "a d e f"
    assert s.cut_spans(text, [span(1, 4, False), span(2, 3, True)]) == "a c\ne f"
    assert s.cut_spans(text, [span(0, 6, False)]) == "" and s.cut_spans(text, [span(0, 6, True)]) == text


def test_awkward_rows(spark):
    rows = awkward()
    df = table(spark, rows, extra=True)
    out = s.deduplicated(df)
    assert out.columns == df.columns
    got = out.collect()
    texts = [r["text"] for r in got]
    assert texts.count(rows[-1][1]) == 3  # one document by doc_id and text, three rows; the copy of another document is gone
    rest = [r for r in rows if r[0] not in (10, 11)]
    assert sorted(repr(r["text"]) for r in got if r["doc_id"] not in (10, 11)) == sorted(repr(r[1]) for r in rest)
    assert s.deduplicated(table(spark, [])).count() == 0


def test_passages_cut_at_any_word_are_removed_whole(spark):
    rng = random.Random(5)
    source = [prose(400, 500 + k).split() for k in range(4)]
    texts, own = [" ".join(w) for w in source], []
    for k in range(40):
        size = rng.choice([51, 60, 70, 80])
        at = rng.randrange(1, 400 - size)
        own.append((prose(45, 600 + k).split(), prose(45, 700 + k).split()))
        texts.append(" ".join([*own[-1][0], *source[k % 4][at : at + size], *own[-1][1]]))
    got = run(spark, texts)
    assert [got[i]["text"] for i in range(4)] == texts[:4]
    left = [len(got[4 + k]["text"].split()) for k in range(40)]
    assert max(left) <= 90  # near paragraphs may take words of the sentences that the passage cuts into
    gone = [set() for _ in range(40)]
    for r in s.repeated_spans(table(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]), s.MIN_WORDS, s.THRESHOLD).where("doc_id >= 4 and kept is null").collect():
        gone[r["doc_id"] - 4] |= set(range(r["start"], r["end"]))
    for k, (text, words) in enumerate(zip(texts[4:], gone)):
        want = set(range(45, len(text.split()) - 45))
        assert want <= words and len(words - want) <= 2, k  # a word beside the passage may be the same by chance


def test_equal_passages_against_all_pairs_of_places(spark):
    """Of runs of over 50 words that an earlier place has too no more than 50 words in a row stay, those that the first place of a seed has not; nothing is cut outside of runs of 25."""
    rng, vocabulary = random.Random(9), [prose(1, 9000 + k).strip(".") + str(k) for k in range(400)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(26, 120))] for _ in range(6)]
    texts = []
    for _ in range(14):
        parts = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] for _ in range(3)]
        for at in (1, 2):
            source = rng.choice(pool)
            begin = rng.randrange(len(source) // 3)
            parts.insert(at, source[begin : rng.randint(len(source) * 2 // 3, len(source))])
        texts.append([w for p in parts for w in p])
    docs = table(spark, [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)])
    gone = [set() for _ in texts]
    for r in s.repeated_spans(docs, s.MIN_WORDS, s.THRESHOLD).where("kept is null").collect():
        gone[r["doc_id"]] |= set(range(r["start"], r["end"]))
    must, may = [set() for _ in texts], [set() for _ in texts]
    for k, text in enumerate(texts):
        for other in texts[: k + 1]:
            run = [0] * (len(other) + 1)
            for i, w in enumerate(text):
                new = [0] * (len(other) + 1)
                for j, x in enumerate(other[:i] if other is text else other):
                    if w == x:
                        new[j + 1] = run[j] + 1
                        for least, words in ((2 * s.MIN_WORDS + 1, must), (s.MIN_WORDS, may)):
                            if new[j + 1] >= least:
                                words[k] |= set(range(i + 1 - new[j + 1], i + 1))
                run = new
    assert sum(map(len, must)) > 200
    for k in range(len(texts)):
        assert gone[k] <= may[k], k
        stays = sorted(must[k] - gone[k])
        assert all(b - a < 2 * s.MIN_WORDS for a, b in zip(stays, stays[2 * s.MIN_WORDS :])) or len(stays) <= 2 * s.MIN_WORDS, k
    assert sum(len(m & g) for m, g in zip(must, gone)) >= 0.95 * sum(map(len, must))


def test_seeds_lie_in_every_passage():
    hashes = np.random.default_rng(1).integers(0, 2**62, 2000, dtype=np.uint64)
    seeds = lambda h: s.seeds(np.array([0, len(h)]), h, s.MIN_WORDS)
    at, c = seeds(hashes)
    assert np.diff(at).max() <= s.MIN_WORDS + 2 and at[0] <= s.MIN_WORDS + 1
    inner, own = seeds(hashes[700:751])
    assert len(inner) and set(zip(inner + 700, own)) <= set(zip(at, c))
    assert [len(seeds(hashes[:n])[0]) for n in (0, 24, 25, 30)] == [0, 0, 1, 1]
    both, _ = s.seeds(np.array([0, 700, 751, 751]), hashes[:751], s.MIN_WORDS)  # texts of a block, each by itself
    assert sorted(both) == sorted([*seeds(hashes[:700])[0], *(inner + 700)])


def test_a_repeating_run_leaves_its_first_occurrence(spark):
    text = prose(40, 800) + " " + "na " * 200
    assert len(run(spark, [text])[0]["text"].split()) >= 40 + s.MIN_WORDS


def test_bands_find_pairs_at_the_threshold():
    assert 1 - (1 - s.THRESHOLD**s.ROWS) ** s.BANDS >= s.RECALL >= 0.99
    rng, hit = np.random.default_rng(2), 0
    cuts = np.array([0])
    for x in rng.integers(0, 2**62, (300, 34), dtype=np.uint64):
        y = np.r_[x[:28], rng.integers(0, 2**62, 6, dtype=np.uint64)]  # Jaccard 28 / 40
        hit += (bands_of(x, cuts, 1, s.BANDS, s.ROWS, s.SEED) == bands_of(y, cuts, 1, s.BANDS, s.ROWS, s.SEED)).any()
    assert hit >= 0.97 * 300


def test_paragraphs_depend_on_the_words_beside_them_alone():
    def of(text):
        words = text.split()
        (_, bounds, hashes, flags), = word_blocks([text])
        return {" ".join(words[a:b]) for a, b in zip(*s.units(bounds, hashes, flags, s.MIN_WORDS)[:2])}

    text = prose(900, 41)
    whole = of(text)
    assert len(whole) > 10 and sum(len(x.split()) for x in whole) > 800 and min(len(x.split()) for x in whole) >= s.MIN_WORDS
    part = " ".join(text.split()[200:700])
    inner = of("other words before it " + part + " and after it")
    assert len(whole & inner) >= len(inner) - 6
    assert of("") == set() and of(prose(24, 1)) == set() and len(of(prose(25, 1))) == 1


@pytest.mark.parametrize("light", [True, False])
def test_lookups_and_joins_find_the_same(spark, monkeypatch, light):
    """Hashes too many to be held by every worker are joined, with the same result."""
    texts = [prose(120, 860 + i) for i in range(8)]
    texts[3] += " " + PASSAGE + " " + prose(40, 50)
    texts[5] = " ".join([*texts[3].split()[:100], "other", *texts[3].split()[101:]])
    texts[6] = PASSAGE + " " + PASSAGE
    want = {i: r["text"] for i, r in run(spark, texts).items()}
    if not light:
        monkeypatch.setattr(s, "LOOKUP_BYTES", -1)
    assert {i: r["text"] for i, r in run(spark, texts).items()} == want
    assert 5 not in want or len(want[5].split()) < 80
    assert len(want[6].split()) < 10 if 6 in want else True


def test_versions_close_together_in_one_document_do_not_hide_their_copies(spark):
    lines = [prose(12, 950 + k).split() for k in range(5)]
    first = [w for x in lines for w in x]
    second = [*first]
    second[20] = second[45] = "changed"  # no run of 25 words is left
    other = prose(45, 970)
    got = run(spark, [prose(45, 971), " ".join([*first, *second]), other + " " + " ".join(second)])
    assert len(got[1]["text"].split()) < 120 - 25 and len(got[2]["text"].split()) < 45 + 30


@pytest.mark.parametrize("size", [10, 5_000])
def test_sieves_have_all_and_few_others(spark, size):
    rng = np.random.default_rng(size)
    own, other = (rng.integers(-(2**63), 2**63 - 1, n) for n in (size, 20_000))
    sieve = s.sieved(spark.createDataFrame([(int(c),) for c in own], "id long")).value
    assert sieve.may_have(own).all() and sieve.may_have(other).mean() < 0.02
    assert not s.sieved(spark.createDataFrame([], "id long")).value.may_have(other).any()
    assert not sieve.may_have(np.zeros(0, np.int64)).any()


@pytest.mark.parametrize("files", [True, False])
def test_no_side_is_broadcast_and_few_texts_and_marks_are_shuffled(spark, monkeypatch, files):
    """With nothing light, lookups in files or joined: the same result, and of rows that repeat nothing, neither text nor places reach a join."""
    texts = [prose(120, 870 + i) for i in range(40)]
    texts[3] += " " + PASSAGE + " " + prose(40, 51)
    texts[5] = " ".join([*texts[3].split()[:100], "other", *texts[3].split()[101:]])
    texts[6] = PASSAGE + " " + PASSAGE
    docs = table(spark, [*((i, t, "en", "s", len(t)) for i, t in enumerate(texts)), *((r[0] and r[0] + 100, *r[1:]) for r in awkward())])
    want = Counter(map(tuple, s.deduplicated(docs).collect()))
    seen = {}
    sieved = s.sieved

    def counted(df):
        seen[df.columns[0]] = sieved(df)
        return seen[df.columns[0]]

    monkeypatch.setattr(s, "light", lambda *_: False)
    monkeypatch.setattr(s, "sieved", counted)
    if not files:
        monkeypatch.setattr(s, "folder", lambda _: None)
    assert Counter(map(tuple, s.deduplicated(docs).collect())) == want
    assert want.total() > 50 and (3, texts[3]) in {r[:2] for r in want}
    assert set(seen) == {"w_version", "__tl_version"} | (set() if files else {"id", "c"})
    assert s.rows_in(docs).where(s.may_be_in(seen["__tl_version"], F.col("version"))).count() < 12
