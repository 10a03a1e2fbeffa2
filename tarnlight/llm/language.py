"""Language of each word of code-switched text by a linear-chain conditional random field.

A word's features are its affixes, character n-grams and its place in lexicons
of frequent words of each language; transitions between languages are learned
with them. Posteriors come from forward-backward over whole texts, computed in
blocks: the product of a block's matrices carries both passes over its borders,
so that texts of any length are exact and take vectorised steps only.

The model is fitted on a bounded sample of rows with a lang: SAMPLE_DOCS
documents a language by the order of a hash of doc_id, TRAIN_WORDS words in all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.llm.words import mixed, normal, trimmed
from tarnlight.shared import spread

SAMPLE_DOCS = 120
TRAIN_WORDS = 60_000
LEXICON_WORDS = 400
SLOTS = 1 << 16
BLOCK = 32
CACHE_WORDS, CACHE_CHARS = 150_000, 2_000_000
MIN_CONFIDENCE = 0.6
MIN_LETTERS = 0.5


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, int]  # word -> bit mask, of any width, of the languages of whose lexicon it is
    weights: np.ndarray  # SLOTS x languages
    transitions: np.ndarray  # languages x languages, log scores


#: Characters of words that are scored together, and feature slots whose weights are summed together.
SCORE_CHARS, SCORE_SLOTS = 1 << 18, 1 << 16
#: Of more languages than this, caches and groups of texts are made smaller, so that they take no more memory.
WIDE = 16
STEP = np.uint64(0x9E3779B97F4A7C15)


def slot(h: np.ndarray, kind: int) -> np.ndarray:
    """Slots of hashes of one kind of feature."""
    return (mixed((h + np.uint64(kind)) * STEP) % np.uint64(SLOTS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Features of words in normal form, kind by kind: (words that have one, slots, starts of each word's slots or None for one a word).

    Kinds: bias, prefixes of 1-3, suffixes of 1-4, whole words up to 4, n-grams
    of 2-3 with edges, lexicons. All n-grams of a word count, however long it is.
    """
    n = len(words)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 2)
    first, last = ends - sizes - 1, ends - 2  # of the word itself
    every = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = [(every, slot(np.zeros(n, np.uint64), 0), None)]
    head = tail = np.zeros(n, np.uint64)
    for k in range(1, 5):
        has = np.flatnonzero(sizes >= k)
        head, tail = head.copy(), tail.copy()
        head[has] = head[has] * STEP + codes[first[has] + k - 1]
        tail[has] = tail[has] + codes[last[has] - k + 1] * np.uint64(pow(int(STEP), k, 1 << 64))
        if k < 4:
            found.append((has, slot(head[has], k), None))
        found.append((has, slot(tail[has], 10 + k), None))
        whole = np.flatnonzero(sizes == k)
        found.append((whole, slot(head[whole], 20 + k), None))
    gram = codes[:-1] * STEP + codes[1:]
    inside = np.ones(len(gram), bool)
    inside[ends[:-1] - 1] = False
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    found.append((every, slot(gram[inside], 30), begin))
    gram = gram[:-1] * STEP + codes[2:]
    inside = np.ones(len(gram), bool)
    inside[np.r_[ends[:-1] - 1, ends[:-1] - 2]] = False
    found.append((every, slot(gram[inside], 31), np.r_[0, np.cumsum(sizes)[:-1]]))
    members: dict[int, list[int]] = {}  # language -> words in its lexicon
    for i, w in enumerate(words):
        mask = lexicon.get(w, 0)
        while mask:
            k = (mask & -mask).bit_length() - 1
            members.setdefault(k, []).append(i)
            mask &= mask - 1
    for k in sorted(members):
        has = np.array(members[k], np.int64)
        found.append((has, slot(np.full(len(has), k, np.uint64), 40), None))
    return found


def scores(words: list[str], model: Model) -> np.ndarray:
    """Sums of the weights of each word's features; long lists and long words go in parts."""
    total = np.zeros((len(words), len(model.languages)))
    ends = np.cumsum([len(w) + 2 for w in words])
    begin = 0
    while begin < len(words):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + SCORE_CHARS, side="right")))
        for has, slots, starts in features(words[begin:end], model.lexicon):
            if starts is None:
                total[begin + has] += model.weights[slots]
                continue
            for k in range(0, len(slots), SCORE_SLOTS):
                part = slots[k : k + SCORE_SLOTS]
                i, j = np.searchsorted(starts, k, side="right") - 1, np.searchsorted(starts, k + len(part))
                own = np.maximum(starts[i:j] - k, 0)
                total[begin + has[i:j]] += np.add.reduceat(model.weights[part], own, axis=0)
        begin = end
    return total


def fit(samples: dict[str, list[str]], train_words: int = TRAIN_WORDS, rounds: int = 60, seed: int = 7) -> Model:
    """Fits weights and transitions on code-switched sequences made of runs of the samples' words.

    Runs have 14 words in the mean; sequences have 40 words. Full-batch Adam on
    the conditional log-likelihood with a small L2 penalty.
    """
    languages = sorted(samples)
    n_lang = len(languages)
    rng = np.random.Generator(np.random.PCG64(seed))
    pools = []
    for lang in languages:
        words: list[str] = []
        for text in samples[lang]:
            words += map(normal, text.split())
            if len(words) >= train_words:  # more can't be drawn
                break
        pools.append(words)
    lexicon: dict[str, int] = {}
    for k, words in enumerate(pools):
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        for w in sorted(counts, key=lambda w: (-counts[w], w))[:LEXICON_WORDS]:
            if counts[w] > 1:
                lexicon[w] = lexicon.get(w, 0) | 1 << k
    length = 40
    n_seq = max(1, train_words // length)
    tokens, labels = [], np.zeros((n_seq, length), np.int64)
    index: dict[str, int] = {}
    for s in range(n_seq):
        row: list[str] = []
        while len(row) < length:
            k = int(rng.integers(n_lang))
            size = min(int(rng.geometric(1 / 14)), length - len(row))
            start = int(rng.integers(max(1, len(pools[k]) - size)))
            run = pools[k][start : start + size]
            if run:
                labels[s, len(row) : len(row) + len(run)] = k
                row += run
        tokens.append([index.setdefault(w, len(index)) for w in row])
    ids = np.array(tokens)
    n_types = len(index)
    parts = features(list(index), lexicon)
    of_type = np.concatenate([has if begin is None else np.repeat(has, np.diff(np.r_[begin, len(slots)])) for has, slots, begin in parts])
    by_word = np.argsort(of_type, kind="stable")
    of_type, flat = of_type[by_word], np.concatenate([slots for _, slots, _ in parts])[by_word]
    order = np.argsort(flat, kind="stable")
    of_type_sorted = of_type[order]
    used, first = np.unique(flat[order], return_index=True)
    begin = np.searchsorted(of_type, np.arange(n_types))
    w, t = np.zeros((len(used), n_lang)), np.zeros((n_lang, n_lang))
    dense = np.searchsorted(used, flat)
    one = np.eye(n_lang)[labels]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, t)]
    pairs = np.zeros((n_lang, n_lang))
    np.add.at(pairs, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    for r in range(1, rounds + 1):
        unary = np.add.reduceat(w[dense], begin, axis=0)
        e = unary[ids]
        e = np.exp(e - e.max(axis=2, keepdims=True))
        trans = np.exp(t)
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        a = np.full((n_seq, n_lang), 1.0 / n_lang)
        for i in range(length):
            a = (a @ trans if i else a) * e[:, i]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, i] = a
        b = beta[:, -1]
        expected = np.zeros_like(t)
        for i in range(length - 2, -1, -1):
            ahead = e[:, i + 1] * b
            joint = alpha[:, i, :, None] * trans * ahead[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            expected += joint.sum(axis=0)
            b = ahead @ trans.T
            b /= b.sum(axis=1, keepdims=True)
            beta[:, i] = b
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        by_type = np.zeros((n_types, n_lang))
        np.add.at(by_type, ids.ravel(), (one - p).reshape(-1, n_lang))
        grads = np.add.reduceat(by_type[of_type_sorted], first, axis=0) - 0.05 * w, pairs - expected - 0.05 * t
        for x, g, (m, v) in zip((w, t), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    weights = np.zeros((SLOTS, n_lang))
    weights[used] = w
    return Model(languages, lexicon, weights, t)


class Unary(dict):
    """word -> row of the table of exp(unary scores); emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        size = max(1, CACHE_WORDS * WIDE // max(WIDE, len(model.languages)))
        self.table = np.ones((size, len(model.languages)))
        self.letters = np.zeros(size, bool)
        self.chars = 0

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of the words, valid until the next call; those that are new are scored together."""
        asked = set(words)
        new = asked - self.keys()
        chars = sum(map(len, new))
        if len(self) + len(new) > len(self.table) or self.chars + chars > CACHE_CHARS:
            self.clear()
            self.chars, new = 0, asked
            chars = sum(map(len, new))
            if len(new) > len(self.table):
                self.table, self.letters = np.ones((len(new), self.table.shape[1])), np.zeros(len(new), bool)
        self.chars += chars
        if new:
            at = len(self)
            self.update(zip(new, range(at, at + len(new))))
            bare = list(map(normal, new))
            s = scores(bare, self.model)
            self.table[at : at + len(new)] = np.exp(s - s.max(axis=1, keepdims=True))
            self.letters[at : at + len(new)] = [w.isalpha() or any(map(str.isalpha, w)) for w in bare]
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def posteriors(e: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior of each label for each word; e: words x labels of all texts in order, sizes: words of each text (none 0)."""
    n_lang = e.shape[1]
    trans = np.exp(transitions)
    blocks = -(-sizes // BLOCK)
    n_block = int(blocks.sum())
    first_block = np.r_[0, np.cumsum(blocks)[:-1]]
    at = np.arange(len(e)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.repeat(first_block * BLOCK, sizes)
    laid = np.ones((n_block * BLOCK, n_lang))
    laid[at] = e
    real = np.zeros(n_block * BLOCK, bool)
    real[at] = True
    laid, real = laid.reshape(n_block, BLOCK, n_lang), real.reshape(n_block, BLOCK)
    steps = np.ascontiguousarray(laid.transpose(1, 0, 2))
    live = np.ascontiguousarray(real.T)
    later = np.ones(n_block, bool)
    later[first_block] = False  # the first word of a text has no transition into it
    m = np.where(later[:, None, None], trans, np.eye(n_lang)) * steps[0][:, None, :]
    m /= m.sum(axis=(1, 2), keepdims=True)
    for i in range(1, BLOCK):
        k = live[i]
        if k.all():
            m = (m @ trans) * steps[i][:, None, :]
            m /= m.sum(axis=(1, 2), keepdims=True)
        else:
            x = (m[k] @ trans) * steps[i][k][:, None, :]
            m[k] = x / x.sum(axis=(1, 2), keepdims=True)
    into, out = np.full((n_block, n_lang), 1.0 / n_lang), np.ones((n_block, n_lang))
    order = np.argsort(-blocks, kind="stable")
    ranked, start = blocks[order], first_block[order]
    for s in range(1, int(blocks.max())):
        b = start[: np.searchsorted(-ranked, -s, side="left")] + s  # texts of more than s blocks
        x = np.einsum("bi,bij->bj", into[b - 1], m[b - 1])
        into[b] = x / x.sum(axis=1, keepdims=True)
    last = start + ranked - 1
    for s in range(1, int(blocks.max())):
        b = last[: np.searchsorted(-ranked, -s, side="left")] - s
        x = np.einsum("bij,bj->bi", m[b + 1], out[b + 1])
        out[b] = x / x.sum(axis=1, keepdims=True)
    alpha = np.empty_like(steps)
    a = into
    for i in range(BLOCK):
        a = (a @ trans if i else np.where(later[:, None], a @ trans, a)) * steps[i]
        a /= a.sum(axis=1, keepdims=True)
        alpha[i] = a
    b = out
    for i in range(BLOCK - 1, -1, -1):
        if i < BLOCK - 1:
            b = (steps[i + 1] * b) @ trans.T
            b /= b.sum(axis=1, keepdims=True)
            b[~live[i + 1]] = out[~live[i + 1]]
        alpha[i] *= b
    p = alpha.transpose(1, 0, 2).reshape(-1, n_lang)[at]
    return p / p.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Texts of at most per_language rows of each language, by a hash of doc_id, then doc_id."""
    named = docs.where("lang is not null and doc_id is not null").select("lang", "doc_id")
    ranked = named.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
    ids = sorted({r[0] for r in ranked.where(F.col("n") <= per_language).select("doc_id").collect()})
    if not ids:
        return {}
    rows = docs.where("lang is not null").where(F.col("doc_id").isin(ids)).where(F.col("text").rlike(r"\S")).select("lang", "doc_id", "text").collect()
    found: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        found.setdefault(r["lang"], []).append(r["text"])
    return found


SPAN = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string()), ("p", pa.float64())])
GROUP_WORDS = 50_000
#: Rows whose texts are in Python at a time.
SLICE = 500


def label_texts(texts: list[str | None], unary: Unary) -> list[pa.Array]:
    """Columns lang, n_words, share, letters, confidence, spans of the texts."""
    model = unary.model
    n_lang = len(model.languages)
    group_words = GROUP_WORDS * WIDE**2 // max(WIDE, n_lang) ** 2
    n = len(texts)
    words = np.zeros(n, np.int64)
    share, letters, confidence = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)
    best = np.full(n, -1)
    runs: list[tuple | None] = [None] * n
    i = 0
    while i < n:
        chosen, group, laid = [], [], 0
        while i < n and laid < max(1, group_words):
            parts = texts[i].split() if texts[i] else []
            if parts:
                chosen.append(i)
                group += parts
                words[i] = len(parts)
                laid += -(-len(parts) // BLOCK) * BLOCK  # texts are laid out in whole blocks
            i += 1
        if not group:
            continue
        flat, sizes = unary.rows(group), words[chosen]
        p = posteriors(unary.table[flat], sizes, model.transitions)
        label, top = p.argmax(axis=1), p.max(axis=1)
        known = unary.letters[flat]
        owner = np.repeat(np.arange(len(chosen)), sizes)
        count = np.bincount(owner, known, len(chosen))
        votes = np.bincount(owner[known] * n_lang + label[known], minlength=len(chosen) * n_lang).reshape(-1, n_lang)
        sure = np.bincount(owner, top * known, len(chosen))
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        cut = np.ones(len(flat), bool)
        cut[1:] = label[1:] != label[:-1]
        cut[first] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.r_[starts, len(flat)])
        mean_p = np.add.reduceat(top, starts) / lengths
        bounds = np.searchsorted(starts, np.r_[first, len(flat)])
        for k, d in enumerate(chosen):
            s = slice(bounds[k], bounds[k + 1])
            runs[d] = starts[s] - first[k], lengths[s], label[starts[s]], mean_p[s]
            letters[d] = count[k] / sizes[k]
            if count[k]:
                best[d] = votes[k].argmax()
                share[d] = votes[k].max() / count[k]
                confidence[d] = sure[k] / count[k]
    names = pa.array(model.languages, pa.string())
    held = [r for r in runs if r is not None]
    cat = lambda k, kind: pa.array(np.concatenate([r[k] for r in held]) if held else [], kind)
    spans = pa.StructArray.from_arrays([cat(0, pa.int32()), cat(1, pa.int32()), names.take(cat(2, pa.int32())), cat(3, pa.float64())], fields=list(SPAN))
    offsets = np.r_[0, np.cumsum([0 if r is None else len(r[0]) for r in runs])].astype(np.int32)
    null = np.r_[[t is None for t in texts], False].astype(bool)
    return [
        names.take(pa.array(best, pa.int32(), mask=best < 0)),
        pa.array(words, pa.int32(), mask=null[:-1]),
        *(pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (share, letters, confidence)),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=null), spans),
    ]


LABELS = ["lang", "n_words", "share", "letters", "confidence", "spans"]
LABEL_TYPES = "lang string, n_words int, share double, letters double, confidence double, spans array<struct<start:int,length:int,lang:string,p:double>>"


def sliced(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def labelled(docs: DataFrame, model: Model | None = None, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, lang, n_words, share, letters, confidence, spans) for each row of docs.

    spans: runs of words (split at white space) of one language with the mean
    posterior of it; lang: the language of most words that have letters, share
    of them, mean posterior of each such word's label (confidence), and the
    part of words that have letters. Null text: null in all but doc_id. No
    words: 0 words, no spans, null else; no word with letters: null lang, share
    and confidence. Where docs has no row with a lang to learn from, every text
    is one span of the language 'und'. Repeated rows stay
    repeated. Other columns than doc_id, text and lang are not read.
    """
    model = model or learned(docs, per_language)

    def run(batches):
        unary = Unary(model)
        for batch in sliced(batches):
            columns = label_texts(batch.column(1).to_pylist(), unary)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *LABELS])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, {LABEL_TYPES}")


def learned(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    samples = sample(docs, per_language)
    if samples:
        return fit(samples)
    return Model(["und"], {}, np.zeros((SLOTS, 1)), np.zeros((1, 1)))


def identified(docs: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_letters: float = MIN_LETTERS) -> DataFrame:
    """Rows of docs, columns as they are, without those whose language can't be told.

    Rejected: null text, texts without words, texts of whose words fewer than
    min_letters have letters, texts whose confidence is under min_confidence.
    Code-switched texts stay. Each row is judged on its own, so copies and
    repeated rows fare alike. Nothing is rejected for its language where docs
    has no row with a lang to learn from.
    """
    model = learned(docs)
    at = docs.columns.index("text")

    def run(batches):
        unary = Unary(model)
        for batch in sliced(batches):
            lang, _, _, letters, confidence, _ = label_texts(batch.column(at).to_pylist(), unary)
            sure = letters.to_numpy(zero_copy_only=False) >= min_letters
            if len(model.languages) > 1:
                sure &= confidence.to_numpy(zero_copy_only=False) >= min_confidence
            yield batch.filter(pa.array(sure & lang.is_valid().to_numpy(zero_copy_only=False)))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the names are
    return plain.mapInArrow(trimmed(run), plain.schema).toDF(*docs.columns)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled() of all documents."""
    return labelled(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op6_language": op6_language}
SQL: dict[str, str] = {}
