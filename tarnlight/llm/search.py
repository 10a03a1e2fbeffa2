"""Exact top-k search by BM25: an inverted index in shards, block-max WAND in each, an exact merge.

Documents are indexed where they lie: a shard is a run of at most SHARD_WORDS
words of one partition, with its postings by term. Number of documents, mean
length and document frequencies are global, so that the scores of all shards
compare and the merge of their top-k is exact. The bounds of the blocks of
BLOCK postings follow from these statistics when a shard is opened.

score = sum over the query's distinct terms of
    ln(1 + (N - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean length))
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.shared import spread, written

K1, B = 1.2, 0.75
TOP = 10
BLOCK = 64
SHARD_WORDS = 4_000_000
QUERY_BATCH = 2_000
TERM = re.compile(r"[^\W_]+")
SLACK = 1e-8  # far above the error of a score, far below a difference that counts


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Ids(dict):
    def __missing__(self, term: str) -> int:
        self[term] = n = len(self)
        return n


def index(docs: DataFrame) -> DataFrame:
    """(shard, term, n, places, counts, doc_ids), written in the shared folder: a row for each term of a shard and one, with null term, for its documents.

    places: numbers of the documents in the shard, in order, counts: the term's
    occurrences in each, as bytes of int32. In the row of the documents n is
    their number, counts has their lengths and doc_ids their ids. Null texts
    are not indexed; empty texts count as documents. Repeated rows are
    documents of their own.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["shard", "term", "n", "places", "counts", "doc_ids"]

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        vocabulary, flat, lengths, ids, size = Ids(), [], [], [], 0
        id_type = None

        def flush():
            nonlocal made
            shard = part << 20 | made
            made += 1
            lens = np.array(lengths, np.int64)
            word = np.concatenate(flat) if flat else np.zeros(0, np.int64)
            key, tf = np.unique(word * max(1, len(lens)) + np.repeat(np.arange(len(lens)), lens), return_counts=True)
            term, place = key // max(1, len(lens)), (key % max(1, len(lens))).astype(np.int32)
            starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
            tf = tf.astype(np.int32)
            cut = pa.array((starts * 4).astype(np.int32))
            packed = [pa.BinaryArray.from_buffers(pa.binary(), len(vocabulary), [None, cut.buffers()[1], pa.py_buffer(x.tobytes())]) for x in (place, tf)]
            n = len(vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(list(vocabulary), pa.string()), pa.array(np.diff(starts)), *packed, pa.nulls(n, pa.list_(id_type))], names)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), pa.array([len(lens)]), pa.array([None], pa.binary()), pa.array([lens.astype(np.int32).tobytes()]), pa.array([ids], pa.list_(id_type))], names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(text)
                flat.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
                lengths.append(len(found))
                ids.append(doc_id)
                size += len(found)
                if size >= SHARD_WORDS:
                    yield from flush()
                    vocabulary, flat, lengths, ids, size = Ids(), [], [], [], 0
        if ids:
            yield from flush()

    rows = docs.select("doc_id", "text").where("text is not null")
    return written(rows.mapInArrow(run, f"shard long, term string, n long, places binary, counts binary, doc_ids array<{kind}>"), "index")


class Postings:
    """One term in one shard: documents, contributions to the score, bounds of the blocks and of the whole."""

    def __init__(self, places: np.ndarray, impacts: np.ndarray):
        self.places, self.impacts = places.tolist(), impacts.tolist()
        starts = np.arange(0, len(places), BLOCK)
        self.bounds = np.maximum.reduceat(impacts, starts).tolist()
        self.bound = max(self.bounds)


def wand(lists: list[Postings], k: int, rank: list[int], n_docs: int) -> list[tuple[float, int]]:
    """The k best (score, document) by score rounded to 9 places, then rank; block-max WAND over the lists.

    Bounds have SLACK added, so that no document is passed over for a rounding
    error, and documents that tie with the worst held are scored.
    """
    best: list[tuple[float, int, int]] = []  # heap of (score, -rank, document)
    least = -math.inf
    cursors = [[p.places[0], 0, p] for p in lists]  # document, position, postings
    while cursors:
        cursors.sort(key=lambda c: c[0])
        total, pivot = SLACK, -1
        for i, c in enumerate(cursors):
            total += c[2].bound
            if total >= least:
                pivot = i
                break
        if pivot < 0:
            break
        doc = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
            pivot += 1
        total, until = SLACK, n_docs
        for c in cursors[: pivot + 1]:
            p = c[2]
            if c[0] < doc:  # shallow: the block that holds doc, without moving the cursor
                at = bisect_left(p.places, doc, c[1])
                if at == len(p.places):
                    continue
            else:
                at = c[1]
            block = at // BLOCK
            total += p.bounds[block]
            end = min((block + 1) * BLOCK, len(p.places)) - 1
            until = min(until, p.places[end] + 1)
        if total >= least:
            parts = []
            for c in cursors[: pivot + 1]:
                p = c[2]
                if c[0] < doc:
                    c[1] = bisect_left(p.places, doc, c[1])
                if c[1] < len(p.places) and p.places[c[1]] == doc:
                    parts.append(p.impacts[c[1]])
                    c[1] += 1
                c[0] = p.places[c[1]] if c[1] < len(p.places) else n_docs
            entry = (round(math.fsum(parts), 9), -rank[doc], doc)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
            if len(best) == k:
                least = best[0][0]
        else:
            goal = max(doc + 1, until)
            if pivot + 1 < len(cursors):
                goal = min(goal, cursors[pivot + 1][0])
            for c in cursors[: pivot + 1]:
                if c[0] < goal:
                    p = c[2]
                    c[1] = bisect_left(p.places, goal, c[1])
                    c[0] = p.places[c[1]] if c[1] < len(p.places) else n_docs
        if any(c[0] >= n_docs for c in cursors[: pivot + 1]):
            cursors = [c for c in cursors if c[0] < n_docs]
    return [(s, d) for s, _, d in sorted(best, reverse=True)]


def search(shards: DataFrame, queries: DataFrame, k: int = TOP, batch: int = QUERY_BATCH) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents for each row of queries (item_id, text), from index().

    Only documents with a score above 0 are given. Scores are rounded to 9
    places; ties go to the lesser doc_id, a null one last. Null or empty query
    texts find nothing; repeated rows of queries are queries of their own, with
    results of their own. Queries go in batches of QUERY_BATCH rows, whatever
    their number, so what the driver and each shard hold is bounded by it.
    """
    spark = shards.sparkSession
    kinds = dict(shards.dtypes)["doc_ids"][len("array<") : -1], dict(queries.dtypes)["item_id"]
    n_docs, mean = shards.where("term is null").select("n", "counts").mapInArrow(_lengths, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    rows = queries.select("item_id", "text").toLocalIterator()
    results = []
    while chunk := list(islice(rows, batch)):
        wanted = [(r["item_id"], sorted(set(terms_of(r["text"] or "")))) for r in chunk]
        results.append(_search_batch(spark, shards, wanted, k, n_docs or 0, (mean or 0) / max(1, n_docs or 0), kinds))
    if not results:
        return spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score double")
    found = results[0]
    for r in results[1:]:
        found = found.union(r)
    return found


def _lengths(batches):
    for b in batches:
        words = [int(np.frombuffer(x, np.int32).sum()) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64())], ["n", "words"])


def _search_batch(spark: SparkSession, shards: DataFrame, wanted: list[tuple], k: int, n_docs: int, mean: float, kinds: tuple[str, str]) -> DataFrame:
    vocabulary = sorted({t for _, ts in wanted for t in ts})
    asked = spark.createDataFrame([(t,) for t in vocabulary], "asked string")
    mine = shards.join(F.broadcast(asked), F.col("term") == F.col("asked"))  # at most a batch's terms
    df = {r["term"]: r["df"] for r in mine.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    idf = {t: math.log(1 + (n_docs - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    plans = spark.sparkContext.broadcast([[t for t in ts if t in idf] for _, ts in wanted])
    weights = spark.sparkContext.broadcast(idf)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf[pdf["term"].isna()].iloc[0]
        lengths = np.frombuffer(whole["counts"], np.int32)
        ids = [None if x is None or x != x else x for x in whole["doc_ids"]]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))
        rank = [0] * len(ids)
        for r, i in enumerate(order):
            rank[i] = r
        norm = K1 * (1 - B + B * lengths / (mean or 1))
        held = {}
        for term, places, counts in pdf.loc[pdf["term"].notna(), ["term", "places", "counts"]].itertuples(index=False):
            at, tf = np.frombuffer(places, np.int32), np.frombuffer(counts, np.int32)
            held[term] = Postings(at, weights.value[term] * tf * (K1 + 1) / (tf + norm[at]))
        out: list[tuple] = []
        for q, terms in enumerate(plans.value):
            lists = [held[t] for t in terms if t in held]
            if lists:
                out += [(q, ids[d], s) for s, d in wand(lists, k, rank, len(ids))]
        return pd.DataFrame({"q": [x[0] for x in out], "doc_id": pd.Series([x[1] for x in out], dtype=object), "score": [float(x[2]) for x in out]})

    rows = mine.drop("asked").unionByName(shards.where("term is null"))
    local = rows.groupBy("shard").applyInPandas(one, f"q int, doc_id {kinds[0]}, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(wanted)], f"q int, item_id {kinds[1]}")
    return top.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL
), stats AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM docs
), tf AS (
  SELECT r, doc_id, len, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS len, unnest(w) AS term FROM docs) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), asked AS (
  SELECT DISTINCT q, item_id, term FROM (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark)
), scored AS (
  SELECT q, item_id, r, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * len / mean))), 9) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) CROSS JOIN stats GROUP BY q, item_id, r, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM scored
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
QUERIES = {"op3_search": op3_search}
SQL = {"op3_search": OP3_SQL}
