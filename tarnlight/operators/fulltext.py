"""BM25 over phrases, with statistics by lookup."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.text import ACCENTED, PLAIN, index_terms
from tarnlight.shared import written

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
KEY = ["lookup", "path", "chunk"]
_TERM = re.compile(r"[^\W_]+")
_FOLD = str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN) :])


def terms(text: str) -> list[str]:
    """index_terms() for a query, on the driver."""
    return _TERM.findall(text.lower().translate(_FOLD))


def phrases_of(queries: list[str], phrase: bool) -> list[list[str]]:
    """Terms of each phrase of a query: the queries themselves, or each of their tokens; repeats are dropped by their spelling, case included."""
    parts = queries if phrase else [t for q in queries for t in re.findall(r"\w+", q)]
    return [p for p in (terms(x) for x in dict.fromkeys(parts)) if p]


def postings(chunks: DataFrame) -> DataFrame:
    """(lookup, path, chunk, pos, term) of the full-text index."""
    return chunks.select(*KEY, F.posexplode(index_terms(F.col("text"))).alias("pos", "term"))


def repeats_itself(phrase: list[str]) -> bool:
    """Whether two occurrences of the phrase can overlap."""
    return any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase)))


def occurrences(flat: Column, phrase: list[str]) -> Column:
    """Occurrences of the phrase, overlapping ones too, in a text of terms with a space of its own before and after each."""
    said = f" {'  '.join(phrase)} "
    if repeats_itself(phrase):
        return F.when(F.contains(flat, F.lit(said)), F.regexp_count(flat, F.lit(f"(?={said})"))).otherwise(0)
    gone = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(said), F.lit("")))
    return (gone / len(said.encode("utf-8"))).cast("int")


def counted(chunks: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """chunks with len, their number of terms, and f, the occurrences of each phrase."""
    found = index_terms(F.col("text"))
    flat = F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))
    return chunks.withColumns({"len": F.size(found), "f": F.array(*[occurrences(flat, p) for p in phrases])})


def counts(chunks: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(lookup, path, chunk, len, f), written: one pass over the texts for all phrases of any number of lists, one narrow row a chunk."""
    return written(counted(chunks.select(*KEY, "text"), phrases).drop("text"), "phrase-counts")


def statistics(counts: DataFrame, phrases: int) -> DataFrame:
    """(lookup, n, avgdl, df): one narrow row for each lookup, made with map-side combine."""
    dfs = F.array(*[F.count_if(F.col("f")[i] > 0) for i in range(phrases)])
    return counts.groupBy("lookup").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), dfs.alias("df"))


def weighed(counts: DataFrame, stats: DataFrame, at: list[int]) -> DataFrame:
    """Rows of counts that have one of the phrases at the places at of f, with their score, rounded to 12 places; stats is joined and left out."""
    total = F.lit(0.0)
    for i in at:
        d = F.col("df")[i]
        idf = F.log((F.col("n") - d + 0.5) / (d + 0.5))
        f = F.col("f")[i]
        weight = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        total = total + weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    hits = counts.where(reduce(or_, [F.col("f")[i] > 0 for i in at]))
    return hits.join(F.broadcast(stats), "lookup").withColumn("score", F.round(total, 12)).drop("n", "avgdl", "df")


def bm25(chunks: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """chunks that have one of the phrases, with their score, rounded to 12 places.

    Two passes over the texts and no shuffle of them: one for the statistics of
    each lookup, one for the scores. The columns of chunks stay as they are.
    """
    if not phrases:
        return chunks.where(F.lit(False)).withColumn("score", F.lit(0.0))
    stats = statistics(counted(chunks.select(*KEY, "text"), phrases), len(phrases))
    return weighed(counted(chunks, phrases), stats, list(range(len(phrases)))).select(*chunks.columns, "score")


def ranked(scored: DataFrame, depth: int) -> DataFrame:
    """The depth best of each lookup with their rank there, ties by path and chunk."""
    w = Window.partitionBy("lookup").orderBy(F.desc("score"), "path", "chunk")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)
