"""Weighted reciprocal-rank fusion of ranked lists, and files from fused chunks.

All of it works on candidates, whose number is bounded by the depths of the
lists times the lookups and not by the corpus; windows over all of them are
therefore small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
RRF_SHARE, SIGNAL_SHARE = 0.75, 0.15
FIRST_BOOST, SECOND_BOOST, EXPANDED_ONLY = 0.05, 0.02, -0.05
STRONG, KEPT_CHUNKS = 0.35, 3
MULTI_BOOST, EXTRA_LIST, EXTRA_CAP = 0.02, 0.01, 0.02
KEY = ["lookup", "path", "chunk"]


def clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def evidence(candidates: DataFrame) -> DataFrame:
    """candidates with their normalised score in their list and their contribution to the fused rank."""
    w = Window.partitionBy("source_list")
    low, high = F.min("score").over(w), F.max("score").over(w)
    norm = F.when(high > low, (F.col("score") - low) / (high - low)).when(F.col("score") > 0, 1.0).otherwise(0.0)
    return candidates.withColumns({"normalized_score": norm, "rrf_contribution": F.col("weight") * (1.0 / (RRF_K + F.col("rank")))})


def fused(candidates: DataFrame) -> DataFrame:
    """A row for each (lookup, path, chunk) of candidates (source_list, backend, query_type, weight, lookup, path, chunk, text, score, rank).

    (…, text, rrf, signal, normalized_rrf, normalized_score_signal, top_rank_original,
    expanded_only_penalty, final_score, sources, evidence). Sums run in the order of
    (source_list, rank), so that they don't depend on the partitioning.
    """
    item = F.struct("source_list", "rank", "backend", "query_type", F.col("score").alias("raw_score"), "normalized_score", "rrf_contribution", "weight")
    grouped = evidence(candidates).groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("e"), F.min("text").alias("text"))
    total = lambda f: F.aggregate("e", F.lit(0.0), lambda s, x: s + f(x))
    sums = grouped.withColumns({"rrf": total(lambda x: x["rrf_contribution"]), "signal": total(lambda x: x["weight"] * x["normalized_score"])})
    whole = Window.partitionBy()
    share = lambda c: F.when(F.max(c).over(whole) > 0, F.col(c) / F.max(c).over(whole)).otherwise(0.0)
    originals = F.transform(F.filter("e", lambda x: x["query_type"] == "original"), lambda x: x["rank"])
    shares = sums.withColumns({"normalized_rrf": share("rrf"), "normalized_score_signal": share("signal"), "ranks": originals})
    boosts = shares.withColumns(
        {
            "top_rank_original": F.when(F.array_contains("ranks", 1), FIRST_BOOST).when(F.exists("ranks", lambda r: r.isin(2, 3)), SECOND_BOOST).otherwise(0.0),
            "expanded_only_penalty": F.when(F.size("ranks") == 0, EXPANDED_ONLY).otherwise(0.0),
        }
    )
    final = clamped(RRF_SHARE * F.col("normalized_rrf") + SIGNAL_SHARE * F.col("normalized_score_signal") + F.col("top_rank_original") + F.col("expanded_only_penalty"))
    shown = F.transform("e", lambda x: x.dropFields("weight"))
    return boosts.select(*KEY, "text", "rrf", "signal", "normalized_rrf", "normalized_score_signal", "top_rank_original", "expanded_only_penalty", F.round(final, 12).alias("final_score"), F.array_distinct(F.transform("e", lambda x: x["source_list"])).alias("sources"), shown.alias("evidence"))


def global_depth(top_n: int) -> int:
    return max(30, min(100, 3 * top_n))


def files(chunks: DataFrame, top_n: int) -> DataFrame:
    """The top_n files of fused(): (lookup, path, score, anchor_score, anchor_chunk, matched_chunks, source_lists, original_match_count, expanded_match_count, multi_chunk_evidence, source_list_diversity)."""
    everywhere = Window.orderBy(F.desc("final_score"), *KEY)
    own = Window.partitionBy("lookup", "path").orderBy(F.desc("final_score"), "chunk")
    kept = chunks.withColumns({"place": F.row_number().over(everywhere), "own": F.row_number().over(own)})
    kept = kept.where((F.col("own") == 1) | (F.col("final_score") >= STRONG) | (F.col("place") <= global_depth(top_n))).where(F.col("own") <= KEPT_CHUNKS)
    has = lambda kind: F.exists("evidence", lambda e: e["query_type"] == kind)
    item = F.struct("own", "chunk", F.col("final_score").alias("score"), "text", "sources", "evidence", has("original").alias("original"), has("expanded").alias("expanded"))
    rows = kept.groupBy("lookup", "path").agg(F.array_sort(F.collect_list(item)).alias("m"))
    strong = F.filter("m", lambda x: x["score"] >= STRONG)
    rows = rows.withColumns({"anchor": F.col("m")[0], "strong": strong})
    multi = F.when((F.size("strong") >= 2) & F.exists("strong", lambda x: x["original"]), MULTI_BOOST).otherwise(0.0)
    lists = F.size(F.array_distinct(F.flatten(F.transform("strong", lambda x: x["sources"]))))
    rows = rows.withColumns({"multi_chunk_evidence": multi, "source_list_diversity": F.least(F.greatest(lists - 1, F.lit(0)) * EXTRA_LIST, F.lit(EXTRA_CAP))})
    count = lambda kind: F.size(F.filter("m", lambda x: x[kind]))
    result = rows.select(
        "lookup",
        "path",
        F.round(clamped(F.col("anchor.score") + F.col("multi_chunk_evidence") + F.col("source_list_diversity")), 12).alias("score"),
        F.col("anchor.score").alias("anchor_score"),
        F.col("anchor.chunk").alias("anchor_chunk"),
        F.transform("m", lambda x: x.dropFields("own", "original", "expanded")).alias("matched_chunks"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda x: x["sources"])))).alias("source_lists"),
        count("original").alias("original_match_count"),
        count("expanded").alias("expanded_match_count"),
        "multi_chunk_evidence",
        "source_list_diversity",
    )
    return result.orderBy(F.desc("score"), F.desc("anchor_score"), F.desc("original_match_count"), "lookup", "path").limit(top_n)
