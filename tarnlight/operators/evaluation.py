"""Latency percentiles, comparison of rankings, quality of chunks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.text import count_tokens

SMALL, OVERSIZED = 50, 1000


def percentile(values: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, one column for each share): the value at place ceil((n - 1) * share) of the sorted ones, no interpolation.

    Values are ranked by a window and not collected in one row.
    """
    w = Window.partitionBy(key).orderBy(value)
    rows = values.where(F.col(value).isNotNull()).withColumns({"p": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(key))})
    at = lambda share: F.max(F.when(F.col("p") == F.ceil((F.col("n") - 1) * share), F.col(value)))
    return rows.groupBy(key).agg(*[at(s).alias(name) for name, s in shares.items()])


def compared(baseline: DataFrame, candidate: DataFrame, key: str = "query") -> DataFrame:
    """(key, overlap, jaccard, mean_rank_displacement, removed, added) of two rankings (key, lookup, path, rank)."""
    a = baseline.select(key, "lookup", "path", F.col("rank").alias("ra"))
    b = candidate.select(key, "lookup", "path", F.col("rank").alias("rb"))
    both = a.join(b, [key, "lookup", "path"], "full_outer")
    n = F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull())
    place = lambda missing: F.array_sort(F.collect_list(F.when(F.col(missing).isNull(), F.concat_ws(":", "lookup", "path"))))
    return both.groupBy(key).agg(n.alias("overlap"), F.round(n / F.count("*"), 4).alias("jaccard"), F.round(F.avg(F.abs(F.col("ra") - F.col("rb"))), 2).alias("mean_rank_displacement"), place("rb").alias("removed"), place("ra").alias("added"))


def scenario_means(comparisons: DataFrame, scenario: str) -> DataFrame:
    return comparisons.groupBy(scenario).agg(*[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("overlap", "jaccard", "mean_rank_displacement")])


def judged(chunks: DataFrame) -> DataFrame:
    """chunks with their tokens and what is wrong with each: small, oversized or duplicate (its text came before)."""
    first = Window.partitionBy("lookup", "hash").orderBy("path", "chunk")
    rows = chunks.withColumns({"tokens": count_tokens(F.col("text")), "n": F.row_number().over(first)})
    issues = {"small": F.col("tokens") < SMALL, "oversized": F.col("tokens") > OVERSIZED, "duplicate": F.col("n") > 1}
    return rows.withColumn("issues", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in issues.items()]))).drop("n")


def chunk_report(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(lookup, files, indexed, empty, chunks, small, oversized, duplicates): chunks of fewer than SMALL or more than OVERSIZED tokens, and those whose text came before.

    files has (lookup, path) of all files that were read; those without a chunk
    are empty. Without it the files are those of the chunks.
    """
    count = lambda issue: F.count_if(F.array_contains("issues", issue))
    issues = {"small": count("small"), "oversized": count("oversized"), "duplicates": count("duplicate")}
    report = judged(chunks).groupBy("lookup").agg(F.count_distinct("path").alias("indexed"), F.count("*").alias("chunks"), *[c.alias(n) for n, c in issues.items()])
    read = (chunks if files is None else files).groupBy("lookup").agg(F.count_distinct("path").alias("files"))
    whole = read.join(report, "lookup", "left").fillna(0)
    return whole.select("lookup", "files", "indexed", (F.col("files") - F.col("indexed")).alias("empty"), "chunks", *issues)


def samples(chunks: DataFrame, per_issue: int = 5) -> DataFrame:
    """(lookup, issue, path, chunk, tokens): the first per_issue chunks of each issue, and of those without one (issue ok) the first, those at the quartiles and the last, by path and chunk."""
    rows = judged(chunks).select("lookup", "path", "chunk", "tokens", "issues")
    w = Window.partitionBy("lookup", "issue").orderBy("path", "chunk")
    bad = rows.withColumn("issue", F.explode("issues")).withColumn("at", F.row_number().over(w)).where(F.col("at") <= per_issue)
    good = rows.where(F.size("issues") == 0).withColumn("issue", F.lit("ok")).withColumns({"at": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("lookup", "issue"))})
    places = F.array(F.lit(0), *[F.floor(F.col("n") * k / 4) for k in (1, 2, 3)], F.col("n") - 1)
    good = good.where((F.col("n") <= 5) | F.array_contains(places, F.col("at").cast("long")))
    columns = ["lookup", "issue", "path", "chunk", "tokens"]
    return bad.select(*columns).union(good.select(*columns))


def cache_key(config: bytes, stores: list[tuple], **asked: object) -> str:
    """SHA-256 of a benchmark's setting: the configuration, what identifies each store (name, folder, version) and what is asked (scenario, queries, depths, limit)."""
    digest = hashlib.sha256(config)
    digest.update(json.dumps([list(map(str, s)) for s in stores]).encode("utf-8"))
    digest.update(json.dumps(asked, sort_keys=True, default=str).encode("utf-8"))
    return digest.hexdigest()
