"""Profiles of communities and peaks: core notes, keywords, sources, neighbours, labels."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.patterns import KEYWORD
from tarnlight.functions.text import label_excerpt
from tarnlight.operators.graph import community_graph, neighbours

CORE, BRIDGE, NEIGHBOURS, LOCAL, KEYWORDS = 12, 8, 5, 14, 10
COMMON = sorted("about and content from has have into markdown note notes that the their theme there this topic will with".split())
HAN = re.compile(r"[一-鿿]")
THOUGHT = re.compile("<think>.*?</think>", re.S | re.I)
#: Quotes, brackets and slashes count as spaces in a label.
MARKS = dict.fromkeys(map(ord, "()[]{}\"'`“”‘’/|\\_"), " ")


def ranked(metrics: DataFrame, by: Column, top: int) -> DataFrame:
    """metrics with place, the first top notes of each community by a column from the highest, ties by id."""
    w = Window.partitionBy("community").orderBy(by.desc(), "id")
    return metrics.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def keywords(snippets: DataFrame, key: str, top: int = KEYWORDS) -> DataFrame:
    """(key, word, n, place): the most frequent words of (key, place, snippet), ties by their first place in the snippets in order."""
    parts = snippets.select(key, F.col("place").alias("snippet_place"), F.posexplode(F.regexp_extract_all("snippet", F.lit(KEYWORD), F.lit(0))).alias("pos", "raw"))
    words = parts.withColumn("word", F.lower("raw")).where(~F.col("word").isin(COMMON))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min(F.struct("snippet_place", "pos")).alias("first"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).where(F.col("place") <= top).select(key, "word", "n", "place")


def source_counts(notes: DataFrame, key: str) -> DataFrame:
    """(key, lookup, n)."""
    return notes.groupBy(key, "lookup").agg(F.count("*").alias("n"))


def listed(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(key, name): the values of a key in the order of place."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", value.alias("v")))).alias("x"))
    return rows.select(key, F.transform("x", lambda e: e["v"]).alias(name))


def community_profiles(notes: DataFrame, metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, size, core, bridge, keywords, neighbours, sources, signature) from notes (id, lookup, hash, text)."""
    text = notes.select("id", "hash", label_excerpt(F.col("text")).alias("snippet"), (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("there"))
    core = ranked(metrics, F.col("internal"), CORE).join(text, "id")
    bridge = ranked(metrics, F.col("bridge"), BRIDGE).join(text, "id").where("there")
    near = neighbours(community_graph(edges, metrics.select("id", "community")), NEIGHBOURS).withColumn("place", F.col("rank"))
    sources = source_counts(metrics.select("id", "community").join(notes.select("id", "lookup"), "id"), "community")
    result = metrics.groupBy("community").agg(F.count("*").alias("size"))
    for part in (
        listed(core.where("there"), "community", F.col("snippet"), "core"),
        listed(bridge, "community", F.col("snippet"), "bridge"),
        listed(keywords(core.where("there"), "community"), "community", F.col("word"), "keywords"),
        listed(near, "community", F.struct("neighbour", F.round("weight", 4).alias("weight")), "neighbours"),
        sources.groupBy("community").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lookup", "n")))).alias("sources")),
        listed(core, "community", F.col("hash"), "hashes"),
    ):
        result = result.join(part, "community", "left")
    for c, kind in (("core", "array<string>"), ("bridge", "array<string>"), ("keywords", "array<string>")):
        result = result.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    return result.withColumn("signature", F.sha2(F.to_json(F.struct("hashes", "keywords", "neighbours")), 256)).drop("hashes")


def peak_profiles(notes: DataFrame, metrics: DataFrame, points: DataFrame, peaks: DataFrame) -> DataFrame:
    """(community, rank, x, y, core, keywords, sources, signature) from the LOCAL notes nearest to each peak."""
    key = F.concat_ws(":", "community", "rank").alias("peak")
    at = peaks.select("community", "rank", F.col("x").alias("px"), F.col("y").alias("py"), key)
    rows = points.select("id", "x", "y").join(metrics.select("id", "community", "internal"), "id").join(at, "community")
    d2 = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    near = rows.withColumn("place", F.row_number().over(Window.partitionBy("peak").orderBy(d2, F.desc("internal"), "id"))).where(F.col("place") <= LOCAL)
    local = near.join(notes.select("id", "lookup", "hash", label_excerpt(F.col("text")).alias("snippet")), "id")
    result = at.toDF("community", "rank", "x", "y", "peak")
    for part in (
        listed(local, "peak", F.col("snippet"), "core"),
        listed(keywords(local, "peak"), "peak", F.col("word"), "keywords"),
        source_counts(local, "peak").groupBy("peak").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lookup", "n")))).alias("sources")),
        listed(local, "peak", F.col("hash"), "hashes"),
    ):
        result = result.join(part, "peak", "left")
    signature = F.sha2(F.to_json(F.struct("community", "rank", F.round(F.col("x") / 20).alias("gx"), F.round(F.col("y") / 20).alias("gy"), "hashes", "keywords")), 256)
    return result.select("community", "rank", "x", "y", F.slice("core", 1, 10).alias("core"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "sources", signature.alias("signature"))


def clean_label(text: str) -> str:
    """A label without quotes, brackets and slashes: 8 characters with Han script, else 4 words and 42 characters at most."""
    flat = " ".join(str(text).translate(MARKS).split()).strip(" ,.-:;，。：；")
    return "".join(flat.split())[:8] if HAN.search(flat) else " ".join(flat.split()[:4])[:42]


def label_key(text: str) -> str:
    return "".join(clean_label(text).lower().split())


def fallback_label(words: list[str], number: int, used: set[str]) -> dict:
    """The first keyword that is not used yet, with three others; else a numbered theme."""
    clean = [w for w in map(clean_label, words) if w]
    for word in clean:
        if label_key(word) not in used:
            chips = [c for c in clean if c != word][:3]
            return {"label": word, "subtitle": " · ".join(chips), "chips": chips, "source": "fallback"}
    return {"label": f"主题{number}", "subtitle": "", "chips": clean[:3], "source": "fallback"}


def parsed_label(reply: str, words: list[str]) -> dict:
    """A label from the first JSON object of a reply, thoughts left out; ValueError without one or without a name."""
    text = THOUGHT.sub(" ", str(reply))
    found, at = None, text.find("{")
    while at >= 0 and found is None:
        try:
            found, _ = json.JSONDecoder().raw_decode(text, at)
        except json.JSONDecodeError:
            at = text.find("{", at + 1)
    if found is None:
        raise ValueError("no JSON object in the reply")
    name = clean_label(found.get("primaryLabel") or found.get("label") or "")
    if not name:
        raise ValueError("the reply has no label")
    chips = [c for c in map(clean_label, found.get("keywordChips") or []) if c][:3]
    chips += [c for c in dict.fromkeys(map(clean_label, words)) if c and c not in chips]
    return {"label": name, "subtitle": clean_label(found.get("subtitle") or "")[:60], "chips": chips[:3], "source": "llm"}


def assigned_labels(profiles: list[dict], chat_fn: Callable[[dict, list[str]], str] | None = None, cache: Path | None = None, retries: int = 2, workers: int = 4) -> list[dict]:
    """A label for each profile (keywords, signature), all distinct: from the cache, from chat_fn(profile, used labels), else a keyword.

    First replies are asked for by so many workers at once, before any other
    label than those of the cache is known; a label that was given meanwhile is
    asked for again, in the order of the profiles.
    """
    held: dict = {}
    if cache and cache.exists():
        try:
            held = json.loads(cache.read_text(encoding="utf-8"))
        except json.JSONDecodeError:
            held = {}
    kept: dict[int, dict] = {}
    used: set[str] = set()
    for i, p in enumerate(profiles):
        label = held.get(p["signature"])
        if label and label.get("source") == "llm" and label_key(label["label"]) not in used:
            kept[i] = label
            used.add(label_key(label["label"]))
    known = sorted(used)

    def asked(p: dict, taken: list[str]) -> dict | None:
        try:
            return parsed_label(chat_fn(p, taken), p["keywords"])
        except Exception:  # a failed call is a failed try
            return None

    open_ = [i for i in range(len(profiles)) if i not in kept] if chat_fn else []
    with ThreadPoolExecutor(max(1, workers)) as pool:
        first = dict(zip(open_, pool.map(lambda i: asked(profiles[i], known), open_)))
    out: list[dict] = []
    for i, p in enumerate(profiles):
        label = kept.get(i)
        if label is None:
            made = first.get(i)
            for _ in range(retries if chat_fn else 0):
                if made and label_key(made["label"]) not in used:
                    break
                made = asked(p, sorted(used))
            label = made if made and label_key(made["label"]) not in used else fallback_label(p["keywords"], i + 1, used)
            used.add(label_key(label["label"]))
        held[p["signature"]] = label
        out.append(label)
    if cache and profiles:
        cache.parent.mkdir(parents=True, exist_ok=True)
        with cache.open("w", encoding="utf-8") as f:
            print(json.dumps(held, indent=2, ensure_ascii=False), file=f)
    return out
