"""Plans of hybrid queries, and the retrieval calls."""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.functions.text import brief, note_url, path_id
from tarnlight.operators import text_index
from tarnlight.operators.fulltext import counts, phrases_of, ranked, statistics, weighed
from tarnlight.operators.fusion import files, fused
from tarnlight.operators.vector_search import global_rank, per_lookup

LONG_QUERY, MAX_TOP, MAX_VARIANTS = 5, 100, 6
WEIGHTS = {"vec:original": 1.2, "bm25:original": 1.1, "bm25:phrase": 1.2, "vec:expanded": 0.7, "bm25:variants": 0.6}
Embed = Callable[[str], list[float]]
Chat = Callable[[str], str]


class ExpansionError(RuntimeError):
    """A query could not be expanded; retrieval goes on without expansion."""


@dataclass(frozen=True)
class SourceList:
    name: str
    queries: tuple[str, ...]
    phrase: bool = False

    @property
    def backend(self) -> str:
        return "vector" if self.name.startswith("vec:") else "bm25"

    @property
    def query_type(self) -> str:
        return "expanded" if self.name in ("vec:expanded", "bm25:variants") else "original"

    @property
    def weight(self) -> float:
        return WEIGHTS[self.name]


@dataclass(frozen=True)
class QueryPlan:
    query: str
    lists: tuple[SourceList, ...]
    rewrite: str | None = None
    variants: tuple[str, ...] = ()


def normalized_query(text: str) -> str:
    return " ".join((text or "").split())


def token_count(text: str) -> int:
    return len(re.findall(r"\w+", text))


def plan_q(query: str) -> QueryPlan:
    """Vector and phrase lists, and for more than LONG_QUERY tokens a list of single tokens."""
    q = normalized_query(query)
    lists = [SourceList("vec:original", (q,))]
    if token_count(q) > LONG_QUERY:
        lists.append(SourceList("bm25:original", (q,)))
    return QueryPlan(q, (*lists, SourceList("bm25:phrase", (q,), True)))


def deduplicated(queries: list[str]) -> list[str]:
    """The first spelling of each, without regard to case."""
    found: dict[str, str] = {}
    for q in map(normalized_query, queries):
        if q:
            found.setdefault(q.casefold(), q)
    return list(found.values())


def plan_q_plus(query: str, rewrite_fn: Chat, variants_fn: Chat) -> QueryPlan:
    """plan_q() and lists for a rewrite and for keyword variants, a comma-separated reply."""
    base = plan_q(query)
    try:
        rewrite = normalized_query(rewrite_fn(base.query))
        variants = deduplicated(variants_fn(base.query).split(","))[:MAX_VARIANTS]
    except Exception as e:  # whatever a chat function raises, the query itself can still run
        raise ExpansionError(str(e)) from e
    if not rewrite or not variants:
        raise ExpansionError("empty rewrite" if not rewrite else "no variants")
    lists = [*base.lists]
    if rewrite.casefold() != base.query.casefold():
        lists.append(SourceList("vec:expanded", (rewrite,)))
    lists.append(SourceList("bm25:variants", tuple(variants), True))
    return QueryPlan(base.query, tuple(lists), rewrite, tuple(variants))


def depths(top_n: int, vector: int | None = None, text: int | None = None) -> tuple[int, int]:
    for given in (vector, text):
        if given is not None and given <= 0:
            raise ValueError("a depth must be positive")
    return vector or min(512, max(64, 6 * top_n)), text or min(800, max(100, 10 * top_n))


def validate(query: str, top_n: int, lookups: list[str] | None) -> None:
    if not normalized_query(query):
        raise ValueError("the query is blank")
    if not 1 <= top_n <= MAX_TOP:
        raise ValueError(f"top_n must be in 1..{MAX_TOP}")
    if lookups is not None and not lookups:
        raise ValueError("no lookups")


def checked_vector(v: list[float]) -> list[float]:
    """The unit vector of a query; an empty one, one without length or one with other than numbers is an error."""
    try:
        values = [float(x) for x in v]
    except (TypeError, ValueError) as e:
        raise ValueError("a query vector must be numbers") from e
    norm = math.sqrt(sum(x * x for x in values))
    if not values or not norm or not math.isfinite(norm):
        raise ValueError("a query vector must have a length")
    return [x / norm for x in values]


class EmbedCache:
    """At most size vectors by text; the oldest goes first, reading keeps none."""

    def __init__(self, embed: Embed, size: int = 256):
        self.embed, self.size, self.held = embed, size, OrderedDict()

    def __call__(self, text: str) -> list[float]:
        if text not in self.held:
            self.held[text] = self.embed(text)
            if len(self.held) > self.size:
                self.held.popitem(last=False)
        return self.held[text]


def of_thresholds(thresholds: dict[str, float] | float) -> Column | float:
    if not isinstance(thresholds, dict):
        return thresholds
    out = F.lit(0.0)
    for name, value in thresholds.items():
        out = F.when(F.col("lookup") == name, float(value)).otherwise(out)
    return out


def candidates(chunks: DataFrame, plan: QueryPlan, embed: Embed, vector_depth: int, text_depth: int, thresholds: dict[str, float] | float = 0.0, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Candidates of all lists of the plan: vector lists ranked over all lookups, text lists in each of them.

    Chunks without a vector are in text lists alone. All text lists are served
    by the index of the chunks, or by one pass over their texts; texts are then
    read for the candidates only.
    """
    lists = {s.name: phrases_of(list(s.queries), s.phrase) for s in plan.lists if s.backend == "bm25"}
    phrases = [list(p) for p in dict.fromkeys(tuple(p) for ps in lists.values() for p in ps)]
    if phrases and index:
        counted, stats = text_index.found(index, phrases)
    elif phrases:
        counted = counts(chunks, phrases)
        stats = statistics(counted, len(phrases))
    found = []
    for s in plan.lists:
        if s.backend == "vector":
            near = per_lookup(chunks.select("lookup", "path", "chunk", "embedding"), checked_vector(embed(s.queries[0])), vector_depth, of_thresholds(thresholds))
            hits = global_rank(near, vector_depth).withColumn("source_list", F.lit(s.name))
        elif lists[s.name]:
            hits = ranked(weighed(counted, stats, [phrases.index(p) for p in lists[s.name]]), text_depth)
            hits = hits.withColumn("source_list", F.concat(F.lit(f"{s.name}:"), "lookup"))
        else:
            continue
        found.append(hits.select("source_list", F.lit(s.backend).alias("backend"), F.lit(s.query_type).alias("query_type"), F.lit(s.weight).alias("weight"), "lookup", "path", "chunk", "score", "rank"))
    rows = reduce(DataFrame.unionByName, found)
    return rows.join(chunks.select("lookup", "path", "chunk", "text"), ["lookup", "path", "chunk"]).select(*rows.columns[:4], "lookup", "path", "chunk", "text", "score", "rank")


@dataclass
class Result:
    """Ranked files and what the plan became."""

    files: DataFrame
    plan: QueryPlan
    requested: str
    mode: str
    fallback: dict | None = field(default=None)


def retrieve(chunks: DataFrame, plan: QueryPlan, embed: Embed, top_n: int, lookups: list[str] | None = None, thresholds: dict[str, float] | float = 0.0, vector_depth: int | None = None, text_depth: int | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Files for a plan; index, if given, must be that of chunks."""
    validate(plan.query, top_n, lookups)
    v, t = depths(top_n, vector_depth, text_depth)
    chosen = lambda df: df if lookups is None else df.where(F.col("lookup").isin(lookups))
    return files(fused(candidates(chosen(chunks), plan, embed, v, t, thresholds, index and tuple(map(chosen, index)))), top_n)


def retrieve_q(chunks: DataFrame, query: str, embed: Embed, top_n: int = 20, **options) -> Result:
    validate(query, top_n, options.get("lookups"))
    plan = plan_q(query)
    return Result(retrieve(chunks, plan, embed, top_n, **options), plan, "q", "q")


def retrieve_q_plus(chunks: DataFrame, query: str, embed: Embed, rewrite_fn: Chat, variants_fn: Chat, top_n: int = 20, **options) -> Result:
    """As retrieve_q(), with expansion; without it where that fails."""
    validate(query, top_n, options.get("lookups"))
    try:
        plan, mode, fallback = plan_q_plus(query, rewrite_fn, variants_fn), "q_plus", None
    except ExpansionError as e:
        plan, mode, fallback = plan_q(query), "q", {"reason": "expansion_failed", "message": str(e)}
    return Result(retrieve(chunks, plan, embed, top_n, **options), plan, "q_plus", mode, fallback)


def similar(chunks: DataFrame, vector: list[float], top_n: int = 3, thresholds: dict[str, float] | float = 0.0) -> DataFrame:
    """The top_n nearest chunks of all lookups: (lookup, path, chunk, text, score)."""
    k = min(512, max(64, 12 * top_n)) if top_n > 0 else 512
    near = per_lookup(chunks.select("lookup", "path", "chunk", "text", "embedding"), checked_vector(vector), k, of_thresholds(thresholds)).drop("embedding")
    ordered = near.orderBy(F.desc("score"), "lookup", "path", "chunk")
    return ordered.limit(top_n) if top_n > 0 else ordered


def find_chunk(chunks: DataFrame, lookup: str, path: str, chunk: int, content_hash: str | None = None) -> DataFrame:
    """One chunk by its place, by filters that reach the scan; with a hash only if it still has that content."""
    found = chunks.where((F.col("lookup") == lookup) & (F.col("path") == path) & (F.col("chunk") == chunk))
    return found.where(F.col("hash") == content_hash) if content_hash else found


def random_sample(chunks: DataFrame, n: int = 3, seed: int | None = None) -> DataFrame:
    """n chunks at random, with score 0."""
    return chunks.orderBy(F.rand(seed)).limit(max(n, 0)).withColumn("score", F.lit(0.0))


def entries(rows: DataFrame, url: Column | None = None, brief_chars: int | None = None) -> DataFrame:
    """Chunk rows for output: (lookup, path, id, url, chunk, text, score)."""
    text = F.col("text") if brief_chars is None else brief(F.col("text"), brief_chars)
    return rows.select("lookup", "path", path_id(F.col("path")).alias("id"), note_url(F.col("path"), url if url is not None else F.lit(None).cast("string")).alias("url"), "chunk", text.alias("text"), "score")


def compact(found: DataFrame, brief_chars: int = 300) -> DataFrame:
    """Files for reading: (lookup, file, score to 4 places, matched_chunks as short texts, none empty)."""
    texts = F.filter(F.transform("matched_chunks", lambda x: brief(x["text"], brief_chars)), lambda t: t != "")
    return found.select("lookup", F.col("path").alias("file"), F.round("score", 4).alias("score"), texts.alias("matched_chunks"))


def discuss(note: str, chat_fn: Chat, query: str = "") -> str:
    """A reply about a note; none for a blank one."""
    if not note.strip():
        return ""
    about = f"\nThe reader asked: {query.strip()}\n" if query.strip() else ""
    return chat_fn(f"Discuss the main points of this note.{about}\n{note}")


def extract_article(text: str, chat_fn: Chat) -> str:
    """An article as Markdown bullet points, in groups by theme with an empty line between them (see extraction_groups()); none for a blank one."""
    if not text.strip():
        return ""
    return chat_fn(f"Write the main points of this article as short Markdown bullet points. Put an empty line between groups of points on different themes.\n\n{text}")
