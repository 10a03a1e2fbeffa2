"""Queries over the driver's tables, one for each operator, with the SQL that they must agree with."""

from __future__ import annotations

import datetime as dt
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions import patterns as P
from tarnlight.functions import text as T
from tarnlight.functions.chunking import journal_chunks, markdown_chunks, text_chunks
from tarnlight.functions.vectors import bucket_key, doubles, dumped, neighbour_keys, parsed
from tarnlight.operators import communities, duplicates, evaluation, graph, ingest, layout, profiles, terrain, text_index, vector_search
from tarnlight.operators.components import components
from tarnlight.operators.fulltext import counts, phrases_of, postings, ranked, statistics, weighed
from tarnlight.operators.fusion import EXTRA_CAP, EXTRA_LIST, MULTI_BOOST, STRONG, fused, global_depth
from tarnlight.plans import mapping, retrieval
from tarnlight.plans.mapping import MapOptions
from tarnlight.shared import new_path, spread, written
from tarnlight.sources.files import chunked
from tarnlight.sources.notes import all_notes, notes, query_vector, table, vector_notes

QUERY = "the thatin of hehely and ononst"
REWRITE = 3
VARIANTS = ("thatin", "of the", "la que")
#: What the full-text lists look for in the queries above, written out for the SQL.
TOKENS, WHOLE, VARIANT_TERMS = [["the"], ["thatin"], ["of"], ["hehely"], ["and"], ["ononst"]], [["the", "thatin", "of", "hehely", "and", "ononst"]], [["thatin"], ["of", "the"], ["la", "que"]]
VEC, TOP, THRESHOLD = 7, 20, 0.05
DUP, KNN, POINT_SEED = 0.35, 10, 42
SINCE = "2024-01-20 00:00:00"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NOTES = "notes AS (SELECT lang AS lookup, '/notes/' || source || '/' || doc_id || '.md' AS path, 0 AS chunk, sha256(text) AS hash, text, doc_id FROM documents)"
VECTORS = f"{NOTES}, vectors AS (SELECT n.*, CAST(e.embedding AS DOUBLE[]) AS embedding, CAST(e.label AS INT) AS label FROM notes n JOIN embeddings e ON e.vec_id = n.doc_id)"
TERMS = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')"
BUDGET = r"\p{Han}|[\p{L}\p{N}]+|\S"


# Text


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{BUDGET}')) AS INT) AS tokens FROM documents")
def count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


@query(rf"SELECT lang AS lookup, term, count(*) AS n FROM (SELECT lang, unnest({TERMS}) AS term FROM documents) GROUP BY ALL")
def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    return postings(notes(spark, sf)).groupBy("lookup", "term").agg(F.count("*").alias("n"))


@query(r"""
WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN len(s) > 300 THEN rtrim(s[1:297]) || '...' ELSE s END AS brief FROM flat""")
def squeeze_brief(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.brief(F.col("text")).alias("brief"))


@query(f"WITH {NOTES} SELECT doc_id, path.split('/')[-2] || '/' || path.split('/')[-1] AS id, 'https://notes.example/' || doc_id AS url, 'file://' || path AS file_url FROM notes")
def extract_id_url(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return notes(spark, sf).select("doc_id", T.path_id(path).alias("id"), T.note_url(path, F.lit("https://notes.example/")).alias("url"), T.note_url(path, F.lit(None).cast("string")).alias("file_url"))


@query(r"""
SELECT doc_id, list_extract(string_split(text, chr(10)), CASE WHEN doc_id % 7 < 3 THEN doc_id % 7 + 1 ELSE doc_id % 7 - 7 END) AS chunk FROM documents""")
def chunk_at(spark: SparkSession, sf: str) -> DataFrame:
    """A line of each document by its place, from the start or from the end."""
    place = F.when(F.col("doc_id") % 7 < 3, F.col("doc_id") % 7).otherwise(F.col("doc_id") % 7 - 7)
    return table(spark, sf, "documents").select("doc_id", T.chunk_at(F.split("text", "\n"), place).alias("chunk"))


@query(f"WITH {NOTES} SELECT doc_id, CASE WHEN starts_with(path, '/notes/src1/') THEN path[13:] ELSE path END AS short FROM notes")
def concise_path(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("doc_id", T.concise_path(F.translate("path", "/", "\\"), "/notes/src1/").alias("short"))


@query(r"""
WITH h AS (SELECT source, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(source, ''), lambda c: unicode(c)::BIGINT)), lambda s, c: (s * 31 + c) & 4294967295) AS h FROM (SELECT DISTINCT source FROM documents))
SELECT source, '#' || lower(printf('%02x%02x%02x', (h & 63) + 192, ((h >> 8) & 63) + 192, ((h >> 16) & 63) + 192)) AS color FROM h""")
def light_color(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source").distinct().select("source", T.light_color(F.col("source")).alias("color"))


@query("SELECT vec_id, CAST(embedding AS DOUBLE[])[1] AS first, len(embedding) AS dimensions FROM embeddings")
def vector_json(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to JSON and back."""
    v = parsed(dumped(doubles(F.col("embedding"))))
    return table(spark, sf, "embeddings").select("vec_id", v[0].alias("first"), F.size(v).alias("dimensions"))


def _with_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("n_chars") > 2000, "evergreen").when(F.col("n_chars") > 800, "'growing'").when(F.col("n_chars") > 300, "Seed").otherwise("")
    head = F.concat(F.lit('---\ntitle: "Note '), F.col("doc_id").cast("string"), F.lit('"\nstatus: '), status, F.lit("\n---\n# Part of "), "source", F.lit("\n"))
    return table(spark, sf, "documents").withColumn("text", F.concat(head, "text"))


@query("""
WITH s AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'evergreen' WHEN n_chars > 800 THEN 'growing' WHEN n_chars > 300 THEN 'Seed' END AS status FROM documents)
SELECT doc_id, 'Note ' || doc_id AS title, status, status IS NULL OR lower(status) = 'seed' AS skipped FROM s""")
def frontmatter_status(spark: SparkSession, sf: str) -> DataFrame:
    block = T.frontmatter(F.col("text"))
    rows = _with_frontmatter(spark, sf).select("doc_id", T.frontmatter_value(block, "title").alias("title"), T.frontmatter_value(block, "status").alias("status"))
    return rows.withColumn("skipped", T.skipped_by_status(F.col("status")))



def _replaced(column: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        column = f"regexp_replace({column}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return column


_CLEAN = _replaced("html", [*P.MARKDOWN, (P.HEADING_MARK, ""), (P.EMPHASIS, "")])


@query(rf"""
WITH s AS (SELECT page_id, array_to_string(list_transform(string_split({_CLEAN}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)) AS s FROM pages)
SELECT page_id, regexp_replace(regexp_replace(s, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM s""")
def strip_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.strip_markdown(F.col("html")).alias("clean"))


@query(rf"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '(?:{BUDGET})\s*') AS t FROM documents),
pieces AS (SELECT doc_id, i, array_to_string(t[i * 100 + 1 : i * 100 + 100], '') AS piece FROM t, unnest(range(0, (len(t) + 99) // 100)) AS u(i) WHERE len(t) > 0)
SELECT doc_id, CAST(i AS INT) AS piece, md5(piece) AS digest, CAST(len(piece) AS INT) AS chars FROM pieces""")
def hard_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where(T.count_tokens(F.col("text")) > 0).select("doc_id", F.posexplode(T.hard_pieces(F.col("text"), 100)).alias("piece", "s"))
    return rows.select("doc_id", "piece", F.md5("s").alias("digest"), F.length("s").alias("chars"))


@query(rf"SELECT lang AS lookup, count(*) AS kept FROM documents WHERE len(regexp_extract_all(text, '{BUDGET}')) >= 10 GROUP BY lang")
def small_chunk_filter(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).where(T.count_tokens(F.col("text")) >= 10).groupBy("lookup").agg(F.count("*").alias("kept"))


def _chunks_by(docs: DataFrame, split) -> DataFrame:
    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return pd.Series([split(t) for t in texts], dtype=object)

    return spread(docs).select("doc_id", F.posexplode(parts("text")).alias("chunk", "text"))


@query()
def chunk_text_reader(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks_by(table(spark, sf, "documents"), text_chunks)


@query()
def chunk_markdown_reader(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks_by(_with_frontmatter(spark, sf), markdown_chunks)


@query()
def chunk_journal_reader(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return _chunks_by(docs.withColumn("text", F.concat(F.lit("## "), "source", F.lit("\nat "), "lang", F.lit("\n"), "text")), journal_chunks)


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|') AS groups FROM documents")
def extraction_groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.extraction_groups(F.col("text")), "|").alias("groups"))


# Ingest


@query(f"WITH {NOTES} SELECT lookup, path, hash FROM notes")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("lookup", "path", "hash")


@query(f"WITH {NOTES}, c AS (SELECT hash, count(*) AS copies FROM notes GROUP BY hash HAVING count(*) > 1) SELECT lookup, path, chunk, hash, copies FROM notes JOIN c USING (hash)")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.exact_duplicates(notes(spark, sf))


@query(f"SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '{SINCE}'")
def delta_select(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("ts") > F.to_timestamp(F.lit(SINCE))).select("event_id", "user_id", "event_type")


def _old(spark: SparkSession, sf: str) -> DataFrame:
    """An older index: notes that have vectors; of the long ones, another version of the text."""
    rows = vector_notes(spark, sf)
    return rows.withColumn("hash", F.when(F.length("text") > 2000, F.sha2(F.left("text", F.lit(100)), 256)).otherwise(F.col("hash"))).select("lookup", "path", "chunk", "hash", "embedding", "text")


OLD = f"{VECTORS}, old AS (SELECT lookup, path, chunk, CASE WHEN len(text) > 2000 THEN sha256(left(text, 100)) ELSE hash END AS hash, embedding, text FROM vectors)"
CLASSES = f"""{OLD}, known AS (SELECT hash, arg_min(embedding, path) AS embedding FROM old GROUP BY hash),
classes AS (
  SELECT n.lookup, n.path, n.chunk, n.hash, n.text, k.embedding, CASE WHEN o.hash = n.hash THEN 'skip' WHEN k.hash IS NOT NULL THEN 'reuse' ELSE 'embed' END AS change
  FROM notes n LEFT JOIN old o USING (lookup, path, chunk) LEFT JOIN known k ON k.hash = n.hash
)"""


@query(f"WITH {CLASSES} SELECT lookup, path, chunk, change FROM classes")
def classify_changes(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.classified(notes(spark, sf), _old(spark, sf)).select("lookup", "path", "chunk", "change")


@query(f"WITH {CLASSES} SELECT lookup, path, chunk, round(embedding[1], 6) AS first, round(list_sum(embedding), 6) AS total FROM classes WHERE change = 'reuse'")
def embedding_reuse(spark: SparkSession, sf: str) -> DataFrame:
    old = _old(spark, sf)
    rows = ingest.classified(notes(spark, sf), old).where("change = 'reuse'").join(ingest.reusable(old), "hash")
    return rows.select("lookup", "path", "chunk", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {CLASSES} SELECT lookup, path, chunk, hash FROM old WHERE (lookup, path, chunk) NOT IN (SELECT lookup, path, chunk FROM classes WHERE change <> 'skip') UNION ALL SELECT lookup, path, chunk, hash FROM classes WHERE change <> 'skip'")
def upsert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    old = _old(spark, sf)
    changed = ingest.classified(notes(spark, sf), old).where("change <> 'skip'")
    cols = ["lookup", "path", "chunk", "hash"]
    return ingest.upserted(old.select(cols), changed.select(cols))


@query(f"WITH {NOTES} SELECT lookup, path, chunk FROM notes WHERE doc_id IN (SELECT doc_id FROM labels)")
def prune_stale(spark: SparkSession, sf: str) -> DataFrame:
    rows = notes(spark, sf)
    keep = rows.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("lookup", "path")
    return ingest.without_stale_paths(rows, keep).select("lookup", "path", "chunk")


@query()
def ingest_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two indexing runs of all documents, the second of which finds nothing changed; vectors are word counts."""
    store = ingest.Store(spark, new_path(spark, "store"))
    docs = table(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    matched = docs.select(F.lit("documents").alias("lookup"), "path")
    embed = lambda texts: [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]
    runs = [ingest.index(store, matched, chunked(docs, "documents", "text"), embed, dt.datetime(2024, 1, 1 + i, tzinfo=dt.timezone.utc)).withColumn("run", F.lit(i)) for i in range(2)]
    return reduce(DataFrame.union, runs)


# Vectors


@query(f"""WITH {VECTORS}, norms AS (SELECT len(embedding) AS dim, sqrt(list_dot_product(embedding, embedding)) AS norm FROM vectors)
SELECT count(*) AS n, CAST(min(dim) AS INT) AS dim, round(min(norm), 6) AS min_norm, round(max(norm), 6) AS max_norm, round(avg(norm), 6) AS mean_norm FROM norms""")
def l2_normalize_stats(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return graph.vector_stats(vector_notes(spark, sf)).select("n", "dim", r("min_norm"), r("max_norm"), r("mean_norm"))


_BUCKET = " + ".join(f"CASE WHEN embedding[{i * 6 + 1}] >= 0 THEN {1 << 9 - i} ELSE 0 END" for i in range(10))


@query(f"SELECT vec_id, CAST({_BUCKET} AS INT) AS bucket FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def lsh_bucket(spark: SparkSession, sf: str) -> DataFrame:
    v = doubles(F.col("embedding"))  # a bucket is one of signs, so that the vector needs no norm
    return table(spark, sf, "embeddings").select("vec_id", bucket_key(v).alias("bucket"))


@query(f"""WITH b AS (SELECT CAST({_BUCKET} AS INT) AS bucket FROM (SELECT CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings))
SELECT CAST(k AS INT) AS neighbour, count(*) AS items FROM (SELECT unnest([bucket] || list_transform(range(0, 10), lambda i: xor(bucket, CAST(1 << i AS INT)))) AS k FROM b) GROUP BY k""")
def bucket_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "embeddings").select(F.explode(neighbour_keys(bucket_key(doubles(F.col("embedding"))))).alias("neighbour"))
    return keys.groupBy("neighbour").agg(F.count("*").alias("items"))


QV = f"qv AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = {VEC})"
COSINE = "round(list_dot_product(embedding, v) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(v, v))), 12)"


@query(f"WITH {VECTORS}, {QV} SELECT lookup, path, round({COSINE}, 9) AS score FROM vectors, qv ORDER BY {COSINE} DESC, lookup, path LIMIT {TOP}")
def vec_topk(spark: SparkSession, sf: str) -> DataFrame:
    near = vector_search.top_k(vector_notes(spark, sf), query_vector(spark, sf, VEC), TOP)
    return near.select("lookup", "path", F.round("score", 9).alias("score"))


def _vector_list(name: str, weight: float, vec: str, kind: str) -> str:
    return f"""{name}_local AS (
  SELECT *, row_number() OVER (PARTITION BY lookup ORDER BY score DESC, path, chunk) AS r
  FROM (SELECT lookup, path, chunk, text, {COSINE} AS score FROM vectors, (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = {vec}))
), {name} AS (
  SELECT * FROM (SELECT '{name.replace("_", ":")}' AS source_list, 'vector' AS backend, '{kind}' AS query_type, {weight} AS weight, lookup, path, chunk, text, score,
    row_number() OVER (ORDER BY score DESC, lookup, path, chunk) AS rank FROM {name}_local WHERE r <= 120 AND score >= {THRESHOLD}) WHERE rank <= 120
)"""


def _bm25(source: str, phrases: list[list[str]]) -> str:
    """(lookup, path, chunk, text, score) of a table with text."""
    count = lambda p: f"len(list_filter(range(1, len(t) + 1), lambda i: t[i : i + {len(p) - 1}] = {p}))"
    fs = ", ".join(f"{count(p)} AS f{i}" for i, p in enumerate(phrases))
    dfs = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(phrases)))
    idf = lambda i: f"ln((n - d{i} + 0.5) / (d{i} + 0.5))"
    parts = " + ".join(f"CASE WHEN {idf(i)} <= 0 THEN 1e-6::DOUBLE ELSE {idf(i)} END * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))" for i in range(len(phrases)))
    return f"""(WITH t AS (SELECT lookup, path, chunk, text, {TERMS} AS t FROM {source}),
  c AS (SELECT lookup, path, chunk, text, len(t) AS len, {fs} FROM t), s AS (SELECT lookup, count(*) AS n, avg(len) AS avgdl, {dfs} FROM c GROUP BY lookup)
  SELECT lookup, path, chunk, text, round({parts}, 12) AS score FROM c JOIN s USING (lookup) WHERE {" OR ".join(f"f{i} > 0" for i in range(len(phrases)))})"""


def _text_list(name: str, weight: float, phrases: list[list[str]], kind: str) -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT '{name.replace("_", ":")}:' || lookup AS source_list, 'bm25' AS backend, '{kind}' AS query_type, {weight} AS weight, lookup, path, chunk, text, score,
    row_number() OVER (PARTITION BY lookup ORDER BY score DESC, path, chunk) AS rank FROM {_bm25("notes", phrases)}) WHERE rank <= 200
)"""


@query(f"WITH {VECTORS}, {_vector_list('vec_original', 1.2, str(VEC), 'original')} SELECT lookup, path, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM vec_original")
def vec_topk_threshold_global_rank(spark: SparkSession, sf: str) -> DataFrame:
    near = vector_search.per_lookup(vector_notes(spark, sf), query_vector(spark, sf, VEC), 120, THRESHOLD)
    return vector_search.global_rank(near, 120).select("lookup", "path", F.round("score", 9).alias("score"), "rank")


def _ranked_bm25(spark: SparkSession, sf: str, queries: list[str], phrase: bool) -> DataFrame:
    phrases = phrases_of(queries, phrase)
    counted = counts(spread(notes(spark, sf)), phrases)
    hits = ranked(weighed(counted, statistics(counted, len(phrases)), list(range(len(phrases)))), 100)
    return hits.select("lookup", "path", F.round("score", 10).alias("score"), "rank")


def _ranked_sql(phrases: list[list[str]]) -> str:
    return f"""WITH {NOTES} SELECT lookup, path, round(score, 10) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lookup ORDER BY score DESC, path, chunk) AS rank FROM {_bm25("notes", phrases)}) WHERE rank <= 100"""


@query(_ranked_sql(TOKENS))
def bm25_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked_bm25(spark, sf, [QUERY], False)


@query(_ranked_sql([["of", "the"]]))
def bm25_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked_bm25(spark, sf, ["Of the"], True)


@query(_ranked_sql(VARIANT_TERMS))
def bm25_multi_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked_bm25(spark, sf, list(VARIANTS), True)


@query(_ranked_sql([*TOKENS, ["of", "the"]]))
def text_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """An index of older notes, brought up to all of them and read again from its files; then a search in it."""
    chunks, folder = notes(spark, sf), new_path(spark, "text-index")
    older = chunks.where("doc_id % 3 > 0").withColumn("hash", F.when(F.col("doc_id") % 3 == 1, F.lit("changed since")).otherwise(F.col("hash")))
    text_index.write(text_index.updated(None, older), f"{folder}/1")
    text_index.write(text_index.updated(text_index.read(spark, f"{folder}/1"), chunks), f"{folder}/2")
    phrases = [*TOKENS, ["of", "the"]]
    counted, stats = text_index.found(text_index.read(spark, f"{folder}/2"), phrases)
    return ranked(weighed(counted, stats, list(range(len(phrases)))), 100).select("lookup", "path", F.round("score", 10).alias("score"), "rank")


# Fusion

LISTS = ["vec_original", "bm25_original", "bm25_phrase"]
Q_LISTS = f"""{VECTORS}, {_vector_list("vec_original", 1.2, str(VEC), "original")},
{_text_list("bm25_original", 1.1, TOKENS, "original")}, {_text_list("bm25_phrase", 1.2, WHOLE, "original")}"""
PLUS_LISTS = f"""{Q_LISTS}, {_vector_list("vec_expanded", 0.7, str(REWRITE), "expanded")}, {_text_list("bm25_variants", 0.6, VARIANT_TERMS, "expanded")}"""


def _fused(lists: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {x}" for x in lists)
    return f"""candidates AS ({union}), ev AS (
  SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN score > 0 THEN 1.0 ELSE 0.0 END AS norm, weight / (60 + rank) AS contribution
  FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM candidates WINDOW w AS (PARTITION BY source_list))
), sums AS (
  SELECT lookup, path, chunk, min(text) AS text, CAST(sum(contribution ORDER BY source_list, rank) AS DOUBLE) AS rrf, CAST(sum(weight * norm ORDER BY source_list, rank) AS DOUBLE) AS signal,
    min(CASE WHEN query_type = 'original' THEN rank END) AS best, list(DISTINCT source_list) AS lists, bool_or(query_type = 'original') AS original, bool_or(query_type = 'expanded') AS expanded
  FROM ev GROUP BY lookup, path, chunk
), shares AS (
  SELECT *, CASE WHEN max(rrf) OVER () > 0 THEN rrf / max(rrf) OVER () ELSE 0 END AS normalized_rrf, CASE WHEN max(signal) OVER () > 0 THEN signal / max(signal) OVER () ELSE 0 END AS normalized_signal,
    CASE WHEN best = 1 THEN 0.05 WHEN best IN (2, 3) THEN 0.02 ELSE 0 END AS top_rank, CASE WHEN best IS NULL THEN -0.05 ELSE 0 END AS penalty FROM sums
), fused AS (
  SELECT *, round(least(greatest(0.75 * normalized_rrf + 0.15 * normalized_signal + top_rank + penalty, 0), 1), 12) AS final FROM shares
)"""


def _files(lists: list[str], top: int) -> str:
    return f"""{_fused(lists)}, placed AS (
  SELECT *, row_number() OVER (ORDER BY final DESC, lookup, path, chunk) AS place, row_number() OVER (PARTITION BY lookup, path ORDER BY final DESC, chunk) AS own FROM fused
), kept AS (SELECT * FROM placed WHERE (own = 1 OR final >= {STRONG} OR place <= {global_depth(top)}) AND own <= 3
), files AS (
  SELECT lookup, path, max(final) AS anchor, arg_min(text, own) AS text, count(*) FILTER (WHERE original) AS originals, count(*) FILTER (WHERE expanded) AS expandeds, list_sort(list_distinct(flatten(list(lists)))) AS lists,
    CASE WHEN count(*) FILTER (WHERE final >= {STRONG}) >= 2 AND bool_or(final >= {STRONG} AND original) THEN {MULTI_BOOST} ELSE 0 END AS multi,
    least(greatest(coalesce(len(list_distinct(flatten(list(lists) FILTER (WHERE final >= {STRONG})))), 0) - 1, 0) * {EXTRA_LIST}, {EXTRA_CAP}) AS diversity
  FROM kept GROUP BY lookup, path
), best AS (
  SELECT *, round(least(anchor + multi + diversity, 1), 12) AS score FROM files ORDER BY score DESC, anchor DESC, originals DESC, lookup, path LIMIT {top}
)"""


def _embed(spark: SparkSession, sf: str):
    return lambda text: query_vector(spark, sf, VEC if text == retrieval.normalized_query(QUERY) else REWRITE)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.candidates(all_notes(spark, sf), retrieval.plan_q(QUERY), _embed(spark, sf), 120, 200, THRESHOLD)


@query(f"WITH {Q_LISTS}, {_fused(LISTS)} SELECT lookup, path, round(rrf, 9) AS rrf, round(signal, 9) AS signal, round(normalized_rrf, 9) AS normalized_rrf, round(normalized_signal, 9) AS normalized_score_signal FROM fused")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 9).alias(c)
    return fused(_candidates(spark, sf)).select("lookup", "path", r("rrf"), r("signal"), r("normalized_rrf"), r("normalized_score_signal"))


@query(f"WITH {Q_LISTS}, {_fused(LISTS)} SELECT lookup, path, CAST(top_rank AS DOUBLE) AS top_rank_original, CAST(penalty AS DOUBLE) AS expanded_only_penalty, round(final, 9) AS final_score, array_to_string(list_sort(lists), ',') AS sources FROM fused")
def chunk_boosts(spark: SparkSession, sf: str) -> DataFrame:
    return fused(_candidates(spark, sf)).select("lookup", "path", "top_rank_original", "expanded_only_penalty", F.round("final_score", 9).alias("final_score"), F.array_join("sources", ",").alias("sources"))


def _flat(found: DataFrame) -> DataFrame:
    c = lambda x: F.col(x).cast("long").alias(x)
    return found.select("lookup", "path", F.round("score", 9).alias("score"), F.round("anchor_score", 9).alias("anchor_score"), F.array_join("source_lists", ",").alias("source_lists"), c("original_match_count"), c("expanded_match_count"))


FLAT = "SELECT lookup, path, round(score, 9) AS score, round(anchor, 9) AS anchor_score, array_to_string(lists, ',') AS source_lists, originals AS original_match_count, expandeds AS expanded_match_count FROM best"


@query(f"WITH {Q_LISTS}, {_files(LISTS, TOP)} {FLAT}")
def hybrid_q(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(retrieval.retrieve_q(all_notes(spark, sf), QUERY, _embed(spark, sf), TOP, thresholds=THRESHOLD, vector_depth=120, text_depth=200).files)


def _plus(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.retrieve_q_plus(all_notes(spark, sf), QUERY, _embed(spark, sf), lambda _: "another wording", lambda _: ", ".join(VARIANTS), TOP, thresholds=THRESHOLD, vector_depth=120, text_depth=200).files


PLUS = [*LISTS, "vec_expanded", "bm25_variants"]


@query(f"WITH {PLUS_LISTS}, {_files(PLUS, TOP)} {FLAT}")
def hybrid_q_plus(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_plus(spark, sf))


@query(rf"""WITH {PLUS_LISTS}, {_files(PLUS, TOP)}, flat AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM best)
SELECT lookup, path AS file, round(score, 4) AS score, CASE WHEN len(s) > 300 THEN rtrim(s[1:297]) || '...' ELSE s END AS matched_chunks FROM flat""")
def compact_results(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.compact(_plus(spark, sf)).withColumn("matched_chunks", F.array_join("matched_chunks", "|"))


@query(f"WITH {VECTORS}, {QV} SELECT lookup, path, chunk, path.split('/')[-2] || '/' || path.split('/')[-1] AS id, round({COSINE}, 9) AS score FROM vectors, qv ORDER BY {COSINE} DESC, lookup, path LIMIT 3")
def similar(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.entries(retrieval.similar(vector_notes(spark, sf), query_vector(spark, sf, VEC)))
    return found.select("lookup", "path", "chunk", "id", F.round("score", 9).alias("score"))


@query(f"WITH {NOTES} SELECT lookup, path, chunk, hash, text FROM notes WHERE lookup = 'en' AND path = '/notes/src1/1.md' AND chunk = 0")
def find_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.find_chunk(notes(spark, sf), "en", "/notes/src1/1.md", 0).select("lookup", "path", "chunk", "hash", "text")


@query()
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.random_sample(notes(spark, sf).select("lookup", "path", "chunk", "text"), 3, seed=1)


# Duplicates


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Items without their texts, which none of these queries reads."""
    return duplicates.items(vector_notes(spark, sf).withColumn("text", F.lit(None).cast("string")))


ITEMS = f"{VECTORS}, items AS (SELECT path || '#' || chunk AS id, embedding, {_BUCKET} AS bucket FROM vectors)"
EDGES = f"{ITEMS}, dup AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.embedding, y.embedding), 12) AS sim FROM items x JOIN items y ON x.id < y.id WHERE list_cosine_similarity(x.embedding, y.embedding) >= {DUP})"


@query(f"WITH {EDGES} SELECT a, b, round(sim, 6) AS sim FROM dup")
def dup_edges(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.all_edges(_items(spark, sf), DUP).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"""WITH {ITEMS} SELECT a, b FROM (SELECT x.id AS a, y.id AS b, row_number() OVER (PARTITION BY x.id ORDER BY y.id) AS n
FROM items x JOIN items y ON x.id <> y.id AND bit_count(xor(CAST(x.bucket AS INT), CAST(y.bucket AS INT))) <= 1) WHERE n <= 400""")
def dup_bucket_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.bucket_candidates(_items(spark, sf))


@query(f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT a, b FROM dup UNION ALL SELECT b, a FROM dup), reach(id, other) AS (
  SELECT a, a FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT id, min(other) AS component FROM reach GROUP BY id""")
def dup_components(spark: SparkSession, sf: str) -> DataFrame:
    return components(vector_search.close_links(_items(spark, sf).select("id", "embedding"), DUP))


@query()
def dup_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.find_duplicates(vector_notes(spark, sf), DUP)


@query(f"""WITH {ITEMS}, members AS (SELECT id, bucket AS cluster_id, embedding FROM items)
SELECT CAST(x.cluster_id AS VARCHAR) AS cluster_id, x.id, round(max(list_cosine_similarity(x.embedding, y.embedding)), 6) AS max_similarity, round(avg(list_cosine_similarity(x.embedding, y.embedding)), 6) AS avg_similarity
FROM members x JOIN members y ON x.cluster_id = y.cluster_id AND x.id <> y.id GROUP BY ALL""")
def dup_cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = _items(spark, sf)
    return duplicates.cluster_stats(found.select(F.col("bucket").cast("string").alias("cluster_id"), "id"), found)


# Graph


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("embedding"))


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("community"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of the graph, written: most queries need them several times."""
    return written(graph.symmetrized(graph.knn(_vectors(spark, sf), KNN)), "edges")


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return graph.node_metrics(_edges(spark, sf), _assigned(spark, sf))


V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS INT) AS community FROM embeddings), assigned AS (SELECT id, community FROM v)"
NEAR = f"""{V}, near AS (SELECT source, target, least(greatest(sim, 0), 1) AS sim, rank FROM (
  SELECT source, target, sim, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM (
    SELECT x.id AS source, y.id AS target, round(list_cosine_similarity(x.embedding, y.embedding), 12) AS sim FROM v x JOIN v y ON x.id <> y.id)) WHERE rank <= {KNN})"""
GRAPH = f"""{NEAR}, edges AS (SELECT * FROM (SELECT source, target, least(CASE WHEN mutual THEN sim * 1.15::DOUBLE ELSE sim END, 1) AS weight, mutual FROM (
  SELECT least(source, target) AS source, greatest(source, target) AS target, max(sim) AS sim, count(*) > 1 AS mutual FROM near GROUP BY ALL)) WHERE mutual OR weight >= 0.05)"""
METRICS = f"""{GRAPH}, ends AS (SELECT source AS id, target AS other, weight FROM edges UNION ALL SELECT target, source, weight FROM edges),
metrics AS (SELECT a.id, a.community, count(e.other) AS degree, coalesce(sum(weight) FILTER (WHERE b.community = a.community), 0) AS internal, coalesce(sum(weight) FILTER (WHERE b.community <> a.community), 0) AS external
  FROM assigned a LEFT JOIN ends e ON e.id = a.id LEFT JOIN assigned b ON b.id = e.other GROUP BY ALL),
nodes AS (SELECT *, CASE WHEN internal + external > 0 THEN external / (internal + external) ELSE 0 END AS bridge FROM metrics)"""
BETWEEN = f"""{GRAPH}, pairs AS (SELECT x.community AS ca, y.community AS cb, weight FROM edges JOIN assigned x ON x.id = source JOIN assigned y ON y.id = target),
between_ AS (SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, sum(weight) AS weight FROM pairs WHERE ca <> cb GROUP BY ALL)"""


@query(f"WITH {NEAR} SELECT source, target, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM near")
def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.knn(_vectors(spark, sf), KNN).withColumn("sim", F.round("sim", 6))


@query(f"WITH {GRAPH} SELECT source, target, round(weight, 6) AS weight, mutual FROM edges")
def knn_symmetrize(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).withColumn("weight", F.round("weight", 6))


_Q = ", ".join(f"round(quantile_cont(weight, {p}), 6) AS {n}" for p, n in ((0, "w_min"), (0.25, "w_p25"), (0.5, "w_median"), (0.75, "w_p75"), (1, "w_max")))


@query(f"WITH {GRAPH} SELECT (SELECT count(*) FROM v) AS nodes, count(*) AS edges, round(avg(mutual::INT), 6) AS mutual_ratio, round(count(*) * 2 / (SELECT count(*) FROM v), 6) AS avg_degree, {_Q} FROM edges")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    stats = graph.graph_stats(_edges(spark, sf), table(spark, sf, "embeddings").count())
    return stats.select("nodes", "edges", *map(r, ("mutual_ratio", "avg_degree", "w_min", "w_p25", "w_median", "w_p75", "w_max")))


@query(f"WITH {METRICS} SELECT id, community, degree, round(internal, 6) AS internal, round(external, 6) AS external, round(bridge, 6) AS bridge FROM nodes")
def node_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _metrics(spark, sf).select("id", "community", "degree", r("internal"), r("external"), r("bridge"))


@query(f"WITH {BETWEEN} SELECT a, b, round(weight, 6) AS weight FROM between_")
def community_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.community_graph(_edges(spark, sf), _assigned(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {BETWEEN}, s AS (SELECT community, count(*) AS size FROM assigned GROUP BY ALL), full_ AS (
SELECT community, size, coalesce((SELECT sum(weight) FROM pairs WHERE ca = cb AND ca = community), 0) AS internal, coalesce((SELECT sum(weight) FROM between_ WHERE a = community OR b = community), 0) AS external FROM s)
SELECT community, size, round(internal, 6) AS internal, round(external, 6) AS external, round(CASE WHEN internal + external > 0 THEN external / (internal + external) ELSE 0 END, 6) AS bridge FROM full_""")
def community_stats(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return graph.community_stats(_edges(spark, sf), _assigned(spark, sf)).select("community", "size", r("internal"), r("external"), r("bridge"))


@query(f"""WITH {BETWEEN}, sides AS (SELECT a AS community, b AS neighbour, weight FROM between_ UNION ALL SELECT b, a, weight FROM between_)
SELECT community, neighbour, round(weight, 6) AS weight, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY weight DESC, neighbour) AS rank FROM sides) WHERE rank <= 8""")
def community_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(graph.community_graph(_edges(spark, sf), _assigned(spark, sf)), 8).withColumn("weight", F.round("weight", 6))


@query(f"WITH {V}, s AS (SELECT community, row_number() OVER (ORDER BY count(*) DESC, community) AS n FROM assigned GROUP BY community) SELECT id, CAST(n AS INT) AS community FROM assigned JOIN s USING (community)")
def community_reindex(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reindexed(_assigned(spark, sf))


@query()
def communities_of_graph(spark: SparkSession, sf: str) -> DataFrame:
    return communities.communities(_edges(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


@query(f"WITH {METRICS} SELECT CAST(least(floor(bridge * 10), 9) AS INT) AS bin, count(*) AS notes FROM nodes GROUP BY ALL")
def bridge_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return graph.histogram(_metrics(spark, sf))


@query(f"WITH {GRAPH} SELECT source, target, round(weight, 6) AS weight FROM edges JOIN assigned x ON x.id = source JOIN assigned y ON y.id = target WHERE x.community <> y.community ORDER BY edges.weight DESC, source, target LIMIT 2400")
def bridge_edges_topn(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bridge_edges(_edges(spark, sf), _assigned(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("SELECT doc_id AS id, lang FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n, greatest(1, ceil(count(*) OVER () / 260)) AS step FROM documents) WHERE n % step = 0")
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    return graph.every_nth(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), 260)


@query("SELECT lang AS lookup, source, count(*) AS notes FROM documents WHERE lang IN ('en', 'fr') GROUP BY ALL")
def visible_counts(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).where(F.col("lookup").isin("en", "fr")).groupBy("lookup", F.split("path", "/")[2].alias("source")).agg(F.count("*").alias("notes"))


# Layout and terrain; points come from two elements of each vector


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


POINTS = "raw AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS INT) AS community FROM embeddings)"


def _box(name: str, x: tuple, y: tuple) -> str:
    axis = lambda c, r: f"{r[0]} + ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * ({r[1]} - {r[0]})"
    return f"{POINTS}, {name} AS (SELECT id, community, {axis('x', x)} AS x, {axis('y', y)} AS y FROM raw)"


@query(f"WITH {_box('p', (-1.0, 1.0), (-1.0, 1.0))} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM p")
def minmax_layout(spark: SparkSession, sf: str) -> DataFrame:
    return layout.fitted(_points(spark, sf)).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"SELECT vec_id AS id, round(CAST('0x' || substr(sha256('{POINT_SEED}:' || vec_id), 1, 12) AS BIGINT) / 281474976710655, 9) AS noise FROM embeddings")
def stable_noise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round(layout.stable_noise(POINT_SEED, F.col("vec_id")), 9).alias("noise"))


@query()
def pca_layout(spark: SparkSession, sf: str) -> DataFrame:
    return layout.fitted(layout.pca(_vectors(spark, sf)))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    at = layout.fitted(_points(spark, sf), (200.0, 1800.0), (200.0, 1200.0)).withColumn("density_weight", F.lit(1.0))
    return at.join(_assigned(spark, sf), "id")


PLACED = _box("p", (200.0, 1800.0), (200.0, 1200.0))


@query(f"""WITH {PLACED}, cells AS (SELECT x, y, cx, unnest(range(CAST(greatest(floor((y - 102) / 10), 0) AS INT), CAST(floor((y + 102) / 10) + 2 AS INT))) AS cy FROM (
  SELECT x, y, unnest(range(CAST(greatest(floor((x - 102) / 10), 0) AS INT), CAST(floor((x + 102) / 10) + 2 AS INT))) AS cx FROM p))
SELECT CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, round(sum(exp(-((cx * 10 - x) ** 2 + (cy * 10 - y) ** 2) / (2 * 34.0 * 34.0))), 6) AS density FROM cells GROUP BY ALL""")
def kde_grid(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.grid(_placed(spark, sf)).withColumn("density", F.round("density", 6))


@query()
def contours(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.contours(terrain.grid(_placed(spark, sf)))


@query()
def peak_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.peaks(_placed(spark, sf))


@query(f"""WITH {PLACED}, s AS (SELECT q.community, q.id, q.x, q.y, round(sum(exp(-((q.x - o.x) ** 2 + (q.y - o.y) ** 2) / (2 * 54.0 * 54.0))), 9) AS s FROM p q JOIN p o USING (community) GROUP BY ALL),
b AS (SELECT *, first_value(x) OVER w AS bx, first_value(y) OVER w AS by_ FROM s WINDOW w AS (PARTITION BY community ORDER BY s DESC, id)), near AS (SELECT * FROM b WHERE (x - bx) ** 2 + (y - by_) ** 2 <= 48.6 ** 2),
w AS (SELECT *, greatest(s - min(s) OVER (PARTITION BY community), 1e-6) AS w FROM near)
SELECT community, round(sum(x * w) / sum(w), 4) AS peak_x, round(sum(y * w) / sum(w), 4) AS peak_y FROM w GROUP BY community""")
def density_peak(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.density_peak(_placed(spark, sf)).select("community", F.round("peak_x", 4).alias("peak_x"), F.round("peak_y", 4).alias("peak_y"))


@query(f"WITH {PLACED} SELECT round(420 - min(x), 6) AS shift_x, round(420 - min(y), 6) AS shift_y, CAST(greatest(ceil(max(x) - min(x) + 840), 1200) AS INT) AS width, CAST(greatest(ceil(max(y) - min(y) + 840), 900) AS INT) AS height FROM p")
def reframe_layout(spark: SparkSession, sf: str) -> DataFrame:
    at = _placed(spark, sf)
    return layout.frame(at, at.limit(0)).select(F.round("shift_x", 6).alias("shift_x"), F.round("shift_y", 6).alias("shift_y"), "width", "height")


@query(f"""WITH {PLACED}, c AS (SELECT community AS q, avg(x) AS qx, avg(y) AS qy FROM p GROUP BY community),
d AS (SELECT q, id, sqrt((x - qx) ** 2 + (y - qy) ** 2) AS distance FROM c CROSS JOIN p)
SELECT q, arg_min(id, (distance, id)) AS id, round(min(distance), 6) AS distance FROM d WHERE distance <= 60 GROUP BY q""")
def nearest_note(spark: SparkSession, sf: str) -> DataFrame:
    at = _placed(spark, sf)
    middle = at.groupBy(F.col("community").alias("q")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return graph.nearest_note(at, middle, 60.0).withColumn("distance", F.round("distance", 6))


@query()
def mountain_layout(spark: SparkSession, sf: str) -> DataFrame:
    edges, assigned = _edges(spark, sf), _assigned(spark, sf)
    between = graph.community_graph(edges, assigned)
    where = layout.centres(between, assigned.groupBy("community").agg(F.count("*").alias("size")))
    return layout.mountains(layout.fitted(_points(spark, sf)), graph.node_metrics(edges, assigned), where, between)


# Profiles


@query(f"WITH {METRICS} SELECT community, id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY round(internal, 9) DESC, id) AS place FROM nodes) WHERE place <= 12")
def core_members_topn(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.ranked(_metrics(spark, sf), F.round("internal", 9), profiles.CORE).select("community", "id", "place")


_COMMON = ", ".join(f"'{w}'" for w in profiles.COMMON)


@query(rf"""WITH raw AS (SELECT lang AS lookup, doc_id, generate_subscripts(t, 1) AS pos, lower(unnest(t)) AS word FROM (SELECT lang, doc_id, regexp_extract_all(trim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 360)), '{P.KEYWORD}') AS t FROM documents)),
c AS (SELECT lookup, word, count(*) AS n, min((doc_id, pos)) AS first FROM raw WHERE word NOT IN ({_COMMON}) GROUP BY ALL)
SELECT lookup, word, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lookup ORDER BY n DESC, first) AS place FROM c) WHERE place <= 10""")
def keywords(spark: SparkSession, sf: str) -> DataFrame:
    flat = F.trim(F.left(T.squeeze(F.col("text")), F.lit(360)))
    return profiles.keywords(notes(spark, sf).select("lookup", F.col("doc_id").alias("place"), flat.alias("snippet")), "lookup")


@query(f"WITH {VECTORS} SELECT label AS community, lookup, count(*) AS n FROM vectors GROUP BY ALL")
def source_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.source_counts(vector_notes(spark, sf).select(F.col("label").alias("community"), "lookup"), "community")


@query(rf"SELECT doc_id, trim(left(trim({_replaced('text', [*P.EXCERPT, (r'\s+', ' ')])}), 120)) AS excerpt FROM documents")
def label_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.label_excerpt(F.col("text")).alias("excerpt"))


@query()
def community_profiles(spark: SparkSession, sf: str) -> DataFrame:
    edges, assigned = _edges(spark, sf), _assigned(spark, sf)
    found = notes(spark, sf).select(F.col("doc_id").alias("id"), "lookup", "hash", "text")
    rows = profiles.community_profiles(found, graph.node_metrics(edges, assigned), edges)
    return rows.select("community", "size", F.array_join("keywords", ",").alias("keywords"), F.size("core").alias("core"), F.to_json("sources").alias("sources"), "signature")


@query()
def map_payload(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.note_rows(mapping.build(vector_notes(spark, sf), MapOptions(knn_k=KNN)))


# Evaluation


@query(f"""WITH {VECTORS}, qs AS (SELECT path AS query, embedding AS v FROM vectors), scored AS (
  SELECT query, lookup, path, {COSINE} AS score, embedding[1] AS other FROM vectors, qs WHERE path <> query),
a AS (SELECT * FROM (SELECT query, lookup, path, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM scored) WHERE rank <= 10),
b AS (SELECT * FROM (SELECT query, lookup, path, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM scored WHERE score >= 0.2) WHERE rank <= 10),
j AS (SELECT query, a.rank AS ra, b.rank AS rb FROM a FULL JOIN b USING (query, lookup, path))
SELECT query, count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) AS overlap, round(count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) / count(*), 4) AS jaccard, round(avg(abs(ra - rb)), 2) AS mean_rank_displacement FROM j GROUP BY query""")
def compare_rankings(spark: SparkSession, sf: str) -> DataFrame:
    rows = vector_notes(spark, sf)
    near = vector_search.all_pairs(rows.select(F.col("path").alias("id"), "embedding"), k=10)
    named = near.select(F.col("id").alias("query"), F.col("other").alias("path"), "rank", "sim").join(rows.select("lookup", "path"), "path")
    return evaluation.compared(named, named.where("sim >= 0.2")).select("query", "overlap", "jaccard", "mean_rank_displacement")


@query("""SELECT event_type, max(v) FILTER (WHERE p = 0) AS least, max(v) FILTER (WHERE p = ceil((n - 1) * 0.5)) AS median, max(v) FILTER (WHERE p = ceil((n - 1) * 0.95)) AS p95, max(v) FILTER (WHERE p = n - 1) AS most
FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type""")
def latency_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.percentile(table(spark, sf, "events"), "event_type", "value", {"least": 0.0, "median": 0.5, "p95": 0.95, "most": 1.0})


@query(rf"""WITH {NOTES}, t AS (SELECT *, len(regexp_extract_all(text, '{BUDGET}')) AS tokens, row_number() OVER (PARTITION BY lookup, hash ORDER BY path) AS n FROM notes)
SELECT lookup, count(DISTINCT path) AS files, count(DISTINCT path) AS indexed, 0::BIGINT AS empty, count(*) AS chunks, count(*) FILTER (WHERE tokens < 50) AS small, count(*) FILTER (WHERE tokens > 1000) AS oversized, count(*) FILTER (WHERE n > 1) AS duplicates FROM t GROUP BY lookup""")
def chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.chunk_report(notes(spark, sf))


@query(rf"""WITH {NOTES}, t AS (SELECT *, len(regexp_extract_all(text, '{BUDGET}')) AS tokens, row_number() OVER (PARTITION BY lookup, hash ORDER BY path) AS n FROM notes),
bad AS (SELECT lookup, unnest(list_filter([CASE WHEN tokens < 50 THEN 'small' END, CASE WHEN tokens > 1000 THEN 'oversized' END, CASE WHEN n > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL)) AS issue, path, chunk, tokens FROM t),
good AS (SELECT lookup, 'ok' AS issue, path, chunk, tokens, row_number() OVER (PARTITION BY lookup ORDER BY path) - 1 AS place, count(*) OVER (PARTITION BY lookup) AS n FROM t WHERE n = 1 AND tokens BETWEEN 50 AND 1000)
SELECT lookup, issue, path, CAST(tokens AS INT) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY lookup, issue ORDER BY path) AS place FROM bad) WHERE place <= 5
UNION ALL SELECT lookup, issue, path, CAST(tokens AS INT) FROM good WHERE n <= 5 OR place IN (0, n // 4, n // 2, n * 3 // 4, n - 1)""")
def chunk_samples(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.samples(notes(spark, sf)).select("lookup", "issue", "path", "tokens")


@query(r"SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def prompt_assembly(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("said"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["said"]), "\n").alias("prompt"))
