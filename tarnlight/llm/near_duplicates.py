"""N-gram Jaccard join of documents by MinHash banding.

Documents are sets of hashed word n-grams. Documents with the same set form a
class; the band hashes of a class bring it to the classes that share one, and
all such pairs are verified on the full sets. BANDS is the least number of
bands of ROWS rows that find a pair at THRESHOLD with probability RECALL;
nearer pairs are found with more. ROWS of 3 keeps chance meetings few: a pair
of similarity s meets by chance about BANDS * s**3 times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.pairs import PACKED, clustered, light, met, near_items, packed_bands, packed_sets, placed, ways_of
from tarnlight.llm.words import bands_for, bands_of, block_grams, distinct, trimmed, word_blocks
from tarnlight.shared import spread, written

N = 3
THRESHOLD = 0.5
RECALL, ROWS = 0.999, 3
BANDS = bands_for(THRESHOLD, ROWS, RECALL)
SEED = 1


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that banding finds a pair of this Jaccard similarity."""
    return 1 - (1 - similarity**rows) ** bands


def gram_sets(texts: list[str | None], n: int, bands: int, rows: int):
    """(places, sets, band hashes) of the texts that have words, block by block."""
    for first, bounds, hashes, _ in word_blocks(texts):
        g, at = block_grams(hashes, bounds, n)
        has = np.flatnonzero(np.diff(at))
        if len(has):
            yield first + has, [distinct(g[at[k] : at[k + 1]]) for k in has], bands_of(g, at[has], 1, bands, rows, SEED)


def signed(docs: DataFrame, n: int = N, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, version, cls, id, size, bands) of each row; version: hash of the text, cls: 128-bit hash of the n-gram set, id: half of it, size of the set, bands: packed band hashes. All but doc_id are null where the text has no words."""

    def run(batches):
        names = ["doc_id", "version", "cls", "id", "size", "bands"]
        for batch in batches:
            at, classes, sizes, keys = [], [], [], []
            for places, sets, hashes in gram_sets(batch.column(1).to_pylist(), n, bands, rows):
                at.append(places)
                classes += [xxhash.xxh3_128_digest(s) for s in sets]
                sizes += map(len, sets)
                keys += [k.tobytes() for k in hashes]
            has = np.concatenate(at) if at else np.zeros(0, np.int64)
            rest = pa.array(np.setdiff1d(np.arange(batch.num_rows), has))
            own, ids = pa.array(has), np.frombuffer(b"".join(classes), np.int64)[::2]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), pa.array(classes, pa.binary()), pa.array(ids), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], names)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rest), *(pa.nulls(len(rest), t) for t in kinds)], names)

    kind = dict(docs.dtypes)["doc_id"]
    rows_in = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    return rows_in.mapInArrow(trimmed(run), f"doc_id {kind}, version long, cls binary, id long, size long, bands binary")


def linked(docs: DataFrame, n: int, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, version, cls, id) of docs and (id, label, links) of the classes that are near others; links: rows of docs in near classes."""
    members = written(signed(docs, n, bands, rows), "signed")
    worded = members.where("cls is not null")
    ways = ways_of(docs.sparkSession, bands)

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield packed_bands(batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, bands), ways)

    found = met(worded.select("id", "bands").mapInArrow(trimmed(pack), PACKED), ways)
    classes = worded.groupBy("id").agg(F.min(F.struct("doc_id", "version")).alias("at"), F.count("*").alias("weight"), F.max("size").alias("size"))
    tiles = placed(found.join(classes.select("id", "size"), "id"))
    wanted = classes.join(tiles.select("id").distinct(), "id").select(F.col("at.doc_id").alias("w_id"), F.col("at.version").alias("w_version"), "id", "weight")
    near = near_items(tiles, class_sets(docs, written(wanted, "wanted"), n, bands, rows), threshold)
    return members.select("doc_id", "version", "cls", "id"), clustered(near)


def class_sets(docs: DataFrame, wanted: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, weight, grams, bands) of the classes wanted (w_id, w_version, id, weight), made again from the text of one document each."""

    def run(batches):
        for batch in batches:
            batch = batch.take(pa.array(np.unique(batch.column("id").to_numpy(), return_index=True)[1]))  # repeated rows
            for places, sets, hashes in gram_sets(batch.column("text").to_pylist(), n, bands, rows):
                own = pa.array(places)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("weight").take(own), *packed_sets(sets, hashes)], ["id", "weight", "grams", "bands"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("version")).where("text is not null")
    side = F.broadcast(wanted) if light(wanted, F.lit(48)) else wanted.hint("shuffle_hash")
    joined = texts.join(side, F.expr("w_id <=> doc_id and w_version = version"))
    return joined.select("id", "weight", "text").mapInArrow(trimmed(run), "id long, weight long, grams binary, bands binary")


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, links) for each row of docs: its group of near duplicates and how many rows it is linked to.

    Two rows are linked if the Jaccard similarity of their n-gram sets is
    threshold or more; links counts the other rows that a row is linked to,
    copies among them, and class_id is the least doc_id of all rows that links
    join to it, over any number of steps, its own among them (a null one only
    where all are null). Words are compared in lower case without punctuation
    at their ends; a text of fewer than n words has one gram, the whole of it.
    Null, empty and blank texts are linked to nothing. Repeated rows and rows
    of one doc_id are rows like any other. Columns other than doc_id and text
    are not read; an empty table gives none.
    """
    members, near = linked(docs, n, threshold, bands, rows)
    classes = members.where("cls is not null").groupBy("cls", "id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = written(classes.join(near, "id", "left"), "classes")
    groups = classes.where("label is not null").groupBy("label").agg(F.min("least").alias("group_least"))
    told = classes.join(groups, "label", "left").select("cls", F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("group_least")).alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    joined = members.join(told, "cls", "left")
    return joined.select("doc_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows of docs, columns as they are, with one row of each group of near duplicates.

    Groups are those of jaccard_join(). The row with the least (doc_id, hash of
    the text) stays, a null doc_id first; of rows equal in both, one. Rows whose
    text has no words all stay.
    """
    members, near = linked(docs, n, threshold, bands, rows)
    counted = members.where("cls is not null").groupBy("cls", "id", "doc_id", "version").agg(F.count("*").alias("n")).join(near.select("id", "label"), "id", "left")
    counted = written(counted.select("doc_id", "version", "label", F.when(F.col("label").isNull(), F.col("cls")).alias("own"), "n"), "counted")
    kept = counted.groupBy("label", "own").agg(F.min(F.struct("doc_id", "version")).alias("kept"), F.sum("n").alias("all")).where("all > 1")
    judged = counted.join(kept.select(F.col("label").alias("l"), F.col("own").alias("o"), "kept"), F.expr("label <=> l and own <=> o"))
    verdict = judged.select("doc_id", "version", F.struct("doc_id", "version").eqNullSafe(F.col("kept")).alias("first"), "n").where("not first or n > 1")
    verdict = written(verdict.select(F.col("doc_id").alias("__tl_id"), F.col("version").alias("__tl_version"), F.col("first").alias("__tl_first")), "verdict")
    side = F.broadcast(verdict) if light(verdict, F.lit(40)) else verdict.hint("shuffle_hash")
    marked = docs.withColumn("__tl_hash", F.xxhash64("text")).join(side, F.expr("doc_id <=> __tl_id and __tl_hash = __tl_version and text is not null"), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = marked.where("__tl_version is null").select(*columns)
    repeated = marked.where("__tl_first").dropDuplicates(["doc_id", "__tl_hash"]).select(*columns)
    return single.unionByName(repeated)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP7_SQL = f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''),
    lambda w: CASE WHEN regexp_replace(lower(w), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') = '' THEN lower(w)
      ELSE regexp_replace(lower(w), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') END) AS w
  FROM documents
), grams AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS g
  FROM words
), sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r
), shared AS (
  SELECT x.r AS a, y.r AS b, count(*) AS i FROM grams x JOIN grams y ON x.g = y.g AND x.r < y.r GROUP BY 1, 2
), near AS (
  SELECT a, b FROM shared JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE i >= {THRESHOLD} * (p.n + q.n - i)
), links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reached(r, s) AS (
  SELECT r, r FROM words UNION SELECT reached.r, links.b FROM reached JOIN links ON links.a = s
), least AS (SELECT reached.r, min(doc_id) AS class_id FROM reached JOIN words ON words.r = s GROUP BY reached.r
), counted AS (SELECT a AS r, count(*) AS links FROM links GROUP BY a
)
SELECT doc_id, class_id, coalesce(links, 0) AS links FROM words JOIN least USING (r) LEFT JOIN counted USING (r)
"""
QUERIES = {"op7_jaccard_join": op7_jaccard_join}
SQL = {"op7_jaccard_join": OP7_SQL}
