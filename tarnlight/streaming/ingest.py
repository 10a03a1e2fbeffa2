"""Indexing of note files as they arrive: a file stream whose batches go through the same upsert as a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnlight.functions.vectors import bucket_key
from tarnlight.operators.ingest import KEY, classified, embedded, reusable, upserted, without_stale_chunks
from tarnlight.shared import shared_dir
from tarnlight.sources.files import chunked
from tarnlight.sources.notes import CHUNKS

FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, store, lookup: str, reader: str, embed_fn, name_match: str = "*.md", checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Starts a query that indexes new files of folder into store; by default it ends when all that is there is done.

    Files that come again under another name or time are read again; chunks
    whose hash is unchanged keep their vectors. Files that vanish are pruned by
    a batch run, which sees the whole listing.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("pathGlobFilter", name_match).load(folder)

    def upsert(batch: DataFrame, _: int) -> None:
        new = chunked(batch, lookup, reader).where("error is null").select(*KEY, "hash", "text")
        old = store.chunks()
        old = batch.sparkSession.createDataFrame([], CHUNKS) if old is None else old
        classes = classified(new, old)
        vectors = reusable(old).union(embedded(classes.where("change = 'embed'").dropDuplicates(["hash"]), embed_fn))
        fresh = classes.where("change <> 'skip'").join(vectors, "hash").select(*KEY, "hash", "embedding", bucket_key(F.col("embedding")).alias("bucket"), "text")
        store.replace(without_stale_chunks(upserted(old, fresh), new), None)

    place = checkpoint or f"{shared_dir(spark)}/stream-{lookup}"
    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", place).trigger(**(trigger or {"availableNow": True})).start()
