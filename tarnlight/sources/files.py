"""Note files, their chunks, and cached articles."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions.chunking import READERS
from tarnlight.functions.text import content_hash


def scan(spark: SparkSession, folder: str, name_match: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the files below folder that match, *.md and *.markdown if nothing is said."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return read.option("pathGlobFilter", name_match or "*.{md,markdown}").load(folder)


def to_index(files: DataFrame, last: dt.datetime | None) -> DataFrame:
    """All files for a full build (last is None), else those modified after last or without a time."""
    return files if last is None else files.where(F.col("modificationTime").isNull() | (F.col("modificationTime") > F.lit(last)))


def build_mode(requested: str, has_index: bool, last: dt.datetime | None) -> str:
    """full if asked for, or without an index or a completed scan; else delta."""
    return "full" if requested == "full" or not has_index or last is None else "delta"


def chunked(files: DataFrame, lookup: str, reader: str) -> DataFrame:
    """(lookup, path, chunk, hash, text, error): a row for each chunk, one with an error for a file that can't be read."""
    if reader not in READERS:
        raise ValueError(f"unknown reader: {reader}")
    split = READERS[reader]

    @F.pandas_udf("struct<chunks:array<string>,error:string>")
    def parts(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                rows.append((split(bytes(data).decode("utf-8")), None))
            except Exception as e:  # one bad file must not stop the scan
                rows.append(([], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["chunks", "error"])

    read = files.select("path", parts("content").alias("r"))
    rows = read.select("path", F.posexplode_outer("r.chunks").alias("chunk", "text"), F.col("r.error").alias("error"))
    rows = rows.where("text is not null or error is not null")
    return rows.select(F.lit(lookup).alias("lookup"), "path", "chunk", content_hash(F.col("text")).alias("hash"), "text", "error")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Cached articles, the latest first: (name, modified, length)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).drop("content")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified"), "length").orderBy(F.desc("modified"), "name")


def read_article(folder: str, name: str) -> str:
    """One cached article by its bare name."""
    if not name or Path(name).name != name or not name.endswith(".md"):
        raise ValueError(f"not an article: {name!r}")
    return (Path(folder) / name).read_text(encoding="utf-8")


def save_article(folder: str, url: str, parts: dict[str, str], now: dt.datetime) -> Path:
    """Writes a Markdown file of sections, named by hour, host and path."""
    at = urlparse(url)
    tail = re.sub(r"[^A-Za-z0-9]+", "-", f"{at.netloc}{at.path}").strip("-") or "article"
    path = Path(folder) / f"{now:%Y-%m-%d-%H}-{tail}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("\n\n".join([f"# {url}", *(f"## {k}\n\n{v.strip()}" for k, v in parts.items())]).encode("utf-8") + b"\n")
    return path


def fetch_article(url: str, fetch_fn=None, token: str | None = None) -> str:
    """The text of a page by the fetch function that is given; there is none by default."""
    if fetch_fn is None:
        raise RuntimeError("no fetch function was given")
    return fetch_fn(url, {"Authorization": f"Bearer {token}"} if token else {})
