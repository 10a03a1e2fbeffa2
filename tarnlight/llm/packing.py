"""Packing of documents into windows by best-fit decreasing.

Lengths are counted in words (runs of characters that are not white space).
Documents go to shards by a hash of their content; each shard holds about
shard_words words whatever the size of the corpus, and is packed on its own, so
that the only windows that stay open are the last of each shard.
"""

from __future__ import annotations

import heapq
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.shared import spread

CAPACITY = 2048
SHARD_WORDS = 400_000
WORD = re.compile(r"\S+")
SCHEMA = "window_id string, n_words int, doc_ids array<{kind}>, starts array<int>, lengths array<int>, text string"


class Tightest:
    """Open windows by remaining capacity: a segment tree over 0..capacity that counts open windows, a heap of window numbers in each leaf."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, window: int) -> None:
        heapq.heappush(self.windows[remaining], window)
        self._shift(remaining, 1)

    def _shift(self, leaf: int, by: int) -> None:
        i = leaf + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The lowest-numbered window with the least remaining capacity >= need, removed, and that capacity."""
        count, i = self.count, need + self.size
        while not count[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i >>= 1
                if not i:
                    return None
            i += 1
            if i & (i - 1) == 0:  # past the right edge of its level
                return None
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        remaining = i - self.size
        self._shift(remaining, -1)
        return heapq.heappop(self.windows[remaining]), remaining


def pack(lengths: list[int], capacity: int) -> list[int]:
    """Window number of each piece; lengths must be in decreasing order, none over capacity."""
    opened, tree, where = 0, Tightest(capacity), []
    for n in lengths:
        found = tree.take(n)
        if found is None:
            found, opened = (opened, capacity), opened + 1
        window, remaining = found
        where.append(window)
        if remaining > n:
            tree.add(remaining - n, window)
    return where


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each window: (window_id, n_words, doc_ids, starts, lengths, text).

    A document of more than capacity words is first cut into full windows; the
    rest of it is a piece like any other. Pieces go in order of decreasing
    length, then doc_id (null first), then text; a tie between windows goes to
    the one opened first. starts and lengths are in words of the document; text
    has the pieces in that order, joined by an empty line, each exactly as in
    its document. Null, empty and blank texts have no words and are in no
    window; repeated rows are packed once each. Columns other than doc_id and
    text are not read; an empty table gives no windows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(r"\S"))
    chars = rows.agg(F.sum(F.length("text")).cast("long")).first()[0] or 0
    shards = max(1, math.ceil(chars / 6 / shard_words))
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(x) else x for x in pdf["doc_id"].astype(object)]
        texts = pdf["text"].tolist()
        windows, pieces = [], []
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, texts[i]))
        for i in order:
            text = texts[i]
            n = len(text.split())
            if n <= capacity:
                pieces.append((n, i, 0, text.strip()))
                continue
            spans = [m.span() for m in WORD.finditer(text)]
            for start in range(0, len(spans), capacity):
                size = min(capacity, len(spans) - start)
                piece = text[spans[start][0] : spans[start + size - 1][1]]
                if size == capacity:
                    windows.append([(size, i, start, piece)])
                else:
                    pieces.append((size, i, start, piece))
        pieces.sort(key=lambda p: -p[0])  # stable: ties stay in order
        whole = len(windows)
        for piece, w in zip(pieces, pack([p[0] for p in pieces], capacity)):
            if whole + w == len(windows):
                windows.append([])
            windows[whole + w].append(piece)
        return pd.DataFrame(
            {
                "window_id": [f"{key[0]}-{k}" for k in range(len(windows))],
                "n_words": [sum(p[0] for p in w) for w in windows],
                "doc_ids": [[ids[p[1]] for p in w] for w in windows],
                "starts": [[p[2] for p in w] for w in windows],
                "lengths": [[p[0] for p in w] for w in windows],
                "text": ["\n\n".join(p[3] for p in w) for w in windows],
            }
        )

    return rows.withColumn("shard", shard).groupBy("shard").applyInPandas(one, SCHEMA.format(kind=kind))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op9_pack": op9_pack}
SQL: dict[str, str] = {}
