"""Byte-level BPE encoding and decoding with a vocabulary of ranks.

The text is cut into pre-tokens by the vocabulary's pattern. In each, a segment
tree over the byte positions holds the leftmost least rank of the pairs of live
neighbours; a merge updates the two pairs beside it and removes one, which are
three point updates of logarithmic cost. Long pre-tokens therefore take
O(n log n). Pre-tokens seen before come from a bounded cache.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tarnlight.llm.words import worker_state
from tarnlight.shared import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES = 500_000
FAR = 1 << 62
#: White space other than the space and the line feed.
RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    Leaves of the tree hold rank << 32 | position, so that the least value is
    the leftmost of the least ranks.
    """
    get = ranks.get
    whole = get(data)
    if whole is not None:
        return [whole]
    n = len(data)
    size = 1 << (n - 2).bit_length()
    tree = [FAR] * (2 * size)
    for i in range(n - 1):
        rank = get(data[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # start of the next live part, n at the end
    before = list(range(-1, n - 1))
    while (low := tree[1]) < FAR:
        i = low & 0xFFFFFFFF
        j = after[i]
        end = after[i] = after[j]
        x = y = z = i + size
        rank = None
        if end < n:
            before[end] = i
            rank = get(data[i : after[end]])
        tree[y] = FAR if rank is None else rank << 32 | i
        if j < n - 1:
            z = j + size
            tree[z] = FAR
        if (p := before[i]) >= 0:
            x = p + size
            rank = get(data[p:end])
            tree[x] = FAR if rank is None else rank << 32 | p
        while y > 1:  # the three leaves' paths to the root, each node once
            x, y, z = x >> 1, y >> 1, z >> 1
            a, b = tree[2 * y], tree[2 * y + 1]
            tree[y] = a if a < b else b
            if x != y:
                a, b = tree[2 * x], tree[2 * x + 1]
                tree[x] = a if a < b else b
            if z != y:
                a, b = tree[2 * z], tree[2 * z + 1]
                tree[z] = a if a < b else b
    ids, i = [], 0
    while i < n:
        ids.append(ranks[data[i : after[i]]])
        i = after[i]
    return ids


class Encoded(dict):
    """text without leading space -> bytes of its ids as int32, emptied when it holds CACHE_ENTRIES.

    Texts are what lies between single spaces; find cuts them, with the lead
    before them, into pre-tokens, which have a cache of their own.
    """

    def __init__(self, ranks: dict[bytes, int], find, lead: str, parts: dict[str, bytes]):
        super().__init__()
        self.ranks, self.find, self.lead, self.parts = ranks, find, lead, parts

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(self.parts) >= CACHE_ENTRIES:
            self.parts.clear()
        found = []
        for part in self.find(self.lead + chunk):
            ids = self.parts.get(part)
            if ids is None:
                ids = array("i", merge(part.encode("utf-8"), self.ranks)).tobytes()
                if len(part) <= 64:
                    self.parts[part] = ids
            found.append(ids)
        ids = b"".join(found)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


class Codec:
    def __init__(self, path: str, pattern: str):
        ranks, parts = load_ranks(path), {}
        find = regex.compile(pattern).findall
        self.bare = Encoded(ranks, find, "", parts)
        self.spaced = Encoded(ranks, find, " ", parts)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text. A space between two other characters that are not white space begins a pre-token, so the text may be cut there first; elsewhere the pattern sees the whole text."""
        first, *rest = chunks = text.split(" ")
        if "" in chunks or " \n" in text or "\n " in text or text[0] == "\n" or text[-1] == "\n" or RARE_SPACE.search(text):
            return np.frombuffer(self.bare[text], np.int32)
        return np.frombuffer(self.bare[first] + b"".join(map(self.spaced.__getitem__, rest)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; an id outside of the vocabulary raises ValueError."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("token id outside of the vocabulary")
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def codec(path: str, pattern: str) -> Codec:
    return worker_state(("bpe", path, pattern), lambda: Codec(path, pattern))


def tokens_column(batches: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if x is None else len(x) for x in batches]
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[[x is None for x in batches], False].astype(bool))
    flat = np.concatenate([x for x in batches if x is not None] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) for each row of docs.

    round_trip: decoding the tokens gives the text again, byte for byte. Null
    text gives null in all but doc_id, empty text no tokens and true. Repeated
    rows stay repeated. Columns other than doc_id and text are not read. The
    vocabulary must be at path on every executor.
    """

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            kept, sizes, same = [], [], []
            for text in batch.column(1).to_pylist():
                if text is None:
                    for x in (kept, sizes, same):
                        x.append(None)
                    continue
                ids = c.encode(text)
                kept.append(ids)
                sizes.append(len(ids))
                same.append(c.decode(ids) == text.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), tokens_column(kept), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "tokens", "round_trip"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens int, tokens array<int>, round_trip boolean")


def decode(tokens: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); null tokens give null text, bytes that are not UTF-8 become U+FFFD."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = [None if ids is None else c.decode(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, text string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op10_bpe": op10_bpe}
SQL: dict[str, str] = {}
