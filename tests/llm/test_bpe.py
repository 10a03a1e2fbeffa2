import random

import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlight.llm import bpe

from .cases import awkward, table

CODEC = bpe.Codec(bpe.VOCABULARY, bpe.PATTERN)
RANKS = bpe.load_ranks(bpe.VOCABULARY)
KNOWN = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def naive(data, ranks):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_equal_a_plain_search():
    rng = random.Random(1)
    for n in (*range(2, 40), 200):
        data = bytes(rng.choice(b"aabethin s") for _ in range(n))
        assert bpe.merge(data, RANKS) == (naive(data, RANKS) if data not in RANKS else [RANKS[data]])


@given(st.lists(st.sampled_from([*" \n\t\r'aAzé日本🙂0!\u3000", "the ", "'s", "  ", " \n"]), max_size=60).map("".join))
@settings(max_examples=400, deadline=None)
def test_tokens_equal_another_encoder(text):
    ids = CODEC.encode(text).tolist() if text else []
    assert ids == KNOWN.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode() if text else True


def test_documents_equal_another_encoder():
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert CODEC.encode(text).tolist() == KNOWN.encode_ordinary(text)


def test_long_pre_tokens():
    text = "ab" * 30_000
    assert CODEC.decode(CODEC.encode(text)) == text.encode()
    assert CODEC.encode(text).tolist() == KNOWN.encode_ordinary(text)


def test_rows_and_round_trip(spark):
    rows = awkward()
    got = bpe.encode(table(spark, rows, extra=True))
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["tokens"] is None) == (r["n_tokens"] is None) == (r["round_trip"] is None)
        assert r["tokens"] is None or (len(r["tokens"]) == r["n_tokens"] and r["round_trip"])
    back = bpe.decode(got).collect()
    assert sorted(repr(tuple(r)) for r in back) == sorted(repr(r[:2]) for r in rows)
    none = table(spark, [])
    assert bpe.encode(none).count() == 0 == bpe.decode(bpe.encode(none)).count()


def test_unknown_ids_are_an_error():
    import numpy as np

    with pytest.raises(ValueError):
        CODEC.decode(np.array([10**6]))
