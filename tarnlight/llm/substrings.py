"""Removal of passages that repeat across documents: paragraph MinHash banding.

Equal passages are found by seeds, wherever they begin and end: runs of MIN_WORDS
words, of which each window of MIN_WORDS + 2 has its least hash chosen, so that
every passage of over 2 * MIN_WORDS words holds one. A seed that repeats is
extended over all words beside it that the first occurrence has as well. Where
another earlier place has more of them, these have seeds of their own if they
are over 2 * MIN_WORDS, else they stay.

The unit of edited copies is a paragraph: at least MIN_WORDS words that end
where a sentence or line does. One begins at each place where a sentence or line
begins (or a word with a capital; for texts without either, one of 32 words)
that has the least hash among those within BESIDE words at each side, and at
the start of the text. So their places depend on the words beside them alone, and copied passages have the
paragraphs of their sources. They overlap, and hold nearly all words; overlapping
ones are not taken for copies of each other.

Paragraphs that share a band of ROWS MinHash values are joined and verified by
exact Jaccard of their word n-grams; the components of the verified pairs join
equal and near paragraphs to one cluster. Its first occurrence stays, all others
are cut from their texts. BANDS is the least number of bands that find a pair at
THRESHOLD with probability RECALL.
"""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.llm.pairs import PACKED, clustered, light, met, near_items, packed_bands, packed_sets, placed, ways_of
from tarnlight.llm.words import ENDS, LINE, MULT, TITLE, bands_for, bands_of, distinct, grams, long_powers, mixed, slices, trimmed, word_blocks, words_of
from tarnlight.shared import new_path, shared_dir, spread, written

MIN_WORDS, BESIDE = 25, 12
N = 3
THRESHOLD = 0.7
RECALL, ROWS = 0.99, 4
BANDS = bands_for(THRESHOLD, ROWS, RECALL)
SEED = 4
#: Bytes of hashes that every worker may hold to look up those of its texts; beyond, texts and hashes are joined.
LOOKUP_BYTES = 32 << 20
#: Bytes of a sieve at most, which must be a power of two, and its slices.
SIEVE_BYTES, SLICES = 32 << 20, 64
PACK_UNITS = 12_000
REPEATED = ["c", "first"]
SPAN, LEFT, RIGHT, FIRST, NEAR = range(5)


def sums_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    up, down = long_powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(hashes * MULT) * up[:n], out=sums[1:])
    return sums, down


def hashed(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the words from each start to its end, in their order."""
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def slid(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold (minimum or maximum) of each width values in a row."""
    size, out = 1, x
    while size < width:
        step = min(size, width - size)
        out = fold(out[: len(out) - step], out[step:])
        size += step
    return out


def seeds(bounds: np.ndarray, hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of min_words words with the least hash in a window of min_words + 2 of them, all in one text, and their hashes."""
    sums, down = sums_of(hashes)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        size = b - a - min_words + 1
        if size < 1:
            continue
        h = mixed((sums[a + min_words : b + 1] - sums[a : b - min_words + 1]) * down[a : a + size])
        width = min(min_words + 2, size)
        least = slid(h, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        found.append(a + np.flatnonzero(slid(np.concatenate((edge, least, edge)), width, np.maximum) == h))
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    return at, hashed(sums, down, at, at + min_words)


def units(bounds: np.ndarray, hashes: np.ndarray, flags: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the paragraphs of a block of texts."""
    n = len(hashes)
    opens = (flags & np.uint8(TITLE | LINE) > 0) | (hashes % np.uint64(32) == 0)
    opens[1:] |= flags[:-1] & np.uint8(ENDS) > 0
    opens[bounds[:-1][bounds[:-1] < n]] = True
    at = np.flatnonzero(opens)
    text = np.searchsorted(bounds, at, side="right")
    # the hash of what stands at a place, of three words if there are so many
    h = mixed(hashes * MULT)
    value = h.copy()
    for k in (1, 2):
        value[: n - k] = mixed(value[: n - k] ^ h[k:] * np.uint64(2 * k + 1))
    value = value[at]
    low = np.ones(len(at), bool)
    for step in range(1, BESIDE + 1):
        if step >= len(at):
            break
        near = (at[step:] - at[:-step] <= BESIDE) & (text[step:] == text[:-step])
        if not near.any():
            break
        low[:-step] &= ~near | (value[:-step] < value[step:])
        low[step:] &= ~near | (value[step:] <= value[:-step])
    low |= np.append(True, text[1:] != text[:-1])[: len(at)]
    places = np.append(at, n)
    starts = at[low & (at + min_words <= bounds[np.minimum(text, len(bounds) - 1)])]
    ends = places[np.searchsorted(places, starts + min_words)]
    sums, down = sums_of(hashes)
    return starts, ends, mixed(hashed(sums, down, starts, ends) + MULT)


def marked(texts: list[str | None], min_words: int):
    """(first text, bounds, starts, ends, hashes, is_unit) of the seeds and paragraphs of texts, block by block."""
    for first, bounds, hashes, flags in word_blocks(texts):
        at, c = seeds(bounds, hashes, min_words)
        starts, ends, own = units(bounds, hashes, flags, min_words)
        yield first, bounds, np.concatenate((at, starts)), np.concatenate((at + min_words, ends)), np.concatenate((c, own)).view(np.int64), np.arange(len(at) + len(starts)) >= len(at)


def rows_in(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("version"), F.xxhash64("doc_id").alias("own")).where("text is not null")


def marks(docs: DataFrame, min_words: int) -> DataFrame:
    """(c, doc_id) of each seed and paragraph."""

    def run(batches):
        for batch in batches:
            cs, owners = [], []
            for first, bounds, starts, _, c, _ in marked(batch.column(1).to_pylist(), min_words):
                cs.append(c)
                owners.append(first + np.searchsorted(bounds, starts, side="right") - 1)
            if cs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cs)), batch.column(0).take(pa.array(np.concatenate(owners)))], ["c", "doc_id"])

    return rows_in(docs).mapInArrow(trimmed(run), f"c long, doc_id {dict(docs.dtypes)['doc_id']}")


def packed_units(docs: DataFrame, repeated: DataFrame, min_words: int, ways: int) -> DataFrame:
    """The band hashes of the paragraphs of docs, packed; of those that repeated has, if every worker can hold it, only in the first document."""
    table = held_by_all(repeated, REPEATED)

    def run(batches):
        known, held = table and Known(table.value), []
        for batch in batches:
            for first, bounds, hashes, flags in word_blocks(batch.column(1).to_pylist()):
                starts, ends, c = units(bounds, hashes, flags, min_words)
                c = c.view(np.int64)
                if known and len(c):
                    k = looked_up(known.c, c)
                    own = k < 0
                    own[~own] = known.own(batch.column(3), first + np.searchsorted(bounds, starts[~own], side="right") - 1, k[~own])
                    starts, ends, c = starts[own], ends[own], c[own]
                if len(c):
                    keys = unit_bands(hashes, starts, ends)
                    held.append((c, keys, followed(starts, ends, keys)))
                if sum(len(x[0]) for x in held) > PACK_UNITS:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def packed(held):
        c, keys, follows = (np.concatenate(x) for x in zip(*held))
        return packed_bands(c, keys, ways, follows)

    return rows_in(docs).mapInArrow(trimmed(run), PACKED)


def followed(starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(paragraphs, bands): whether a paragraph has a band hash from an earlier one of its text, which it overlaps."""
    follows = np.zeros(keys.shape, bool)
    for step in range(1, len(starts)):
        over = starts[step:] < ends[:-step]
        if not over.any():
            break
        follows[step:] |= over[:, None] & (keys[step:] == keys[:-step])
    return follows


def flat(table: pa.Table, name: str) -> np.ndarray:
    """A column of 64-bit integers as it lies in memory or in a file."""
    column = table.column(name)
    return (column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()).to_numpy()


class Known:
    """The hashes that repeat, from a table of REPEATED."""

    def __init__(self, table: pa.Table):
        self.c, self.first = flat(table, "c"), flat(table, "first")

    def own(self, ids: pa.Array, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the doc_id of each row, by its hash in ids, is the first of all that have the hash at a place of the table: the least one, or null where one is null."""
        return ids.to_numpy()[rows] == self.first[at]


def unit_bands(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) band hashes."""
    g = grams(hashes, N)
    # overlapping [start, end) of grams, a reduction each; the second of each two is thrown away
    return bands_of(np.concatenate((g, g[-1:])), np.c_[starts, ends - N + 1].ravel(), 2, BANDS, ROWS, SEED)


def looked_up(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Place of each c in the sorted table, -1 where it is not there."""
    if not len(table):
        return np.full(len(c), -1)
    order = np.argsort(c)  # those close together look at the same part of a large table
    at = np.empty(len(c), np.int64)
    at[order] = np.minimum(np.searchsorted(table, c[order]), len(table) - 1)
    return np.where(table[at] == c, at, -1)


def held_by_all(df: DataFrame, columns: list[str]):
    """df, columns of 64-bit integers, sorted by the first: value is an Arrow table. A broadcast up to LOOKUP_BYTES, beyond them files; None where the shared folder has no path of the file system."""
    if light(df, F.lit(8 * len(columns)), LOOKUP_BYTES):
        return df.sparkSession.sparkContext.broadcast(df.select(*columns).toArrow().sort_by(columns[0]))
    return mapped(df, columns) if folder(df.sparkSession) else None


def folder(spark: SparkSession) -> str | None:
    """The shared folder as a path of the file system, if it has one."""
    path = re.sub("^file:/+", "/", shared_dir(spark))
    return path if path.startswith("/") else None


class Mapped:
    """Sorted columns in files that workers map, so that those of a machine share what they read, and hold none of it."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    @property
    def value(self) -> pa.Table:
        paths = [f"{self.path}/{c}" for c in self.columns]
        buffers = [pa.memory_map(p).read_buffer() if os.path.getsize(p) else pa.py_buffer(b"") for p in paths]
        return pa.table([pa.Array.from_buffers(pa.int64(), b.size // 8, [None, b]) for b in buffers], names=self.columns)


def mapped(df: DataFrame, columns: list[str]) -> Mapped:
    spark = df.sparkSession
    path = f"{folder(spark)}/{new_path(spark, 'lookup').rpartition('/')[2]}"

    def write(batches):
        trial = f"{path}-{uuid.uuid4().hex}"  # of a task that may run again
        os.makedirs(trial)
        files = [open(f"{trial}/{c}", "wb") for c in columns]  # noqa: SIM115
        for batch in batches:
            for file, column in zip(files, batch.columns):
                file.write(column.to_numpy().tobytes())
        for file in files:
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([trial])], ["path"])

    # one task sorts narrow rows and writes them as they come
    (row,) = df.select(*columns).repartition(1).sortWithinPartitions(columns[0]).mapInArrow(write, "path string").collect()
    os.rename(row["path"], path)
    return Mapped(path, columns)


class Sieve:
    """Which 64-bit hashes may be in a table: all that are, and few others. Three bits of one of SLICES slices each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, len(bits) // SLICES * 8

    def may_have(self, c: np.ndarray) -> np.ndarray:
        begin = (c.astype(np.int64) & (SLICES - 1)) * self.size
        found = np.ones(len(c), bool)
        for at in sieve_places(c, self.size):
            at += begin
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


def sieve_places(c: np.ndarray, size: int) -> list[np.ndarray]:
    """Three places of each c in its slice of size bits."""
    h = mixed(c.astype(np.int64).view(np.uint64) * MULT)
    return [(h >> np.uint64(k) & np.uint64(size - 1)).astype(np.int64) for k in (0, 21, 42)]


def sieved(df: DataFrame):
    """A broadcast Sieve of df, of one column of 64-bit hashes: 16 to 32 bits a row, but SIEVE_BYTES at most. Each slice is made by a task."""
    size = 64
    rows = df.count()
    while size * SLICES < min(16 * rows, 8 * SIEVE_BYTES):
        size *= 2

    def made(key, table):
        bits = np.zeros(size, np.uint8)
        for at in sieve_places(table.column("c").to_numpy(), size):
            bits[at] = 1
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    slices = df.toDF("c").select("c", F.expr(f"cast(pmod(c, {SLICES}) as int) as slice")).groupBy("slice").applyInArrow(made, "slice int, bits binary").toArrow()
    bits = np.zeros((SLICES, size // 8), np.uint8)
    for k, own in zip(slices.column("slice").to_pylist(), slices.column("bits").to_pylist()):
        bits[k] = np.frombuffer(own, np.uint8)
    return df.sparkSession.sparkContext.broadcast(Sieve(bits.ravel()))


def may_be_in(sieve, c: Column) -> Column:
    def may_have(x: pd.Series) -> pd.Series:
        return pd.Series(sieve.value.may_have(x.to_numpy()))

    return F.pandas_udf(may_have, "boolean")(c)


def unit_sets(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """(id, weight, grams, bands) of the paragraphs wanted (id), and of a few more; in one pass over the texts, which stay where they are."""
    sieve = sieved(wanted)

    def run(batches):
        for batch in batches:
            for _, _, hashes, starts, ends, c in units_of(batch.column(1), min_words):
                keep = np.flatnonzero(sieve.value.may_have(c))
                keep = keep[np.unique(c[keep], return_index=True)[1]]
                if len(keep):
                    yield sets_at(hashes, starts[keep], ends[keep], c[keep])

    return rows_in(docs).mapInArrow(trimmed(run), "id long, weight long, grams binary, bands binary").dropDuplicates(["id"])


def units_of(texts: pa.Array, min_words: int):
    """(first text, bounds, hashes, starts, ends, c) of the paragraphs of texts, block by block."""
    for first, bounds, hashes, flags in word_blocks(texts.to_pylist()):
        starts, ends, c = units(bounds, hashes, flags, min_words)
        yield first, bounds, hashes, starts, ends, c.view(np.int64)


def sets_at(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    columns = packed_sets([distinct(grams(hashes[a:b], N)) for a, b in zip(starts, ends)], unit_bands(hashes, starts, ends))
    return pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.zeros(len(c), np.int64)), *columns], ["id", "weight", "grams", "bands"])


def sets_by_lookup(docs: DataFrame, wanted, repeated, min_words: int) -> DataFrame:
    """As unit_sets(), where every worker holds what is wanted and what repeats; a paragraph comes from each text of its first document."""

    def run(batches):
        ids, known = flat(wanted.value, "id"), Known(repeated.value)
        for batch in batches:
            for first, bounds, hashes, starts, ends, c in units_of(batch.column(1), min_words):
                keep = np.flatnonzero(looked_up(ids, c) >= 0)
                if len(keep):
                    k = looked_up(known.c, c[keep])
                    own = k < 0
                    own[~own] = known.own(batch.column(3), first + np.searchsorted(bounds, starts[keep[~own]], side="right") - 1, k[~own])
                    keep = keep[own]
                if len(keep):
                    keep = keep[np.unique(c[keep], return_index=True)[1]]
                    keep.sort()
                    yield sets_at(hashes, starts[keep], ends[keep], c[keep])

    return rows_in(docs).mapInArrow(trimmed(run), "id long, weight long, grams binary, bands binary")


def near_units(docs: DataFrame, repeated: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """(c, label) of the paragraphs that are near others."""
    ways = ways_of(docs.sparkSession, BANDS)
    tiles = placed(met(packed_units(docs, repeated, min_words, ways), ways).withColumn("size", F.lit(2 * min_words)))
    wanted = written(tiles.select("id").distinct(), "wanted")
    held = held_by_all(wanted, ["id"]), held_by_all(repeated, REPEATED)
    sets = sets_by_lookup(docs, *held, min_words) if all(held) else unit_sets(docs, wanted, min_words)
    near = near_items(tiles, sets, threshold)
    return clustered(near).select(F.col("id").alias("c"), "label")


HITS = "kind int, doc_id {kind}, version long, start int, end int, c long"


def hits(docs: DataFrame, repeated: DataFrame, near: DataFrame, min_words: int) -> DataFrame:
    """(kind, doc_id, version, start, end, c) of what repeats; repeated has (c, first), near (c, label).

    SPAN: words that an earlier place has. Of seeds in a row, each of which
    begins before the end of the one before, they are one, with its first seed
    as LEFT and its last as RIGHT. FIRST: the first place of c in each text of
    the document that has the first of all. NEAR: a paragraph of a cluster, c is
    its label.
    """
    kind = dict(docs.dtypes)["doc_id"]
    tables = held_by_all(repeated, REPEATED), held_by_all(near, ["c", "label"])
    names = [x.split()[0] for x in HITS.split(", ")]

    def of_texts(batch, found):
        """Hits of a batch's rows (doc_id, _, version) from (owner, start, end, is_unit, c, is_first_doc, label or None) in the order of owner and start."""
        owner, start, end, unit, c, own, labels = found
        out = []
        give = lambda what, at, a, b, code: out.append((np.full(len(at), what), owner[at], a, b, code))
        clustered_ = labels.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(clustered_)
        give(NEAR, at, start[at], end[at], labels.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64))
        rest = ~clustered_
        # in the first document, the first place in its text stays
        at = np.flatnonzero(own & rest)
        order = at[np.lexsort((start[at], c[at], owner[at]))]
        new = np.ones(len(order), bool)
        new[1:] = (owner[order][1:] != owner[order][:-1]) | (c[order][1:] != c[order][:-1])
        firsts = order[new]
        give(FIRST, firsts, start[firsts], end[firsts], c[firsts])
        begin = start.copy()
        if len(order):
            first_of = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            begin[order] = np.maximum(start[order], end[first_of])  # what overlaps the first place leaves that whole
        again = rest.copy()
        again[firsts] = False
        again &= begin < end
        at = np.flatnonzero(again & unit)
        give(SPAN, at, begin[at], end[at], c[at])
        at = np.flatnonzero(again & ~unit)
        if len(at):
            first = np.r_[True, (owner[at][1:] != owner[at][:-1]) | (begin[at][1:] > end[at][:-1])]
            left, right = at[first], at[np.r_[first[1:], True]]
            give(SPAN, left, begin[left], end[right], c[left])
            give(LEFT, left, start[left], end[left], c[left])
            give(RIGHT, right, start[right], end[right], c[right])
        what, who, a, b, code = (np.concatenate(x) for x in zip(*out))
        who = pa.array(who)
        return pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), batch.column(0).take(who), batch.column(2).take(who), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(code)], names)

    if all(tables):

        def run(batches):
            known, labels = Known(tables[0].value), tables[1].value
            ls, label_of = flat(labels, "c"), pa.array(flat(labels, "label"))
            for batch in batches:
                parts = []
                for first, bounds, starts, ends, c, unit in marked(batch.column(1).to_pylist(), min_words):
                    k, j = looked_up(known.c, c), looked_up(ls, c)
                    at = np.flatnonzero((k >= 0) | (j >= 0))
                    at = at[np.argsort(starts[at], kind="stable")]
                    text = np.searchsorted(bounds, starts[at], side="right") - 1
                    parts.append((first + text, starts[at] - bounds[text], ends[at] - bounds[text], unit[at], c[at], k[at], j[at]))
                if not parts:
                    continue
                owner, start, end, unit, c, k, j = (np.concatenate(x) for x in zip(*parts))
                if not len(c):
                    continue
                own = k >= 0
                own[own] = known.own(batch.column(3), owner[own], k[own])
                yield of_texts(batch, (owner, start, end, unit, c, own, label_of.take(pa.array(j, mask=j < 0))))

        return rows_in(docs).mapInArrow(trimmed(run), HITS.format(kind=kind))

    sieve = sieved(repeated.select("c").union(near.select("c")))

    def every(batches):
        for batch in batches:
            for first, bounds, starts, ends, c, unit in marked(batch.column(1).to_pylist(), min_words):
                kept = sieve.value.may_have(c)
                starts, ends, c, unit = starts[kept], ends[kept], c[kept], unit[kept]
                text = np.searchsorted(bounds, starts, side="right") - 1
                at = pa.array(first + text)
                yield pa.RecordBatch.from_arrays([pa.array(c), batch.column(0).take(at), batch.column(2).take(at), pa.array(starts - bounds[text], pa.int32()), pa.array(ends - bounds[text], pa.int32()), pa.array(unit)], ["c", "doc_id", "version", "start", "end", "unit"])

    def gathered(batches):
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten()
            sizes = pa.compute.list_value_length(lists).to_numpy()
            column = lambda name: flat.field(flat.type.get_field_index(name))
            start, end, c, own = (column(x).to_numpy(zero_copy_only=False) for x in ("start", "end", "c", "own"))
            yield of_texts(batch, (np.repeat(np.arange(len(lists)), sizes), start.astype(np.int64), end.astype(np.int64), column("unit").to_numpy(zero_copy_only=False), c, own, column("label")))

    rows = rows_in(docs).mapInArrow(trimmed(every), f"c long, doc_id {kind}, version long, start int, end int, unit boolean")
    keys = repeated.join(near, "c", "full")
    own = F.xxhash64("doc_id") == F.col("first")
    found = rows.join(keys, "c").select("doc_id", "version", F.struct("start", "end", "unit", "c", F.coalesce(own, F.lit(False)).alias("own"), "label").alias("hit"))
    lists = found.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("hit")).alias("hits"))
    return lists.select("doc_id", F.lit(0).alias("none"), "version", "hits").mapInArrow(trimmed(gathered), HITS.format(kind=kind))


def contexts(docs: DataFrame, places: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, version, place, words): hashes of the min_words + 2 words beside a seed, nearest first; place is twice its start for those before it, and one more for those after it."""
    reach = min_words + 2

    def run(batches):
        for batch in batches:
            lists = batch.column(3).to_pylist()
            owners, kept, words = [], [], []
            for first, bounds, hashes, _ in word_blocks(batch.column(1).to_pylist()):
                for k in range(len(bounds) - 1):
                    own = hashes[bounds[k] : bounds[k + 1]].astype(np.uint32)
                    for place in lists[first + k]:
                        at = place >> 1
                        beside = own[at + min_words :][:reach] if place & 1 else own[max(0, at - reach) : at][::-1]
                        owners.append(first + k)
                        kept.append(place)
                        words.append(beside.tobytes())
            at = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(kept, pa.int64()), pa.array(words, pa.binary())], ["doc_id", "version", "place", "words"])

    kind = dict(docs.dtypes)["doc_id"]
    lists = written(places.groupBy("w_id", "w_version").agg(F.collect_set("place").alias("places")), "places")
    texts, side = rows_in(docs), lists
    if light(lists, "64 + 8 * size(places)"):
        side = F.broadcast(lists)
    else:  # only the texts that have any go through the shuffle
        texts, side = texts.where(may_be_in(sieved(lists.select("w_version")), F.col("version"))), lists.hint("shuffle_hash")
    joined = texts.join(side, F.expr("w_id <=> doc_id and w_version = version"))
    # rows that stand twice have the same words
    return joined.select("doc_id", "text", "version", "places").mapInArrow(trimmed(run), f"doc_id {kind}, version long, place long, words binary").dropDuplicates(["doc_id", "version", "place"])


def extended(docs: DataFrame, found: DataFrame, firsts: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, version, start, end) of the words beside the LEFT and RIGHT seeds of found that the first place (firsts: c, at) has too."""
    right = F.col("kind") == RIGHT
    edges = found.where(F.col("kind").isin(LEFT, RIGHT)).join(firsts, "c")
    edges = edges.select("doc_id", "version", "start", (F.col("start").cast("long") * 2 + right.cast("long")).alias("place"), F.col("at.doc_id").alias("f_id"), F.col("at.version").alias("f_version"), F.col("at.start").alias("f_start"), (F.col("at.start").cast("long") * 2 + right.cast("long")).alias("f_place"))
    edges = written(edges, "edges")
    places = edges.select(F.col("doc_id").alias("w_id"), F.col("version").alias("w_version"), "place").union(edges.select("f_id", "f_version", "f_place"))
    beside = written(contexts(docs, places, min_words), "contexts")
    own, first = beside.toDF("o_id", "o_version", "o_place", "words"), beside.toDF("p_id", "p_version", "p_place", "first_words")
    both = edges.join(own, F.expr("doc_id <=> o_id and version = o_version and place = o_place")).join(first, F.expr("f_id <=> p_id and f_version = p_version and f_place = p_place"))

    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), np.int32)
        for k, (x, y) in enumerate(zip(a, b)):
            n = min(len(x), len(y)) // 4
            same = np.frombuffer(x, np.uint32, n) == np.frombuffer(y, np.uint32, n)
            out[k] = n if same.all() else same.argmin()
        return pd.Series(out)

    both = both.withColumn("n", F.pandas_udf(common, "int")("words", "first_words"))
    within = F.expr("doc_id <=> f_id and version = f_version")  # what the first place has stays whole
    start, end = F.col("start"), F.col("start") + min_words
    before = F.when(within, F.greatest(start - F.col("n"), F.col("f_start") + min_words)).otherwise(start - F.col("n"))
    after = F.col("place") % 2 == 1
    return both.select("doc_id", "version", F.when(after, end).otherwise(before).cast("int").alias("start"), F.when(after, end + F.col("n")).otherwise(start).cast("int").alias("end")).where("start < end")


def cut_spans(text: str, spans: list) -> str:
    """text without the words of the spans (start, end, kept) that no kept span has, and without those of the spans of which kept is null; the white space after a cut word goes with it."""
    parts, done = [], 0
    for part in slices(text, 1 << 20):
        parts.append(words_of(part)[0] + done)
        done += len(part)
    at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    gone = np.zeros(len(at), bool)
    for value, kept in ((True, False), (False, True), (True, None)):
        for start, end, own in spans:
            if own is kept:
                gone[start:end] = value
    if not gone.any():
        return text
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    out, last = [], 0
    for i, j in zip(edges[::2], edges[1::2]):
        out.append(text[last : at[i]])
        last = at[j] if j < len(at) else len(text)
    out.append(text[last:])
    return "".join(out)


def repeated_spans(docs: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """(doc_id, version, start, end, kept) of the words to cut (kept false, or null: whatever else is kept there) and to keep."""
    none = F.lit(None).cast(docs.schema["doc_id"].dataType)
    first = F.xxhash64(F.when(F.max(F.col("doc_id").isNull()), none).otherwise(F.min("doc_id")))
    counted = marks(docs, min_words).groupBy("c").agg(F.count("*").alias("n"), first.alias("first"))
    repeated = written(counted.where("n > 1").select(*REPEATED), "repeated")
    near = written(near_units(docs, repeated, min_words, threshold), "near-units")
    found = written(hits(docs, repeated, near, min_words), "hits")
    place = ("doc_id", "version", "start", "end")
    own = found.where(F.col("kind") == FIRST).select("c", *place).distinct()
    firsts = written(own.groupBy("c").agg(F.min(F.struct(*place)).alias("at")), "firsts")
    # of texts under the same doc_id, one has the first place
    later = own.join(firsts, "c").where("version <> at.version").select(*place)
    equal = found.where(F.col("kind") == SPAN).select(*place).union(later).union(extended(docs, found, firsts, min_words))
    cluster = found.where(F.col("kind") == NEAR).select(F.col("c").alias("label"), *place).distinct()
    # a paragraph that overlaps one of its cluster is alike by the words that they share, and stays
    before = F.lag("end").over(Window.partitionBy("label", "doc_id", "version").orderBy("start"))
    cluster = written(cluster.withColumn("before", before).where("before is null or before <= start").drop("before"), "cluster")
    first_of = cluster.groupBy("label").agg(F.min(F.struct(*place)).alias("at"))
    judged = cluster.join(first_of, "label").select(*place, F.struct(*place).eqNullSafe(F.col("at")).alias("kept"))
    return equal.select(*place, F.lit(None).cast("boolean").alias("kept")).union(judged)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, columns as they are, with the repeated passages cut from text.

    Equal passages are cut to their full length, but for the first occurrence by
    (doc_id, hash of the text, position), a null doc_id first: every word cut
    has its like at an earlier place, so that the first of all stays. Of each
    cluster of near paragraphs the first occurrence stays too, and its words are
    not cut for another cluster. A row loses its place only where every word of
    it is cut. n_chars, if there, is the length of the new text in rows that
    changed. Rows with the same doc_id and text are one document and fare alike.
    Null, empty and short texts (fewer than min_words words) stay as they are.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    code = F.when(F.col("kept").isNull(), 0).when(F.col("kept"), 1).otherwise(2)
    spans = repeated_spans(docs, min_words, threshold).withColumn("span", F.shiftleft(F.col("start").cast("long"), 33) + F.shiftleft(F.col("end").cast("long"), 2) + code)
    lists = spans.groupBy("doc_id", "version").agg(F.collect_list("span").alias("__tl_spans"), F.max(code).alias("most"), F.min(code).alias("least"))
    lists = written(lists.where("most <> 1 or least <> 1").select(F.col("doc_id").alias("__tl_id"), F.col("version").alias("__tl_version"), "__tl_spans"), "spans")

    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        kept = (None, True, False)
        return pd.Series([None if t is None else cut_spans(t, [(s >> 33, s >> 2 & 0x7FFFFFFF, kept[s & 3]) for s in map(int, spans)]) for t, spans in zip(texts, lists)], dtype=object)

    rows, on = docs.withColumn("__tl_hash", F.xxhash64("text")), F.expr("doc_id <=> __tl_id and __tl_hash = __tl_version and text is not null")
    if light(lists, "64 + 8 * size(__tl_spans)"):
        joined = rows.join(F.broadcast(lists), on, "left")
    else:  # only the texts that have spans, and a few more, go through the shuffle
        maybe = may_be_in(sieved(lists.select("__tl_version")), F.col("__tl_hash"))
        none = [F.lit(None).cast(lists.schema[c].dataType).alias(c) for c in lists.columns]
        joined = rows.where(maybe).join(lists.hint("shuffle_hash"), on, "left").union(rows.where(~maybe).select("*", *none))
    touched = F.when(F.col("__tl_spans").isNotNull(), F.col("text"))
    joined = joined.withColumn("__tl_new", F.pandas_udf(cut, "string")(touched, "__tl_spans"))
    new = joined.where(F.expr(r"__tl_new is null or __tl_new = text or __tl_new rlike '\\S'"))
    values = {"text": F.coalesce("__tl_new", "text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("__tl_new").isNotNull(), F.length("__tl_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return new.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the passages that an earlier place has already: deduplicated() on the whole table."""
    return deduplicated(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op4_substrings": op4_substrings}
SQL: dict[str, str] = {}
