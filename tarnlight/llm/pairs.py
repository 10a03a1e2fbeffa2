"""Near pairs of hashed sets: buckets of equal band hashes, tiles around their hubs, exact Jaccard in each tile, components.

Items are sets of 64-bit hashes with a 64-bit id. Those that share a band hash
form a bucket, whose hub is its least id. All items that a hub has in any of
its buckets meet in the hub's tile, each with the mask of the bands that brought
it there, and every two that share a bit are compared on their full sets. Pairs
are never rows: a tile gives one row an item, so that what is shuffled grows
with the items and not with their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.words import trimmed
from tarnlight.operators.components import components
from tarnlight.shared import written

#: Bytes of sets and number of items of one block; a tile that has more is split into pairs of blocks.
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 1024
BROADCAST_BYTES = 24 << 20
DENSE = 1 << 22


def few(df: DataFrame, rows: int = 500_000) -> bool:
    """Whether df, of narrow rows, may be broadcast: counted, not assumed."""
    return df.limit(rows + 1).count() <= rows


def light(df: DataFrame, size, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of df, of the given size in bytes (an expression, summed over all rows), may be broadcast."""
    return (df.agg(F.sum(F.expr(size) if isinstance(size, str) else size)).first()[0] or 0) <= most


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


PACKED = "part int, ids binary, lows binary"


def packed_bands(ids: np.ndarray, keys: np.ndarray, ways: int, follows: np.ndarray | None = None) -> pa.RecordBatch:
    """A row (PACKED) for each part that the band hashes keys (items x bands) of ids fall in, ways parts a band.

    ids and 31 bits of the hashes are packed, with follows (items x bands) as
    the lowest bit: whether an item has the hash from another beside it.
    """
    ids, first, place = np.unique(ids, return_index=True, return_inverse=True)
    bands = keys.shape[1]
    lows = keys[first].astype(np.uint32) << np.uint32(1)
    if follows is not None:
        leads = np.zeros(lows.shape, bool)
        np.logical_or.at(leads, place, ~follows)
        lows |= (~leads).astype(np.uint32)
    part = ((keys[first] >> np.uint64(32)) % np.uint64(ways)).astype(np.int64) + np.arange(bands) * ways
    order = np.argsort(part.ravel(), kind="stable")
    parts, begin = np.unique(part.ravel()[order], return_index=True)
    bounds = np.r_[begin, len(order)]
    rows = [[x[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])] for x in (ids[order // bands], lows.ravel()[order])]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(pa.array(r, pa.binary()) for r in rows)], ["part", "ids", "lows"])


def ways_of(spark: SparkSession, bands: int) -> int:
    return max(1, 4 * partitions(spark) // bands)


def met(packed: DataFrame, ways: int) -> DataFrame:
    """(hub, id, mask) for the items that share a band hash with another: bit j of mask says that hub is the least id of a bucket of band j in which id is.

    A bucket of one item and one that only follows is none. A part, which holds
    the hashes of one band that are alike in some bits, is the work of a task at
    a time, at 12 bytes an item.
    """

    def buckets(key, table):
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        lows = np.frombuffer(b"".join(table.column("lows").to_pylist()), np.uint32)
        order = np.argsort(lows, kind="stable")
        same = lows[order] >> np.uint32(1)
        same = np.r_[False, same[1:] == same[:-1], False]
        order = order[same[1:] | same[:-1]]  # the others are alone
        ids, follows, lows = ids[order], lows[order] & np.uint32(1), lows[order] >> np.uint32(1)
        order = np.lexsort((follows, ids, lows))
        ids, follows, lows = ids[order], follows[order], lows[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (lows[1:] != lows[:-1])
        ids, follows, lows = ids[new], follows[new].astype(np.int64), lows[new]
        starts = np.flatnonzero(np.r_[True, lows[1:] != lows[:-1]]) if len(ids) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(ids)])
        after = np.add.reduceat(follows, starts) if len(ids) else sizes
        shared = np.repeat((sizes - after > 1) | (after > 1), sizes)
        hub = np.repeat(ids[starts], sizes)
        band = int(key[0].as_py()) // ways
        return pa.table({"hub": hub[shared], "id": ids[shared], "mask": np.full(int(shared.sum()), np.array(1 << band, np.uint64).astype(np.int64))})

    found = packed.groupBy("part").applyInArrow(buckets, "hub long, id long, mask long")
    return found.groupBy("hub", "id").agg(F.bit_or("mask").alias("mask"))


TILES = ["tile", "cross", "side", "mask", "id"]


def placed(found: DataFrame) -> DataFrame:
    """(tile, cross, side, mask, id), written: the tiles where items of found (hub, id, mask, size) are compared; size: 8-byte hashes of the item's set.

    The items of a hub that has over BLOCK_BYTES or BLOCK_ITEMS are put to
    blocks by their hash; each block is a tile, and so is each pair of blocks,
    in which only items of different blocks are compared.
    """
    found = written(found, "met")
    total = found.groupBy("hub").agg(F.sum("size").alias("size"), F.count("*").alias("items"))
    blocks = F.ceil(F.greatest(F.col("size") * 8 / BLOCK_BYTES, F.col("items") / BLOCK_ITEMS)).cast("int")
    large = total.select("hub", blocks.alias("blocks")).where("blocks > 1")
    rows = found.join(F.broadcast(large) if few(large) else large, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("hub", F.least("own", "other"), F.greatest("own", "other"))
    return written(rows.select(tile.alias("tile"), (F.col("own") != F.col("other")).alias("cross"), (F.col("own") > F.col("other")).cast("int").alias("side"), "mask", "id"), "tiles")


def packed_sets(sets: list[np.ndarray], bands: np.ndarray) -> list[pa.Array]:
    """Columns grams and bands of sets and of their band hashes (items x bands), of which the low halves will do."""
    return [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([b.tobytes() for b in bands.astype(np.uint32)], pa.binary())]


def compared(ids: np.ndarray, masks: np.ndarray, sides: np.ndarray | None, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the items of a tile that share a bit of masks and have Jaccard >= threshold; with sides, only of different ones."""
    m = len(ids)
    sizes = np.array([len(s) for s in sets])
    maybe = np.triu((masks[:, None] & masks) != 0, 1)
    if sides is not None:
        maybe &= sides[:, None] != sides
    maybe &= np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes)
    i, j = np.nonzero(maybe)
    if not len(i):
        return i, j
    if len(i) <= 2 * m or m <= 4:  # few pairs: each by itself
        inter = np.array([np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y) for x, y in ((sets[p], sets[q]) for p, q in zip(i, j))])
    else:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(m), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.r_[True, flat[1:] != flat[:-1]]
        number = np.cumsum(new) - 1
        count = np.bincount(number)
        shared = count[number] > 1  # the rest add to no intersection
        number, owner = np.cumsum(new & shared)[shared] - 1, owner[shared]
        both = np.zeros((m, m), np.float32)
        step, width = max(64, DENSE // m), int(number[-1]) + 1 if len(number) else 0
        for begin in range(0, width, step):
            lo, hi = np.searchsorted(number, [begin, begin + step])
            x = np.zeros((m, min(step, width - begin)), np.float32)
            x[owner[lo:hi], number[lo:hi] - begin] = 1
            both += x @ x.T
        inter = both[i, j].astype(np.int64)
    near = inter >= threshold * (sizes[i] + sizes[j] - inter)
    return i[near], j[near]


def rooted(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """Least place of each one's component under the pairs i, j."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_items(tiles: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(id, root, links) of the items of each of the tiles that are near another there; sets has (id, weight, grams, bands).

    root is the least id of those that they are joined to in the tile, links the
    sum of the weights of their near items; a pair that meets in several tiles
    is counted in one, that of the first band that it shares.
    """

    def run(batches):
        held: pa.RecordBatch | None = None

        def close(rows: pa.RecordBatch):
            ids, first = np.unique(rows.column("id").to_numpy(), return_index=True)
            if len(ids) < rows.num_rows:  # made from repeated rows
                rows = rows.take(pa.array(first))
            ids, masks, weights = (rows.column(c).to_numpy() for c in ("id", "mask", "weight"))
            cross = rows.column("cross")[0].as_py()
            sets_ = [np.frombuffer(g.as_buffer(), np.uint64) for g in rows.column("grams")]
            i, j = compared(ids, masks, rows.column("side").to_numpy() if cross else None, sets_, threshold)
            if not len(i):
                return None
            links = np.zeros(len(ids), np.int64)
            bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.uint32).reshape(len(ids), -1)
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                first = (bands[p] == bands[q]).argmax(axis=1)
                own = (masks[p] & masks[q]) >> first & 1 == 1
                np.add.at(links, p[own], weights[q[own]])
                np.add.at(links, q[own], weights[p[own]])
            root = rooted(i, j, len(ids))
            at = np.union1d(i, j)
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, root, ids)
            return ids[at], least[root[at]], links[at]

        def tiles(rows: pa.RecordBatch, last: bool):
            """Results of the whole tiles of rows, and the rows of the last, which may go on."""
            tile = rows.column("tile").to_numpy()
            starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
            bounds = np.r_[starts, len(tile)] if last else starts
            found = [x for a, b in zip(bounds[:-1], bounds[1:]) if b - a > 1 and (x := close(rows.slice(a, b - a)))]
            return found, None if last else rows.slice(starts[-1])

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["id", "root", "links"])

        for batch in batches:
            if batch.num_rows:
                rows = batch if held is None else pa.concat_batches([held, batch])
                found, held = tiles(rows, False)
                if found:
                    yield batch_of(found)
        if held is not None and (found := tiles(held, True)[0]):
            yield batch_of(found)

    n = 2 * partitions(sets.sparkSession)
    rows = sets.join(F.broadcast(tiles) if light(tiles, F.lit(48)) else tiles, "id").select(*TILES, "weight", "grams", "bands")
    return rows.repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(trimmed(run), "id long, root long, links long")


def clustered(near: DataFrame) -> DataFrame:
    """(id, label, links) from near_items(): label is the least id of the component, links are summed."""
    near = written(near, "near")
    labels = components(near.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "label")
    return labels.join(near.groupBy("id").agg(F.sum("links").alias("links")), "id")
