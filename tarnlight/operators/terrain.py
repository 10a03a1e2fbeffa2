"""Density terrain of a map: a sparse raster, contours, peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.shared import written

CELL, SIGMA = 10, 34.0
LEVELS, LOWEST, HIGHEST = 22, 0.035, 0.88
PEAK_SHARE, MAX_PEAKS = 0.38, 3
PEAK_SIGMA = 54.0
#: Corners of the raster of a community in each direction, and rows of a task's kernel sums.
RASTER, PART = 600, 16_384


def grid(points: DataFrame, cell: int = CELL, sigma: float = SIGMA) -> DataFrame:
    """(cx, cy, density): Gaussian kernel sums of points (x, y, density_weight) at the corners of a grid, within three sigma of each point.

    Only cells near a point exist. Each point makes as many rows as the window
    has cells, whatever their number; partial sums are combined before the shuffle.
    """
    radius = max(float(cell), 3 * sigma)
    low = lambda c: F.greatest(F.floor((F.col(c) - radius) / cell), F.lit(0)).cast("int")
    high = lambda c: (F.floor((F.col(c) + radius) / cell) + 1).cast("int")
    rows = points.where((F.col("x") + radius >= 0) & (F.col("y") + radius >= 0))
    rows = rows.select("x", "y", "density_weight", F.explode(F.sequence(low("x"), high("x"))).alias("cx"), low("y").alias("y0"), high("y").alias("y1"))
    rows = rows.select("x", "y", "density_weight", "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))
    d2 = (F.col("cx") * cell - F.col("x")) ** 2 + (F.col("cy") * cell - F.col("y")) ** 2
    return rows.groupBy("cx", "cy").agg(F.sum(F.col("density_weight") * F.exp(-d2 / (2 * sigma * sigma))).alias("density"))


def ratios(count: int = LEVELS, lowest: float = LOWEST, highest: float = HIGHEST) -> list[float]:
    """Shares of the greatest density at which contours lie, denser at the top."""
    low = float(np.clip(lowest, 1e-5, 0.95))
    high = max(min(0.999, highest), low + 1e-5)
    return [low * (high / low) ** ((k / max(count - 1, 1)) ** 0.68) for k in range(count)]


def contours(cells: DataFrame, count: int = LEVELS, lowest: float = LOWEST, highest: float = HIGHEST, cell: int = CELL) -> DataFrame:
    """(level, ratio, value, major, x1, y1, x2, y2): segments of the contours of grid(), by marching squares.

    A square gets its four corners by one aggregation over the cells that each
    corner belongs to; corners without a cell have density 0. A saddle is cut
    by the mean of its corners.
    """
    shares = ratios(count, lowest, highest)
    spark = cells.sparkSession
    levels = spark.createDataFrame([(k, r, k % 4 == 0 or k == count - 1) for k, r in enumerate(shares)], "level int, ratio double, major boolean")
    top = cells.agg(F.max("density").alias("top"))
    corners = F.array(*[F.struct((F.col("cx") - i).alias("cx"), (F.col("cy") - j).alias("cy"), F.lit(k).alias("k")) for k, (i, j) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    spread = cells.select(F.explode(corners).alias("q"), "density").select("q.*", "density")
    value = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("density"))), F.lit(0.0)).alias(f"d{k}")
    squares = spread.groupBy("cx", "cy").agg(*[value(k) for k in range(4)])
    low, high = F.least("d0", "d1", "d2", "d3"), F.greatest("d0", "d1", "d2", "d3")
    at = squares.crossJoin(F.broadcast(levels)).crossJoin(F.broadcast(top)).withColumn("value", F.col("top") * F.col("ratio")).where((low < F.col("value")) & (high >= F.col("value")))
    inside = [(F.col(f"d{k}") >= F.col("value")).cast("int") for k in range(4)]
    case = sum((inside[k] * (1 << k) for k in range(1, 4)), inside[0])

    def on(a: int, b: int) -> Column:
        where = ((0, 0), (1, 0), (1, 1), (0, 1))
        (ax, ay), (bx, by) = where[a], where[b]
        t = (F.col("value") - F.col(f"d{a}")) / (F.col(f"d{b}") - F.col(f"d{a}"))
        x = (F.col("cx") + ax + F.when(F.lit(ax != bx), t * (bx - ax)).otherwise(0.0)) * cell
        y = (F.col("cy") + ay + F.when(F.lit(ay != by), t * (by - ay)).otherwise(0.0)) * cell
        return F.struct(F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))

    sides = {"s": (0, 1), "e": (1, 2), "n": (3, 2), "w": (0, 3)}
    line = lambda p, q: F.struct(on(*sides[p]).alias("p"), on(*sides[q]).alias("q"))
    cases = {1: "ws", 2: "se", 3: "we", 4: "en", 6: "sn", 7: "wn", 8: "nw", 9: "ns", 11: "ne", 12: "ew", 13: "es", 14: "sw"}
    middle = (F.col("d0") + F.col("d1") + F.col("d2") + F.col("d3")) / 4 >= F.col("value")
    two = lambda a, b: F.array(line(*a), line(*b))
    found = F.when(F.col("case") == 5, F.when(middle, two("wn", "se")).otherwise(two("ws", "en")))
    found = found.when(F.col("case") == 10, F.when(middle, two("ws", "en")).otherwise(two("wn", "se")))
    for k, (p, q) in cases.items():
        found = found.when(F.col("case") == k, F.array(line(p, q)))
    rows = at.withColumn("case", case).select("level", "ratio", "value", "major", F.explode(found).alias("s"))
    return rows.select("level", "ratio", "value", "major", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def greatest_around(a: np.ndarray, size: int) -> np.ndarray:
    """The maximum of a size x size window around each cell, edges repeated."""
    for axis in (0, 1):
        before = size // 2
        padded = np.pad(a, [(before, size - 1 - before) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        a = np.lib.stride_tricks.sliding_window_view(padded, size, axis=axis).max(axis=-1)
    return a


def peaks_of(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cell: float = CELL, sigma: float = SIGMA, most: int = MAX_PEAKS) -> list[tuple[float, float, float]]:
    """(x, y, density) of a community's peaks: local maxima of its own raster, the highest first, not near one another."""
    if len(x) == 1:
        return [(float(x[0]), float(y[0]), 1.0)]
    radius = max(cell, 3 * sigma)
    x0, y0 = x.min() - radius, y.min() - radius
    xs, ys = np.arange(x0, x.max() + radius + cell, cell), np.arange(y0, y.max() + radius + cell, cell)
    raster = np.zeros(ys.shape + xs.shape)
    for px, py, w in zip(x, y, weight):
        i0, i1 = max(0, int((px - radius - x0) // cell)), min(len(xs) - 1, int((px + radius - x0) // cell) + 1)
        j0, j1 = max(0, int((py - radius - y0) // cell)), min(len(ys) - 1, int((py + radius - y0) // cell) + 1)
        raster[j0 : j1 + 1, i0 : i1 + 1] += w * np.outer(np.exp(-((ys[j0 : j1 + 1] - py) ** 2) / (2 * sigma**2)), np.exp(-((xs[i0 : i1 + 1] - px) ** 2) / (2 * sigma**2)))
    top = raster.max()
    if top <= 0:
        return [(float(x.mean()), float(y.mean()), 0.0)]
    window = max(3, round(1.45 * sigma / cell))
    at = np.argwhere((raster == greatest_around(raster, window)) & (raster >= top * PEAK_SHARE))
    apart = max(130.0, 3.2 * sigma) ** 2
    chosen: list[tuple[float, float, float]] = []
    for j, i in sorted(at.tolist(), key=lambda p: -raster[p[0], p[1]]):
        if all((xs[i] - px) ** 2 + (ys[j] - py) ** 2 >= apart for px, py, _ in chosen):
            chosen.append((float(xs[i]), float(ys[j]), float(raster[j, i])))
        if len(chosen) == most:
            break
    return chosen


def peaks(points: DataFrame, cell: float = CELL, sigma: float = SIGMA, most: int = MAX_PEAKS) -> DataFrame:
    """(community, rank, x, y, density) of (id, community, x, y, density_weight); a community is one task's work."""
    kind = dict(points.dtypes)["community"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        found = peaks_of(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["density_weight"].to_numpy(), cell, sigma, most)
        return pd.DataFrame([(key[0], k + 1, *p) for k, p in enumerate(found)], columns=["community", "rank", "x", "y", "density"])

    return points.select("id", "community", "x", "y", "density_weight").groupBy("community").applyInPandas(one, f"community {kind}, rank int, x double, y double, density double")


def dense_cells(corners: DataFrame, sigma: float) -> DataFrame:
    """(community, gx, gy): the cells that may hold the densest point of a community, from the weights (community, gx, gy, w, cell, h) of points split between the corners of their cells; a community is one task's work on RASTER x RASTER sums at most.

    Splitting a weight by place is linear interpolation of the kernel: it is off
    by h ** 2 / (8 * sigma ** 2) in each direction at most, which bounds the
    density in a cell by its corners from both sides.
    """
    kind = dict(corners.dtypes)["community"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gx, gy, w = pdf["gx"].to_numpy(), pdf["gy"].to_numpy(), pdf["w"].to_numpy()
        h = float(pdf["h"].iloc[0])
        weights, there = np.zeros((gx.max() + 2, gy.max() + 2)), np.zeros((gx.max() + 2, gy.max() + 2), bool)
        weights[gx, gy] = w
        cells = pdf["cell"].to_numpy(bool)
        there[gx[cells], gy[cells]] = True
        k = [np.exp(-((np.subtract.outer(np.arange(n), np.arange(n)) * h) ** 2) / (2 * sigma * sigma)) for n in weights.shape]
        d = k[0] @ weights @ k[1]
        four = np.stack([d[:-1, :-1], d[1:, :-1], d[:-1, 1:], d[1:, 1:]])
        off = 2 * np.abs(w).sum() * h * h / (4 * sigma * sigma) + 1e-6  # at the corners, and between them
        low, high, there = four.min(axis=0) - off, four.max(axis=0) + off, there[:-1, :-1]
        x, y = np.nonzero(there & (high >= low[there].max()))
        return pd.DataFrame({"community": key[0], "gx": x, "gy": y})

    return corners.groupBy("community").applyInPandas(one, f"community {kind}, gx int, gy int")


def kernel_sums(asked: DataFrame, places: DataFrame, sigma: float) -> DataFrame:
    """asked (community, x, y) with s: the kernel sum of the weights w of all places of its community, in parts of PART rows of both."""
    kind = dict(asked.dtypes)["community"]

    def parted(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        sizes = rows.groupBy("community").agg(F.ceil(F.count("*") / PART).cast("int").alias(name + "s"))
        return rows.join(F.broadcast(sizes), "community").withColumn(name, F.pmod(F.xxhash64("x", "y"), F.col(name + "s")).cast("int")), sizes

    (left, n), (right, m) = parted(asked.select("community", "x", "y"), "p"), parted(places.select("community", "x", "y", "w"), "q")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = left.join(F.broadcast(m), "community").select("community", "p", every("qs").alias("q"), "x", "y")
    right = right.join(F.broadcast(n), "community").select("community", every("ps").alias("p"), "q", "x", "y", "w").toDF("c", "i", "j", "qx", "qy", "w")

    def sums(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (theirs[c].to_numpy() for c in ("qx", "qy", "w"))
        total = np.zeros(len(mine))
        for at in range(0, len(mine) if len(theirs) else 0, 128):
            d2 = np.subtract.outer(mine["x"].to_numpy()[at : at + 128], x) ** 2 + np.subtract.outer(mine["y"].to_numpy()[at : at + 128], y) ** 2
            total[at : at + 128] = np.exp(d2 / (-2 * sigma * sigma)) @ w
        return mine[["community", "x", "y"]].assign(s=total)

    parts = left.groupBy("community", "p", "q").cogroup(right.groupBy("c", "i", "j")).applyInPandas(sums, f"community {kind}, x double, y double, s double")
    return parts.groupBy("community", "x", "y").agg(F.round(F.sum("s"), 9).alias("s"))


def density_peak(points: DataFrame, sigma: float = PEAK_SIGMA) -> DataFrame:
    """(community, peak_x, peak_y): the mean, by density, of the notes near the densest one of each community.

    Densities are summed over all notes of a community, but only for notes that
    can be the densest or that are near it; a raster bounds those of the others.
    """
    rows = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("density_weight").isNotNull())
    places = rows.groupBy("community", "x", "y").agg(F.sum("density_weight").alias("w"), F.min("id").alias("id"), F.count("*").alias("notes"))
    box = places.groupBy("community").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    box = box.select("community", "x0", "y0", F.greatest(F.col("span") / (RASTER - 2), F.lit(1e-9)).alias("h"))
    at = places.join(F.broadcast(box), "community").withColumns({"fx": (F.col("x") - F.col("x0")) / F.col("h"), "fy": (F.col("y") - F.col("y0")) / F.col("h")})
    at = written(at.withColumns({"gx": F.floor("fx").cast("int"), "gy": F.floor("fy").cast("int")}), "places")
    part = lambda c, i: F.abs(F.lit(1 - i) - (F.col("f" + c) - F.col("g" + c)))
    corner = [F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy"), (F.col("w") * part("x", i) * part("y", j)).alias("w"), F.lit(i + j == 0).alias("cell")) for i in (0, 1) for j in (0, 1)]
    corners = at.select("community", "h", F.explode(F.array(*corner)).alias("c")).groupBy("community", "c.gx", "c.gy").agg(F.sum("c.w").alias("w"), F.max("c.cell").alias("cell"), F.first("h").alias("h"))
    maybe = at.join(dense_cells(corners, sigma), ["community", "gx", "gy"], "left_semi")
    known = written(kernel_sums(maybe, at, sigma).join(at.select("community", "x", "y", "id"), ["community", "x", "y"]), "densest")
    top = known.groupBy("community").agg(F.min_by(F.struct("x", "y"), F.struct((-F.col("s")).alias("s"), "id")).alias("b"))
    close = (F.col("x") - F.col("b.x")) ** 2 + (F.col("y") - F.col("b.y")) ** 2 <= (0.9 * sigma) ** 2
    near = written(at.join(F.broadcast(top), "community").where(close).select("community", "x", "y", "notes"), "near")
    found = kernel_sums(near, at, sigma).join(near, ["community", "x", "y"])
    least = F.min("s").over(Window.partitionBy("community"))
    found = found.withColumn("w", F.greatest(F.col("s") - least, F.lit(1e-6)) * F.col("notes"))
    return found.groupBy("community").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("peak_x"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("peak_y"))
