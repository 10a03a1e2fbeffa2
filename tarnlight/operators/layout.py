"""Two-dimensional layout of notes: principal components, community centres, placement around them."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT, MARGIN, PADDING = 3200, 2200, 140, 420
LEAST_WIDTH, LEAST_HEIGHT = 1200, 900


def pca(vectors: DataFrame) -> DataFrame:
    """(id, x, y): the first two principal components of (id, embedding), the largest loading of each positive.

    Sums of outer products are made by partition in one pass, so the driver
    gets one matrix of dim x dim from each task, whatever the rows.
    """
    rows = vectors.select("embedding")

    def sums(batches):
        n, s, p = 0, None, None
        for pdf in batches:
            m = np.array(pdf["embedding"].tolist(), np.float64)
            if len(m):
                n, s, p = n + len(m), m.sum(axis=0) + (0 if s is None else s), m.T @ m + (0 if p is None else p)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "p": [p.tobytes()]})

    parts = rows.mapInPandas(sums, "n long, s binary, p binary").collect()
    if not parts:
        return vectors.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    n = sum(r["n"] for r in parts)
    s = sum(np.frombuffer(r["s"]) for r in parts)
    p = sum(np.frombuffer(r["p"]).reshape(len(s), len(s)) for r in parts)
    mean = s / n
    _, axes = np.linalg.eigh(p / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :2].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    if len(axes) == 1:
        axes = np.vstack([axes, np.zeros_like(axes)])
    project = lambda axis: F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, axis.tolist())), lambda x, w: x * w), F.lit(-float(mean @ axis)), lambda t, x: t + x)
    return vectors.select("id", project(axes[0]).alias("x"), project(axes[1]).alias("y"))


def fitted(points: DataFrame, x: tuple[float, float] = (-1.0, 1.0), y: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """points (id, x, y) with each axis stretched to a range; the middle of it where all values are equal."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))

    def axis(c: str, low: float, high: float) -> Column:
        span = F.col(f"{c}1") - F.col(f"{c}0")
        return F.when(span < 1e-12, (low + high) / 2).otherwise(low + (F.col(c) - F.col(f"{c}0")) / span * (high - low))

    return points.crossJoin(F.broadcast(box)).select("id", axis("x", *x).alias("x"), axis("y", *y).alias("y"))


def stable_noise(seed: Column | int, index: Column) -> Column:
    """A number in [0, 1] from the hash of 'seed:index'."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), index.cast("string")), 256), 1, 12), 16, 10).cast("double") / float(0xFFFFFFFFFFFF)


def noise(seed: int, index: int) -> float:
    return int(hashlib.sha256(f"{seed}:{index}".encode()).hexdigest()[:12], 16) / float(0xFFFFFFFFFFFF)


def spring(n: int, links: list[tuple[int, int, float]], seed: int, rounds: int = 900) -> np.ndarray:
    """Fruchterman and Reingold's layout of n communities from a circle, with a temperature that falls evenly."""
    turn = 2 * math.pi * (np.arange(n) / max(n, 1) + noise(seed, n))
    at = np.c_[np.cos(turn), np.sin(turn)]
    if n < 2 or not links:
        return at
    a, b, w = (np.array(x) for x in zip(*links))
    hot = math.sqrt(n) / 10
    for r in range(rounds):
        gap = at[:, None] - at[None, :]
        d2 = (gap**2).sum(axis=2) + np.eye(n)
        force = (gap / d2[..., None]).sum(axis=1)
        pull = (at[a] - at[b]) * (w * np.sqrt(((at[a] - at[b]) ** 2).sum(axis=1)))[:, None]
        np.add.at(force, a, -pull)
        np.add.at(force, b, pull)
        size = np.sqrt((force**2).sum(axis=1, keepdims=True)) + 1e-12
        at = at + force / size * np.minimum(size, hot * (1 - r / rounds))
    return at


def centres(between: DataFrame, sizes: DataFrame, seed: int = 42, separation: float = 1.15) -> DataFrame:
    """(community, size, x, y, neighbour_weight) from the community graph (a, b, weight) and sizes (community, size). Communities are few; they are laid out on the driver."""
    names = [(r[0], r[1]) for r in sizes.select("community", "size").orderBy("community").collect()]
    index = {c: i for i, (c, _) in enumerate(names)}
    links = [(index[r[0]], index[r[1]], float(r[2])) for r in between.select("a", "b", "weight").orderBy("a", "b").collect()]
    at = spring(len(names), links, seed)
    middle = np.array([WIDTH / 2, HEIGHT / 2])
    if len(names) > 1:
        low, span = at.min(axis=0), at.max(axis=0) - at.min(axis=0)
        room = np.array([WIDTH - 2 * MARGIN, HEIGHT - 2 * MARGIN])
        at = np.where(span < 1e-12, middle, MARGIN + (at - low) / np.where(span < 1e-12, 1, span) * room)
        at = middle + (at - middle) * separation
    else:
        at = np.tile(middle, (len(names), 1))
    near = np.zeros(len(names))
    for a, b, w in links:
        near[a] += w
        near[b] += w
    rows = [(c, n, float(x), float(y), float(w)) for (c, n), (x, y), w in zip(names, at, near)]
    kind = dict(sizes.dtypes)["community"]
    return sizes.sparkSession.createDataFrame(rows, f"community {kind}, size long, x double, y double, neighbour_weight double")


def neighbour_centres(between: DataFrame, where: DataFrame) -> DataFrame:
    """(community, bx, by): the mean of the neighbours' centres by weight."""
    sides = between.select(F.col("a").alias("community"), F.col("b").alias("other"), "weight").union(between.select("b", "a", "weight"))
    joined = sides.join(where.select(F.col("community").alias("other"), "x", "y"), "other")
    return joined.groupBy("community").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("bx"), (F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("by"))


def mountains(semantic: DataFrame, metrics: DataFrame, where: DataFrame, between: DataFrame, seed: int = 42, core_packing: float = 0.72, shape: float = 0.82, foothill: float = 1.18, bridge_blend: float = 0.65) -> DataFrame:
    """(id, community, x, y, density_weight): notes around the centre of their community, those of most inner weight next to it.

    semantic (id, x, y) gives the direction; metrics and the community graph say
    how far out a note lies and how much it is drawn to the neighbours.
    """
    own, order = Window.partitionBy("community"), Window.partitionBy("community").orderBy(F.desc("internal"), "bridge", "id")
    rows = metrics.join(semantic.toDF("id", "sx", "sy"), "id").withColumns(
        {"most": F.max("internal").over(own), "n": F.count("*").over(own), "mx": F.avg("sx").over(own), "my": F.avg("sy").over(own), "place": F.row_number().over(order)}
    )
    rows = rows.join(where.select("community", F.col("x").alias("cx"), F.col("y").alias("cy")), "community").join(neighbour_centres(between, where), "community", "left")
    dx, dy = F.col("sx") - F.col("mx"), F.col("sy") - F.col("my")
    jitter = stable_noise(seed, F.col("id"))
    angle = F.when(F.hypot(dx, dy) > 1e-9, F.atan2(dy, dx)).otherwise(jitter * 2 * math.pi)
    core = F.col("internal") / F.greatest("most", F.lit(1e-9))
    out = (42 + 18 * F.sqrt("n")) * (0.16 + (1 - core) * core_packing + F.col("place") / F.col("n") * 0.42) * (1 + (jitter - 0.5) * 0.32 * shape)
    out = F.when(F.col("degree") <= 1, out * foothill).otherwise(out)
    blend = F.when((F.col("bridge") > 0.18) & F.col("bx").isNotNull(), F.least(F.lit(bridge_blend), F.col("bridge"))).otherwise(0.0)
    x = F.col("cx") + F.cos(angle) * out
    y = F.col("cy") + F.sin(angle) * out * (0.76 + 0.3 * stable_noise(seed + 17, F.col("id")))
    drawn = lambda v, b: v * (1 - blend) + F.coalesce(F.col(b), F.lit(0.0)) * blend
    density = F.greatest(F.lit(0.35), 0.72 + core * 1.2 + F.log1p("degree") * 0.08 - F.col("bridge") * 0.55)
    return rows.select("id", "community", drawn(x, "bx").alias("x"), drawn(y, "by").alias("y"), density.alias("density_weight"))


def frame(points: DataFrame, where: DataFrame, padding: float = PADDING) -> DataFrame:
    """(shift_x, shift_y, width, height, min_x, min_y, max_x, max_y) that bring points and centres into a page."""
    box = points.select("x", "y").union(where.select("x", "y")).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    side = lambda c, least: F.greatest(F.ceil(F.col(f"max_{c}") - F.col(f"min_{c}") + 2 * padding).cast("int"), F.lit(least))
    return box.select((padding - F.col("min_x")).alias("shift_x"), (padding - F.col("min_y")).alias("shift_y"), side("x", LEAST_WIDTH).alias("width"), side("y", LEAST_HEIGHT).alias("height"), "min_x", "min_y", "max_x", "max_y")


def shifted(points: DataFrame, page: DataFrame) -> DataFrame:
    moved = points.crossJoin(F.broadcast(page.select("shift_x", "shift_y")))
    return moved.select(*[(F.col(c) + F.col(f"shift_{c}")).alias(c) if c in ("x", "y") else F.col(c) for c in points.columns])
