"""Neighbour graph of notes and its metrics; edges are (source, target, weight, mutual) with source < target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.operators.components import components
from tarnlight.operators import vector_search
from tarnlight.shared import written

MUTUAL_FACTOR, LEAST_WEIGHT = 1.15, 0.05


def vector_stats(vectors: DataFrame) -> DataFrame:
    """(n, dim, min_norm, max_norm, mean_norm) of (embedding); other lengths or vectors without length are an error."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    stats = vectors.select(F.size("embedding").alias("dim"), norm.alias("norm")).agg(F.count("*").alias("n"), F.min("dim").alias("dim"), F.max("dim").alias("most"), F.min("norm").alias("min_norm"), F.max("norm").alias("max_norm"), F.avg("norm").alias("mean_norm"))
    good = F.assert_true((F.col("dim") == F.col("most")) & (F.col("min_norm") > 1e-12), F.lit("vectors must have one dimension and a length"))
    return stats.where(good.isNull()).select("n", "dim", "min_norm", "max_norm", "mean_norm")


def knn(vectors: DataFrame, k: int) -> DataFrame:
    """(source, target, sim, rank): the k nearest of each id by cosine, within [0, 1]."""
    found = vector_search.neighbours(vectors, k)
    return found.select(F.col("id").alias("source"), F.col("other").alias("target"), F.least(F.greatest("sim", F.lit(0.0)), F.lit(1.0)).alias("sim"), "rank")


def symmetrized(near: DataFrame) -> DataFrame:
    """Edges of knn(): the greater similarity, raised where both name each other; mutual ones stay, others from LEAST_WEIGHT."""
    both = near.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max("sim").alias("sim"), (F.count("*") > 1).alias("mutual"))
    weight = F.least(F.when(F.col("mutual"), F.col("sim") * MUTUAL_FACTOR).otherwise(F.col("sim")), F.lit(1.0))
    return both.select("source", "target", weight.alias("weight"), "mutual").where(F.col("mutual") | (F.col("weight") >= LEAST_WEIGHT))


def ends(edges: DataFrame) -> DataFrame:
    """(id, other, weight): each edge from both of its ends."""
    sides = F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))
    return edges.select(F.explode(sides).alias("x"), "weight").select("x.id", "x.other", "weight")


def with_communities(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """edges with the communities of their ends, from assigned (id, community)."""
    a, b = assigned.toDF("source", "source_community"), assigned.toDF("target", "target_community")
    return edges.join(a, "source").join(b, "target")


def node_metrics(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """(id, community, degree, internal, external, bridge) of each id of assigned, those without edges too."""
    rows = ends(edges).join(assigned, "id").join(assigned.toDF("other", "other_community"), "other")
    inside = F.col("community") == F.col("other_community")
    sums = rows.groupBy("id").agg(F.count("*").alias("degree"), F.sum(F.when(inside, F.col("weight")).otherwise(0.0)).alias("internal"), F.sum(F.when(inside, 0.0).otherwise(F.col("weight"))).alias("external"))
    full = assigned.join(sums, "id", "left").fillna(0, ["degree"]).fillna(0.0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    return full.withColumn("bridge", F.when(total > 0, F.col("external") / total).otherwise(0.0))


def community_graph(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: total weight between each two communities."""
    rows = with_communities(edges, assigned).where("source_community <> target_community")
    return rows.groupBy(F.least("source_community", "target_community").alias("a"), F.greatest("source_community", "target_community").alias("b")).agg(F.sum("weight").alias("weight"))


def neighbours(between: DataFrame, top: int) -> DataFrame:
    """(community, neighbour, weight, rank): the top neighbours of each community by weight."""
    sides = between.select("a", "b", "weight").union(between.select("b", "a", "weight")).toDF("community", "neighbour", "weight")
    return sides.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weight"), "neighbour"))).where(F.col("rank") <= top)


def community_stats(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """(community, size, internal, external, bridge)."""
    sizes = assigned.groupBy("community").agg(F.count("*").alias("size"))
    rows = with_communities(edges, assigned)
    inside = rows.where("source_community = target_community").groupBy(F.col("source_community").alias("community")).agg(F.sum("weight").alias("internal"))
    between = community_graph(edges, assigned)
    outside = between.select(F.col("a").alias("community"), "weight").union(between.select("b", "weight")).groupBy("community").agg(F.sum("weight").alias("external"))
    full = sizes.join(inside, "community", "left").join(outside, "community", "left").fillna(0.0)
    total = F.col("internal") + F.col("external")
    return full.withColumn("bridge", F.when(total > 0, F.col("external") / total).otherwise(0.0))


def graph_stats(edges: DataFrame, n: int) -> DataFrame:
    """(nodes, edges, mutual_ratio, avg_degree, w_min, w_p25, w_median, w_p75, w_max), quantiles interpolated."""
    quantiles = [F.percentile("weight", p).alias(name) for p, name in ((0.0, "w_min"), (0.25, "w_p25"), (0.5, "w_median"), (0.75, "w_p75"), (1.0, "w_max"))]
    return edges.agg(F.lit(n).cast("long").alias("nodes"), F.count("*").alias("edges"), F.avg(F.col("mutual").cast("int")).alias("mutual_ratio"), (F.count("*") * 2 / F.lit(n)).alias("avg_degree"), *quantiles)


def component_sizes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(component, size), ids without edges as components of one."""
    found = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    labelled = ids.join(found, "id", "left").select(F.coalesce("component", "id").alias("component"))
    return labelled.groupBy("component").agg(F.count("*").alias("size"))


def reindexed(assigned: DataFrame) -> DataFrame:
    """assigned with communities 1, 2, … by size, then by their old number."""
    sizes = assigned.groupBy("community").agg(F.count("*").alias("size"))
    order = sizes.select("community", F.row_number().over(Window.orderBy(F.desc("size"), "community")).alias("number"))
    return assigned.join(F.broadcast(order) if order.count() < 100_000 else order, "community").select("id", F.col("number").alias("community"))


def histogram(metrics: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, notes): bridge values in bins of [0, 1], the last one closed."""
    return metrics.groupBy(F.least(F.floor(F.col("bridge") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("notes"))


def bridge_edges(edges: DataFrame, assigned: DataFrame, top: int = 2400) -> DataFrame:
    """The top heaviest edges between communities, for ids of assigned only."""
    return with_communities(edges, assigned).where("source_community <> target_community").select("source", "target", "weight").orderBy(F.desc("weight"), "source", "target").limit(top)


def every_nth(rows: DataFrame, most: int = 2600) -> DataFrame:
    """A systematic sample: every ceil(n / most)-th row in the order of id. Numbers rows by partition, so that nothing goes through one task."""
    n = rows.count()
    step = max(1, -(-n // most))
    if step == 1:
        return rows
    order = F.asc_nulls_last("id")
    placed = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("p", F.spark_partition_id())
    # written, for a second run of the sort may draw other bounds between partitions, so that places and counts would not fit
    local = written(placed.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy(order))), "placed")
    sizes = local.groupBy("p").agg(F.count("*").alias("c"))
    before = sizes.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))
    return local.join(F.broadcast(before), "p").where((F.col("before") + F.col("n") - 1) % step == 0).select(rows.columns)


def nearest_note(points: DataFrame, at: DataFrame, radius: float) -> DataFrame:
    """(q, id, distance): for each point (q, x, y) of at the nearest note (id, x, y) within radius, by a grid of cells of that size."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.struct((cell("x") + F.lit(i)).alias("cx"), (cell("y") + F.lit(j)).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = at.select("q", F.col("x").alias("qx"), F.col("y").alias("qy"), F.explode(around).alias("c")).select("q", "qx", "qy", "c.cx", "c.cy")
    placed = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2)
    found = asked.join(placed, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius)
    return found.groupBy("q").agg(F.min_by("id", F.struct("distance", "id")).alias("id"), F.min("distance").alias("distance"))
