"""Builds a map of a corpus: graph, communities, layout, terrain, profiles, labels, JSON."""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.text import map_snippet, note_url, path_id
from tarnlight.operators import communities, graph, layout, profiles, terrain
from tarnlight.shared import written

__all__ = ["Map", "MapOptions", "build", "debug", "payload", "replace", "read_map", "write_json"]
STAGES = tuple("graph communities layout terrain labels all".split())


@dataclass(frozen=True)
class MapOptions:
    stage: str = "all"
    seed: int = 42
    knn_k: int = 50
    least_size: int = 12
    resolution: float = 0.8
    separation: float = 1.15
    foothill: float = 1.18
    core_packing: float = 0.72
    bridge_blend: float = 0.65
    shape: float = 0.82
    levels: int = 22
    sigma: float = 34.0
    cell: int = 10
    highest: float = 0.88
    lowest: float = 0.035

    @classmethod
    def of(cls, settings: dict) -> MapOptions:
        """Options from the map settings of a configuration, with floors for those that need one."""
        v2 = settings.get("v2") or {}
        given = {}
        for name, (section, key, least) in SETTINGS.items():
            value = ((v2.get(section) or {}) if section else v2).get(key)
            if value is not None:
                kind = type(getattr(cls, name))
                given[name] = kind(value) if least is None else max(kind(least), kind(value))
        return cls(**given)


#: Option -> section of the settings, key, floor.
SETTINGS = {
    "seed": ("", "randomState", None), "knn_k": ("", "knnK", 1), "least_size": ("", "minCommunitySize", 1), "resolution": ("", "communityResolution", None),
    "separation": ("cartography", "mountainSeparation", None), "foothill": ("cartography", "foothillSpread", None), "core_packing": ("cartography", "corePacking", None), "bridge_blend": ("cartography", "bridgeBlend", None), "shape": ("cartography", "mountainShapeStrength", None),
    "levels": ("terrain", "levels", 3), "sigma": ("terrain", "sigma", 1), "cell": ("terrain", "cellSize", 2), "highest": ("terrain", "highestRatio", None), "lowest": ("terrain", "lowestRatio", None),
}


@dataclass
class Map:
    """The tables of a map, all with lazy plans but for those that were written on the way."""

    notes: DataFrame
    edges: DataFrame
    assigned: DataFrame
    metrics: DataFrame
    semantic: DataFrame
    points: DataFrame
    centres: DataFrame
    page: DataFrame
    cells: DataFrame
    peaks: DataFrame
    profiles: DataFrame
    peak_profiles: DataFrame
    stats: DataFrame
    options: MapOptions


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks that have a vector, with id 0, 1, … in the order of (lookup, path, chunk), title and url."""
    rows = chunks.where("embedding is not null")
    order = Window.partitionBy("p").orderBy("lookup", "path", "chunk")
    placed = rows.repartitionByRange("lookup", "path", "chunk").sortWithinPartitions("lookup", "path", "chunk").withColumn("p", F.spark_partition_id())
    local = written(placed.withColumn("n", F.row_number().over(order)), "map-rows")
    sizes = local.groupBy("p").agg(F.count("*").alias("c"))
    before = sizes.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))
    named = local.join(F.broadcast(before), "p").withColumn("id", F.col("before") + F.col("n") - 1)
    return named.select("id", "lookup", "path", "chunk", "hash", "text", "embedding", path_id(F.col("path")).alias("title"), note_url(F.col("path"), F.lit(None).cast("string"), True).alias("url"))


def build(chunks: DataFrame, options: MapOptions = MapOptions()) -> Map:
    """All tables of a map. An error if there is no chunk with a vector."""
    o = options
    if o.stage not in STAGES:
        raise ValueError(f"stage must be one of {', '.join(STAGES)}")
    notes = written(numbered(chunks), "map-notes")
    n = notes.count()
    if not n:
        raise ValueError("no notes with vectors")
    vectors = notes.select("id", "embedding")
    stats = graph.vector_stats(vectors)
    edges = written(graph.symmetrized(graph.knn(vectors, max(1, min(o.knn_k, n - 1)))), "map-edges")
    assigned = written(communities.communities(edges, notes.select("id"), o.resolution, o.least_size, o.seed), "map-communities")
    metrics = written(graph.node_metrics(edges, assigned), "map-metrics")
    semantic = written(layout.fitted(layout.pca(vectors)), "map-semantic")
    between = graph.community_graph(edges, assigned)
    sizes = assigned.groupBy("community").agg(F.count("*").alias("size"))
    centres = layout.centres(between, sizes, o.seed, o.separation)
    raw = written(layout.mountains(semantic, metrics, centres, between, o.seed, o.core_packing, o.shape, o.foothill, o.bridge_blend), "map-points")
    page = layout.frame(raw, centres)
    points = layout.shifted(raw, page)
    peaks = written(terrain.peaks(points, o.cell, o.sigma), "map-peaks")
    return Map(
        notes, edges, assigned, metrics, semantic, points, layout.shifted(centres, page), page, terrain.grid(points, o.cell, o.sigma), peaks,
        profiles.community_profiles(notes, metrics, edges), profiles.peak_profiles(notes, metrics, points, peaks), stats, o,
    )


def note_rows(m: Map) -> DataFrame:
    """The notes of the payload, a row each."""
    r = lambda c, d: F.round(c, d).alias(c)
    rows = m.notes.join(m.metrics, "id").join(m.semantic.toDF("id", "sx", "sy"), "id").join(m.points.select("id", "x", "y", "density_weight"), "id")
    name = F.concat(F.col("lookup"), F.lit("::"), F.col("path"), F.lit("#"), F.col("chunk").cast("string"))
    return rows.select(
        name.alias("name"), F.col("id").alias("index"), "lookup", "path", "chunk", "hash", "title", "url", map_snippet(F.col("text")).alias("snippet"), F.col("community").alias("communityId"), F.concat(F.lit("mountain-"), F.col("community").cast("string")).alias("clusterId"),
        F.round("sx", 6).alias("semanticX"), F.round("sy", 6).alias("semanticY"), r("x", 2), r("y", 2), "degree", F.round("internal", 4).alias("internalWeight"), F.round("external", 4).alias("externalWeight"), F.round("bridge", 4).alias("bridgeScore"), F.round("density_weight", 4).alias("densityWeight"),
    )


def edge_rows(m: Map) -> DataFrame:
    both = graph.with_communities(m.edges, m.assigned)
    same = F.col("source_community") == F.col("target_community")
    return both.select(F.col("source").alias("sourceIndex"), F.col("target").alias("targetIndex"), F.round("weight", 4).alias("weight"), same.alias("sameCommunity"), (~same).alias("bridge"), "mutual")


def cluster_rows(m: Map) -> DataFrame:
    """(community, size, x, y, peak_x, peak_y, spread_x, spread_y): a row for each cluster."""
    spread = m.points.groupBy("community").agg(F.round(F.stddev_pop("x") + 36, 2).alias("spread_x"), F.round(F.stddev_pop("y") + 36, 2).alias("spread_y"))
    top = m.peaks.where("rank = 1").select("community", F.round("x", 2).alias("peak_x"), F.round("y", 2).alias("peak_y"))
    return m.centres.select("community", "size", F.round("x", 2).alias("x"), F.round("y", 2).alias("y")).join(spread, "community").join(top, "community")


def warnings(mutual_ratio: float, n_components: int, sizes: list[int], bridges: list[int], levels: int | None) -> list[str]:
    """What looks wrong with a map; bridges is the histogram of bridge values above 0.45 and all: (over, total)."""
    out = []
    if mutual_ratio < 0.25:
        out.append("few mutual edges")
    if n_components > 5:
        out.append("many components")
    if sizes and max(sizes) / sum(sizes) > 0.65:
        out.append("one dominant community")
    allowed = max(len(sizes) // 3, 4)
    if sum(s < 12 for s in sizes) > allowed:
        out.append("many small communities")
    if bridges[1] and bridges[0] / bridges[1] > 0.3:
        out.append("many bridge notes")
    if levels is not None and levels < 4:
        out.append("few contour levels")
    return out


def told(label: dict, default: str) -> dict:
    """A label as the payload has it; a map without labels has the default and nothing else."""
    full = {"label": default, "subtitle": "", "chips": [], "source": "fallback"} | label
    return {"primaryLabel": full["label"], "subtitle": full["subtitle"], "keywordChips": full["chips"], "labelSource": full["source"]}


def payload(m: Map, chat_fn: Callable | None = None, cache: Path | None = None) -> dict:
    """The map as one JSON object, for a page that shows all of it: it is gathered on the driver."""
    o = m.options
    dicts = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    page, stats = dicts(m.page)[0], dicts(m.stats)[0]
    rows = sorted(dicts(m.profiles), key=lambda p: p["community"])
    spots = sorted(dicts(m.peak_profiles), key=lambda p: (p["community"], p["rank"]))
    named = o.stage in ("all", "labels")
    labels = profiles.assigned_labels(rows, chat_fn, cache) if named else [{} for _ in rows]
    spot_labels = profiles.assigned_labels(spots, chat_fn, cache) if named else [{} for _ in spots]
    shapes = {c["community"]: c for c in dicts(cluster_rows(m))}
    heights = {(p["community"], p["rank"]): p["density"] for p in dicts(m.peaks)}
    clusters = []
    for p, label in zip(rows, labels):
        c = shapes[p["community"]]
        anchors = [
            {"x": round(s["x"], 2), "y": round(s["y"], 2), "rank": s["rank"], "density": round(heights[s["community"], s["rank"]], 4), **told(got, "")}
            for s, got in zip(spots, spot_labels)
            if s["community"] == p["community"]
        ]
        name = f"mountain-{p['community']}"
        clusters.append(
            {
                "id": name, "communityId": p["community"], "label": label.get("label", name), **told(label, name),
                "centerX": c["x"], "centerY": c["y"], "peakX": c["peak_x"], "peakY": c["peak_y"], "labelAnchors": anchors, "spreadX": c["spread_x"], "spreadY": c["spread_y"], "noteCount": p["size"],
                "neighbors": [{"clusterId": f"mountain-{x['neighbour']}", "weight": x["weight"]} for x in p["neighbours"] or []], "sourceBreakdown": p["sources"],
            }
        )
    found = dicts(note_rows(m).orderBy("index"))
    for r in found:
        r["id"] = r.pop("name")
    out = {
        "generatedAt": dt.datetime.now(dt.UTC).isoformat(timespec="seconds").replace("+00:00", "Z"), "generator": "tarnlight", "noteCount": len(found), "vectorDim": stats["dim"], "width": page["width"], "height": page["height"],
        "layout": {"method": "semantic_cartography", "semanticMethod": "pca", "communityMethod": "louvain_rb", "knnK": o.knn_k, "communityResolution": o.resolution, "minCommunitySize": o.least_size, "randomState": o.seed, "stage": o.stage, "mapExtent": page},
        "clusters": clusters, "notes": found, "edges": dicts(edge_rows(m).orderBy("sourceIndex", "targetIndex")),
    }
    if o.stage in ("all", "terrain", "labels"):
        segments: dict[int, list] = {}
        for s in dicts(terrain.contours(m.cells, o.levels, o.lowest, o.highest, o.cell)):
            segments.setdefault(s["level"], []).append([s["x1"], s["y1"], s["x2"], s["y2"]])
        top = m.cells.agg(F.max("density")).first()[0] or 0.0
        out["terrain"] = {"cellSize": o.cell, "sigma": o.sigma, "maxDensity": top, "levels": [{"ratio": r, "level": top * r, "major": k % 4 == 0 or k == o.levels - 1, "segments": sorted(segments.get(k, []))} for k, r in enumerate(terrain.ratios(o.levels, o.lowest, o.highest))]}
    return out


def debug(m: Map) -> dict:
    """Figures that say how good a map is, and warnings."""
    stats = graph.graph_stats(m.edges, m.notes.count()).first().asDict()
    sizes = sorted((r["size"] for r in m.assigned.groupBy("community").agg(F.count("*").alias("size")).collect()), reverse=True)
    parts = sorted((r["size"] for r in graph.component_sizes(m.edges, m.notes.select("id")).collect()), reverse=True)
    over, total = m.metrics.agg(F.count_if(F.col("bridge") > 0.45), F.count("*")).first()
    counts = {r["bin"]: r["notes"] for r in graph.histogram(m.metrics).collect()}
    levels = m.options.levels if m.options.stage in ("all", "terrain", "labels") else None
    return {"embedding": m.stats.first().asDict(), "graph": stats, "components": parts, "communities": sizes, "bridgeHistogram": [counts.get(k, 0) for k in range(10)], "warnings": warnings(stats["mutual_ratio"] or 0.0, len(parts), sizes, [over, total], levels)}


def write_json(data: dict, path: Path) -> None:
    """Writes a file whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(f".{path.name}.tmp")
    with tmp.open("w", encoding="utf-8") as f:
        print(json.dumps(data, indent=2, ensure_ascii=False), file=f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def read_map(path: Path) -> dict:
    with path.open(encoding="utf-8") as f:
        return json.load(f)
