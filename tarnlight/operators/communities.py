"""Communities of a weighted graph: Louvain moves with a resolution, run by parts, then merged and numbered."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.operators.components import components
from tarnlight.operators.graph import reindexed

RESOLUTION, LEAST_SIZE, SEED = 0.8, 12, 42


def louvain(n: int, source: np.ndarray, target: np.ndarray, weight: np.ndarray, resolution: float, seed: int) -> np.ndarray:
    """Community of each node: local moves by the gain in modularity of Reichardt and Bornholdt, then the same on the graph of communities, until none moves."""
    rng = np.random.default_rng(seed)
    label = np.arange(n)
    while True:
        links: list[dict[int, float]] = [{} for _ in range(n)]
        loops = np.zeros(n)
        for a, b, w in zip(source.tolist(), target.tolist(), weight.tolist()):
            if a == b:
                loops[a] += 2 * w
            else:
                links[a][b] = links[a].get(b, 0.0) + w
                links[b][a] = links[b].get(a, 0.0) + w
        strength = np.array([sum(x.values()) for x in links]) + loops
        total = strength.sum()
        if total <= 0:
            return label
        # plain lists: an element of an array is far slower to read
        around, total = [(list(x), list(x.values())) for x in links], float(total)
        own, mass, strengths = list(range(n)), strength.tolist(), strength.tolist()
        moved = False
        for _ in range(100):
            changes = 0
            for v in rng.permutation(n).tolist():
                at, s = own[v], strengths[v]
                mass[at] -= s
                to: dict[int, float] = {}
                for u, w in zip(*around[v]):
                    c = own[u]
                    to[c] = to[c] + w if c in to else w
                share = resolution * s
                best, most = at, to.get(at, 0.0) - share * mass[at] / total
                for c in sorted(to):
                    g = to[c] - share * mass[c] / total
                    if g > most + 1e-12:
                        best, most = c, g
                own[v] = best
                mass[best] += s
                changes += best != at
            moved |= changes > 0
            if not changes:
                break
        if not moved:
            return label
        names, compact = np.unique(np.array(own), return_inverse=True)
        label = compact[label]
        source, target, n = compact[source], compact[target], len(names)


def merged_small(label: dict, edges: list[tuple], least: int) -> dict:
    """Communities of fewer than least members joined to the one they have most weight with, or to the largest if to none.

    edges: (community, community, weight) totals. Sizes are those at the start
    of a pass; passes go on while there is a small one and more than one.
    """
    sizes = dict(label)
    to = {c: c for c in sizes}
    between: dict = {c: {} for c in sizes}
    for a, b, w in edges:
        if a != b:
            between[a][b] = between[a].get(b, 0.0) + w
            between[b][a] = between[b].get(a, 0.0) + w
    largest = [(-n, c) for c, n in sizes.items()]  # a heap; entries of sizes that changed are dropped when they come up
    heapq.heapify(largest)

    def other(c: int) -> int:
        """The largest community but c, the first of equal ones."""
        kept = []
        while True:
            n, o = largest[0]
            if sizes.get(o) != -n:
                heapq.heappop(largest)
            elif o == c:
                kept.append(heapq.heappop(largest))
            else:
                for x in kept:
                    heapq.heappush(largest, x)
                return o

    while True:
        small = [c for c, n in sorted(sizes.items()) if n < least] if len(sizes) > 1 else []
        if not small:
            break
        for c in small:
            if c not in sizes or len(sizes) == 1:
                continue
            own = between.pop(c)
            goal = max(own, key=lambda o: (own[o], -o)) if own else other(c)
            for o, w in own.items():
                between[o].pop(c, None)
                if o != goal:
                    between[o][goal] = between[o].get(goal, 0.0) + w
                    between[goal][o] = between[goal].get(o, 0.0) + w
            sizes[goal] += sizes.pop(c)
            heapq.heappush(largest, (-sizes[goal], goal))
            to[c] = goal

    def last(c: int) -> int:
        path = []
        while to[c] != c:
            path.append(c)
            c = to[c]
        to.update(dict.fromkeys(path, c))
        return c

    return {c: last(c) for c in list(to)}


def communities(edges: DataFrame, ids: DataFrame, resolution: float = RESOLUTION, least: int = LEAST_SIZE, seed: int = SEED) -> DataFrame:
    """(id, community), numbered from 1 by size.

    Each connected component is one task's work, in the order of its ids, so
    the result does not depend on the partitioning. Small communities are
    merged on the driver from the totals between communities, whose number is
    that of the communities and not of the notes. Ids without edges are
    communities of one before that.
    """
    found = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    placed = edges.join(found, edges.source == found.id).select("component", "source", "target", "weight")
    kind = dict(ids.dtypes)["id"]

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "target"])
        names, flat = np.unique(np.r_[pdf["source"], pdf["target"]], return_inverse=True)
        n = len(pdf)
        label = louvain(len(names), flat[:n], flat[n:], pdf["weight"].to_numpy(float), resolution, seed)
        least_of = pd.Series(names).groupby(label).transform("min")
        return pd.DataFrame({"id": names, "community": least_of.to_numpy()})

    inside = placed.groupBy("component").applyInPandas(part, f"id {kind}, community {kind}")
    raw = ids.join(inside, "id", "left").select("id", F.coalesce("community", "id").alias("community")).persist()
    sizes = {r[0]: r[1] for r in raw.groupBy("community").count().collect()}
    a, b = raw.toDF("source", "ca"), raw.toDF("target", "cb")
    totals = edges.join(a, "source").join(b, "target").where("ca <> cb").groupBy("ca", "cb").agg(F.sum("weight")).orderBy("ca", "cb").collect()
    to = merged_small(sizes, [tuple(r) for r in totals], least)
    moves = ids.sparkSession.createDataFrame(list(to.items()), f"community {kind}, goal {kind}")
    return reindexed(raw.join(moves, "community").select("id", F.col("goal").alias("community")))
