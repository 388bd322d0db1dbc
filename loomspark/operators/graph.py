"""Tag graph: co-occurrence, components, modularity and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, release


def cooccurrence(tagged: DataFrame, item: str = "item", tag: str = "tag") -> DataFrame:
    """(a, b, weight) with a < b: the number of items that hold both. One shuffle on the item for
    the sorted tag array, pairs made inside it, then a group-by that combines map-side."""
    lists = tagged.groupBy(item).agg(F.array_sort(F.collect_set(tag)).alias("t")).filter(F.size("t") > 1)
    at = F.posexplode("t").alias("i", "a")
    left = lists.select("t", at)
    pairs = left.select("a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as rows (node, root).

    Min-label propagation with pointer jumping; rounds grow with the logarithm of the
    longest path. Each round reads tables of the shared folder, every join is between two
    plain scans (AQE splits a hot node) and every group-by combines map-side. Only a count
    of changes reaches the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        least = labels.select("node", "root").union(near).groupBy("node").agg(F.min("root").alias("root"))
        step = materialize(least, "labels")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        jumped = materialize(step.join(up, "root").select("node", F.col("upper").alias("root")), "labels")
        changed = jumped.join(labels.withColumnRenamed("root", "was"), "node").filter("root <> was").limit(1).count()
        release(labels, step)
        labels = jumped
        if not changed:
            release(both)
            return labels


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row (modularity) of a weighted graph and (node, community)."""
    m = F.col("m")
    total = edges.agg(F.sum("weight").cast("double").alias("m"))
    mem = lambda c, name: membership.select(F.col("node").alias(c), F.col("community").alias(name))
    inside = edges.join(mem("a", "ca"), "a").join(mem("b", "cb"), "b").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").cast("double").alias("w"))
    ends = edges.select(F.col("a").alias("node"), "weight").union(edges.select("b", "weight"))
    degree = ends.join(membership, "node").groupBy("community").agg(F.sum("weight").cast("double").alias("k"))
    parts = degree.join(inside, "community", "left").join(F.broadcast(total))  # one row
    return parts.agg(F.sum(F.coalesce("w", F.lit(0.0)) / m - (F.col("k") / (2 * m)) * (F.col("k") / (2 * m))).alias("modularity"))


def _moved(adj: dict, own: dict) -> dict:
    """Node to community after local moving until no move gains; ``own`` is a node's weight inside itself."""
    degree = {n: sum(x.values()) + 2 * own.get(n, 0.0) for n, x in adj.items()}
    total = sum(degree.values()) or 1.0
    com = {n: n for n in adj}
    mass = dict(degree)
    for _ in range(100):
        moved = False
        for n in sorted(adj):
            links: dict = {com[n]: 0.0}
            for v, w in adj[n].items():
                links[com[v]] = links.get(com[v], 0.0) + w
            mass[com[n]] -= degree[n]
            gain = {c: w - mass[c] * degree[n] / total for c, w in links.items()}
            best = min(gain, key=lambda c: (-gain[c], c))
            if gain[best] > gain[com[n]] + 1e-12:
                com[n], moved = best, True
            mass[com[n]] += degree[n]
        if not moved:
            break
    return com


def levels(weights: dict) -> dict:
    """Node to community by local moving on the graph, then on the graph of its communities, and so on."""
    adj: dict = {}
    for (a, b), w in weights.items():
        adj.setdefault(a, {})[b] = adj.setdefault(b, {})[a] = w
    at, own = {n: n for n in adj}, {}
    while True:
        com = _moved(adj, own)
        if len(set(com.values())) == len(adj):
            return at
        at = {n: com[c] for n, c in at.items()}
        up, inside = {c: {} for c in com.values()}, {c: 0.0 for c in com.values()}
        for n, x in adj.items():
            inside[com[n]] += own.get(n, 0.0)
            for v, w in x.items():
                if com[n] == com[v]:
                    inside[com[n]] += w / 2
                else:
                    up[com[n]][com[v]] = up[com[n]].get(com[v], 0.0) + w
        adj, own = up, inside


def communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, community) by modularity on several levels; isolated nodes are their own.

    No community spans components, so each connected component is a task of its own. The tag graph
    is a dimension (a component fits in memory); the corpus behind it is not."""

    def move(pdf):
        import pandas as pd

        com = levels({(a, b): float(w) for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"], strict=True)})
        return pd.DataFrame({"node": list(com), "com": list(com.values())})

    parts = components(edges).select(F.col("node").alias("a"), "root")
    found = edges.join(parts, "a").groupBy("root").applyInPandas(move, "node string, com string")
    found = materialize(found, "communities")
    named = nodes.select(F.col("node").cast("string").alias("node")).distinct().join(found, "node", "left")
    first = found.groupBy("com").agg(F.min("node").alias("name"))
    return named.join(first, "com", "left").select("node", F.coalesce("name", "node").alias("community"))


def community_counts(membership: DataFrame) -> DataFrame:
    """One row (n_tags, n_communities)."""
    return membership.agg(F.count(F.lit(1)).alias("n_tags"), F.countDistinct("community").alias("n_communities"))
