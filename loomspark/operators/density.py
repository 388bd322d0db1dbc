"""Density clusters over a spanning tree of mutual reachability, found unit by unit.

Two vectors reach each other at the greatest of their distance and both core distances. A spanning tree of the least
such links holds all that single linkage needs. Equal vectors are one node; the others of them hang on it at their core distance. Nodes lie in
units, a twelfth of them each up to ``MOST_UNIT``: each unit finds its own tree, and each pair of units the links between them that
are better than what their trees and the links found so far say. Forests of neighbouring units are then joined, several
at a time, until one is left. Every pair of nodes is looked at (the job is quadratic by nature), in tasks of two units each, tile by
tile; a node goes to as many tasks as there are units. The last tree, three numbers a vector, is cut in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import free_shuffles, materialize, release
from .nearest import Squares, cores, matrix
from .runs import numbered

BLOCK, MOST_UNIT, UNITS = 4096, 65536, 12  # vectors of a unit at least and at most, and units between
#: Units, in each direction, whose forests are joined in one task; and partitions of the pairs of units at most.
FAN, PARTS = 6, 1024
#: Rows and columns of a tile, rows of a first tree, pairs looked up at once, and links that are joined to a tree at once.
HIGH, WIDE, FIRST, LOOKED_UP, AT_ONCE = 512, 2048, 512, 1 << 16, 1 << 20


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows to rows (or to one row), by differences: the same bits wherever a pair is looked at."""
    gap = x - y
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def reach_tree(x: np.ndarray, core: np.ndarray) -> list[tuple]:
    """(reach, from, to) of the spanning tree that grows from row 0, in the order in which rows join it."""
    n = len(x)
    seen, best, link, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        seen[at] = True
        reach = np.maximum(distances(x, x[at]), np.maximum(core, core[at]))
        closer = reach < best
        best[closer], link[closer] = reach[closer], at
        at = int(np.where(seen, np.inf, best).argmin())
        edges.append((float(best[at]), int(link[at]), at))
    return edges


def forest(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links that a least spanning forest keeps; links of equal reach count in the order of their ends."""
    order = np.lexsort((b, a, w))
    ends, near = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    tree, i, j, left = np.arange(len(ends)), near[: len(a)], near[len(a) :], np.arange(len(a))
    kept = []
    while len(left):
        first = np.full(len(ends), len(a))
        for side in (i, j):  # assigned from the last to the first, so the first link of a tree stands
            least = np.full(len(ends), len(a))
            least[side[::-1]] = left[::-1]
            first = np.minimum(first, least)
        roots = np.flatnonzero(first < len(a))
        chosen = first[roots]
        kept.append(np.unique(chosen))
        at = np.searchsorted(left, chosen)
        other = np.where(i[at] == roots, j[at], i[at])
        up = np.arange(len(ends))
        up[roots] = other
        both = (up[up] == np.arange(len(ends))) & (np.arange(len(ends)) < up)  # two trees that chose the same link
        up[both] = np.flatnonzero(both)
        while (up != up[up]).any():
            up = up[up]
        tree = up[tree]
        i, j = up[i], up[j]
        apart = i != j
        i, j, left = i[apart], j[apart], left[apart]
    return order[np.sort(np.concatenate(kept))] if kept else np.zeros(0, int)


def joined(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """The links that :func:`forest` keeps, from ``AT_ONCE`` at a time, so that memory follows the forest and not the links."""
    kept = w[:0], a[:0], b[:0]
    for at in range(0, len(w), AT_ONCE):
        more = [np.concatenate([k, c[at : at + AT_ONCE]]) for k, c in zip(kept, (w, a, b), strict=True)]
        keep = forest(*more)
        kept = tuple(c[keep] for c in more)
    return kept


class Tree:
    """A spanning tree of rows 0 to n - 1 that takes better links and says what the greatest link between two rows is.

    Rows stand in the order in which single linkage puts them side by side; the greatest link between two rows is the
    greatest of the gaps between their places."""

    def __init__(self, n: int, w: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.n, self.links, self.new, self.held = n, (w, a, b), [], 0
        self._order()

    def _order(self) -> None:
        w, a, b = self.links
        n, by = self.n, np.argsort(self.links[0], kind="stable")
        up, size, tail, after = list(range(n)), [1] * n, list(range(n)), [-1] * n
        gap, first = np.zeros(n), 0
        met: list = [0.0] * n
        for x, i, j in zip(w[by].tolist(), a[by].tolist(), b[by].tolist(), strict=True):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            while up[j] != j:
                up[j] = up[up[j]]
                j = up[j]
            if size[i] < size[j]:
                i, j = j, i
            # a root is the first row of its run
            after[tail[i]], met[tail[i]] = j, x
            tail[i], up[j] = tail[j], i
            size[i] += size[j]
            first = i
        place, at, order = 0, first, np.zeros(n, int)
        while at >= 0:
            order[place], gap[place] = at, met[at]
            place, at = place + 1, after[at]
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.table = [gap[: n - 1]]
        while 2 << (len(self.table) - 1) < n:
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.maximum(last[:-step], last[step:]))
        start = np.zeros(len(self.table) + 1, int)
        start[1:] = np.cumsum([len(t) for t in self.table])
        self.start, self.flat = start, np.concatenate(self.table)
        del self.table
        # the larger side always comes first, so the first row is the one that the larger sides lead to
        self.far = np.empty(n)
        self.far[order] = np.concatenate([np.zeros(1), np.maximum.accumulate(gap[: n - 1])])

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j = self.place[i], self.place[j]
        low, high = np.minimum(i, j), np.maximum(i, j)
        level = np.frexp(high - low)[1].astype(np.int64) - 1
        at = self.start[level]
        return np.maximum(self.flat[at + low], self.flat[at + high - (1 << level)])

    def offer(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
        """Keeps links for later, or takes them all in; whether it did."""
        self.new.append((w, a, b))
        self.held += len(w)
        return self.held >= max(2 * self.n, LOOKED_UP) and self.take()

    def take(self) -> bool:
        if self.held:
            self.links = joined(*(np.concatenate([c, *(f[i] for f in self.new)]) for i, c in enumerate(self.links)))
            self.new, self.held = [], 0
            self._order()
        return True


def improve(tree: Tree, x: np.ndarray, core: np.ndarray, cut: int) -> None:
    """Shows a tree all pairs of a row before ``cut`` and one from there on, or all pairs of rows if ``cut`` is 0.

    Products leave out what is above the greatest link between two rows; differences give the reach of the others."""
    rows, cols = (np.arange(cut), np.arange(cut, len(x))) if cut else (np.arange(len(x)),) * 2
    squares = Squares(x[rows], x[cols], np.median(tree.far))
    off, walls = cols[0], squares.wall(tree.far)
    for top in range(0, len(rows), HIGH):
        for left in range(0 if cut else top // WIDE * WIDE, len(cols), WIDE):
            r, c = slice(top, top + HIGH), slice(left, left + WIDE)
            low = squares.low(r, c)
            near = np.flatnonzero(low <= np.maximum(walls[rows[r], None], walls[cols[c]]))
            for k in range(0, len(near), LOOKED_UP):
                i, j = np.divmod(near[k : k + LOOKED_UP], low.shape[1])
                d = low[i, j]
                i, j = i + top, j + left + off
                if not cut:
                    above = i < j
                    i, j, d = i[above], j[above], d[above]
                wall = tree.between(i, j)
                some = (d <= squares.wall(wall)) & (np.maximum(core[i], core[j]) < wall)
                i, j, wall = i[some], j[some], wall[some]
                w = np.maximum(distances(x[i], x[j]), np.maximum(core[i], core[j]))
                better = w < wall
                if tree.offer(w[better], i[better], j[better]):
                    walls = squares.wall(tree.far)
    tree.take()


def unit_tree(x: np.ndarray, core: np.ndarray) -> tuple:
    """(reach, from, to) of a least spanning tree of the rows: trees of a few rows, hung on row 0, then improved."""
    if len(x) < 2:
        return np.zeros(0), np.zeros(0, int), np.zeros(0, int)
    w, a, b = [], [], []
    for at in range(0, len(x), FIRST):
        part = slice(at, at + FIRST)
        edges = reach_tree(x[part], core[part])
        if at:
            edges.append((max(distances(x[at : at + 1], x[0])[0], core[at], core[0]), -at, 0))
        w += [e[0] for e in edges]
        a += [e[1] + at for e in edges]
        b += [e[2] + at for e in edges]
    tree = Tree(len(x), np.array(w), np.array(a), np.array(b))
    if len(x) > FIRST:
        improve(tree, x, core, 0)
    return tree.links


def unit_size(n: int, least: int = BLOCK) -> int:
    """Nodes of a unit: as many as leave ``UNITS`` of them, so that what is shuffled grows with the table."""
    return max(least, min(MOST_UNIT, -(-n // UNITS)))


_LINKS = "w double, a long, b long"


def spanning_links(rows: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(w, a, b): links of (row: 0 to n - 1, v, core) that hold a least spanning tree, a few times ``n`` at most."""
    block = unit_size(n, block)
    units = -(-n // block)
    kind = dict(rows.dtypes)["v"]

    def own(table):
        table = table.sort_by("row")
        row = table["row"].to_numpy()
        w, a, b = unit_tree(matrix(table["v"]), table["core"].to_numpy())
        return pa.table({"w": w, "a": row[a], "b": row[b]})

    unit = F.floor(F.col("row") / block).cast("int")
    homes = rows.select("row", "v", "core", unit.alias("unit"))
    trees = homes.repartition(min(8 * units, PARTS), "unit").groupBy("unit").applyInArrow(own, _LINKS)
    if units == 1:
        return trees
    trees = materialize(trees, "density-own")

    def meet(table):
        # rows are (row, v, core), links of both units' trees (a, b, w) in the same columns
        link = table["b"].is_valid().to_numpy()
        nodes, links = table.filter(pa.array(~link)).sort_by("row"), table.filter(pa.array(link))
        row, x, core = nodes["row"].to_numpy(), matrix(nodes["v"]), nodes["core"].to_numpy()
        cut = int(np.searchsorted(row // block, row[0] // block, side="right"))
        w, a, b = links["core"].to_numpy(), np.searchsorted(row, links["row"].to_numpy()), np.searchsorted(row, links["b"].to_numpy())
        bridge = max(distances(x[:1], x[cut])[0], core[0], core[cut])
        tree = Tree(len(x), np.append(w, bridge), np.append(a, 0), np.append(b, cut))
        improve(tree, x, core, cut)
        w, a, b = tree.links
        over = (a < cut) != (b < cut)  # the units' own links are there already
        return pa.table({"w": w[over], "a": row[a[over]], "b": row[b[over]]})

    both = homes.select("row", "v", "core", F.lit(None).cast("long").alias("b"), "unit").unionAll(
        trees.select(F.col("a").alias("row"), F.lit(None).cast(kind).alias("v"), F.col("w").alias("core"), "b", F.floor(F.col("a") / block).cast("int").alias("unit"))
    )
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(units - 1)), lambda u: u != F.col("unit")))
    guests = both.withColumn("other", other).withColumn("cell", F.least("unit", "other").cast("long") * units + F.greatest("unit", "other")).drop("unit", "other")
    met = guests.repartition(min(4 * units * (units - 1), PARTS), "cell").groupBy("cell").applyInArrow(meet, _LINKS)
    links, span = materialize(met.unionAll(trees), "density-links"), block
    release(trees)

    def join(table):
        w, a, b = joined(*(table[c].to_numpy() for c in ("w", "a", "b")))
        return pa.table({"w": w, "a": a, "b": b})

    while -(-n // span) > FAN:
        span *= FAN
        many = -(-n // span)
        place = lambda c: F.floor(F.col(c) / span)  # noqa: B023, E731
        cell = F.least(place("a"), place("b")) * many + F.greatest(place("a"), place("b"))
        wide = links
        links = materialize(wide.withColumn("cell", cell).repartition(min(4 * many * (many + 1), PARTS), "cell").groupBy("cell").applyInArrow(join, _LINKS), "density-links")
        release(wide)
    return links


def rooted(n: int, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """The links of a spanning tree as arrays (reach, from, to), away from row 0, so that clusters are numbered alike however rows were dealt."""
    ends, link = np.concatenate([a, b]), np.tile(np.arange(len(w)), 2)
    order = np.argsort(ends, kind="stable")
    begin, link = np.searchsorted(ends[order], np.arange(n + 1)), link[order]
    source, seen, front = np.full(len(w), -1), np.zeros(n, bool), np.zeros(1, int)
    seen[0] = True
    while len(front):
        many = begin[front + 1] - begin[front]
        at = np.repeat(begin[front] - np.cumsum(many) + many, many) + np.arange(many.sum())
        k, here = link[at], np.repeat(front, many)
        there = a[k] + b[k] - here
        new = ~seen[there]
        source[k[new]], front = here[new], there[new]
        seen[front] = True
    return w, source, a + b - source


def tree_labels(n: int, reach: np.ndarray, start: np.ndarray, end: np.ndarray, min_size: int) -> np.ndarray:
    """Cluster numbers (-1: outlier) of ``n`` rows from the arrays (reach, a, b) of a spanning tree, by condensed-tree stability."""
    order = np.lexsort((end, start, reach))
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    reaches, left, right = reach[order].tolist(), start[order].tolist(), end[order].tolist()  # of the tree's node n + k; sides are nodes after the loop

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k in range(n - 1):
        left[k], right[k] = a, b = find(left[k]), find(right[k])
        parent[a] = parent[b] = n + k
        size[n + k] = size[a] + size[b]
    del parent

    def leaves(i):
        stack, out = [i], []
        while stack:
            j = stack.pop()
            if j < n:
                out.append(j)
            else:
                stack += (left[j - n], right[j - n])
        return out

    def stretch(i, born):
        """Stability of the cluster that starts at tree node i, the two it splits in, and their birth."""
        gain, j = 0.0, i
        while j >= n:
            w, a, b = reaches[j - n], left[j - n], right[j - n]
            lam = 1.0 / max(w, 1e-12)
            big = [c for c in (a, b) if size[c] >= min_size]
            if len(big) == 2:
                return gain + (lam - born) * size[j], big, lam
            gain += (lam - born) * (size[j] - (size[big[0]] if big else 0))
            if not big:
                break
            j = big[0]
        return gain, [], 0.0

    top, order, own, parts = 2 * n - 2, [], {}, {}
    todo = [(top, 0.0)]
    while todo:
        i, born = todo.pop()
        own[i], parts[i], lam = stretch(i, born)
        order.append(i)
        todo += [(c, lam) for c in parts[i]]
    chosen: dict = {}
    for i in reversed(order):  # parts come before what they are parts of
        below = [chosen.pop(c) for c in parts[i]]
        total = sum(g for g, _ in below)
        chosen[i] = (own[i], [i]) if not below or own[i] >= total and i != top else (total, [c for _, found in below for c in found])

    usual = 4 * np.median(reach) + 1e-12
    out = np.full(n, -1)
    for c, node in enumerate(chosen[top][1]):
        last, j = node, node
        while j >= n and node == top:  # the whole tree as one cluster: shed lone points
            w, a, b = reaches[j - n], left[j - n], right[j - n]
            if min(size[a], size[b]) >= min_size:
                break
            j = a if size[a] >= size[b] else b
            if size[j] < min_size:
                break
            last = j if w > usual else last
        out[leaves(last)] = c
    return out


def density_labels(x: np.ndarray, min_size: int) -> np.ndarray:
    """The same of the rows of an array, in memory."""
    n = len(x)
    if n < max(2, min_size):
        return np.full(n, -1)
    k = min(min_size, n - 1)
    core = np.array([np.partition(distances(x, x[i]), k)[k] for i in range(n)])
    w, a, b = (np.array(c) for c in zip(*reach_tree(x, core), strict=True))
    return tree_labels(n, w, a, b, min_size)


def clustered(vectors: DataFrame, min_size: int, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(row, id, v, cluster_id) in the order of the ids, and how many rows."""
    kind = "array<float>" if dict(vectors.dtypes)["features"] == "array<float>" else "array<double>"
    rows = materialize(numbered(vectors.select("id", F.col("features").cast(kind).alias("v")), ["id", "v"], "row", 0), "density-rows")
    n = rows.count()
    if n < max(2, min_size):
        return rows.withColumn("cluster_id", F.lit(-1).cast("long")), n
    core, parts = cores(rows.select(F.col("row").alias("id"), F.col("v").alias("features")), min(min_size, n - 1))
    known = materialize(rows.select("row", "v").join(core.withColumnRenamed("id", "row"), "row"), "density-core")
    release(*parts)
    nodes = materialize(numbered(known.groupBy("v").agg(F.min("row").alias("first"), F.first("core").alias("core")), ["first"], "row", 0), "density-nodes")
    many = nodes.count()
    free_shuffles(vectors.sparkSession)
    found = spanning_links(nodes.select("row", "v", "core"), many, block)
    links = found
    if many < n:
        number = nodes.select("row", "first")
        for end in ("a", "b"):
            links = links.join(number.withColumnsRenamed({"row": end, "first": f"{end}_row"}), end)
        links = links.select("w", F.col("a_row").alias("a"), F.col("b_row").alias("b"))
        copies = known.join(nodes.select("v", "first"), "v").filter("row <> first").select(F.col("core").alias("w"), F.col("first").alias("a"), F.col("row").alias("b"))
        links = links.unionAll(copies)

    def cut(table):
        w, a, b = joined(*(table[c].to_numpy() for c in ("w", "a", "b")))
        ids = tree_labels(n, *rooted(n, w, a, b), min_size)
        return pa.table({"row": np.arange(n), "cluster_id": ids.astype(np.int64)})

    labels = links.groupBy(F.lit(1).alias("g")).applyInArrow(cut, "row long, cluster_id long")
    out = materialize(rows.join(labels, "row"), "density-labels")
    release(rows, known, nodes, found)
    free_shuffles(vectors.sparkSession)
    return out, n


def density_clusters(vectors: DataFrame, min_size: int = 30, second: int = 15, most: float = 0.05, block: int = BLOCK) -> DataFrame:
    """(id, cluster_id) of (id, features): density clusters, then a second pass over the outliers.

    New clusters among the outliers are numbered after the old ones; those of over ``most`` of all rows stay outliers, and so do
    rows without a vector."""
    there = vectors.filter("features is not null")
    found, n = clustered(there, min_size, block)
    none = vectors.filter("features is null").select("id", F.lit(-1).cast("long").alias("cluster_id"))
    top, lone = found.agg(F.max("cluster_id"), F.count_if(F.col("cluster_id") == -1)).first()
    if not n or lone < second:
        return found.select("id", "cluster_id").unionAll(none)
    sub, _ = clustered(found.filter("cluster_id = -1").select(F.col("row").alias("id"), F.col("v").alias("features")), second, block)
    sizes = sub.filter("cluster_id >= 0").groupBy("cluster_id").count().filter(F.col("count") <= most * n).select(F.col("cluster_id").alias("sub"))
    new = numbered(sizes, ["sub"], "new", top + 1)
    later = sub.join(new, F.col("cluster_id") == F.col("sub")).select(F.col("id").alias("row"), "new")
    return found.join(later, "row", "left").select("id", F.coalesce("new", "cluster_id").alias("cluster_id")).unionAll(none)
