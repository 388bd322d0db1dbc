"""Approximate nearest neighbours by balanced posting lists (operator 13).

Vectors are lifted by one component to a sphere, where the largest inner product is the least
distance. Balanced bisection of a bounded sample gives centroids, linked to their nearest ones in
a graph that each task holds in memory. Searching the graph gives each vector its lists: the
nearest centroid's, and on a boundary those of further ones nearly as near. A query scans the
lists whose centroids are within a ratio of the nearest one's distance; the ratio is calibrated
against brute force on ``CALIBRATED`` queries over the whole table. Equal vectors are indexed and
searched once. Long lists and many queries of one list are split over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, table

SAMPLE = 131_072  # rows that the centroids are fitted on, about
MOST_LISTS = 16_384  # so centroids and graph have a bound: 64 components take 4 MB
DEGREE = 24
BEAM = 16
CLOSE = 1.15  # a list this much further than the nearest one gets a copy of the vector
COPIES = 6
CALIBRATED = 128
AIM = 0.97
PART, QUERIES = 4096, 1024  # vectors and queries of one task of a list


def bisect(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Centroids of ``k`` groups of nearly equal size: rows are split by balanced two-means, again and again."""
    out, todo = [], [(np.arange(len(x)), k)]
    while todo:
        rows, k = todo.pop()
        mine = x[rows]
        if k <= 1 or len(rows) < 2:
            out.append(mine.mean(axis=0))
            continue
        left, cut = k // 2, len(rows) * (k // 2) // k
        a, b = mine[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            order = np.argsort(mine @ (b - a), kind="stable")
            a, b = mine[order[: max(cut, 1)]].mean(axis=0), mine[order[max(cut, 1) :]].mean(axis=0)
        todo += [(rows[order[: max(cut, 1)]], left), (rows[order[max(cut, 1) :]], k - left)]
    return np.array(out)


class Graph:
    """Centroids, each linked to its nearest ones, searched best first for many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.norm = (centroids**2).sum(axis=1)
        n = len(centroids)
        near = np.empty((n, min(DEGREE, n - 1)), np.int32)
        for at in range(0, n, 1024):
            d = self.norm - 2 * centroids[at : at + 1024] @ centroids.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 1024] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
        # links both ways, so that no centroid is out of reach of those it is linked to
        a = np.r_[np.repeat(np.arange(n), near.shape[1]), near.ravel()]
        b = np.r_[near.ravel(), np.repeat(np.arange(n), near.shape[1])]
        key = np.unique(a * np.int64(n) + b)
        self.to, self.off = (key % n).astype(np.int32), np.searchsorted(key // n, np.arange(n + 1))
        self.entry = np.linspace(0, n - 1, min(n, 64)).astype(int)  # bisection leaves stand in tree order: spread out

    def search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances of each row of ``x`` to the centroids met, inf elsewhere: from the entries the search
        goes on from every centroid that is among the ``BEAM`` nearest so far or within ``ratio`` of the nearest."""
        n = len(self.c)
        size = (x**2).sum(axis=1)
        far = np.full((len(x), n), np.inf)
        far[:, self.entry] = np.sqrt(np.maximum(size[:, None] + self.norm[self.entry] - 2 * x @ self.c[self.entry].T, 0))
        done = np.zeros((len(x), n), bool)
        live = np.arange(len(x))
        while len(live):
            d = far[live]
            bound = np.maximum(np.partition(d, min(BEAM, n) - 1, axis=1)[:, min(BEAM, n) - 1], d.min(axis=1) * ratio)
            row, node = np.nonzero((d <= bound[:, None]) & np.isfinite(d) & ~done[live])
            row = live[row]
            done[row, node] = True
            live = np.unique(row)
            many = self.off[node + 1] - self.off[node]
            to = self.to[np.arange(many.sum()) + np.repeat(self.off[node] - (np.cumsum(many) - many), many)]
            new = np.unique(np.repeat(row, many) * np.int64(n) + to)
            row, to = new // n, new % n
            unmet = ~np.isfinite(far[row, to])
            row, to = row[unmet], to[unmet]
            for at in range(0, len(row), 1 << 16):
                r, t = row[at : at + (1 << 16)], to[at : at + (1 << 16)]
                far[r, t] = np.sqrt(np.maximum(size[r] + self.norm[t] - 2 * np.einsum("ij,ij->i", x[r], self.c[t]), 0))
        return far


class Index:
    """Centroids of lifted vectors, and the lists of vectors and queries."""

    def __init__(self, sample: np.ndarray, lists: int, longest: float, seed: int = 13):
        self.longest = longest
        self.graph = Graph(bisect(self.lifted(sample), lists, np.random.default_rng(seed)))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.longest**2 - (x**2).sum(axis=1), 0))]

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, nearest) of vectors: lists nearly as near as the nearest one, but none that is nearer to a
        list taken before than to the vector."""
        x = self.lifted(x)
        far = self.graph.search(x, 1.0)
        order = np.argsort(far, axis=1, kind="stable")[:, : 4 * COPIES]
        d = np.take_along_axis(far, order, axis=1)
        took = np.zeros(order.shape, bool)
        took[:, 0] = True
        c = self.graph.c
        for j in range(1, order.shape[1]):
            fine = (d[:, j] <= CLOSE * d[:, 0]) & (took.sum(axis=1) < COPIES)
            for i in range(j):
                gap = ((c[order[:, j]] - c[order[:, i]]) ** 2).sum(axis=1)
                fine &= ~took[:, i] | (gap > d[:, j] ** 2)
            took[:, j] = fine
        row, at = np.nonzero(took)
        return row, order[row, at], at == 0

    def toward(self, q: np.ndarray) -> np.ndarray:
        """Queries at the length of the longest vector, which leaves their order of vectors as it is."""
        return np.c_[q * (self.longest / np.sqrt((q**2).sum(axis=1)))[:, None], np.zeros(len(q))]

    def probes(self, q: np.ndarray, ratio: float, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of queries: lists within ``ratio`` of the nearest one, and more, by distance, until
        they hold ``k`` vectors. ``held``: vectors whose nearest list it is."""
        x = self.toward(q)
        far = self.graph.search(x, ratio)
        take = far <= ratio * far.min(axis=1)[:, None]
        few = np.flatnonzero(take @ held < k)
        if len(few):
            g = self.graph
            all_d = g.norm - 2 * x[few] @ g.c.T
            order = np.argsort(all_d, axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            np.put_along_axis(all_d, order, before < k, axis=1)
            take[few] |= all_d.astype(bool)
        return np.nonzero(take)


def _matrix(column, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of at least the ``k`` largest inner products of each query, ties included."""
    rows, cols, at = [], [], 0
    while at < len(q):
        s = q[at : at + 256] @ x.T
        edge = np.partition(s, -k, axis=1)[:, -k] if len(x) > k else s.min(axis=1)
        r, c = np.nonzero(s >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
        rows.append(r + at), cols.append(c)
        at += 256
    row, col = np.concatenate(rows), np.concatenate(cols)
    return row, col, np.einsum("ij,ij->i", q[row], x[col])


def _found(k: int, dim: int):
    """The ``k`` nearest of the queries on the right in a part of a list on the left."""

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "found": pa.array([], _FOUND)})
        x, q = _matrix(left["e"], dim), _matrix(right["e"], dim)
        row, col, score = best(q, x, k)
        ids = left["ids"].combine_chunks()
        off = np.asarray(ids.offsets)
        many = (off[1:] - off[:-1])[col]
        one = np.repeat(np.arange(len(col)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(off[col], many)
        vec = ids.values.to_numpy()[at]
        order = np.lexsort((vec, -score[one], row[one]))
        one, vec = one[order], vec[order]
        r = row[one]
        first = np.searchsorted(r, np.arange(len(q)))
        keep = np.arange(len(r)) - first[r] < k
        one, vec, r = one[keep], vec[keep], r[keep]
        v = left["v"].to_numpy()[col[one]]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(len(q) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(-score[one]), pa.array(vec), pa.array(v)], names=["minus", "id", "v"]))
        return pa.table({"q": right["v"], "found": lists.cast(_FOUND)})

    return run


_FOUND = pa.list_(pa.struct([("minus", pa.float64()), ("id", pa.int64()), ("v", pa.int64())]))
_FOUND_DDL = "q long, found array<struct<minus:double,id:long,v:long>>"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(q, best): the ``k`` first of all that was found for a query, copies from several lists once."""
    all_sorted = F.array_sort(F.flatten(F.collect_list("found")))
    lists = found.groupBy("q").agg(all_sorted.alias("all"))
    once = F.filter("all", lambda x, i: (i == 0) | (F.get(F.col("all"), i - 1) != x))
    return lists.select("q", F.slice(once, 1, k).alias("best"))


def _scan_all(queries: list, k: int, dim: int):
    """Brute force of a few queries over the batches of a task."""

    def run(batches):
        q = np.array([v for _, v in queries])
        for b in batches:
            if b.num_rows:
                row, col, score = best(q, _matrix(b.column("e"), dim), k)
                v = b.column("v").to_numpy()[col]
                keep = np.concatenate([np.flatnonzero(row == i)[np.argsort(-score[row == i], kind="stable")[:k]] for i in range(len(q))])
                found = [[{"minus": -s, "id": 0, "v": w}] for s, w in zip(score[keep].tolist(), v[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([queries[i][0] for i in row[keep]], pa.int64()), pa.array(found, _FOUND)], names=["q", "found"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", aim: float = AIM) -> DataFrame:
    """Of each row for which the Column ``is_query`` holds, the ``k`` nearest other rows: query_id, rank (from 1), vec_id, score.

    The nearest have the largest inner product, taken in double precision from the vectors as they are; ties
    go to the smaller id. Rows with a null id or vector, a zero vector, null or non-finite components take no part,
    nor do vectors of another length than the most frequent one (of equally frequent ones the least). Rows
    that repeat id and vector count once; rows that share an id alone are different rows, each a query and
    a candidate. With ``k`` other rows or fewer all are returned. Empty tables give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("e"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter("id is not null and e is not null").filter(~bad & F.exists("e", lambda c: c != 0))
    common = rows.groupBy(F.size("e").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dim = common["dim"]
    pairs = materialize(rows.filter(F.size("e") == dim).groupBy("e", "id").agg(F.max("is_query").alias("is_query")), "ann-rows")
    place = F.row_number().over(Window.partitionBy("e").orderBy("id"))
    firsts = pairs.select("e", "id").withColumn("n", place).filter(F.col("n") <= k + 1)
    same = firsts.groupBy("e").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    distinct = materialize(same.withColumn("v", F.monotonically_increasing_id()).withColumn("norm", norm), "ann-distinct")
    n, longest = distinct.agg(F.count(F.lit(1)), F.max("norm")).first()
    lists = int(min(max(1, round(n**0.5)), MOST_LISTS))
    part = max(1, n // SAMPLE)
    sample = distinct.filter(F.pmod(F.xxhash64("e"), F.lit(part)) == 0).select("e") if part > 1 else distinct.select("e")
    x = _matrix(sample.toArrow()["e"], dim)
    x = x[np.lexsort(x.T)] if len(x) else np.zeros((1, dim))
    index = Index(x, min(lists, len(x)), longest)
    del x

    def assign(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                row, lst, first = index.lists(_matrix(some.column("e"), dim))
                out = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lst, pa.int32()), pa.array(first), out.column("v"), out.column("e"), out.column("ids")], names=["list", "nearest", "v", "e", "ids"])

    kind = dict(distinct.dtypes)["e"]
    posted = materialize(distinct.select("v", "e", "ids").mapInArrow(assign, f"list int, nearest boolean, v long, e {kind}, ids array<long>"), "ann-lists")
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.count_if("nearest").alias("held")).collect()  # a row per list
    held = np.zeros(len(index.graph.c), np.int64)
    held[[r["list"] for r in sizes]] = [r["held"] for r in sizes]
    asked = materialize(pairs.filter("is_query").select("e", "id").join(distinct.select("e", "v"), "e").select("v", F.col("id").alias("query_id")), "ann-queries")
    searched = distinct.select("v", "e").join(asked.select("v").distinct(), "v", "left_semi")

    ratio = _calibrated(index, searched, distinct, posted, k, dim, aim)

    def route(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                row, lst = index.probes(_matrix(some.column("e"), dim), ratio, held, k + 1)
                out = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lst, pa.int32()), out.column("v"), out.column("e")], names=["list", "v", "e"])

    routed = materialize(searched.mapInArrow(route, f"list int, v long, e {kind}"), "ann-routed")
    asks = {r["list"]: r["count"] for r in routed.groupBy("list").count().collect()}  # a row per list
    split = spark.createDataFrame([(r["list"], -(-r["size"] // PART), -(-asks.get(r["list"], 1) // QUERIES)) for r in sizes], "list int, parts long, many long")
    dealt = lambda t, own, other, a, b: t.join(F.broadcast(split), "list").withColumn(a, F.pmod(F.xxhash64("v"), F.col(own))).withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))  # noqa: E731  a row per list
    left = dealt(posted.drop("nearest"), "parts", "many", "p", "m").select("list", "p", "m", "v", "e", "ids")
    right = dealt(routed, "many", "parts", "m", "p").select("list", "p", "m", "v", "e")
    found = left.groupBy("list", "p", "m").cogroup(right.groupBy("list", "p", "m")).applyInArrow(_found(k + 1, dim), _FOUND_DDL)
    answers = materialize(_merged(found, k + 1), "ann-found")
    release(posted, routed)
    own = (F.col("x.id") == F.col("query_id")) & (F.col("x.v") == F.col("q"))
    out = asked.withColumnRenamed("v", "q").join(answers, "q").select("query_id", "q", F.filter("best", lambda x: ~((x["id"] == F.col("query_id")) & (x["v"] == F.col("q")))).alias("best"))
    out = out.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (F.lit(0.0) - F.col("x.minus")).alias("score"))


def _calibrated(index: Index, searched: DataFrame, distinct: DataFrame, posted: DataFrame, k: int, dim: int, aim: float) -> float:
    """The least ratio at which ``CALIBRATED`` queries find the share ``aim`` of their true neighbours.

    The queries of least hash are compared with every vector; what reaches the driver is bounded:
    ``CALIBRATED`` times ``k`` neighbours with at most ``COPIES`` lists each."""
    some = [(r["v"], r["e"]) for r in searched.orderBy(F.xxhash64("e"), "v").limit(CALIBRATED).collect()]
    if not some:
        return 1.0
    true = _merged(distinct.select("v", "e").mapInArrow(_scan_all(some, k + 1, dim), _FOUND_DDL), k + 1)
    true = true.select("q", F.explode("best").alias("x")).select("q", F.col("x.v").alias("v")).filter("q <> v")
    placed = true.join(posted.select("v", "list"), "v").groupBy("q", "v").agg(F.collect_list("list").alias("lists")).collect()
    far = dict(zip([v for v, _ in some], _distances(index, np.array([e for _, e in some], np.float64)), strict=True))
    need = sorted(far[r["q"]][r["lists"]].min() / max(far[r["q"]].min(), 1e-12) for r in placed)
    return float(need[min(len(need) - 1, int(aim * len(need)))]) if need else 1.0


def _distances(index: Index, q: np.ndarray) -> np.ndarray:
    x, g = index.toward(q), index.graph
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + g.norm - 2 * x @ g.c.T, 0))


def op13_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
