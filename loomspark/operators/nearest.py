"""Exact distances to the k-th neighbour on a grid of block pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

SAMPLE = 4096
MOST_GROUPS = 256
#: Distances at once; and vectors of a unit, and units that they make, from where on units grow with the table up to that.
AT_ONCE, MOST_BLOCK, UNITS = 1 << 21, 32768, 12
#: Partitions of units and of their pairs at most; they are few bytes and much work, so they are not drawn together.
PARTS = 1024


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of one length, in double."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in chunks]
    n = len(column)
    return np.concatenate(flat).reshape(n, -1) if n else np.zeros((0, 0))


class Squares:
    """Lower bounds of the squared distances of rows of ``x`` to rows of ``y``, in one product, in a unit of its own.

    Rows are centred; their squared lengths are cut by what rounding can add. Floats serve where that is little beside
    the square of ``usual``, a distance that is looked for; doubles otherwise."""

    def __init__(self, x: np.ndarray, y: np.ndarray, usual: float, mid: np.ndarray | None = None):
        mid = x.mean(axis=0) if mid is None else mid
        p, q = x - mid, y - mid
        nx, ny = np.einsum("ij,ij->i", p, p), np.einsum("ij,ij->i", q, q)
        most = max(nx.max(initial=0.0), ny.max(initial=0.0))
        self.scale = 1 / np.sqrt(most) if most > 0 and np.isfinite(1 / np.sqrt(most)) else 1.0
        slack = lambda kind: 2 * (x.shape[1] + 8) * np.finfo(kind).eps
        fine = np.isfinite(usual) and slack(np.float32) * (np.median(nx) + np.median(ny)) <= 0.02 * usual * usual if len(x) and len(y) else True
        self.kind = np.float32 if fine else np.float64
        self.slack = self.kind(slack(self.kind))
        less = (1 - slack(self.kind)) * self.scale**2
        self.p = np.column_stack([p * (-2 * self.scale), nx * less, np.ones(len(p))]).astype(self.kind)
        self.q = np.column_stack([q * self.scale, np.ones(len(q)), ny * less]).astype(self.kind).T.copy()

    def low(self, rows: slice, cols: slice) -> np.ndarray:
        return self.p[rows] @ self.q[:, cols]

    def rise(self, d: np.ndarray, edge: np.ndarray, rows: slice) -> np.ndarray:
        """What a row's bounds ``d`` can be of distances that are not above those whose bounds are not above ``edge``."""
        most = np.where(d <= edge[:, None], self.q[-1], 0).max(axis=1, initial=0)
        return edge + 4 * self.slack * (self.p[rows, -2] + most) + self.kind(1e-30)

    def wall(self, far: np.ndarray) -> np.ndarray:
        """The squares of distances in the unit of the bounds, rounded up."""
        return ((far * self.scale) ** 2 * (1 + 4 * np.finfo(self.kind).eps) + 1e-30).astype(self.kind)


class Layout:
    """Principal axes of a sample and a tree of median cuts along them, which deals vectors into groups."""

    def __init__(self, sample: np.ndarray, groups: int):
        self.centre = sample.mean(axis=0)
        x = sample - self.centre
        self.axes = np.linalg.svd(x, full_matrices=False)[2].T
        self.cuts: list[tuple] = []  # (axis, value, left, right); a negative child is the group ~child
        self.groups = 0
        self.root = self._cut(x @ self.axes, groups)

    def _cut(self, y: np.ndarray, groups: int) -> int:
        spread = y.max(axis=0) - y.min(axis=0) if len(y) else np.zeros(1)
        if groups <= 1 or len(y) < 2 or not spread.max() > 0:
            self.groups += 1
            return ~(self.groups - 1)
        axis = int(spread.argmax())
        order = np.sort(y[:, axis])
        value = order[len(order) * (groups // 2) // groups]
        left = y[:, axis] < value
        if not left.any():
            left = y[:, axis] <= value
            value = np.nextafter(value, np.inf)
        at = len(self.cuts)
        self.cuts.append(())
        self.cuts[at] = (axis, value, self._cut(y[left], groups // 2), self._cut(y[~left], groups - groups // 2))
        return at

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.axes

    def group(self, y: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(y), np.int32), [(self.root, np.arange(len(y)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            axis, value, left, right = self.cuts[node]
            small = y[rows, axis] < value
            todo += [(left, rows[small]), (right, rows[~small])]
        return out


def closest(a: np.ndarray, b: np.ndarray, many: np.ndarray, k: int, centre: np.ndarray, same: bool, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``a`` the distances, up to ``reach``, to the ``k`` rows of ``b`` next to it, with how many each stands for:
    (where the row's begin, and the end; distances; counts).

    Products of centred rows say which rows can be among them, with a margin for their rounding; the distances
    themselves are of differences, so an offset that all vectors share costs no digits."""
    ends, fars, counts = [np.zeros(1, int)], [], []
    step = max(1, AT_ONCE // max(len(b), 1))
    squares = Squares(a, b, np.median(reach), centre)
    walls = squares.wall(reach)
    for at in range(0, len(a), step):
        rows = slice(at, at + step)
        d = squares.low(rows, slice(None))
        if same:
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = d <= walls[rows, None]
        if np.count_nonzero(near) > 2 * k * len(d) and d.shape[1] > k:  # else the exact distances decide at once
            edge = np.partition(d, k - 1, axis=1)[:, k - 1]  # k bounds are not above it, so k distances are not above it by more than rounding
            near &= d <= squares.rise(d, edge, rows)[:, None]
        if same:
            near[np.arange(len(d)), np.arange(at, at + len(d))] = False
        r, c = np.divmod(np.flatnonzero(near), max(1, d.shape[1]))
        gap = a[rows][r] - b[c]
        far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        within = far <= reach[rows][r]
        r, c, far = r[within], c[within], far[within]
        order = np.lexsort((far, r))
        r, c, far = r[order], c[order], far[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        ends.append(ends[-1][-1] + np.searchsorted(r[keep], np.arange(len(d)), side="right"))
        fars.append(far[keep])
        counts.append(many[c[keep]])
    return np.concatenate(ends), np.concatenate([*fars, np.zeros(0)]), np.concatenate([*counts, np.zeros(0, np.int64)])


def lists(found: list[tuple]) -> pa.Array:
    """What :func:`closest` finds, as lists of structs."""
    far, many = (pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2))
    starts = np.cumsum([0, *(f[0][-1] for f in found)])
    ends = np.concatenate([np.zeros(1, int), *(f[0][1:] + s for f, s in zip(found, starts, strict=False))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([far, many], ["far", "many"])).cast(_NEAR)


_NEAR = pa.list_(pa.struct([("far", pa.float64()), ("many", pa.int64())]))


def core_distance(vectors: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """(id, core): distance to the k-th nearest other vector, exact; null where there are fewer.

    Equal vectors are looked up once, each for all its rows (rows that repeat an id too count once). The others lie in groups by
    median cuts along principal axes, and groups in units of about ``block``. A unit meets itself first; what its vectors
    have found so far says which other groups' boxes are near enough. Units that must meet do so as pairs, so a
    vector goes to at most as many tasks as there are units, the square root of the tasks, and a task holds two units.
    Units grow with the table up to ``MOST_BLOCK`` vectors, so until then what is shuffled grows with it alone."""
    return cores(vectors, k, block)[0]


def cores(vectors: DataFrame, k: int, block: int = 4096) -> tuple[DataFrame, list[DataFrame]]:
    """The same, and the tables in the shared folder that it reads."""
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)["features"] == "array<float>" else "array<double>"
    rows = vectors.select("id", F.col("features").cast(kind).alias("v")).filter("v is not null")
    distinct = materialize(rows.groupBy("v").agg(F.count_distinct("id").alias("many")).withColumn("row", F.monotonically_increasing_id()), "core-rows")
    n = distinct.count()
    if not n:
        return rows.select("id", F.lit(None).cast("double").alias("core")), [distinct]
    block, part = max(block, min(MOST_BLOCK, n // UNITS)), max(1, n // SAMPLE)
    layout = Layout(matrix(distinct.filter(F.pmod(F.xxhash64("v"), F.lit(part)) == 0).limit(4 * SAMPLE).select("v").toArrow()["v"]) if n > block else np.zeros((1, 1)), min(MOST_GROUPS, -(-n // block)))
    if layout.groups == 1:
        units, placed = -(-n // block), distinct.withColumn("g", F.lit(0))
        sizes = {0: n}
    else:

        def place(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(layout.group(layout.turned(matrix(b.column("v")))), pa.int32())], names=["v", "many", "row", "g"])

        placed = materialize(distinct.mapInArrow(place, f"v {kind}, many long, row long, g int"), "core-groups")
        sizes = {r["g"]: r["count"] for r in placed.groupBy("g").count().collect()}  # a row per group
    first, units = {}, 0
    for g in sorted(sizes):
        first[g], units = units, units + -(-sizes[g] // block)
    begin = F.create_map(*[F.lit(x) for g in first for x in (g, first[g])])
    parts = F.create_map(*[F.lit(x) for g in first for x in (g, -(-sizes[g] // block))])
    homes = placed.withColumn("unit", (begin[F.col("g")] + F.pmod(F.xxhash64("row"), parts[F.col("g")])).cast("int"))
    centre = layout.centre if layout.groups > 1 else None

    def own(table):
        x, many, r = matrix(table["v"]), table["many"].to_numpy(), table["row"]
        near = closest(x, x, many, k, x.mean(axis=0) if centre is None else centre, True, np.full(len(x), np.inf))
        return pa.table({"row": r, "v": table["v"], "many": table["many"], "g": table["g"], "unit": table["unit"], "reach": pa.array(_kth(near, many, k)), "near": lists([near])})

    ddl = f"row long, v {kind}, many long, g int, unit int, reach double, near array<struct<far:double,many:long>>"
    alone = homes.select("row", "v", "many", "g", "unit").repartition(min(units, PARTS), "unit").groupBy("unit").applyInArrow(own, ddl)
    near, tables = alone.select("row", "many", "near"), [distinct, placed]
    if units > 1:
        alone = materialize(alone, "core-own")
        tables.append(alone)
        near = alone.select("row", "many", "near")
        meets = spark.createDataFrame(_meetings(alone, layout, sizes, first, block), "unit int, cell string, left boolean")
        guests = alone.select("row", "v", "many", "unit", "reach").join(F.broadcast(meets), "unit")  # a row per pair of units, of which groups and blocks bound the number

        def meet(table):
            side = table["left"].to_numpy(zero_copy_only=False)
            x, many, reach, r = matrix(table["v"]), table["many"].to_numpy(), table["reach"].to_numpy(), table["row"].to_numpy()
            mid = x.mean(axis=0) if centre is None else centre
            found = [(r[s], many[s], closest(x[s], x[~s], many[~s], k, mid, False, reach[s])) for s in (side, ~side)]
            return pa.table({"row": np.concatenate([f[0] for f in found]), "many": np.concatenate([f[1] for f in found]), "near": lists([f[2] for f in found])})

        met = guests.repartition(min(units * (units + 1) // 2, PARTS), "cell").groupBy("cell").applyInArrow(meet, "row long, many long, near array<struct<far:double,many:long>>")
        near = near.unionAll(met).groupBy("row", "many").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    counted = F.aggregate("near", F.struct((F.col("many") - 1).alias("n"), F.when(F.col("many") > k, 0.0).alias("core")), lambda s, x: F.struct((s["n"] + x["many"]).alias("n"), F.when(s["core"].isNull() & (s["n"] + x["many"] >= k), x["far"]).otherwise(s["core"]).alias("core")))
    found = near.select("row", counted["core"].alias("core")).join(distinct.select("row", "v"), "row").select("v", "core")
    return rows.distinct().join(found, "v").select("id", "core"), tables


def _kth(found: tuple, many: np.ndarray, k: int) -> np.ndarray:
    """Distances to the k-th other vector, of the vectors found; infinite where they are fewer."""
    ends, far, counts = found
    row = np.repeat(np.arange(len(many)), np.diff(ends))
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    there = np.flatnonzero(total[1:] - total[ends[row]] + many[row] - 1 >= k)
    out = np.full(len(many), np.inf)
    out[row[there[::-1]]] = far[there[::-1]]  # the last to be set is the nearest
    out[many > k] = 0.0
    return out


def _meetings(alone: DataFrame, layout: Layout, sizes: dict, first: dict, block: int) -> list[tuple]:
    """(unit, cell, left) of units that must meet: of one group, or of groups whose boxes are nearer than the
    greatest reach in either. A row per group reaches the driver."""
    def boxes(batches):
        for b in batches:
            if b.num_rows:
                y, g = layout.turned(matrix(b.column("v"))), b.column("g").to_numpy()
                for u in np.unique(g):
                    yield pa.RecordBatch.from_arrays([pa.array([u], pa.int32()), pa.array([y[g == u].min(axis=0)], pa.list_(pa.float64())), pa.array([y[g == u].max(axis=0)], pa.list_(pa.float64())), pa.array([b.column("reach").to_numpy()[g == u].max()])], names=["g", "low", "high", "reach"])

    known = sorted(sizes)
    if layout.groups > 1:
        low, high, reach = {}, {}, {}
        ends = alone.select("g", "v", "reach").mapInArrow(boxes, "g int, low array<double>, high array<double>, reach double")
        each = ends.groupBy("g").agg(*[F.array(*[f(F.get(c, F.lit(i))) for i in range(layout.axes.shape[1])]).alias(c) for c, f in (("low", F.min), ("high", F.max))], F.max("reach").alias("reach"))
        for r in each.collect():
            low[r["g"]], high[r["g"]], reach[r["g"]] = np.array(r["low"]), np.array(r["high"]), r["reach"]
    out = []
    for i, g in enumerate(known):
        for h in known[i:]:
            if g != h:
                gap = np.maximum(0, np.maximum(low[g] - high[h], low[h] - high[g]))
                scale = max(np.abs(low[g]).max(), np.abs(high[h]).max())
                if np.sqrt((gap * gap).sum()) > max(reach[g], reach[h]) + 1e-9 * (1 + scale):
                    continue
            for u in range(first[g], first[g] - (-sizes[g] // block)):
                for w in range(first[h], first[h] - (-sizes[h] // block)):
                    if g != h or u < w:
                        out += [(u, f"{u}-{w}", True), (w, f"{u}-{w}", False)]
    return out
