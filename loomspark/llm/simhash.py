"""SimHash near-dedup by bit-sliced comparison (operator 4).

Fingerprints are made row-wise in Arrow batches. Distinct fingerprints are then compared:
by the pigeonhole principle, fingerprints that differ in at most ``radius`` of 64 bits agree
wholly in at least ``r - radius`` of ``r`` bit blocks, so each fingerprint is dealt to one
bucket per choice of ``r - radius`` blocks, and no link is lost. ``r`` rises with the number
of distinct fingerprints, which keeps a bucket of unrelated ones to a few rows. Inside a
bucket, bit planes are stored vertically, once; each pass adds the mismatch planes of many pairs
to carry-save counters and gives up on a block of 64 lanes once all exceed the radius. A bucket
larger than ``BUCKET_ROWS`` is split in sub-blocks whose pairs go to different tasks, so
nothing is capped. Only a spanning star of each bucket's links is emitted, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, release, table
from .pretok import forget

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
BUCKET_ROWS = 512


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one UTF-8 text: ASCII lower case, word shingles with repeats, majority of XXH64."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    norm = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(norm, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    total, count = np.zeros(64, np.int64), len(starts)
    for at in range(0, count, 8192):
        some = [xxh64_intdigest(norm[a:b], SEED) for a, b in zip(starts[at : at + 8192], ends[words - 1 + at : words - 1 + at + 8192].tolist(), strict=False)]
        h = np.array(some, dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    forget()
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        fp = np.array([fingerprint(t.as_py() or b"") for t in texts], dtype="<u8").view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], names=["doc_id", "tie", "fp"])


def _tie(text):
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie: a digest of the text, fp: the fingerprint as a signed long)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), _tie(F.col(text_col)).alias("tie")).mapInArrow(
        _fingerprints, "doc_id long, tie string, fp long"
    )


def _blocks(distinct: int, radius: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bucket tables as (table, [(first bit, bits), ...]) for so many fingerprints."""
    r = radius + 1
    while r < radius + 6 and distinct > 4 * 2 ** (64 * (r - radius) / r):
        r += 1
    edges = [round(64 * i / r) for i in range(r + 1)]
    return [(t, [(edges[i], edges[i + 1] - edges[i]) for i in pick]) for t, pick in enumerate(combinations(range(r), r - radius))]


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Planes:
    """The bits of fingerprints stored vertically: row k holds bit k of every lane, 64 lanes a word."""

    def __init__(self, fps: np.ndarray):
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
        words = -(-len(fps) // 64)
        padded = np.zeros((64, (2 * words + 2) * 64), np.uint8)  # a step may reach past the end
        padded[:, : len(fps)] = bits
        self.rows = np.packbits(padded, axis=1, bitorder="little").view("<u8")

    def differences(self, k: int, words: np.ndarray, step: int) -> np.ndarray:
        """Where bit k of lanes and of those ``step`` further differ, for some words of lanes."""
        row, skip, shift = self.rows[k], step >> 6, np.uint64(step & 63)
        there = row[words + skip]
        if shift:
            there = (there >> shift) | (row[words + skip + 1] << (np.uint64(64) - shift))
        return row[words] ^ there


def near_lanes(planes: Planes, lanes: np.ndarray, step: int, radius: int) -> np.ndarray:
    """Of ``lanes`` (ascending), those with at most ``radius`` bits between them and the one ``step`` further.

    Carry-save counters take two planes at a time; a word goes as soon as all its lanes are beyond
    the radius (lanes that were not asked for count as beyond from the start)."""
    word = lanes >> 6
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words = word[first]
    over = ~np.bitwise_or.reduceat(np.uint64(1) << (lanes & 63).astype(np.uint64), first)
    one, two, four = (np.zeros_like(over) for _ in range(3))
    for k in range(0, 64, 2):
        x, y = planes.differences(k, words, step), planes.differences(k + 1, words, step)
        half = one ^ x  # carry-save adder: one + x + y -> one, carry
        carry, one = (one & x) | (half & y), half ^ y
        carry, two = two & carry, two ^ carry
        over |= four & carry
        four ^= carry
        # counters hold 0..7; over marks lanes beyond the radius
        over |= four & (one | two) if radius == 4 else _beyond(one, two, four, radius)
        if k % 8 == 6:
            alive = over != _FULL
            if not alive.any():
                return np.zeros(0, np.int64)
            if not alive.all():
                words, over, one, two, four = (v[alive] for v in (words, over, one, two, four))
    at, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return words[at] * 64 + bit


def _beyond(one, two, four, radius):
    out = np.zeros_like(one)
    for v in range(radius + 1, 8):
        out |= (one if v & 1 else ~one) & (two if v & 2 else ~two) & (four if v & 4 else ~four)
    return out


def _links(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (least fingerprint, other) of the links inside runs of equal ``group``."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lengths = np.diff(np.r_[starts, len(group)])
    left = np.repeat(starts + lengths, lengths) - np.arange(len(fps))  # lanes from here to the run's end
    planes, lanes = Planes(fps), np.flatnonzero(left > 1)
    pairs_a, pairs_b, step = [], [], 1
    while len(lanes):
        near = near_lanes(planes, lanes, step, radius)
        if len(near):
            pairs_a.append(near)
            pairs_b.append(near + step)
        step += 1
        lanes = lanes[left[lanes] > step]
    if not pairs_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[ia], root[ib])
        new = root.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return fps[nodes[root[far]]].view(np.int64), fps[nodes[far]].view(np.int64)


def _bucket_links(radius: int):
    def run(batches):
        held_g, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            g = np.concatenate([held_g, b.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, b.column(1).to_numpy(zero_copy_only=False)])
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1], "left"))  # the last bucket may go on in the next batch
            held_g, held_f = g[cut:], f[cut:]
            if cut:
                x, y = _links(g[:cut], f[:cut].view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
        if len(held_g):
            x, y = _links(held_g, held_f.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def simhash_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their closure joins all within the radius.

    ``fps`` has distinct rows (fp: long). Buckets over BUCKET_ROWS are split, see the module.
    """
    tables = _blocks(fps.count(), radius)
    keys = []
    for t, parts in tables:
        k, width = F.lit(t).cast("long"), 0
        for first, bits in parts:
            k = F.shiftleft(k, bits).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
            width += bits
        keys.append(k)
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = dealt.groupBy("key").count().filter(f"count > 1")
    sizes = materialize(sizes, "buckets")
    dealt = dealt.join(sizes, "key")
    k = F.ceil(F.col("count") / BUCKET_ROWS).cast("int")
    sub = F.pmod(F.xxhash64("fp"), F.col("k"))
    dealt = (
        dealt.withColumn("k", k)
        .withColumn("sub", sub.cast("int"))
        .select("key", "fp", "k", "sub", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        .select(
            F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("sub", "other"), F.greatest("sub", "other"))).alias("grp"), "fp"
        )
    )
    # rows of different buckets may share a hashed group: more are compared, none is lost
    return dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(_bucket_links(radius), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat an id
    each get a row. Null ids take part; a component of null ids alone has a null component_id.
    An empty table gives no rows. Columns other than the two named are not read.
    """
    return _components(docs, id_col, text_col, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    rows = materialize(fingerprints(docs, id_col, text_col), "fp")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(simhash_links(nodes.select("fp"), radius))
    rooted = materialize(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    least = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    by_fp = materialize(rooted.join(least, "root").select("fp", "component_id", "root"), "byfp")
    release(nodes, roots, rooted, least)
    # rows and by_fp are read by the result; they go with the folder of the checkpoints
    return rows.join(by_fp, "fp").select("doc_id", "tie", "fp", "component_id", "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least doc_id (a null id
    is larger than any other; of rows that share it, the least digest of the text).

    Rows that repeat id and text stay or go together. Null and empty texts are near each other. An
    empty table stays empty. All columns are kept, whatever their names."""
    null, key = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("long"))
    found = _components(docs, id_col, text_col, radius).select(F.struct(null, key, F.col("tie")).alias("who"), "root")
    stay = found.groupBy("root").agg(F.min("who").alias("who")).select("who.*").toDF("null", "key", "tie")
    own = F.col(id_col).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), own.isNull().alias("null"), F.coalesce(own, F.lit(0).cast("long")).alias("key"), _tie(F.col(text_col)).alias("tie"))
    return rows.join(stay, ["null", "key", "tie"], "left_semi").select("row.*")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
