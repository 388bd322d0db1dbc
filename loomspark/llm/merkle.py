"""Merkle manifest of a dataset (operator 11).

A leaf is the digest of a row, made by Spark beside the scan, so texts are never shuffled. Leaves
are numbered within their language and dealt into aligned buckets of ``bucket`` (a power of two)
consecutive ones. A bucket is one Arrow table in an embedded DuckDB on an executor: level queries
(ordered ``string_agg``, then ``sha256``) make its tree, and a walk up the levels gives each leaf
its siblings and refolds the leaf that may be tampered with. Spark combines the bucket roots,
``bucket`` at a time, to subroots and the root, and joins the outer proofs to the leaves. No task
holds more than a bucket, and rounds grow with the logarithm of the rows to the base ``bucket``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.runs import numbered, numbered_within
from .common import materialize, release, table

BUCKET = 1024


def row_digest(cols: list[Column]) -> Column:
    """Digest of values in turn: `-` where null, else the UTF-8 byte count, `:` and the value."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def height(n: int, at: int, bucket: int) -> int:
    """Levels above ``n`` leaves of bucket ``at``: those of a whole bucket, unless it is the only one."""
    return (n - 1 if not at and n < bucket else bucket - 1).bit_length()


_LEVEL = "INSERT INTO nodes SELECT ?, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE l = ? GROUP BY i // 2"
_WALK = """
WITH RECURSIVE walk(l, leaf, i, proof, folded) AS (
  SELECT 0, i, i, '', t FROM leaves
  UNION ALL
  SELECT w.l + 1, w.leaf, w.i // 2, w.proof || coalesce(s.h, ''),
    sha256(CASE WHEN s.h IS NULL THEN w.folded WHEN w.i % 2 = 0 THEN w.folded || s.h ELSE s.h || w.folded END)
  FROM walk w LEFT JOIN nodes s ON s.l = w.l AND s.i = xor(w.i, 1) WHERE w.l < {up}
)
SELECT doc_id, leaves.h AS leaf, unhex(proof) AS proof, folded, CASE WHEN leaves.i = 0 THEN (SELECT h FROM nodes WHERE l = {up}) END AS top
FROM walk JOIN leaves ON leaves.i = walk.leaf WHERE l = {up} ORDER BY leaves.i
"""
_INNER = pa.schema([("g", pa.string()), ("at", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("proof", pa.binary()), ("folded", pa.string()), ("top", pa.string())])
_DB: list = []


def _block(bucket: int):
    def run(key, leaves):
        import duckdb

        if not _DB:
            _DB.append(duckdb.connect(config={"threads": 1, "memory_limit": "200MB"}))
            _DB[0].execute("CREATE TABLE nodes(l INTEGER, i BIGINT, h VARCHAR)")
        db, g, at = _DB[0], key[0].as_py(), key[1].as_py()
        up = height(leaves.num_rows, at, bucket)
        db.execute("DELETE FROM nodes")
        db.register("leaves", leaves.select(["i", "doc_id", "h", "t"]))
        db.execute("INSERT INTO nodes SELECT 0, i, h FROM leaves")
        for level in range(up):
            db.execute(_LEVEL, [level + 1, level])
        out = db.sql(_WALK.format(up=up)).to_arrow_table()
        db.unregister("leaves")
        n = out.num_rows
        return pa.table([pa.array([g] * n), pa.array([at] * n, pa.int64()), *out.columns], names=_INNER.names).cast(_INNER)

    return run


def _pairs_up(level: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda k: F.sha2(F.concat(F.get(level, 2 * k), F.coalesce(F.get(level, 2 * k + 1), F.lit(""))).cast("binary"), 256))


def tree(nodes: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, list[DataFrame]]:
    """The binary trees over ``nodes`` (g, i from 0, h): (g, i, top, steps) and tables to release.

    ``steps`` lead from the node to ``top``, the root of its tree: L or R with a sibling that
    stands left or right, S where there is none. Rounds of ``bucket`` nodes each."""
    bits = (bucket - 1).bit_length()
    rounds, cur = [], nodes
    while True:
        lists = cur.groupBy("g", F.floor(F.col("i") / bucket).cast("long").alias("at")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("all"))
        lists = lists.select("g", "at", F.transform("all", lambda x: x["h"]).alias("h"))
        alone = (F.col("at") == 0) & (F.size("h") < bucket)
        up = F.when(alone, F.ceil(F.log2(F.size("h").cast("double")))).otherwise(bits).cast("int")
        grown = F.aggregate(F.sequence(F.lit(1), F.lit(bits)), F.array("h"), lambda acc, k: F.when(k <= F.col("up"), F.concat(acc, F.array(_pairs_up(F.element_at(acc, -1))))).otherwise(acc))
        made = materialize(lists.withColumn("up", up).withColumn("levels", grown).drop("h"), "merkle-levels")
        rounds.append(made)
        if not made.filter("at > 0").limit(1).count():
            break
        cur = made.select("g", F.col("at").alias("i"), F.element_at(F.element_at("levels", -1), 1).alias("h"))
    steps = None
    for r in reversed(range(len(rounds))):
        made = rounds[r].select("g", "at", "up", "levels", F.explode(F.sequence(F.lit(0), F.size(F.col("levels")[0]) - 1)).alias("k"))

        def step(level):
            place = F.call_function("shiftright", F.col("k"), level)
            other = F.get(F.get(F.col("levels"), level), place.bitwiseXOR(F.lit(1)))
            return F.when(other.isNull(), F.lit("S")).otherwise(F.concat(F.when(place % 2 == 1, F.lit("L")).otherwise(F.lit("R")), other))

        own = F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda x: F.when(x < F.col("up"), step(x))), lambda s: s.isNotNull())
        here = made.select("g", "at", (F.col("at") * bucket + F.col("k")).alias("i"), F.element_at(F.element_at("levels", -1), 1).alias("top"), own.alias("steps"))
        if steps is None:
            steps = here.drop("at")
        else:
            above = steps.select("g", F.col("i").alias("at"), F.col("top").alias("root"), F.col("steps").alias("more"))
            steps = here.join(above, ["g", "at"]).select("g", "i", F.col("root").alias("top"), F.concat("steps", "more").alias("steps"))
    return steps, rounds


def fold(start: Column, steps: Column) -> Column:
    """The root that ``steps`` lead to from ``start``."""
    side = lambda s: F.substring(s, 1, 1)
    rest = lambda s: F.substring(s, 2, 64)
    return F.aggregate(steps, start, lambda a, s: F.sha2(F.when(side(s) == "S", a).when(side(s) == "L", F.concat(rest(s), a)).otherwise(F.concat(a, rest(s))).cast("binary"), 256))


def manifest(docs: DataFrame, columns: list[str], group: str = "lang", id_col: str = "doc_id", tampered: DataFrame | dict | None = None, bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of ``columns``; ``tampered`` maps some of them to the Column that a second
    copy of the row holds, whose digest is folded with the siblings of the first. A null or empty
    value has its own form in a digest, so they differ. Rows without a ``group`` (null) make one of their own,
    before all others. Leaves stand by id (null first), rows that repeat an id by leaf; rows that are alike
    stand next to each other, each with its own proof. A single row is its own subroot and root, with the
    digest of nothing as proof. An empty table gives no rows. Texts of any length are digested in place.
    Other columns are not read.
    """
    given = {c: F.col(c) for c in columns}
    second = {**given, **(tampered or {})}
    base = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("g"), F.col(id_col).cast("long").alias("doc_id"),
        row_digest(list(given.values())).alias("h"), row_digest(list(second.values())).alias("t"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialize(base, "merkle-leaves")
    placed = numbered_within(leaves, "g", ["doc_id", "h", "row"], "i", rows=max(8 * bucket, leaves.count() // 4096)).withColumn("i", F.col("i") - 1)
    placed = placed.select("g", F.floor(F.col("i") / bucket).cast("long").alias("at"), (F.col("i") % bucket).alias("i"), "doc_id", "h", "t")
    inner = materialize(placed.groupBy("g", "at").applyInArrow(_block(bucket), "g string, at long, doc_id long, leaf string, proof binary, folded string, top string"), "merkle-inner")
    release(leaves)
    roots = inner.filter("top is not null").select("g", F.col("at").alias("i"), F.col("top").alias("h"))
    outer, held = tree(roots, bucket)
    subroots = materialize(outer.filter("i = 0").select("g", F.col("top").alias("h")), "merkle-subroots")
    order = numbered(subroots, ["g"], "i", 0, rows=8 * bucket)
    last, more = tree(order.select(F.lit("").alias("g"), "i", "h"), bucket)
    upper = order.select("g", "i").join(last.select("i", F.col("top").alias("root"), F.col("steps").alias("upper")), "i").drop("i")
    outer = materialize(outer.join(upper, "g").select("g", F.col("i").alias("at"), F.col("top").alias("subroot"), "root", F.concat("steps", "upper").alias("steps")), "merkle-outer")
    release(*held, *more, subroots)
    siblings = F.array_join(F.transform("steps", lambda s: F.substring(s, 2, 64)), "")
    out = inner.join(outer, ["g", "at"]).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat(F.lower(F.hex("proof")), siblings).cast("binary"), 256).alias("proof_sha256"), fold(F.col("folded"), F.col("steps")).alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(table(spark, sf_dir, "documents"), COLUMNS, tampered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


_VALUE = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_ROW = " || ".join(_VALUE.format(c) for c in COLUMNS)
SQL = f"""
WITH RECURSIVE crc AS (SELECT *, row_number() OVER () AS r, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS sum FROM documents),
plain AS (SELECT r, doc_id, lang, sha256({_ROW}) AS leaf FROM crc),
other AS (SELECT r, sha256({_ROW}) AS tampered FROM (SELECT * REPLACE (CASE WHEN sum % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars) FROM crc)),
leaves AS (SELECT r, doc_id, lang, leaf, tampered, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM plain JOIN other USING (r) WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
nodes(l, lang, i, h, n) AS (SELECT 0, lang, i, leaf, n FROM leaves
  UNION ALL SELECT l + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY l, lang, i // 2, n),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(l, i, h, n) AS (SELECT 0, i, subroot, n FROM subs
  UNION ALL SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY l, i // 2, n),
inner_walk(l, r, lang, i, n, proof, f) AS (SELECT 0, r, lang, i, n, '', tampered FROM leaves
  UNION ALL SELECT w.l + 1, w.r, w.lang, w.i // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''),
    sha256(CASE WHEN s.h IS NULL THEN w.f WHEN w.i % 2 = 0 THEN w.f || s.h ELSE s.h || w.f END)
  FROM inner_walk w LEFT JOIN nodes s ON s.l = w.l AND s.lang IS NOT DISTINCT FROM w.lang AND s.i = xor(w.i, 1) WHERE w.n > 1),
outer_walk(l, r, i, n, proof, f) AS (SELECT 0, w.r, subs.i, subs.n, w.proof, w.f FROM inner_walk w JOIN subs ON subs.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL SELECT w.l + 1, w.r, w.i // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''),
    sha256(CASE WHEN s.h IS NULL THEN w.f WHEN w.i % 2 = 0 THEN w.f || s.h ELSE s.h || w.f END)
  FROM outer_walk w LEFT JOIN tops s ON s.l = w.l AND s.i = xor(w.i, 1) WHERE w.n > 1)
SELECT leaves.doc_id, leaf, subroot, tops.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = tops.h AS verified
FROM outer_walk w JOIN leaves USING (r) JOIN subs ON subs.lang IS NOT DISTINCT FROM leaves.lang JOIN tops ON tops.n = 1 WHERE w.n = 1
"""
