"""Exact dedup by deterministic block naming (operator 1, DataFrame functions only).

Each normalised text is cut into blocks of ``block_bytes`` bytes. Distinct blocks are sorted
inside hash buckets and numbered, so each gets an integer name; then adjacent names of a
document are paired and distinct pairs are named the same way, level by level, until a
document has one name. Two documents have the same (level, name) exactly when their texts
are equal. Names depend on the data alone, not on the partitioning, so a task that is run
again gives the same names.

Blocks travel under a 128-bit key; where two different blocks ever had the same key, the
naming window would see the key twice and stop the job: it never merges different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, release, table

BLOCK_BYTES = 4096
NAME_BUCKETS = 16384


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalized(text).cast("binary"), 256))


def _named(keys: DataFrame, a: str, b: str) -> DataFrame:
    """Integer names for distinct rows (a, b): rank in a hash bucket times the buckets, plus the bucket."""
    w = Window.partitionBy("bucket").orderBy(a, b)
    twice = (F.lag(a).over(w) == F.col(a)) & (F.lag(b).over(w) == F.col(b))
    return (
        keys.withColumn("bucket", F.pmod(F.xxhash64(a, b), F.lit(NAME_BUCKETS)))
        .withColumn(
            "name",
            F.when(twice, F.raise_error(F.lit("two different blocks share a 128-bit key")).cast("long")).otherwise(
                (F.row_number().over(w).cast("long") - 1) * NAME_BUCKETS + F.col("bucket")
            ),
        )
        .drop("bucket")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other. Of equal texts the row
    with the smallest doc_id stays; of rows that repeat both id and text, one stays. A null id
    is larger than any other (a group of null ids keeps one row, with a null keep_id). Rows that
    repeat id and text each get a row. An empty table gives no rows. Other columns are not read.
    """
    norm = normalized(F.col(text_col))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), norm.cast("binary").alias("bin")
    ).select("doc_id", F.unhex(F.sha2("bin", 256)).alias("sha"), F.greatest(F.lit(1), F.ceil(F.length("bin") / block_bytes)).cast("int").alias("n"), "bin")
    blocks = base.select(
        "doc_id", "sha", "n",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("bin"), i * block_bytes + 1, F.lit(block_bytes)))).alias("idx", "block"),
    ).select("doc_id", "sha", "n", "idx", F.xxhash64("block").alias("a"), F.xxhash64(F.lit(7), "block").alias("b"), "block")

    distinct_blocks = blocks.select("a", "b", "block").distinct().select("a", "b")
    named = blocks.drop("block").join(_named(distinct_blocks, "a", "b"), ["a", "b"])
    cur = materialize(
        named.groupBy("doc_id", "sha", "n", "idx").agg(F.max("name").alias("name"), F.count(F.lit(1)).alias("copies")), "names"
    )
    longest = cur.agg(F.max("n")).first()[0] or 0
    level, done = 0, [cur.filter("n = 1").select("doc_id", "sha", F.lit(0).alias("level"), "name", "copies")]
    while longest > 1:
        pairs = (
            cur.filter("n > 1")
            .groupBy("doc_id", "sha", "n", F.expr("idx div 2").cast("int").alias("idx"))
            .agg(
                F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"),
                F.max("copies").alias("copies"),
            )
        )
        names = _named(pairs.select("a", "b").distinct(), "a", "b")
        level, longest = level + 1, (longest + 1) // 2
        cur = materialize(
            pairs.join(names, ["a", "b"]).select("doc_id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), "idx", "name", "copies"), "names"
        )
        done.append(cur.filter("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name", "copies"))
    ident = done[0]
    for d in done[1:]:
        ident = ident.unionAll(d)
    groups = materialize(
        ident.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").cast("long").alias("group_size")), "groups"
    )
    return ident.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "sha",
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that :func:`exact_dedup` keeps, with all their columns, whatever their names.

    Of rows that repeat id and text the one stays whose other columns hash least (rows that agree
    in that too are alike, or as good as). Null ids, null and empty texts and empty tables as there."""
    own = F.col(id_col).cast("long")
    null, key = own.isNull(), F.coalesce(own, F.lit(0).cast("long"))
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("key"), F.unhex("text_sha256").alias("sha"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), null.alias("null"), key.alias("key"), text_digest(F.col(text_col)).alias("sha"))
    rows = rows.join(kept, ["null", "key", "sha"], "left_semi")
    return rows.groupBy("null", "key", "sha").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
