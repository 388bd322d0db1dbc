"""I-Match document fingerprints over randomised lexicon subsets (operator 2, native).

Terms (lower-cased words) whose inverse document frequency lies in a band are the lexicon: the
lower edge drops words of most documents, the upper one words of hardly any (typos, ids).
A document's distinct lexicon terms are hashed and sorted; the hash of all of them is the
classic fingerprint. Besides, the range of term hashes is split in cells on several levels;
each kept cell is a random subset of the lexicon whose sorted terms are hashed. Fine levels
hold about one term of a long document per cell: likeness is the share of equal subset hashes
on the finest level that has enough filled cells.

Document frequencies are counted per term over all documents by a group-by. A document has T
distinct terms on average, so at most T * e**upper terms can reach the document frequency of
the upper edge, however large the corpus: that is the bound of the lexicon, which the driver
collects. As a hash table it is one row of the shared folder that plans read as a scalar subquery:
as literals it would stand in the text of each plan, which Spark's driver keeps for many queries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, free_shuffles, materialize, release, table

IDF_BAND = (2.0, 7.0)
#: (cells kept, cells that the hash range is split in), fine to coarse.
LEVELS = [(192, 4096), (96, 1024), (64, 256), (32, 64), (8, 8)]
ENOUGH = 14
RANGE_ROWS = 500_000
SLOT_ROWS = 4096
_KEY = ["nul", "key", "d1", "d2"]


def _hashes(text: Column) -> Column:
    """Distinct term hashes of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str, band: tuple[float, float] = IDF_BAND) -> list[int]:
    """Hashes of the terms whose idf ln((n + 1) / df) is in the band; at most T * e**upper, see above."""
    n = docs.select(F.lit(1)).count()
    hashes = docs.select(F.explode(_hashes(F.coalesce(F.col(text_col), F.lit("")))).alias("h"))
    few, many = (n + 1) / math.exp(band[1]), (n + 1) / math.exp(band[0])
    return sorted(r["h"] for r in hashes.groupBy("h").count().filter((F.col("h") != 0) & (F.col("count") >= few) & (F.col("count") <= many)).select("h").collect())


def _slots(kept: list[int]) -> tuple[list[int], list[int], int]:
    """Two tables of 2**bits places: each hash lies in the place of its low bits in the first or of its
    next bits in the second (cuckoo hashing), so a lookup reads two places. 0 is an empty place."""
    bits = max(4, (2 * len(kept)).bit_length())
    while True:
        tables, mask, fits = ([0] * (1 << bits), [0] * (1 << bits)), (1 << bits) - 1, True
        for h in kept:
            side = 0
            for _ in range(500):
                at = (h >> (bits * side)) & mask
                h, tables[side][at] = tables[side][at], h
                if not h:
                    break
                side = 1 - side
            fits = fits and not h
        if fits:
            return *tables, bits
        bits += 1


def _table(spark: SparkSession, kept: list[int]) -> tuple[DataFrame, int]:
    """The lexicon as a hash table: one row (one, two: array<long>) in the shared folder, and the bits of a place."""
    one, two, bits = _slots(kept)
    halves = spark.createDataFrame([(side, at, t[at : at + SLOT_ROWS]) for side, t in enumerate((one, two)) for at in range(0, len(t), SLOT_ROWS)], "side int, at int, t array<long>")
    whole = lambda side: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", "t")))), lambda x: x["t"]))
    return materialize(halves.agg(whole(0).alias("one"), whole(1).alias("two")), "lexicon"), bits


def _placed(df: DataFrame, lexicon_table: DataFrame) -> DataFrame:
    """Adds places (struct of one, two). A subquery may not be written inside a lambda's call, but the optimizer
    moves it to its one use there, so no row carries it."""
    return df.withColumn("places", lexicon_table.select(F.struct("one", "two")).scalar())


def _terms(text: Column, bits: int) -> Column:
    """Sorted lexicon terms of a text, by the column places; all its terms where none is in the lexicon,
    so that such texts are told apart too."""
    mask = F.lit((1 << bits) - 1).cast("long")

    def pick(x):
        one, two, all_ = x["places"]["one"], x["places"]["two"], x["all"]

        def known(h):
            return (F.get(one, h.bitwiseAND(mask).cast("int")) == h) | (F.get(two, F.shiftright(h, bits).bitwiseAND(mask).cast("int")) == h)

        mine = F.filter(all_, known)
        return F.sort_array(F.when(F.size(mine) > 0, mine).otherwise(all_))

    return F.transform(F.array(F.struct("places", _hashes(text).alias("all"))), pick)[0]


def _subset_hashes(t: Column, cells: int, split: int) -> Column:
    """For each kept cell the hash of its terms in order (1 to 32767), 0 where it has none.

    A cell is a range of hashes, so its terms follow each other in the sorted array."""
    shift = 64 - (split.bit_length() - 1)
    half = split // 2  # signed order: the cells of negative hashes come first

    def subsets(c):
        def one(i):
            first = F.array_position(c["cells"], i)
            last = F.size(c["cells"]) + 1 - F.array_position(c["back"], i)
            terms = F.slice(c["terms"], first.cast("int"), (last - first + 1).cast("int"))
            return F.when(first == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(terms), F.lit(32767)).cast("int") + 1).cast("short")

        return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), one)

    def of(mine):
        cell = F.transform(mine, lambda h: (F.shiftright(h, shift) + F.lit(half)).cast("int"))
        return F.transform(F.array(F.struct(mine.alias("terms"), cell.alias("cells"), F.reverse(cell).alias("back"))), subsets)[0]

    mine = F.filter(t, lambda h: F.shiftright(h, shift) + F.lit(half) < cells) if cells < split else t
    return F.transform(F.array(mine), of)[0]


def fingerprint(text: Column, bits: int) -> Column:
    """struct(all: long, cells: array<short>, levels in LEVELS order) of a text, by the column places."""
    prints = lambda t: F.struct(F.xxhash64(t).alias("all"), F.concat(*[_subset_hashes(t, *level) for level in LEVELS]).alias("cells"))
    return F.transform(F.array(_terms(text, bits)), prints)[0]


def _text_of(fp: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(fp["all"]), 16, "0"), F.array_join(F.transform(fp["cells"], lambda c: F.lpad(F.hex(c), 4, "0")), "")))


def _likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes on the finest level with enough filled cells (0 to 1)."""
    out, at = None, 1
    found = []
    for cells, _ in LEVELS:
        both = F.zip_with(F.slice(a["cells"], at, cells), F.slice(b["cells"], at, cells), lambda x, y: F.when((x == 0) & (y == 0), F.lit(0)).when(x == y, F.lit(2)).otherwise(F.lit(1)))
        found.append((F.size(F.filter(both, lambda v: v > 0)), F.size(F.filter(both, lambda v: v == 2))))
        at += cells
    for filled, equal in reversed(found):
        share = equal.cast("double") / F.greatest(filled, F.lit(1))
        out = share if out is None else F.when(filled >= ENOUGH, share).otherwise(out)
    return F.when(a["all"] == b["all"], F.lit(1.0)).otherwise(out)


def with_next(keys: DataFrame) -> DataFrame:
    """Adds next (struct of _KEY) to distinct rows with the columns of _KEY: the next row in descending
    key (nulls last, then by digest), after the last the first.

    Only keys move: to ranges of about RANGE_ROWS, whose first rows (one per range) follow the
    last ones of the ranges before."""
    spark = keys.sparkSession
    order = [F.col("nul"), F.col("key").desc(), F.col("d1"), F.col("d2")]
    ranges = keys.count() // RANGE_ROWS + 1
    dealt = materialize(keys.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "keys")
    mine = F.struct(*_KEY)
    w = Window.partitionBy("range").orderBy(*order)
    heads = [(r["range"], r["first"]) for r in dealt.groupBy("range").agg(F.min_by(mine, F.struct("nul", -F.col("key").cast("decimal(20,0)"), "d1", "d2")).alias("first")).orderBy("range").collect()]
    after = spark.createDataFrame([(r, heads[(i + 1) % len(heads)][1]) for i, (r, _) in enumerate(heads)], "range int, head struct<nul boolean, key long, d1 long, d2 long>")
    led = dealt.withColumn("next", F.lead(mine).over(w))
    return led.join(F.broadcast(after), "range").withColumn("next", F.coalesce("next", "head")).drop("range", "head")  # one row per range


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last third (rounded down) replaced by as many first
    characters of the next document in descending doc_id (after the last: the first). A null
    text counts as empty; a text with no term of the lexicon is judged by all its terms, and
    texts without any term are alike (1.0). Null ids come after all others; rows that share an
    id follow each other by a digest of the text; rows that repeat id and text are one document,
    whose result each gets. A long text is held whole by one task. An empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    lexicon_table, bits = _table(spark, lexicon(docs, text_col, band))
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    part = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")
    base = docs.select(key.alias("doc_id"), key.isNull().alias("nul"), F.coalesce(key, F.lit(0).cast("long")).alias("key"), sha.alias("sha"), text.alias("text"))
    base = base.withColumns({"d1": part(1), "d2": part(17)}).drop("sha")
    prints = _placed(base, lexicon_table).select("doc_id", *_KEY, F.length("text").cast("long").alias("n"), fingerprint(F.col("text"), bits).alias("fp"))
    prints = materialize(prints, "prints")  # one row per row of docs; the texts stay behind
    once = prints.groupBy(*_KEY).agg(F.first("n").alias("n"), F.first("fp").alias("fp"))
    keys = materialize(once.select(*_KEY, "n"), "distinct")
    led = materialize(with_next(keys).withColumn("third", F.floor(F.col("n") / 3).cast("int")), "next")
    release(keys)
    free_shuffles(spark)
    at = F.col("next")
    following = led.select(*_KEY, "third", *[at[c].alias(f"n_{c}") for c in _KEY])
    texts = base.groupBy(*_KEY).agg(F.first("text").alias("text"))  # both uses share one exchange
    as_next = lambda df: df.select(*[F.col(c).alias(f"n_{c}") for c in _KEY], *[F.col(c).alias(f"n_{c}") for c in df.columns if c not in _KEY])
    n_key = [f"n_{c}" for c in _KEY]
    heads = following.join(as_next(texts), n_key).select(*_KEY, F.substring(F.col("n_text"), F.lit(1), F.col("third")).alias("head"), "third")
    edited = texts.join(heads, _KEY).select(*_KEY, F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("third")), F.col("head")).alias("edited"))
    edited = _placed(edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), lexicon_table).select(*_KEY, "edited_sha256", fingerprint(F.col("edited"), bits).alias("efp"))
    edited = materialize(edited, "edited")
    release(lexicon_table)
    free_shuffles(spark)
    next_fp = following.join(as_next(once.select(*_KEY, "fp")), n_key).select(*_KEY, F.col("n_fp").alias("next_fp"))
    return prints.join(edited, _KEY).join(next_fp, _KEY).select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", _text_of(F.col("fp")).alias("fingerprint"), _text_of(F.col("efp")).alias("edited_fingerprint"),
        _likeness(F.col("fp"), F.col("efp")).alias("near_edited"), _likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op2_imatch(spark, sf_dir: str) -> DataFrame:
    return imatch(table(spark, sf_dir, "documents"))
