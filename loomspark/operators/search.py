"""Full-text search in stored chapters with an index of letter triples.

An index is three keyed tables in one folder: the files in it, their chapters, and for each triple of letters (of the
text with case folded away) and file the chapters that hold it. Files are added as they come. A search reads the
buckets of the needle's triples alone, keeps the chapters that hold them all, and looks for the needle in their texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import scalars as S
from ..scratch import materialize
from ..sources import epub
from ..sources.html import spread
from . import keyed, tables

FILES, CHAPTERS, POSTINGS = "path string", "path string, name string, title string, text string", "gram string, path string, names array<string>"


def folded(text: Column) -> Column:
    """The text without case, sign by sign: what a search that ignores case takes for equal is equal."""
    plain = F.replace(text, F.lit("İ"), F.lit("i"))
    return F.replace(F.lower(F.upper(plain)), F.lit("ς"), F.lit("σ"))


def triples(text: Column) -> Column:
    """The distinct runs of three signs of a folded text."""
    return _triples(text)


@F.pandas_udf(ArrayType(StringType()))
def _triples(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))))


def add(spark: SparkSession, folder: str, books: DataFrame) -> int:
    """Indexes the EPUB files (path, content) whose path the index lacks, and says how many they are."""
    known = keyed.load(spark, f"{folder}/files", FILES)
    new = materialize(books.join(known, "path", "left_anti").dropDuplicates(["path"]), "books")
    n = new.count()
    if not n:
        return 0
    scanned = materialize(epub.scan(spread(new)), "chapters")
    grams = spread(scanned.select("path", "name", "text")).select("path", "name", F.explode(triples(folded(F.col("text")))).alias("gram"))
    posted = materialize(grams.groupBy("gram", "path").agg(F.array_sort(F.collect_list("name")).alias("names")), "postings")  # the names of one file
    # a run that stops before the last line adds the same files again: what it has written of them is replaced
    paths = new.select("path")
    keyed.change(f"{folder}/postings", posted, ["gram"], POSTINGS, lambda rows, d: rows.join(paths, "path", "left_anti").unionByName(d.select("gram", "path", "names")))
    keyed.change(f"{folder}/chapters", scanned, ["path"], CHAPTERS, lambda rows, d: rows.join(paths, "path", "left_anti").unionByName(d))
    keyed.change(f"{folder}/files", paths, ["path"], FILES, lambda rows, d: tables.remove(rows, d, ["path"]).unionByName(d))
    return n


def candidates(spark: SparkSession, folder: str, needle: str) -> DataFrame | None:
    """(path, name) of the chapters that hold all triples of the needle; None where it is too short to have one."""
    grams = [r[0] for r in spark.range(1).select(F.explode(triples(folded(F.lit(needle))))).collect()]
    if not grams:
        return None
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string")
    rows = keyed.lookup(spark, f"{folder}/postings", ["gram"], POSTINGS, wanted).filter(F.col("gram").isin(grams))
    held = rows.select("path", "gram", F.explode("names").alias("name"))
    return held.groupBy("path", "name").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("path", "name")


def grep(spark: SparkSession, folder: str, needle: str, context: int = 60, ignore_case: bool = True) -> DataFrame:
    """(path, name, title, k, snippet) of each place of the needle, as a scan of all chapters would find them."""
    some = candidates(spark, folder, needle) if needle else None
    if some is None:
        texts = keyed.load(spark, f"{folder}/chapters", CHAPTERS)
    else:
        some = materialize(some, "candidates")
        texts = keyed.lookup(spark, f"{folder}/chapters", ["path"], CHAPTERS, some.select("path")).join(some, ["path", "name"], "left_semi")
    hits = texts.select("path", "name", "title", F.explode(S.snippets(F.col("text"), needle, context, ignore_case)).alias("h"))
    return hits.select("path", "name", "title", "h.k", "h.snippet")
