"""Shared plumbing: document scans and the library's tables and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..scratch import free_shuffles, materialize, release, scratch_root

__all__ = ["SPACE", "components", "crc_mod", "free_shuffles", "materialize", "release", "scratch_root", "table"]

#: White space that the text contracts name: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))
