"""Keyed tables in hash buckets: a write touches the buckets of its keys alone.

A table is a folder of data files and numbered manifests. A manifest names the folder of each bucket; a write
puts new folders beside the old ones and then claims the next number by making its manifest, which fails if
another writer has claimed it meanwhile. So readers see whole versions, the first of two writers wins, and
the second knows. Files that no kept manifest names are removed by :func:`expire`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    buckets: int = BUCKETS
    #: folder under the table by bucket; a bucket without rows has none
    folders: dict[int, str] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _manifests(spark: SparkSession, path: str) -> list[int]:
    at, fs = _fs(spark, f"{path}/manifests")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[:12]) for n in names if n[:12].isdigit() and n.endswith(".json"))


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The named version, else the newest; version 0 is the empty table."""
    known = _manifests(spark, path)
    number = number if number is not None else (known[-1] if known else 0)
    if not number:
        return Version()
    if number not in known:
        raise LookupError(f"{path} has no version {number}")
    said = json.loads(spark.read.text(f"{path}/manifests/{number:012}.json", wholetext=True).first()[0])
    return Version(number, said["buckets"], {int(b): f for b, f in said["folders"].items()})


def _commit(spark: SparkSession, path: str, new: Version) -> Version:
    """Writes the manifest under another name and gives it its own, which the file system does once only."""
    jvm = spark._jvm
    at, fs = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(at)
    out.write(json.dumps({"buckets": new.buckets, "folders": new.folders}).encode())
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        files.rename(at, jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{new.number:012}.json"), none)
    except Exception as e:
        fs.delete(at, False)
        if "FileAlreadyExistsException" in str(e):
            raise Conflict(f"version {new.number} of {path} is there already") from None
        raise
    return new


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, at: Version, schema, wanted=None) -> DataFrame:
    folders = [f"{path}/{f}" for b, f in sorted(at.folders.items()) if wanted is None or b in wanted]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str, schema, at: Version | None = None) -> DataFrame:
    """The rows of a version, the newest by default."""
    return _read(spark, path, at or version(spark, path), schema)


def lookup(spark: SparkSession, path: str, keys: list[str], schema, wanted: DataFrame, at: Version | None = None) -> DataFrame:
    """All rows of the buckets that the keys of ``wanted`` fall into; a number per bucket reaches the driver."""
    at = at or version(spark, path)
    return _read(spark, path, at, schema, {r[0] for r in wanted.select(bucket_of(keys, at.buckets)).distinct().collect()})


def write(rows: DataFrame, path: str, keys: list[str], touched: set[int], at: Version, buckets: int) -> Version:
    """The next version: buckets in ``touched`` hold ``rows``, the others what they held at ``at``."""
    spark, name = rows.sparkSession, f"data/{at.number + 1:012}-{uuid.uuid4().hex}"
    rows.withColumn("__bucket", bucket_of(keys, buckets)).repartition(max(1, len(touched)), "__bucket").write.partitionBy("__bucket").parquet(f"{path}/{name}")
    here, fs = _fs(spark, f"{path}/{name}")
    made = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(here) if "=" in s.getPath().getName()}
    if not made <= touched:
        raise ValueError("a write made rows of buckets that it does not own")
    folders = {b: f for b, f in at.folders.items() if b not in touched} | {b: f"{name}/__bucket={b}" for b in made}
    return _commit(spark, path, Version(at.number + 1, buckets, folders))


def change(path: str, delta: DataFrame, keys: list[str], schema, merge: Callable[[DataFrame, DataFrame], DataFrame], at: Version | None = None, buckets: int = BUCKETS) -> Version:
    """The next version of the table: in the buckets of ``delta``'s keys ``merge(rows, delta)``, elsewhere as before.

    ``at`` is the version that the caller has read (the newest by default); the write fails with :class:`Conflict` where
    another one came after it. At most a number per bucket reaches the driver. A delta of nothing makes no version."""
    spark = delta.sparkSession
    at = at or version(spark, path)
    buckets = at.buckets if at.number else buckets
    touched = {r[0] for r in delta.select(bucket_of(keys, buckets)).distinct().collect()}
    if not touched:
        return at
    return write(merge(_read(spark, path, at, schema, touched), delta), path, keys, touched, at, buckets)


def upsert(path: str, delta: DataFrame, keys: list[str], schema, replaced: list[str] | None = None, **how) -> Version:
    """:func:`tables.upsert` into the buckets of the delta; all its other columns are replaced by default."""
    columns = replaced if replaced is not None else [c for c in delta.columns if c not in keys]
    return change(path, delta, keys, schema, lambda rows, d: tables.upsert(rows, d, keys, columns), **how)


def delete(path: str, gone: DataFrame, keys: list[str], schema, **how) -> Version:
    return change(path, gone, keys, schema, lambda rows, d: tables.remove(rows, d, keys), **how)


def rebucket(spark: SparkSession, path: str, keys: list[str], schema, buckets: int) -> Version:
    """The same rows in another number of buckets, for a table that has outgrown its own."""
    at = version(spark, path)
    return write(_read(spark, path, at, schema), path, keys, set(range(buckets)), Version(at.number, buckets), buckets)


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the ``keep`` newest versions and the folders that only older ones name; how many folders went.

    What a writer has put down and not claimed yet is younger than the newest version and stays."""
    known = _manifests(spark, path)
    kept = known[-keep:]
    used = {f.split("/")[1] for n in kept for f in version(spark, path, n).folders.values()}
    for n in known[:-keep]:
        at, fs = _fs(spark, f"{path}/manifests/{n:012}.json")
        fs.delete(at, False)
    data, fs = _fs(spark, f"{path}/data")
    old = [s.getPath() for s in (fs.listStatus(data) if fs.exists(data) else []) if s.getPath().getName() not in used and kept and int(s.getPath().getName()[:12]) <= kept[-1]]
    for p in old:
        fs.delete(p, True)
    return len(old)
