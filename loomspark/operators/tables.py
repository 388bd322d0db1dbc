"""Snapshot DML: upserts, merges, dictionaries and aligned schemas over immutable tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in order; missing ones are null, doing it again changes nothing."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; one aggregate that combines map-side, no window over a hot key."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], replaced: list[str]) -> DataFrame:
    """Full-outer merge: ``replaced`` columns come from the delta where it has the key (nulls too),
    all others keep the base's value and are taken from the delta for new keys."""
    d = delta.select(*keys, *[F.col(c).alias(f"__d_{c}") for c in delta.columns if c not in keys], F.lit(True).alias("__new"))
    b = base.withColumn("__old", F.lit(True))
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in delta.columns:
            new = F.col(f"__d_{c}")
            out.append((F.when(F.col("__new"), new).otherwise(F.col(c)) if c in replaced else F.when(F.col("__old"), F.col(c)).otherwise(new)).alias(c))
        else:
            out.append(F.col(c))
    return b.join(d, keys, "full_outer").select(*out)


def merge_metadata(base: DataFrame, delta: DataFrame, key: str, coalesced: list[str]) -> DataFrame:
    """Overwrites the delta's columns even with null, save ``coalesced``, which keep the old value.

    A key of the delta that the base lacks is an error when the result is read."""
    d = delta.select(key, *[F.col(c).alias(f"__d_{c}") for c in delta.columns if c != key], F.lit(True).alias("__hit"))
    cols = []
    for c in base.columns:
        if c == key or c not in delta.columns:
            cols.append(F.col(c))
        elif c in coalesced:
            cols.append(F.coalesce(f"__d_{c}", c).alias(c))
        else:
            cols.append(F.when(F.col("__hit"), F.col(f"__d_{c}")).otherwise(F.col(c)).alias(c))
    lost = d.join(base.select(key).distinct(), key, "left_anti").select(F.raise_error(F.concat(F.lit("unknown key "), F.col(key).cast("string"))).cast("string").alias("__lost"))
    checked = base.join(d, key, "left").select(*cols)
    # an aggregate without groups gives one row, with the count 0, or fails
    return checked.withColumn("__lost", F.lit(0).cast("bigint")).join(F.broadcast(lost.agg(F.count("__lost").alias("__lost"))), "__lost").drop("__lost")


def dictionary(names: DataFrame, known: DataFrame, name: str = "name", number: str = "id") -> DataFrame:
    """``known`` plus new names with numbers from its maximum on, in name order.

    New names are a dimension (tags); the one-partition window numbers those alone."""
    new = names.select(name).distinct().join(known, name, "left_anti")
    top = known.agg(F.coalesce(F.max(number), F.lit(0)).alias("top")).first()["top"]
    return known.select(number, name).unionByName(new.select((F.row_number().over(Window.orderBy(name)) + top).cast("bigint").alias(number), name))


def undo(df: DataFrame, key: str, when: str) -> DataFrame:
    """``df`` without the row that was written last (one aggregate; ties go by the greatest key)."""
    last = df.agg(F.max_by(key, F.struct(when, key)).alias(key))
    return df.join(F.broadcast(last), key, "left_anti")  # one row


def add(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the new rows; a key that is there already is an error when the result is read."""
    twice = new.join(base.select(*keys, F.lit(True).alias("__there")).distinct(), keys, "left")
    fail = F.raise_error(F.concat_ws(" ", F.lit("already there:"), *[F.col(k).cast("string") for k in keys]))
    checked = twice.withColumn(keys[0], F.when(F.col("__there"), fail.cast(new.schema[keys[0]].dataType)).otherwise(F.col(keys[0])))
    return base.unionByName(checked.drop("__there").select(*new.columns))


def remove(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def append_new(path: str, rows: DataFrame, keys: list[str]) -> int:
    """Appends the rows whose keys the Parquet table at ``path`` lacks (a cache of captured pages) and
    says how many; the first call makes the table."""
    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def save(df: DataFrame, path: str) -> str:
    """Writes a snapshot in a new folder under ``path`` and then names it in the file CURRENT, in one
    rename: a reader sees the old snapshot or the new one, never half of one."""
    spark = df.sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    jvm = spark._jvm
    here = jvm.org.apache.hadoop.fs.Path(path)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(here.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    fresh = jvm.org.apache.hadoop.fs.Path(here, f"{name}.name")
    fs = here.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(fresh)
    out.write(name.encode())
    out.close()
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = rename
    files.rename(fresh, jvm.org.apache.hadoop.fs.Path(here, "CURRENT"), options)
    return name


def load(spark, path: str, schema: T.StructType | str) -> DataFrame:
    """The snapshot that CURRENT names; an empty table where there is none."""
    jvm = spark._jvm
    current = jvm.org.apache.hadoop.fs.Path(path, "CURRENT")
    fs = current.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(current):
        return spark.createDataFrame([], schema)
    name = spark.read.text(f"{path}/CURRENT").first()[0]
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def load_json(spark, path: str, schema: str) -> DataFrame:
    """A JSON document as rows; a missing file is an empty table, broken JSON or a wrong shape an error."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


#: Checks in a row without progress after which a title is switched off.
IDLE_CHECKS = 5


def wanted_chapters(tracked: DataFrame) -> DataFrame:
    """(id, n, known) that a check of (id, last_known, seen, failed: array) tries, in order: all chapters where the
    index shows new ones, else those that failed before. ``known`` ones were got before and need no fetch."""
    news = F.col("seen") > F.col("last_known")
    numbers = F.when(news, F.sequence(F.lit(1).cast("bigint"), F.col("seen"))).when(F.col("seen").isNotNull(), F.col("failed"))
    rows = tracked.select("id", "last_known", "failed", F.explode(numbers).alias("n"))
    return rows.select("id", "n", ((F.col("n") <= F.col("last_known")) & ~F.coalesce(F.array_contains("failed", F.col("n")), F.lit(False))).alias("known"))


def check_states(tracked: DataFrame, dry: bool = False, idle_checks: int = IDLE_CHECKS, breaker: int = 3) -> DataFrame:
    """Adds status, fetched, new_last, still_failed, idle, enabled and last_error to rows with last_known, seen
    (chapters now; null: could not be told), failed (array of chapters that failed before), idle, and what trying
    the :func:`wanted_chapters` gave: attempted, failed_now (array) and stopped_at (null where nothing was tried).

    With news, what counts as fetched is the chapters held after the check beyond those known before it, not
    the index's difference: failures do not count. Else it is the failed ones got this time."""
    delta, had = F.col("seen") - F.col("last_known"), F.coalesce(F.size("failed") > 0, F.lit(False))
    got = F.coalesce(F.col("attempted") - F.size("failed_now"), F.lit(0))
    quiet = F.col("seen").isNull() | ((delta <= 0) & ~had)
    idle_now = quiet | F.lit(dry)
    fetched = F.when(idle_now, 0).when(delta > 0, F.greatest(got - F.col("last_known"), F.lit(0))).otherwise(got).cast("bigint")
    idle = F.when(idle_now, F.col("idle")).when(fetched > 0, 0).otherwise(F.col("idle") + 1).cast("bigint")
    off = ~idle_now & (idle >= idle_checks)
    status = F.when(F.col("seen").isNull(), "error").when(quiet, "unchanged").when(F.lit(dry), "dry-run").when(off, "disabled").when(fetched > 0, "updated").otherwise("no-progress")
    tripped = ~idle_now & (delta > 0) & F.col("stopped_at").isNotNull()
    error = (
        F.when(F.col("seen").isNull(), "could not determine chapter count")
        .when(off, F.lit(f"switched off after {idle_checks} checks in a row without progress"))
        .when(tripped, F.concat(F.lit(f"circuit breaker: {breaker} consecutive failures starting at chapter "), F.col("stopped_at").cast("string")))
    )
    new_last = F.when(~idle_now & (delta > 0), F.coalesce(F.col("stopped_at") - 1, F.col("seen"))).otherwise(F.col("last_known")).cast("bigint")
    still = F.when(idle_now, F.coalesce("failed", F.array().cast("array<bigint>"))).otherwise(F.coalesce("failed_now", F.array().cast("array<bigint>")))
    return tracked.withColumns({"status": status, "fetched": fetched, "new_last": new_last, "still_failed": still, "__idle": idle, "last_error": error}).drop("idle").withColumnRenamed("__idle", "idle")
