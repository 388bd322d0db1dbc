"""Ordered runs per key: breakers, counters and proportional interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def in_ranges(df: DataFrame, order: list, rows: int = 1_000_000) -> DataFrame:
    """Adds __range: ``df`` dealt by ``order`` into ranges of about ``rows`` rows, so that a hot key spans several."""
    ranges = df.count() // rows + 1
    if ranges == 1:
        return df.withColumn("__range", F.lit(0))
    return materialize(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which null keys meet."""
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return left.join(other, cond, "left").drop(*[f"__r_{c}" for c in on])


def numbered_within(df: DataFrame, key: str, order: list[str], name: str = "n", rows: int = 1_000_000) -> DataFrame:
    """Adds the place (1, 2, ...) of a row among those of its key, in the order of ``order``.

    A key that spans ranges is numbered range by range; what earlier ranges hold of it is added."""
    dealt = in_ranges(df, [key, *order], rows)
    at = F.row_number().over(Window.partitionBy("__range", key).orderBy(*order)).cast("bigint")
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__size"))
    # a range goes on with one key at most, so this has a row per range at most
    offsets = sizes.withColumn("__before", F.sum("__size").over(before)).filter("__before is not null").drop("__size")
    return _join(dealt.withColumn(name, at), offsets, [key, "__range"]).withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0).cast("bigint"))).drop("__range", "__before")


def breaker(df: DataFrame, k: int = 3, key: str = "key", n: str = "n", ok: str = "ok", rows: int = 1_000_000) -> DataFrame:
    """key, stopped_at (start of the first run of ``k`` failures, or null), attempted, failed (sorted).

    Nothing after the failure that trips the breaker is attempted. Gaps and islands: the number
    of successes so far names a run. Runs are found in each range of a key alone; the failures at
    the end of a range are carried to the run that its successor begins with."""
    dealt = in_ranges(df.select(key, n, ok), [key, n], rows)
    bad = ~F.col(ok)
    w = Window.partitionBy("__range", key).orderBy(n)
    marked = dealt.withColumn("__run", F.coalesce(F.sum(F.col(ok).cast("int")).over(w), F.lit(0).cast("bigint")))
    marked = marked.withColumn("__at", F.sum(bad.cast("int")).over(Window.partitionBy("__range", key, "__run").orderBy(n)))
    found = marked.groupBy(key, "__range", "__run").agg(F.count_if(bad).alias("__len"), F.min(F.when(bad, F.col(n))).alias("__start"), F.array_sort(F.collect_list(F.when(bad & (F.col("__at") <= k), F.col(n)))).alias("__first"))
    ends = found.groupBy(key, "__range").agg(F.max("__run").alias("__last"), F.max_by("__len", "__run").alias("__len"), F.max_by("__start", "__run").alias("__start"))
    by_range = Window.partitionBy(key).orderBy("__range")
    island = Window.partitionBy(key, "__island").orderBy("__range")
    ends = ends.withColumn("__island", F.count_if(F.col("__last") > 0).over(by_range))
    ends = ends.select(key, "__range", F.sum("__len").over(island).alias("__sum"), F.min("__start").over(island).alias("__from"))
    carry = ends.select(key, "__range", F.lag("__sum").over(by_range).alias("__carry"), F.lag("__from").over(by_range).alias("__from")).filter("__carry > 0").withColumn("__run", F.lit(0).cast("bigint"))
    need = F.lit(k) - F.coalesce("__carry", F.lit(0))
    trips = _join(found, carry, [key, "__range", "__run"]).withColumn("__trip", F.when((need >= 1) & (F.size("__first") >= need), F.get("__first", need.cast("int") - 1))).filter("__trip is not null")
    trips = trips.groupBy(key).agg(F.min_by(F.coalesce("__from", "__start"), "__trip").alias("__stop"), F.min("__trip").alias("__trip"))
    kept = _join(dealt, trips, [key]).filter(F.col("__trip").isNull() | (F.col(n) <= F.col("__trip")))
    return kept.groupBy(key).agg(F.max("__stop").alias("stopped_at"), F.count(F.lit(1)).alias("attempted"), F.array_sort(F.collect_list(F.when(bad, F.col(n)))).alias("failed"))


def until_failure(df: DataFrame, key: str = "key", n: str = "n", ok: str = "ok") -> DataFrame:
    """The rows of each key up to and with its first failure."""
    stop = df.groupBy(key).agg(F.min(F.when(~F.col(ok), F.col(n))).alias("__stop"))
    return _join(df, stop, [key]).filter(F.col("__stop").isNull() | (F.col(n) <= F.col("__stop"))).drop("__stop")


def trailing_run(df: DataFrame, key: str = "key", n: str = "n", ok: str = "ok") -> DataFrame:
    """key and the number of failures since the last success; aggregates only, gaps in ``n`` do not count."""
    last = df.groupBy(key).agg(F.max(F.when(F.col(ok), F.col(n))).alias("__ok"))
    since = ~F.col(ok) & (F.col("__ok").isNull() | (F.col(n) > F.col("__ok")))
    return _join(df, last, [key]).groupBy(key).agg(F.count_if(since).alias("run"))


def pacing(df: DataFrame, start: float = 2.5, cap: float = 120.0, key: str = "key", n: str = "n", ok: str = "ok", asked: str = "asked", rows: int = 1_000_000) -> DataFrame:
    """key and the interval after its last row: a failure doubles it, or raises it to the ``asked`` one
    where that is not null; it never shrinks and ends at ``cap``.

    Steps are x -> min(max(a, 2^d x), cap), and so is a chain of them: each range of a key gives its
    (a, d), and a key's interval is the greatest of what its ranges ask for after all later doublings."""
    steps = throttles(df, key, n, ok, asked, rows)
    return steps.select(key, F.least(F.greatest(F.col("__a"), F.lit(start) * _power(F.col("__d"))), F.lit(cap)).alias("interval"))


def _power(d):
    return F.pow(F.lit(2.0), F.least(d, F.lit(1000)))  # far beyond any cap


def throttles(df: DataFrame, key: str = "key", n: str = "n", ok: str = "ok", asked: str = "asked", rows: int = 1_000_000) -> DataFrame:
    """(key, __a, __d) of all rows of a key: they lead from an interval x to max(__a, 2^__d x)."""
    double = (~F.col(ok) & F.col(asked).isNull()).cast("int")
    w = Window.partitionBy("__range", key).orderBy(n)
    dealt = in_ranges(df.select(key, n, ok, asked), [key, n], rows).withColumn("__so_far", F.sum(double).over(w))
    each = dealt.withColumn("__all", F.sum(double).over(Window.partitionBy("__range", key)))
    each = each.groupBy(key, "__range").agg(F.max("__all").alias("__d"), F.max(F.when(~F.col(ok), F.col(asked) * _power(F.col("__all") - F.col("__so_far")))).alias("__a"))
    later = F.coalesce(F.sum("__d").over(Window.partitionBy(key).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("__a", F.col("__a") * _power(later)).groupBy(key).agg(F.max("__a").alias("__a"), F.sum("__d").alias("__d"))


def learned(known: DataFrame, requests: DataFrame, default: float = 2.5, cap: float = 120.0) -> DataFrame:
    """(site, interval) after ``requests`` (site, n, ok, asked) from those ``known`` before.

    A site starts at what it has learned, or at ``default`` where that is more; only sites that were throttled
    are written, never below what they had and up to ``cap``."""
    steps = throttles(requests.withColumnRenamed("site", "key")).withColumnRenamed("key", "site")
    now = F.greatest(F.coalesce("interval", F.lit(0.0)), F.lit(default))
    pushed = (F.col("__d") > 0) | F.col("__a").isNotNull()
    wide = F.least(F.greatest(F.col("__a"), now * _power(F.col("__d")), now), F.lit(cap))
    return known.join(steps, "site", "full_outer").select("site", F.when(F.coalesce(pushed, F.lit(False)), wide).otherwise(F.col("interval")).alias("interval")).filter("interval is not null")


def load_intervals(spark, path: str) -> DataFrame:
    """(site, interval) of a JSON object; a file that is missing, broken or not all numbers has learned nothing."""
    none = spark.createDataFrame([], "site string, interval double")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return none
    pairs = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    rows = spark.read.text(path, wholetext=True).select(F.explode(pairs).alias("site", "said")).select("site", F.col("said").try_cast("double").alias("interval"))
    return none if rows.filter("interval is null").limit(1).count() else rows


def numbered(df: DataFrame, order: list, name: str = "pos", start: int = 1, rows: int = 1_000_000) -> DataFrame:
    """Adds a gapless long number in the order of the columns ``order`` (they should tell rows apart).

    A range-partitioned sort of about ``rows`` rows a range; only a count per range reaches the
    driver, so no task sees the whole table."""
    ranges = df.count() // rows + 1
    dealt = materialize(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    counts = sorted((r["__range"], r["count"]) for r in dealt.groupBy("__range").count().collect())
    offsets, total = [], start - 1
    for at, n in counts:
        offsets.append((at, total))
        total += n
    first = df.sparkSession.createDataFrame(offsets, "__range int, __first long")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__at", within).join(F.broadcast(first), "__range").withColumn(name, (F.col("__first") + F.col("__at")).cast("bigint")).drop("__range", "__at", "__first")  # a row per range


def interleave(df: DataFrame, bucket: str, order: str) -> DataFrame:
    """Adds pos: item k of a bucket of N stands at the k-th partial sum of 1/N (in double, like a
    counter that is stepped), ties by bucket, then by place in it."""
    w = Window.partitionBy(bucket).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(bucket))
    out = df.withColumn("__one", F.lit(1.0) / n).withColumn("__mark", F.sum("__one").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__k", F.row_number().over(w))
    return numbered(out, ["__mark", bucket, "__k"]).drop("__one", "__mark", "__k")


def first_open(queue: DataFrame, order: str, skipped, otherwise=None, by: list[str] | None = None, key: str = "id") -> DataFrame:
    """The first row of ``queue`` whose key is not skipped; with none left, the first of ``otherwise()`` by ``by``."""
    left = queue.filter(~F.col(key).isin(list(skipped))).orderBy(order).limit(1)
    if otherwise is None or left.count():
        return left
    return otherwise().filter(~F.col(key).isin(list(skipped))).orderBy(*by).limit(1)


def seed_queue(u: DataFrame, target: int = 200) -> DataFrame:
    """(id, bucket, pos) of (id, cluster_id; -1: outlier): equal shares of the clusters and a proportional
    share of the outliers, interleaved. Three counts reach the driver."""
    n_real, outliers, n = u.agg(F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))), F.count_if(F.col("cluster_id") == -1), F.count(F.lit(1))).first()
    per = max(1, target // max(1, n_real))
    ranked = u.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy("id")))
    real = numbered(ranked.filter((F.col("cluster_id") != -1) & (F.col("rn") <= per)), ["rn", "cluster_id"], "k").select("id", F.lit(1).alias("bucket"), "k")
    taken, share = real.count(), outliers / n if n else 0.0
    quota = round(taken * share / (1 - share)) if 0 < share < 1 else outliers
    out = ranked.filter((F.col("cluster_id") == -1) & (F.col("rn") <= quota)).select("id", F.lit(0).alias("bucket"), F.col("rn").cast("bigint").alias("k"))
    return interleave(out.unionByName(real), "bucket", "k").select("id", "bucket", "pos")
