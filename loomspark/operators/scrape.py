"""The scrape loop: cached and fetched pages of many titles parsed in order, up to a circuit breaker."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import materialize
from .runs import numbered_within

PER_ROUND = 256


def pages_of(wanted: DataFrame, cached: DataFrame, fetched: DataFrame, use_cache: bool = True) -> DataFrame:
    """(id, n, origin, html, error) of each wanted (id, n): the cached page (id, n, html) goes before the
    outcome of a fetch (id, n, html, error). A page that neither has is one that could not be got."""
    at = ["id", "n"]
    outcome = fetched.select(*at, F.col("html").alias("__web"), F.col("error").alias("__error"))
    if use_cache:
        rows = wanted.select(*at).join(cached.filter("html <> ''").select(*at, F.col("html").alias("__kept")), at, "left")
    else:
        rows = wanted.select(*at, F.lit(None).cast("string").alias("__kept"))
    hit = F.col("__kept").isNotNull()
    return rows.join(outcome, at, "left").select(*at, F.when(hit, "cache").otherwise("web").alias("origin"), F.coalesce("__kept", "__web").alias("html"), F.when(~hit & F.col("__web").isNull(), F.coalesce("__error", F.lit("not fetched"))).alias("error"))


def scrape(pages: DataFrame, parse, schema: str, breaker: int | None = 3, per_round: int = PER_ROUND) -> DataFrame:
    """(id, n, origin, label, parsed, run, start, stopped_at) of each page that was tried.

    ``pages`` are those of :func:`pages_of`; ``parse(html, n)`` gives a dict of ``schema`` or raises. A page
    that was not got or does not parse is a failure, whose reason is its label (else null). After ``breaker``
    failures in a row a title ends: nothing behind is parsed, and ``stopped_at`` is the first of them. ``run``
    and ``start`` are the failures in a row up to the page. Titles go on in rounds of ``per_round`` pages with that state,
    so a task holds a round of a title, whatever its length, and one title's end costs the others nothing."""
    spark = pages.sparkSession
    dealt = materialize(numbered_within(pages, "id", ["n"], "__place").withColumn("__round", F.expr(f"(__place - 1) div {per_round}")), "scrape-pages")
    out = spark.createDataFrame([], f"id {dict(pages.dtypes)['id']}, n long, origin string, label string, parsed struct<{schema}>, run int, start long, stopped_at long").schema
    arrow = to_arrow_schema(out)
    none = spark.createDataFrame([], f"id {dict(pages.dtypes)['id']}, run int, start long, stopped_at long")

    def fold(key, rows, state):
        run, start = (state["run"][0].as_py(), state["start"][0].as_py()) if state.num_rows else (0, None)
        got: dict = {f.name: [] for f in arrow}
        for n, origin, html, error in sorted(zip(*(rows[c].to_pylist() for c in ("n", "origin", "html", "error")), strict=True), key=lambda r: r[0]):
            parsed = None
            if error is None:
                try:
                    parsed = parse(html, n)
                except Exception as e:  # noqa: BLE001  the error is the value
                    error = f"{type(e).__name__}: {e}"
            run, start = (0, None) if error is None else (run + 1, start if run else n)
            tripped = breaker is not None and run >= breaker
            for name, v in zip(got, (key[0].as_py(), n, origin, error, parsed, run, start, start if tripped else None), strict=True):
                got[name].append(v)
            if tripped:
                break
        return pa.table([pa.array(v, f.type) for v, f in zip(got.values(), arrow, strict=True)], schema=arrow)

    rounds = (dealt.agg(F.max("__round")).first()[0] or 0) + 1
    whole, state = None, none
    for r in range(rounds):
        rows = dealt.filter(F.col("__round") == r).select("id", "n", "origin", "html", "error")
        if whole is not None:
            rows = rows.join(whole.filter("stopped_at is not null").select("id"), "id", "left_anti")
        done = materialize(rows.groupBy("id").cogroup(state.filter("stopped_at is null").groupBy("id")).applyInArrow(lambda key, a, b: fold(key, a, b) if a.num_rows else arrow.empty_table(), out), "scraped")
        whole = done if whole is None else whole.unionAll(done)
        # a title of the next round has pages in this one
        state = done.groupBy("id").agg(F.max_by(F.struct("run", "start", "stopped_at"), "n").alias("s")).select("id", "s.*")
    return whole


def summary(tried: DataFrame) -> DataFrame:
    """(id, chapters, cached, failed, stopped_at) of a :func:`scrape`; a title's failures are its one array."""
    bad = F.col("label").isNotNull()
    return tried.groupBy("id").agg(
        F.count_if(~bad).alias("chapters"), F.count_if(~bad & (F.col("origin") == "cache")).alias("cached"),
        F.array_sort(F.collect_list(F.when(bad, F.col("n")))).alias("failed"), F.max("stopped_at").alias("stopped_at"),
    )
