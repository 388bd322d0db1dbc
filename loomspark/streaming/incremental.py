"""Structured Streaming twins: incremental upserts and a stateful breaker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frontier import fold as page_fold


def ingest(stream: DataFrame, apply_batch, checkpoint: str):
    """Run all that is there once (availableNow), with the progress kept in ``checkpoint``; a failed
    batch is not marked done, so it is run again."""
    q = stream.writeStream.foreachBatch(lambda df, _: apply_batch(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window, with late data bounded by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def breaker(stream: DataFrame, k: int = 3, late: str = "10 minutes") -> DataFrame:
    """(key, run, tripped) after each batch: consecutive failures per key as state.

    Rows wait in the state until the watermark has passed their ``ts``, and then count in the order
    of (ts, event_id), however batches and chunks cut them; what is later than the watermark is
    dropped by it. The last rows count when the watermark passes them."""

    def step(key, frames, state):
        import pandas as pd

        run, tripped, waiting = state.get if state.exists else (0, False, [])
        waiting = [tuple(w) for w in waiting]
        for pdf in frames:
            waiting += zip(pdf["ts"].astype("datetime64[us]").astype("int64").tolist(), pdf["event_id"].tolist(), pdf["ok"].tolist(), strict=True)
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        while waiting and waiting[0][0] <= passed:
            ok = waiting.pop(0)[2]
            if not tripped:
                run = 0 if ok else run + 1
                tripped = run >= k
        state.update((run, tripped, waiting))
        if waiting:
            state.setTimeoutTimestamp(waiting[0][0] // 1000 + 1)
        yield pd.DataFrame({"key": [key[0]], "run": [run], "tripped": [tripped]})

    held = "run int, tripped boolean, waiting array<struct<ts:long,event_id:long,ok:boolean>>"
    return stream.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "key long, run int, tripped boolean", held, "update", "EventTimeTimeout")


def frontier(stream: DataFrame, first: int = 0) -> DataFrame:
    """(site, next_page, reason) of each site that a batch of page attempts (site, page, attempt, kind, has_next) touches.

    The state of a site is its next page and the pages at or behind it that are good or wait, as in
    ``operators.frontier``; a stopped query goes on from its checkpoint."""

    def step(key, frames, state):
        import pandas as pd

        at, reason, held = state.get if state.exists else (first, "open", [])
        pages = {p: (v, e, m, last) for p, v, e, m, last in held}
        tried = [t for pdf in frames for t in zip(pdf["page"].tolist(), pdf["attempt"].tolist(), pdf["kind"].tolist(), (None if pd.isna(x) else bool(x) for x in pdf["has_next"]), strict=True)]
        at, reason, pages = page_fold((at, reason, pages), tried)
        state.update((at, reason, [(p, *v) for p, v in sorted(pages.items())]))
        yield pd.DataFrame({"site": [key[0]], "next_page": [at], "reason": [reason]})

    held = "next_page long, reason string, pages array<struct<page:long,verdict:string,errors:int,empties:int,last:boolean>>"
    return stream.groupBy("site").applyInPandasWithState(step, "site string, next_page long, reason string", held, "update", "NoTimeout")
