"""The page frontier of paged catalogs: which page of each site is next, over runs that stop and go on.

A run offers attempts (site, page, attempt, kind, has_next) in any order; kinds are good, empty (fetched, but
without entries), error and gone (404). A page is good at its first good attempt, gone at a 404, failed after
``ERRORS`` retried errors in a row and stuck after ``EMPTIES`` retries of an empty page, whichever comes
first; until then it waits, and its counts go on in the next run. A site's next page moves over the run of
good pages that begins at it, and no further: what is good beyond a gap is remembered until the gap is closed.
A listing that says it has no next page ends behind its page. Only counts and page numbers are state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

ERRORS, EMPTIES = 5, 3
#: Attempts after which a page is decided: each of the first and the retried fetches errs at most that often.
ENOUGH = (EMPTIES + 1) * (ERRORS + 1)
STATE = "site string, next_page long, reason string"
PAGES = "site string, page long, verdict string, errors int, empties int, last boolean"


def verdict(attempts: Column, errors: Column, empties: Column) -> Column:
    """struct(verdict, errors, empties, last) after an array of struct(kind, has_next) in order, from counts so far."""
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("verdict"), F.coalesce(errors, F.lit(0)).alias("errors"), F.coalesce(empties, F.lit(0)).alias("empties"), F.lit(False).alias("last"))

    def step(s, a):
        errs = F.when(a["kind"] == "error", s["errors"] + 1).otherwise(0)
        void = s["empties"] + (a["kind"] == "empty").cast("int")
        now = F.when(a["kind"] == "good", "good").when(a["kind"] == "gone", "gone").when(errs > ERRORS, "failed").when(void > EMPTIES, "stuck")
        after = F.struct(now.alias("verdict"), errs.alias("errors"), void.alias("empties"), ((a["kind"] == "good") & ~F.coalesce(a["has_next"], F.lit(True))).alias("last"))
        return F.when(s["verdict"].isNotNull(), s).otherwise(after)

    return F.aggregate(attempts, start, step)


def judged(attempts: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of an earlier run (PAGES) and of ``attempts``, each with its verdict (null: it waits).

    Pages that were good stay so; others are judged by this run's attempts, a decided one from the start. ``tried`` says
    whether this run has any."""
    place = F.row_number().over(Window.partitionBy("site", "page").orderBy("attempt", "kind", "has_next"))
    few = attempts.select("site", "page", "attempt", "kind", "has_next").withColumn("__n", place).filter(F.col("__n") <= ENOUGH)
    tried = few.groupBy("site", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "kind", "has_next"))), lambda x: F.struct(x["kind"].alias("kind"), x["has_next"].alias("has_next"))).alias("__tried"))
    both = pages.join(tried, ["site", "page"], "full_outer")
    carried = lambda c: F.when(F.col("verdict").isNull(), F.col(c))
    now = verdict(F.col("__tried"), carried("errors"), carried("empties"))
    kept = F.struct("verdict", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("empties", F.lit(0)).alias("empties"), F.coalesce("last", F.lit(False)).alias("last"))
    return both.withColumn("__v", F.when((F.col("verdict") == "good") | F.col("__tried").isNull(), kept).otherwise(now)).select("site", "page", "__v.*", F.col("__tried").isNotNull().alias("tried"))


def advance(state: DataFrame, pages: DataFrame, attempts: DataFrame, first: int = 0, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(STATE, PAGES) after a run. New sites begin at page ``first``; a run moves by ``most`` pages at the most.

    The reason says why a site stands where it does: open (the page was not tried), waiting, empty, failed, end (404: it is
    tried again next time, as catalogs grow), last (the listing's own end) or limit. One join of the good pages with
    themselves finds the gaps, so a site with any number of pages is spread over tasks. The attempts are sorted once: the verdicts,
    which several steps read, are written before."""
    seen = materialize(judged(attempts, pages), "verdicts")
    known = state.select("site", F.col("next_page").alias("start")).join(seen.filter("tried").select("site").distinct(), "site", "full_outer").select("site", F.coalesce("start", F.lit(first).cast("bigint")).alias("start"))
    seen = known.join(seen, "site").filter("page >= start")
    good = seen.filter("verdict = 'good'").select("site", "start", "page", "last")
    follows = good.select("site", (F.col("page") - 1).alias("page"), F.lit(True).alias("__on"))
    stops = good.join(follows, ["site", "page"], "left").filter("__on is null or last").groupBy("site").agg(F.min(F.struct((F.col("page") + 1).alias("next"), "last")).alias("stop"))
    begun = good.filter("page = start").select("site", F.lit(True).alias("__begun")).distinct()
    at = known.join(begun, "site", "left").join(stops, "site", "left")
    reach = F.when(F.col("__begun"), F.col("stop.next")).otherwise(F.col("start"))
    bound = reach if most is None else F.least(reach, F.col("start") + most)
    at = at.select("site", "start", bound.alias("next_page"), (F.col("__begun") & F.col("stop.last") & (bound == F.col("stop.next"))).alias("__last"), (bound < reach).alias("__cut"))
    names = F.when(F.col("verdict") == "gone", "end").when(F.col("verdict") == "stuck", "empty").when(F.col("verdict") == "failed", "failed")
    there = seen.select("site", F.col("page").alias("next_page"), F.coalesce(names, F.lit("waiting")).alias("__why"))
    full = F.lit(False) if most is None else F.col("next_page") >= F.col("start") + most
    why = F.when(F.coalesce("__last", F.lit(False)), "last").when(F.col("__cut") | full, "limit").otherwise(F.coalesce("__why", F.lit("open")))
    new = at.join(there, ["site", "next_page"], "left").select("site", "next_page", why.alias("reason"))
    ahead = seen.join(new.select("site", "next_page"), "site").filter((F.col("page") >= F.col("next_page")) & (F.col("verdict").isNull() | (F.col("verdict") == "good")))
    return new, ahead.select("site", "page", "verdict", "errors", "empties", "last")


def fold(state: tuple, attempts: list[tuple]) -> tuple:
    """The same for one site and a few attempts (page, attempt, kind, has_next), as a stream's state needs it:
    (next page, reason, {page: (verdict, errors, empties, last)}) goes in and comes out."""
    at, _, held = state
    pages = dict(held)
    for page, _, kind, has_next in sorted(attempts, key=lambda a: (a[0], a[1], a[2], a[3] is not None, a[3] or False)):
        was, errors, empties, _ = pages.get(page, (None, 0, 0, False))
        if was is not None or page < at:
            continue
        errors, empties = errors + 1 if kind == "error" else 0, empties + (kind == "empty")
        now = kind if kind in ("good", "gone") else "failed" if errors > ERRORS else "stuck" if empties > EMPTIES else None
        pages[page] = (now, errors, empties, kind == "good" and has_next is False)
    reason = None
    while reason is None and pages.get(at, (None,))[0] == "good":
        reason = "last" if pages[at][3] else None
        at += 1
    if reason is None:
        why = {"gone": "end", "stuck": "empty", "failed": "failed", None: "waiting", "good": "open"}
        reason = why[pages[at][0]] if at in pages else "open"
    return at, reason, {p: v for p, v in pages.items() if p >= at and v[0] in (None, "good")}
