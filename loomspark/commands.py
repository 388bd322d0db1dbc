"""The library's commands as methods over stored tables: crawl, label, update and scrape.

Each method reads the current snapshots, composes operators and writes new snapshots. What comes
from the network comes in as tables of captured pages. A page that fails is counted and leaves its
row as it was; the others go on. ``progress`` is called with (command, counts) after each one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import frontier, graph, keyed, learning, resolve, runs, search, tables
from .operators import scrape as scraping
from .scratch import materialize
from .sources import epub, html
from .sources.site import Site, Unsupported, site_for

SCHEMAS = {
    "catalog": "id long, site_key string, url string, title string, chapter_count int, status string, updated_text string, alt_title string, author string, rating string, synopsis string, genres array<string>, resolution string, best long, best_name string, best_genres array<string>, best_tags array<string>, cluster_id long, sampled_at long",
    "listings": "url string, title string",
    "frontier": frontier.STATE,
    "frontier_pages": frontier.PAGES,
    "bad_pages": "site string, page long, attempt int, reason string, html string",
    "chapters": "id long, n int, title string, body_html string",
    "labels": "id long, label string, source string, labeled_at long",
    "vectors": "id long, vector array<double>",
    "tracked": "id long, site_key string, url string, title string, last_known long, last_mailed long, enabled boolean, failed array<bigint>, idle long, last_error string",
    "cache": "id string, n long, html string",
    "pacing": "site string, interval double",
}
KEYS = {"listings": ["url"], "frontier": ["site"], "frontier_pages": ["site", "page"], "bad_pages": ["site", "page", "attempt"], "chapters": ["id", "n"], "cache": ["id", "n"], "pacing": ["site"]}
CARD = "title:string,url:string,chapter_id:string,chapters:int,status:string,updated_text:string"
DETAILS = "alt_title:string,author:string,rating:string,status:string,genres:array<string>,synopsis:string"
LISTING = "hits:array<struct<title:string,url:string>>,has_next:boolean"


class Library:
    def __init__(self, spark: SparkSession, path: str, sites: list[Site], progress: Callable[[str, dict], None] | None = None):
        self.spark, self.path, self.sites, self.progress = spark, path.rstrip("/"), sites, progress or (lambda name, counts: None)

    def table(self, name: str) -> DataFrame:
        return keyed.load(self.spark, f"{self.path}/{name}", SCHEMAS[name])

    def _change(self, name: str, delta: DataFrame, merge, at: keyed.Version | None = None) -> None:
        keyed.change(f"{self.path}/{name}", delta, KEYS.get(name, ["id"]), SCHEMAS[name], merge, at)

    def _put(self, name: str, delta: DataFrame, replaced: list[str] | None = None, at: keyed.Version | None = None) -> None:
        keys = KEYS.get(name, ["id"])
        columns = replaced if replaced is not None else [c for c in delta.columns if c not in keys]
        self._change(name, materialize(delta, "delta"), lambda rows, d: tables.upsert(rows, d, keys, columns), at)

    def _merge(self, name: str, delta: DataFrame, coalesced: list[str]) -> None:
        self._change(name, materialize(delta, "delta"), lambda rows, d: tables.merge_metadata(rows, d, "id", coalesced))

    def _gone(self, name: str, rows: DataFrame) -> None:
        keys = KEYS.get(name, ["id"])
        self._change(name, materialize(rows.select(*keys), "delta"), lambda old, d: tables.remove(old, d, keys))

    def expire(self, keep: int = 2) -> int:
        """Removes old versions of all tables and says how many folders went."""
        return sum(keyed.expire(self.spark, f"{self.path}/{name}", keep) for name in SCHEMAS)

    def _done(self, command: str, **counts) -> dict:
        self.progress(command, counts)
        return counts

    def _site(self, key: str) -> Site:
        return site_for(self.sites, "", key)

    # pacing

    def throttled(self, requests: DataFrame, default: float = 2.5) -> DataFrame:
        """Learns from requests (site, n, ok, asked: the pause that was asked for) and returns the intervals (site, interval)."""
        new = runs.learned(self.table("pacing").join(requests.select("site").distinct(), "site", "left_semi"), requests, default)
        self._put("pacing", new)
        return self.table("pacing")

    def gaps(self, requests: DataFrame, seed: int, default: float = 2.5) -> DataFrame:
        """(site, n, gap): the pause before each request (site, n), around what the site has taught or ``default`` if that is more."""
        known = requests.select("site", "n").join(self.table("pacing"), "site", "left")
        mean = F.greatest(F.coalesce("interval", F.lit(0.0)), F.lit(default))
        return known.select("site", "n", S.gap(mean, F.lit(seed), F.col("site"), F.col("n")).alias("gap"))

    # catalog

    def _paged(self, site: str, pages: DataFrame, parser, schema: str, many: bool, kind, has_next, first: int, start: int | None, most: int | None):
        """Parses each captured page (id: its number, html, base, and if known attempt and status) once, moves the site's
        frontier, and keeps pages without a result for a look. What one pass over the pages counts is observed in it."""
        pages = pages.withColumns({c: F.lit(v).cast("int") for c, v in (("attempt", 0), ("status", 200)) if c not in pages.columns})
        got = html.extract(pages.filter("status = 200").select(F.struct("id", "attempt").alias("key"), "html", "base"), parser, schema, many=many, key="key")
        seen = Observation()
        got = materialize(got.observe(seen, F.count(F.lit(1)).alias("pages"), F.count_if(kind != "good").alias("bad")), "pages")
        counts = seen.get if got.limit(1).count() else {"pages": 0, "bad": 0}
        lost = pages.filter("status <> 200 or status is null").select("id", "attempt", F.when(F.col("status") == 404, "gone").otherwise("error").alias("kind"), F.lit(None).cast("boolean").alias("has_next"))
        attempts = got.select("key.id", "key.attempt", kind.alias("kind"), has_next.alias("has_next")).unionAll(lost).select(F.lit(site).alias("site"), F.col("id").cast("long").alias("page"), "attempt", "kind", "has_next")
        state, held = (self.table(t).filter(F.col("site") == site) for t in ("frontier", "frontier_pages"))
        if start is not None:
            state, held = self.spark.createDataFrame([(site, start, "open")], frontier.STATE), held.limit(0)
        new, ahead = (materialize(x, "frontier") for x in frontier.advance(state, held, attempts, first, most))
        old = state.first()
        begin = old["next_page"] if old else first
        end = begin + most if most is not None else None
        fine = got.filter((kind == "good") & (F.col("key.id") >= begin) & (F.lit(True) if end is None else F.col("key.id") < end))
        bad = got.filter(kind != "good").select("key", F.coalesce("error", F.lit("nothing found")).alias("reason"))
        bad = pages.select(F.struct("id", "attempt").alias("key"), "html").join(bad, "key").select(F.lit(site).alias("site"), F.col("key.id").cast("long").alias("page"), "key.attempt", "reason", "html")

        def commit() -> dict:
            """After the rows are in; a run that stops before goes over the same pages again."""
            self._put("bad_pages", tables.latest(bad, KEYS["bad_pages"], ["reason"]))
            stale = self.table("frontier_pages").filter(F.col("site") == site).join(ahead, ["site", "page"], "left_anti")
            self._gone("frontier_pages", stale)
            self._put("frontier_pages", ahead)
            self._put("frontier", new)
            at = new.first()
            return {"pages": counts["pages"] + lost.count(), "failed": counts["bad"], "next_page": at["next_page"] if at else begin, "reason": at["reason"] if at else "open"}

        return fine, commit

    def crawl(self, site_key: str, pages: DataFrame, start_page: int | None = None, most: int | None = None, refresh: bool = False) -> dict:
        """Catalog cards of captured list pages into the catalog; the later page wins. A run goes on at the page where the
        last one ended, unless ``start_page`` says otherwise, and over ``most`` pages at the most. Titles whose chapters
        are counted already are left as they are without ``refresh``."""
        kind = F.when(F.col("error").isNotNull(), "error").when(F.size("parsed") > 0, "good").otherwise("empty")
        fine, commit = self._paged(site_key, pages, "cards", CARD, True, kind, F.lit(None).cast("boolean"), 0, start_page, most)
        cards = fine.select("key", F.posexplode("parsed").alias("at", "x")).select("x.*", "key", "at")
        cards = tables.latest(cards, ["url"], ["key", "at"]).drop("key", "at").withColumn("site_key", F.lit(site_key)).withColumnRenamed("chapters", "chapter_count")
        at = keyed.version(self.spark, f"{self.path}/catalog")
        known = keyed.load(self.spark, f"{self.path}/catalog", SCHEMAS["catalog"], at)
        before = known.filter(F.col("site_key") == site_key).select("url", "id", F.col("chapter_count").alias("had"))
        cards = materialize(cards.join(before, "url", "left"), "cards")
        top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = runs.numbered(cards.filter("id is null").drop("id"), ["url"], "id", top + 1)
        again = cards.filter(F.col("id").isNotNull() & (F.lit(refresh) | F.col("had").isNull()))
        delta = materialize(fresh.select("id", "site_key", "url", "title", "chapter_count", "status", "updated_text").unionByName(again.select("id", "site_key", "url", "title", "chapter_count", "status", "updated_text")), "delta")
        n = delta.count()
        self._put("catalog", delta, ["title", "chapter_count", "status", "updated_text"], at)
        return self._done("crawl", new_or_updated=n, skipped=cards.count() - n, **commit())

    def nu_crawl(self, site_key: str, pages: DataFrame, start_page: int | None = None, most: int | None = None) -> dict:
        """Titles and addresses of captured listing pages, which start at 1 and say themselves whether one follows."""
        kind = F.when(F.col("error").isNotNull(), "error").otherwise("good")
        fine, commit = self._paged(site_key, pages, "listing", LISTING, False, kind, F.col("parsed.has_next"), 1, start_page, most)
        hits = fine.select("key", F.posexplode("parsed.hits").alias("at", "x")).select("x.url", "x.title", "key", "at").filter("url <> '' and title <> ''")
        hits = materialize(tables.latest(hits, ["url"], ["key", "at"]).select("url", "title"), "hits")
        self._put("listings", hits)
        return self._done("nu_crawl", hits=hits.count(), **commit())

    def metadata(self, site_key: str, pages: DataFrame) -> dict:
        """Details of captured title pages (url, html) into the catalog."""
        asked = self.table("catalog").filter(F.col("site_key") == site_key).select("id", "url").join(pages, "url").select("id", "html", F.col("url").alias("base"))
        seen = Observation()
        got = materialize(html.extract(asked, self._site(site_key).parser("metadata"), DETAILS).observe(seen, F.count(F.lit(1)).alias("pages"), F.count("error").alias("failed")), "details")
        self._merge("catalog", got.filter("error is null").select("id", "parsed.*"), ["status"])
        return self._done("metadata", **(seen.get if got.limit(1).count() else {"pages": 0, "failed": 0}))

    def enrich(self, catalog: DataFrame, min_chapters: int = 80) -> dict:
        """Resolves candidates without a decision against (cid, name: array of names, and if known genres and tags),
        and stores the names, genres and tags of a sure match with its number."""
        known = self.table("catalog")
        open_ = known.filter((F.col("chapter_count") >= min_chapters) & F.col("resolution").isNull())
        decided = resolve.resolve(open_.select("id", F.array("title", "alt_title").alias("title")), catalog.select("cid", "name")).select("id", F.col("decision").alias("resolution"), F.when(F.col("decision") == "auto", F.col("best")).alias("best"))
        more = {c: F.col(c) if c in catalog.columns else F.lit(None).cast("array<string>") for c in ("genres", "tags")}
        about = catalog.select(F.col("cid").alias("best"), F.get("name", F.lit(0)).alias("best_name"), more["genres"].alias("best_genres"), more["tags"].alias("best_tags"))
        decided = materialize(decided.join(about, "best", "left"), "decided")
        self._merge("catalog", decided, [])
        return self._done("enrich", **{r["resolution"]: r["count"] for r in decided.groupBy("resolution").count().collect()})

    def chapters(self, site_key: str, pages: DataFrame, count: int = 5, sampled_at: int = 0) -> dict:
        """The first chapters of captured pages (id, n, html); bodies that were got are stored, and every title that was
        looked at is stamped, so that one without chapters is not asked for again and again."""
        site = self._site(site_key).parser("chapter")
        asked = pages.filter(F.col("n") <= count).select(F.struct("id", "n").alias("key"), "html", F.col("n").cast("string").alias("base"))
        got = html.extract(asked, lambda page, n: site(page, "", int(n)), "title:string,body_html:string", key="key")
        ok, seen = F.expr("error is null and parsed.body_html <> ''"), Observation()
        got = materialize(got.observe(seen, F.count_if(ok).alias("stored"), F.count_if(~ok).alias("failed")), "bodies")
        counts = seen.get if got.limit(1).count() else {"stored": 0, "failed": 0}
        self._put("chapters", got.filter(ok).select("key.id", "key.n", "parsed.*"))
        looked = got.select("key.id").distinct().join(self.table("catalog").select("id"), "id", "left_semi")
        self._merge("catalog", looked.withColumn("sampled_at", F.lit(sampled_at).cast("long")), [])
        return self._done("chapters", **counts)

    def unsampled(self, min_chapters: int = 80) -> DataFrame:
        """Candidates whose chapters were never looked at."""
        return self.table("catalog").filter((F.col("chapter_count") >= min_chapters) & F.col("sampled_at").isNull()).select("id", "url")

    def embed(self, encoder: str = "hashing", limit: int = 200) -> dict:
        texts = self.table("catalog").filter("synopsis is not null").select("id", F.col("synopsis").alias("text"))
        old = self.table("vectors")
        new = learning.encode(texts, old, encoder, limit)
        new = materialize(new, "vectors")
        n = new.count()
        self._put("vectors", new)
        return self._done("embed", embedded=n)

    def cluster(self, dims: int = 8, min_size: int = 30, second: int = 15, most: float = 0.05) -> dict:
        found = learning.cluster_map(self.table("vectors").withColumnRenamed("vector", "features"), dims, min_size, second, most)
        known = self.table("catalog")
        self._merge("catalog", found.select("id", "cluster_id").join(known.select("id"), "id", "left_semi"), [])
        c = F.col("cluster_id")
        row = self.table("catalog").agg(F.count(c), F.countDistinct(F.when(c != -1, c)), F.count_if(c == -1)).first()
        return self._done("cluster", n=row[0], clusters=row[1], outliers=row[2])

    def tag_communities(self) -> DataFrame:
        tags = self.table("catalog").select(F.col("id").alias("item"), F.explode("genres").alias("tag"))
        return graph.communities(graph.cooccurrence(tags), tags.select(F.col("tag").alias("node")))

    def stats(self, min_chapters: int = 80) -> dict:
        wanted = F.col("chapter_count") >= min_chapters
        row = self.table("catalog").agg(
            F.count(F.lit(1)).alias("total"), F.count_if(wanted).alias("candidates"), F.count_if(wanted & F.col("synopsis").isNotNull()).alias("with_metadata"),
            F.count_if(wanted & F.col("resolution").isNotNull()).alias("resolved"), F.count_if(F.col("cluster_id").isNotNull()).alias("clustered"),
        ).first()
        return self._done("stats", **row.asDict())

    # labels

    def queue(self, target: int = 200) -> DataFrame:
        open_ = self.table("catalog").filter("cluster_id is not null").join(self.table("labels"), "id", "left_anti")
        return runs.seed_queue(open_.select("id", "cluster_id"), target)

    def label(self, rows: DataFrame) -> dict:
        """Labels (id, label, source, labeled_at); the last one of a title counts."""
        checked = rows.withColumn("label", F.when(F.col("label").isin(S.LABEL_ORDER), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.col("label"))).cast("string")))
        checked = materialize(checked, "labels")
        n = checked.count()
        newest = lambda old, new: tables.latest(old.unionByName(new.select(*old.columns)), ["id"], ["labeled_at"])
        self._change("labels", checked, newest)
        return self._done("label", labels=n)

    def import_labels(self, path: str, labeled_at: int) -> dict:
        """JSON with rows under ``labels`` or as a bare list."""
        kind = "array<struct<novel_id:long,label:string,source:string>>"
        text = self.spark.read.text(path, wholetext=True).select(F.trim("value").alias("j"))
        listed = F.when(F.col("j").startswith("["), F.from_json("j", kind, {"mode": "FAILFAST"})).otherwise(F.from_json("j", f"labels {kind}", {"mode": "FAILFAST"})["labels"])
        rows = text.select(F.inline(listed))
        return self.label(rows.select(F.col("novel_id").alias("id"), "label", F.coalesce("source", F.lit("cold")).alias("source"), F.lit(labeled_at).cast("long").alias("labeled_at")))

    def undo(self) -> dict:
        before = self.table("labels")
        last = materialize(before.join(tables.undo(before, "id", "labeled_at").select("id"), "id", "left_anti").select("id"), "undo")
        self._gone("labels", last)
        return self._done("undo", removed=last.count())

    def next(self, skipped=()) -> int | None:
        """The next title to judge: of the queue, else the one the model is least sure of, else none."""

        def unsure():
            labels, vectors = self.table("labels"), self.table("vectors").withColumnRenamed("vector", "features")
            good = F.when(F.col("label").isin(S.POSITIVE_LABELS), 1).otherwise(0)
            model = learning.train_uncertainty(vectors.join(labels.select("id", good.alias("y"), F.when(F.col("source") == "read", 2.0).otherwise(1.0).alias("weight")), "id"))
            left = vectors.join(labels, "id", "left_anti")
            return left.select("id", F.lit(0.5).alias("p")).limit(0) if model is None else learning.rank_uncertain(model, vectors, labels.select("id"))

        row = runs.first_open(self.queue(), "pos", skipped, lambda: unsure().withColumn("margin", F.abs(F.col("p") - 0.5)), ["margin", "id"]).first()
        return row["id"] if row else None

    def export(self, path: str) -> None:
        """Search index and review batch as JSON lines."""
        index = self.table("catalog").filter("synopsis is not null").select(F.lit("search_index").alias("part"), "id", "title", F.lit(None).cast("long").alias("pos"))
        batch = self.queue().join(self.table("catalog").select("id", "title"), "id").select(F.lit("review_batch").alias("part"), "id", "title", "pos")
        index.unionByName(batch).write.mode("overwrite").json(path)

    # tracked titles

    def add(self, rows: DataFrame) -> dict:
        """Tracked titles (id, site_key, url, title); one that is there already is an error."""
        none = F.array().cast("array<bigint>")
        new = rows.withColumns({"last_known": F.lit(0).cast("long"), "last_mailed": F.lit(0).cast("long"), "enabled": F.lit(True), "failed": none, "idle": F.lit(0).cast("long"), "last_error": F.lit(None).cast("string")})
        self._change("tracked", materialize(new, "delta"), lambda old, d: tables.add(old, d.select(*old.columns), ["id"]))
        return self._done("add", tracked=self.table("tracked").count())

    def remove(self, ids: list[int]) -> bool:
        there = materialize(self.table("tracked").filter(F.col("id").isin(list(ids))).select("id"), "remove")
        self._gone("tracked", there)
        return there.count() > 0

    def search(self, site_key: str, page: str) -> list[dict]:
        """Results of a captured answer; see Site.search_request for what to ask."""
        return self._site(site_key).parser("search")(page, "")

    def find(self, needle: str, limit: int = 15) -> DataFrame:
        return self.table("catalog").filter(S.like_ascii(F.col("title"), needle)).orderBy("title", "id").limit(limit)

    def grep(self, needle: str, context: int = 60, ignore_case: bool = True) -> DataFrame:
        """Places of the needle in the stored chapters: (id, n, title, k, snippet)."""
        hits = self.table("chapters").select("id", "n", "title", F.explode(S.snippets(S.plain_text(F.col("body_html")), needle, context, ignore_case)).alias("h"))
        return hits.select("id", "n", "title", "h.k", "h.snippet")

    def add_books(self, files: DataFrame) -> dict:
        """Indexes EPUB files (path, content) for :meth:`grep_books`; those that are there already are left alone."""
        return self._done("add_books", added=search.add(self.spark, f"{self.path}/books", files))

    def grep_books(self, needle: str, context: int = 60, ignore_case: bool = True) -> DataFrame:
        """Places of the needle in the chapters of indexed files: (path, name, title, k, snippet)."""
        return search.grep(self.spark, f"{self.path}/books", needle, context, ignore_case)

    def check(self, indexes: DataFrame, attempts: DataFrame, dry: bool = False, only: list[int] | None = None, breaker: int = 3) -> dict:
        """Compares tracked titles with captured index pages (id, html) and the outcomes of fetching
        chapters (id, n, ok), and brings the bookkeeping up to date; a title's fault stays its own.
        A chapter that is wanted and has no outcome counts as one that was not got."""
        known = self.table("tracked")
        chosen = known.filter(F.col("id").isin(list(only))) if only is not None else known.filter("enabled")
        seen = self.spark.createDataFrame([], "id long, seen long")
        for site in self.sites:  # few
            try:
                parse = site.parser("index")
            except Unsupported:
                continue
            mine = chosen.filter(F.col("site_key") == site.key).select("id", F.col("url").alias("base")).join(indexes, "id")
            seen = seen.unionByName(html.extract(mine, parse, "title:string,chapter_id:string,total:long").select("id", F.col("parsed.total").alias("seen")))
        state = materialize(chosen.join(seen, "id", "left"), "checked")
        wanted = tables.wanted_chapters(state).join(attempts.select("id", "n", "ok"), ["id", "n"], "left")
        tried = runs.breaker(wanted.select(F.col("id").alias("key"), "n", (F.col("known") | F.coalesce("ok", F.lit(False))).alias("ok")), breaker)
        state = state.join(tried.select(F.col("key").alias("id"), "attempted", F.col("failed").alias("failed_now"), "stopped_at"), "id", "left")
        state = materialize(tables.check_states(state, dry, breaker=breaker), "states")
        if not dry:
            delta = state.select("id", F.col("new_last").alias("last_known"), F.col("still_failed").alias("failed"), "idle", (F.col("enabled") & (F.col("status") != "disabled")).alias("enabled"), "last_error")
            self._merge("tracked", delta, [])
        return self._done("check", **{r["status"]: r["count"] for r in state.groupBy("status").count().collect()})

    def mail(self, threshold: int = 100, force: bool = False) -> DataFrame:
        """(id, first, last, outcome): what there is to send; sending itself is not done here."""
        n = F.col("last_known") - F.col("last_mailed")
        outcome = F.when(n <= 0, "nothing-new").when((n < threshold) & ~F.lit(force), "below-threshold").otherwise("send")
        return self.table("tracked").select("id", (F.col("last_mailed") + 1).alias("first"), F.col("last_known").alias("last"), outcome.alias("outcome"))

    def mailed(self, ids: list[int]) -> None:
        sent = self.table("tracked").filter(F.col("id").isin(list(ids)))
        self._merge("tracked", sent.select("id", F.col("last_known").alias("last_mailed")), [])

    # one book

    def scrape(self, site_key: str, index_page: str, fetched: DataFrame, start: int = 1, end: int | None = None, breaker: int | None = None, use_cache: bool = True) -> tuple[DataFrame, dict]:
        """An EPUB of the chapters from ``start`` to ``end`` (or the stated total) and what became of them. Pages come from
        the cache, else from ``fetched`` (n, html, error), which is cached; behind ``breaker`` failures in a row nothing is parsed."""
        site = self._site(site_key)
        about, parse = site.parser("index")(index_page, ""), site.parser("chapter")
        book = str(about["chapter_id"] or about["title"])
        last = end if end is not None else about["total"]
        if last is None:
            last = fetched.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        wanted = self.spark.range(start, last + 1).select(F.lit(book).alias("id"), F.col("id").alias("n"))
        error = F.col("error") if "error" in fetched.columns else F.lit(None).cast("string")
        web = fetched.select(F.lit(book).alias("id"), F.col("n").cast("long").alias("n"), "html", error.alias("error"))
        pages = materialize(scraping.pages_of(wanted, self.table("cache"), web, use_cache), "book")
        tried = scraping.scrape(pages, lambda page, n: parse(page, "", n), "title string, body_html string", breaker)
        got = tried.join(pages.select("id", "n", "html"), ["id", "n"]).filter("origin = 'web' and html <> ''").select("id", "n", "html")
        self._put("cache", got)
        fine = tried.filter("label is null").select(F.lit(about["title"]).alias("item_id"), F.col("n").cast("int").alias("n"), F.col("parsed.title").alias("title"), S.plain_text(F.col("parsed.body_html")).alias("body"))
        row = scraping.summary(tried).drop("id").first()
        return epub.books(fine), self._done("scrape", **(row.asDict() if row else {"chapters": 0, "cached": 0, "failed": [], "stopped_at": None}))
