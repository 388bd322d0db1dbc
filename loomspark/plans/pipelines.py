"""DML snapshots, state machines, queues and incremental operators as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import resolve as R
from ..operators import frontier, runs, tables
from ..operators import scrape as scraping
from ..sources import html
from .base import ATTEMPTS, CHAPTERS, ITEMS, SQL, TIERS, attempts, chapters, items, query, read, tiers

_DELTA = "SELECT doc_id + 500 AS id, 'fresh' AS author, 'new title' AS title, CASE WHEN doc_id % 2 = 0 THEN 's9' END AS status FROM documents"


def _delta(spark, d):
    x = read(spark, d, "documents")
    return x.select((F.col("doc_id") + 500).alias("id"), F.lit("fresh").alias("author"), F.lit("new title").alias("title"), F.when(F.col("doc_id") % 2 == 0, "s9").alias("status"))


@query("upsert_latest_wins", f"""WITH {ITEMS}, delta AS ({_DELTA}) SELECT coalesce(i.id, x.id) AS id, coalesce(i.author, x.author) AS author,
  CASE WHEN x.id IS NOT NULL THEN x.title ELSE i.title END AS title, CASE WHEN x.id IS NOT NULL THEN x.status ELSE i.status END AS status FROM items i FULL JOIN delta x ON i.id = x.id""")
def upsert_latest_wins(spark, d):
    return tables.upsert(items(spark, d).select("id", "author", "title", "status"), _delta(spark, d), ["id"], ["title", "status"])


@query("merge_coalesce", f"""WITH {ITEMS}, delta AS ({_DELTA}) SELECT i.id, CASE WHEN x.id IS NOT NULL THEN x.title ELSE i.title END AS title, coalesce(x.status, i.status) AS status FROM items i LEFT JOIN delta x ON i.id = x.id""")
def merge_coalesce(spark, d):
    known = items(spark, d).select("id", "title", "status")
    return tables.merge_metadata(known, _delta(spark, d).select("id", "title", "status").join(known.select("id"), "id", "left_semi"), "id", ["status"])


@query("schema_align", "SELECT p_partkey AS id, p_name AS title, NULL::VARCHAR AS synopsis, NULL::BIGINT AS cluster_id FROM part")
def schema_align(spark, d):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("synopsis", T.StringType()), T.StructField("cluster_id", T.LongType())])
    once = tables.align_schema(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), schema)
    return tables.align_schema(once, schema)


@query("partial_sample_flag", f"WITH {CHAPTERS}, c AS (SELECT item_id, count(*)::BIGINT AS n FROM chapters WHERE body <> '' AND n <= 3 GROUP BY item_id) SELECT DISTINCT v.conv_id AS item_id, coalesce(c.n, 0)::BIGINT AS stored, true AS sampled FROM conversations v LEFT JOIN c ON v.conv_id = c.item_id")
def partial_sample_flag(spark, d):
    got = F.count_if((F.col("body") != "") & (F.col("n") <= 3))
    return chapters(spark, d).groupBy("item_id").agg(got.alias("stored")).withColumn("sampled", F.lit(True))


@query("labels_latest", f"WITH {TIERS}, h AS (SELECT id % 50 AS item, label, id AS seq FROM tiers) SELECT item, arg_max(label, seq) AS label, max(seq) AS seq FROM h GROUP BY item")
def labels_latest(spark, d):
    return tables.latest(tiers(spark, d).select((F.col("id") % 50).alias("item"), "label", F.col("id").alias("seq")), ["item"], ["seq"])


@query("undo_latest", f"WITH {TIERS}, h AS (SELECT tiers.*, doc.n_chars * 100000 + id AS labeled_at FROM tiers JOIN documents doc ON doc_id = id) SELECT id, label FROM h WHERE labeled_at <> (SELECT max(labeled_at) FROM h)")
def undo_latest(spark, d):
    """Without the label that was given last; a table without labels stays as it is."""
    when = read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") * 100000 + F.col("doc_id")).alias("labeled_at"))
    return tables.undo(tiers(spark, d).join(when, "id"), "id", "labeled_at").select("id", "label")


@query("tag_dictionary", "WITH k AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand < 'Brand#2'), o AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM k), n AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT IN (SELECT name FROM k)) SELECT id::BIGINT AS id, name FROM o UNION ALL SELECT (row_number() OVER (ORDER BY name) + (SELECT coalesce(max(id), 0) FROM o))::BIGINT, name FROM n")
def tag_dictionary(spark, d):
    names = read(spark, d, "part").select(F.col("p_brand").alias("name"))
    known = names.filter("name < 'Brand#2'").distinct().withColumn("id", F.row_number().over(Window.orderBy("name")).cast("bigint"))
    return tables.dictionary(names, known)


@query("checkpoint_next", "SELECT lang AS site_key, coalesce(max(CASE WHEN doc_id % 3 = 0 THEN doc_id END), 0)::BIGINT + 1 AS next_page FROM documents GROUP BY lang")
def checkpoint_next(spark, d):
    done = F.max(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")))
    return read(spark, d, "documents").groupBy(F.col("lang").alias("site_key")).agg((F.coalesce(done, F.lit(0)) + 1).alias("next_page"))


_TRIES = ["l_quantity::BIGINT", "l_partkey", "l_suppkey", "l_partkey + l_suppkey", "l_quantity::BIGINT + l_partkey", "l_quantity::BIGINT + l_suppkey", "l_orderkey"]
_KIND = {0: "gone", 1: "empty", 2: "empty", 3: "empty", 4: "error", 5: "error"}


@query("crawl_frontier", f"""WITH t AS (SELECT l_orderkey::VARCHAR AS site, l_linenumber::BIGINT AS page, unnest([{", ".join(f"({x}) % 8" for x in _TRIES)}]) AS code, unnest(range({len(_TRIES)})) AS attempt, (l_partkey % 10) <> 0 AS has_next FROM lineitem),
k AS (SELECT *, CASE code {" ".join(f"WHEN {c} THEN '{n}'" for c, n in _KIND.items())} ELSE 'good' END AS kind FROM t),
l AS (SELECT site, page, list(CASE kind WHEN 'gone' THEN 0 WHEN 'empty' THEN 1 WHEN 'error' THEN 2 ELSE 3 + has_next::INT END ORDER BY attempt, kind, has_next) AS codes FROM k GROUP BY site, page),
f AS (SELECT site, page, list_reduce(list_prepend(0::BIGINT, codes), lambda s, c: CASE WHEN s >= 1000 THEN s WHEN c >= 3 THEN 1000 + 500 * (c - 3) WHEN c = 0 THEN 2000
  WHEN c = 2 THEN CASE WHEN s % 10 >= 5 THEN 3000 ELSE s + 1 END WHEN s // 10 >= 3 THEN 4000 ELSE (s // 10 + 1) * 10 END) AS s FROM l),
g AS (SELECT site, page, s // 1000 AS v, s = 1000 AS last FROM f),
n AS (SELECT site, min(p) FILTER (v IS DISTINCT FROM 1) AS gap, min(p + 1) FILTER (last) AS behind_last
  FROM (SELECT x.site, x.p, v, coalesce(last, false) AS last FROM (SELECT DISTINCT site, unnest(range(1, 9)) AS p FROM g) x LEFT JOIN g ON g.site = x.site AND g.page = x.p) GROUP BY site),
e AS (SELECT site, least(gap, coalesce(behind_last, 99), 7) AS next_page, coalesce(behind_last <= least(gap, 7), false) AS is_last FROM n)
SELECT e.site, next_page, CASE WHEN is_last THEN 'last' WHEN next_page >= 7 THEN 'limit' WHEN v IS NULL THEN 'open' ELSE ['waiting', 'good', 'end', 'failed', 'empty'][v + 1] END AS reason
FROM e LEFT JOIN g ON g.site = e.site AND g.page = e.next_page""")
def crawl_frontier(spark, d, most: int = 6):
    """The next page of each order's line pages after a run of up to seven attempts at each, and why it is there."""
    rows = read(spark, d, "lineitem")
    spark_sql = [x.replace("::BIGINT", "") for x in _TRIES]
    codes = F.array(*[(F.expr(x).cast("bigint") % 8).cast("int") for x in spark_sql])
    kinds = F.create_map(*[F.lit(x) for c in _KIND.items() for x in c])
    tries = rows.select(F.col("l_orderkey").cast("string").alias("site"), F.col("l_linenumber").cast("bigint").alias("page"), (F.col("l_partkey") % 10 != 0).alias("has_next"), F.posexplode(codes).alias("attempt", "code"))
    tries = tries.select("site", "page", "attempt", F.coalesce(F.try_element_at(kinds, "code"), F.lit("good")).alias("kind"), "has_next")
    none = [spark.createDataFrame([], s) for s in (frontier.STATE, frontier.PAGES)]
    return frontier.advance(*none, tries, first=1, most=most)[0]


_TRACKED = "tracked AS (SELECT c_custkey AS id, count(o_orderkey)::BIGINT AS last_known, (count(o_orderkey) + c_custkey % 4)::BIGINT AS total, c_custkey % 5 <> 0 AS enabled FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"


def tracked(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left").withColumn("last_known", F.coalesce("k", F.lit(0)).cast("bigint"))
    return c.select("id", "last_known", (F.col("last_known") + F.col("id") % 4).alias("total"), (F.col("id") % 5 != 0).alias("enabled"))


@query("library_add_remove", f"WITH {_TRACKED} SELECT id FROM tracked WHERE id % 6 <> 0 UNION ALL SELECT 1000000 AS id")
def library_add_remove(spark, d):
    ids = tracked(spark, d).select("id")
    lib = tables.remove(ids, ids.filter("id % 6 = 0"), ["id"])
    return tables.add(lib, spark.range(1000000, 1000001), ["id"])


@query("library_find", f"WITH {_TRACKED} SELECT id, last_known FROM tracked WHERE id = 7")
def library_find(spark, d, key: int = 7):
    return tracked(spark, d).filter(F.col("id") == key).select("id", "last_known")


@query("check_bookkeeping", f"WITH {_TRACKED} SELECT id, CASE WHEN enabled AND total > last_known THEN total ELSE last_known END AS last_known FROM tracked")
def check_bookkeeping(spark, d):
    updated = F.col("enabled") & (F.col("total") > F.col("last_known"))
    return tracked(spark, d).select("id", F.when(updated, F.col("total")).otherwise(F.col("last_known")).alias("last_known"))


@query("mail_bookkeeping", f"WITH {_TRACKED} SELECT id, CASE WHEN id % 3 = 0 THEN last_known - 1 ELSE total END AS last_mailed, CASE WHEN id % 3 = 0 THEN 'no connection' ELSE '' END AS mail_error FROM tracked")
def mail_bookkeeping(spark, d):
    """After sending: the last chapter mailed moves on and the error is cleared; a failure keeps the chapter and notes the error."""
    failed = F.col("id") % 3 == 0
    return tracked(spark, d).select("id", F.when(failed, F.col("last_known") - 1).otherwise(F.col("total")).alias("last_mailed"), F.when(failed, "no connection").otherwise("").alias("mail_error"))


_CHECKED = f"""WITH {_TRACKED}, b AS (SELECT *, CASE WHEN id % 11 <> 0 THEN total END AS seen, (id % 6)::BIGINT AS idle,
  CASE WHEN id % 7 = 0 THEN range(1, least(last_known, 1 + id % 5) + 1) ELSE []::BIGINT[] END AS failed FROM tracked WHERE enabled),
w AS (SELECT id, n, n <= last_known AND NOT list_contains(failed, n) OR (id + n) % 3 <> 0 AND id % 9 <> 0 AS ok
  FROM (SELECT *, unnest(CASE WHEN seen > last_known THEN range(1, seen + 1) WHEN seen IS NOT NULL THEN failed END) AS n FROM b)),
g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY id ORDER BY n) AS island FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY id, island ORDER BY n) AS nth, min(n) OVER (PARTITION BY id, island) AS start FROM g WHERE NOT ok),
t AS (SELECT id, min(n) AS trip, min(start) AS stopped_at FROM f WHERE nth = 3 GROUP BY id),
o AS (SELECT w.id, count(*) FILTER (ok) AS got, any_value(stopped_at) AS stopped_at, list_sort(coalesce(list(n) FILTER (NOT ok), []::BIGINT[])) AS failed_now FROM w LEFT JOIN t ON t.id = w.id WHERE trip IS NULL OR n <= trip GROUP BY w.id),
c AS (SELECT b.*, seen - last_known AS delta, len(failed) > 0 AS had, coalesce(got, 0) AS got, stopped_at, coalesce(failed_now, []::BIGINT[]) AS failed_now FROM b LEFT JOIN o ON o.id = b.id),
x AS (SELECT *, CASE WHEN delta > 0 THEN greatest(got - last_known, 0) WHEN had THEN got ELSE 0 END AS fetched, seen IS NULL OR delta <= 0 AND NOT had AS quiet FROM c)
"""
_STATUS = "CASE WHEN seen IS NULL THEN 'error' WHEN quiet THEN 'unchanged' WHEN {dry} THEN 'dry-run' WHEN fetched > 0 THEN 'updated' WHEN idle + 1 >= 5 THEN 'disabled' ELSE 'no-progress' END"


@query("check_status", _CHECKED + f"""SELECT id, {_STATUS.format(dry='false')} AS status, CASE WHEN quiet THEN 0 ELSE fetched END::BIGINT AS fetched,
  CASE WHEN quiet THEN idle WHEN fetched > 0 THEN 0 ELSE idle + 1 END::BIGINT AS idle, CASE WHEN NOT quiet AND delta > 0 THEN coalesce(stopped_at - 1, seen) ELSE last_known END AS new_last,
  CASE WHEN quiet THEN failed ELSE failed_now END AS still_failed,
  CASE WHEN seen IS NULL THEN 'could not determine chapter count' WHEN NOT quiet AND fetched = 0 AND idle + 1 >= 5 THEN 'switched off after 5 checks in a row without progress'
    WHEN NOT quiet AND delta > 0 AND stopped_at IS NOT NULL THEN 'circuit breaker: 3 consecutive failures starting at chapter ' || stopped_at END AS last_error FROM x""")
def check_status(spark, d, dry: bool = False):
    """A check of the enabled titles: status, chapters fetched, checks without progress, last chapter known, chapters
    that still fail and what went wrong. Chapters fail alone, in runs that trip the breaker, and again."""
    old = F.when(F.col("id") % 7 == 0, F.filter(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("id") % 5), lambda n: n <= F.col("last_known"))).otherwise(F.array().cast("array<bigint>"))
    t = tracked(spark, d).filter("enabled").withColumns({"seen": F.when(F.col("id") % 11 != 0, F.col("total")), "idle": F.col("id") % 6, "failed": old})
    ok = F.col("known") | (((F.col("id") + F.col("n")) % 3 != 0) & (F.col("id") % 9 != 0))
    tried = runs.breaker(tables.wanted_chapters(t).select(F.col("id").alias("key"), "n", ok.alias("ok")), 3)
    t = t.join(tried.select(F.col("key").alias("id"), "attempted", F.col("failed").alias("failed_now"), "stopped_at"), "id", "left")
    return tables.check_states(t, dry).select("id", "status", "fetched", "idle", "new_last", "still_failed", "last_error")


@query("check_dry_run", _CHECKED + f"SELECT {_STATUS.format(dry='true')} AS status, count(*)::BIGINT AS n FROM x GROUP BY 1")
def check_dry_run(spark, d):
    return check_status(spark, d, dry=True).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_PAGES = """wanted AS (SELECT conv_id AS id, (turn + 1)::BIGINT AS n, text, conv_id % 3 = 0 AND turn % 2 = 0 AS kept FROM conversations),
tried AS (SELECT *, kept OR (id + n) % 5 > 1 AND length(text) % 4 > 0 AS ok FROM wanted)"""


def _scraped(spark, d):
    """Turns as pages: some cached, some not got, and some (empty) that do not parse."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("id"), (F.col("turn") + 1).cast("bigint").alias("n"), "text", "turn")
    page = F.concat(F.lit("<h2>c"), F.col("n").cast("string"), F.lit("</h2><div class='chapter-content'><p>"), F.col("text"), F.lit("</p></div>"))
    cached = c.filter("id % 3 = 0 and turn % 2 = 0").select("id", "n", page.alias("html"))
    got = F.when((F.col("id") + F.col("n")) % 5 > 1, F.when(F.length("text") % 4 > 0, page).otherwise(""))
    fetched = c.select("id", "n", got.alias("html"), F.when(got.isNull(), "HTTP 500").alias("error"))

    def parse(page, n):
        if not page:
            raise ValueError("no page")
        return {"title": html.chapter(page, n)["title"]}

    return scraping.scrape(scraping.pages_of(c.select("id", "n"), cached, fetched), parse, "title string", 3)


@query("scrape_loop", f"""WITH {_PAGES}, g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY id ORDER BY n) AS island FROM tried),
f AS (SELECT *, row_number() OVER (PARTITION BY id, island ORDER BY n) AS nth, min(n) OVER (PARTITION BY id, island) AS start FROM g WHERE NOT ok),
t AS (SELECT id, min(n) AS trip, min(start) AS stop FROM f WHERE nth = 3 GROUP BY id)
SELECT tried.id, count(*) FILTER (ok) AS chapters, count(*) FILTER (kept) AS cached, list_sort(coalesce(list(n) FILTER (NOT ok), []::BIGINT[])) AS failed, any_value(stop) AS stopped_at
FROM tried LEFT JOIN t ON t.id = tried.id WHERE trip IS NULL OR n <= trip GROUP BY tried.id""")
def scrape_loop(spark, d):
    """Chapters got, those from the cache, numbers that failed and where the breaker stopped each title."""
    return scraping.summary(_scraped(spark, d))


@query("batch_gate", f"WITH {_TRACKED} SELECT id, last_known + 1 AS first, total AS last, CASE WHEN total <= last_known THEN 'nothing-new' WHEN total - last_known < 3 AND id % 10 <> 0 THEN 'below-threshold' ELSE 'send' END AS outcome FROM tracked")
def batch_gate(spark, d, threshold: int = 3):
    n, forced = F.col("total") - F.col("last_known"), F.col("id") % 10 == 0
    return tracked(spark, d).select("id", (F.col("last_known") + 1).alias("first"), F.col("total").alias("last"), F.when(n <= 0, "nothing-new").when((n < threshold) & ~forced, "below-threshold").otherwise("send").alias("outcome"))


@query("retarget_diff", f"WITH {_TRACKED} SELECT id, '[Ch 1 - Ch ' || last_known::VARCHAR || '] T.epub' AS old, '[Ch 1 - Ch ' || total::VARCHAR || '] T.epub' AS new FROM tracked WHERE last_known <> total")
def retarget_diff(spark, d):
    name = lambda c: S.artifact_name(F.lit("T"), F.lit(1), F.col(c))
    return tracked(spark, d).select("id", name("last_known").alias("old"), name("total").alias("new")).filter("old <> new")


@query("epub_manifest", f"WITH {CHAPTERS} SELECT item_id, n, 'chap_' || lpad(n::VARCHAR, 4, '0') || '.xhtml' AS file, row_number() OVER (PARTITION BY item_id ORDER BY n) AS spine FROM chapters")
def epub_manifest(spark, d):
    spine = F.row_number().over(Window.partitionBy("item_id").orderBy("n")).cast("bigint")
    return chapters(spark, d).select("item_id", "n", F.concat(F.lit("chap_"), F.lpad(F.col("n").cast("string"), 4, "0"), F.lit(".xhtml")).alias("file"), spine.alias("spine"))


@query("cache_hit_split", "SELECT conv_id AS item_id, turn AS n, CASE WHEN page_id IS NULL THEN 'fetch' ELSE 'cache' END AS origin FROM conversations LEFT JOIN pages ON page_id = conv_id AND turn % 2 = 0")
def cache_hit_split(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("n"))
    p = read(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.lit(True).alias("hit"))
    return c.join(p, "item_id", "left").select("item_id", "n", F.when(F.col("hit") & (F.col("n") % 2 == 0), "cache").otherwise("fetch").alias("origin"))


@query("json_roundtrip", "SELECT event_id, json_extract_string(props, '$.k') AS k, user_id FROM events")
def json_roundtrip(spark, d):
    e = read(spark, d, "events")
    packed = e.select("event_id", F.to_json(F.struct("user_id", F.get_json_object("props", "$.k").alias("k"))).alias("j"))
    return packed.select("event_id", F.from_json("j", "user_id bigint, k string").alias("x")).select("event_id", "x.k", "x.user_id")


@query("json_permissive", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 7)::DOUBLE END AS interval FROM events")
def json_permissive(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(F.concat(F.lit('{"s":"'), (F.col("event_id") % 7).cast("string"), F.lit('"}')))
    x = F.from_json(raw, "s string", {"mode": "PERMISSIVE"})
    return read(spark, d, "events").select("event_id", x["s"].try_cast("double").alias("interval"))


@query("labels_import", f"WITH {TIERS} SELECT id, label FROM tiers")
def labels_import(spark, d):
    """Documents of labels, either under a key or as a bare list; an unknown label stops the import."""
    rows = F.collect_list(F.struct(F.col("id").alias("novel_id"), "label"))
    doc = tiers(spark, d).groupBy(F.floor(F.col("id") / 100).alias("g")).agg(F.when(F.first("id") % 2 == 0, F.to_json(F.struct(rows.alias("labels")))).otherwise(F.to_json(rows)).alias("j"))
    kind = "array<struct<novel_id:bigint,label:string>>"
    listed = F.when(F.col("j").startswith("["), F.from_json("j", kind)).otherwise(F.from_json("j", f"labels {kind}")["labels"])
    rows = doc.select(F.explode(listed).alias("x"))
    known = F.when(F.col("x.label").isin(S.LABEL_ORDER), F.col("x.label")).otherwise(F.raise_error(F.lit("unknown label")).cast("string"))
    return rows.select(F.col("x.novel_id").alias("id"), known.alias("label"))


@query("resolution_apply", f"""WITH {ITEMS}, r AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'https://c.example/' || doc_id::VARCHAR END AS url FROM documents WHERE lang = 'fr')
SELECT i.id, CASE WHEN r.id IS NULL THEN i.resolution WHEN r.url IS NULL THEN 'no_candidates' ELSE 'auto' END AS resolution, r.url FROM items i LEFT JOIN r ON i.id = r.id""")
def resolution_apply(spark, d):
    r = read(spark, d, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://c.example/"), F.col("doc_id").cast("string"))).alias("url"), F.lit(True).alias("hit"))
    return items(spark, d).join(r, "id", "left").select("id", F.when(F.col("hit").isNull(), F.col("resolution")).when(F.col("url").isNull(), "no_candidates").otherwise("auto").alias("resolution"), "url")


@query("dedupe_longest_title", "WITH h AS (SELECT p_type AS url, p_name AS title, p_partkey AS place FROM part) SELECT url, arg_max(title, length(title) * 1000000000 - place) AS title, min(place) AS first FROM h GROUP BY url")
def dedupe_longest_title(spark, d):
    h = read(spark, d, "part").select(F.col("p_type").alias("url"), F.col("p_name").alias("title"), F.col("p_partkey").alias("at"))
    return h.groupBy("url").agg(F.max_by("title", F.struct(F.length("title"), -F.col("at"))).alias("title"), F.min("at").alias("first"))


_RUNS = f"""WITH {ATTEMPTS}, a AS (SELECT *, sum(ok::INT) OVER (PARTITION BY key ORDER BY n) AS run FROM attempts),
r AS (SELECT key, run, min(n) FILTER (NOT ok) AS start, count(*) FILTER (NOT ok) AS len FROM a GROUP BY key, run),
t AS (SELECT key, min(start) FILTER (len >= 3) AS stopped_at FROM r GROUP BY key) """


@query("circuit_breaker", _RUNS + """SELECT key, any_value(stopped_at) AS stopped_at, count(*)::BIGINT AS attempted, list_sort(coalesce(list(n) FILTER (NOT ok), []::BIGINT[])) AS failed
FROM attempts JOIN t USING (key) WHERE stopped_at IS NULL OR n <= stopped_at + 2 GROUP BY key""")
def circuit_breaker(spark, d):
    return runs.breaker(attempts(spark, d), 3)


@query("sustained_throttle", _RUNS + "SELECT key, stopped_at IS NOT NULL AS escalated FROM t")
def sustained_throttle(spark, d):
    return runs.breaker(attempts(spark, d), 3).select("key", F.col("stopped_at").isNotNull().alias("escalated"))


@query("auto_disable", f"WITH {ATTEMPTS} SELECT key, max(n) - coalesce(max(n) FILTER (ok), 0) AS run, max(n) - coalesce(max(n) FILTER (ok), 0) >= 5 AS disabled FROM attempts GROUP BY key")
def auto_disable(spark, d, most: int = tables.IDLE_CHECKS):
    return runs.trailing_run(attempts(spark, d)).withColumn("disabled", F.col("run") >= most)


@query("retry_latest", f"WITH {ATTEMPTS} SELECT key, arg_max(value, n) FILTER (ok) AS value FROM attempts WHERE n <= 5 GROUP BY key")
def retry_latest(spark, d, tries: int = 5):
    return attempts(spark, d).filter(F.col("n") <= tries).groupBy("key").agg(F.max_by(F.when(F.col("ok"), F.col("value")), F.when(F.col("ok"), F.col("n"))).alias("value"))


@query("takewhile_pages", f"WITH {ATTEMPTS}, e AS (SELECT key, min(n) FILTER (NOT ok) AS stop FROM attempts GROUP BY key) SELECT key, n FROM attempts JOIN e USING (key) WHERE stop IS NULL OR n <= stop")
def takewhile_pages(spark, d):
    return runs.until_failure(attempts(spark, d)).select("key", "n")


@query("pacing_fold", f"""WITH RECURSIVE {ATTEMPTS}, f AS (SELECT key, 0::BIGINT AS n, 2.5::DOUBLE AS interval FROM (SELECT DISTINCT key FROM attempts)
UNION ALL SELECT f.key, a.n, CASE WHEN a.ok THEN f.interval ELSE least(greatest(CASE WHEN a.n % 2 = 0 THEN a.value ELSE f.interval * 2 END, f.interval), 120.0) END FROM f JOIN attempts a ON a.key = f.key AND a.n = f.n + 1)
SELECT key, round(arg_max(interval, n), 6) AS interval FROM f GROUP BY key""")
def pacing_fold(spark, d):
    asked = F.when(F.col("n") % 2 == 0, F.coalesce("value", F.lit(0.0)))  # a null value asks for nothing
    return runs.pacing(attempts(spark, d).withColumn("asked", asked)).select("key", F.round("interval", 6).alias("interval"))


CLUSTERS = "clusters AS (SELECT vec_id AS id, CASE WHEN label >= 8 THEN -1 ELSE label END::BIGINT AS cluster_id, label FROM embeddings)"


def clusters(spark, d):
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.when(F.col("label") >= 8, -1).otherwise(F.col("label")).cast("bigint").alias("cluster_id"), "label")


@query("cluster_summary", f"WITH {CLUSTERS} SELECT count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END)::BIGINT AS n_clusters, count(*) FILTER (cluster_id = -1)::BIGINT AS n_outliers, count(*)::BIGINT AS n FROM clusters")
def cluster_summary(spark, d):
    return clusters(spark, d).agg(F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("n_clusters"), F.count_if(F.col("cluster_id") == -1).alias("n_outliers"), F.count(F.lit(1)).alias("n"))


@query("oversize_cluster_filter", f"WITH {CLUSTERS}, s AS (SELECT label, count(*)::BIGINT AS size FROM clusters GROUP BY label) SELECT label, size FROM s WHERE size <= 0.1 * (SELECT count(*) FROM clusters)")
def oversize_cluster_filter(spark, d, fraction: float = 0.1):
    c = clusters(spark, d)
    s = c.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return s.filter(F.col("size") <= fraction * F.lit(c.count())).select("label", "size")


@query("recluster_relabel", f"WITH {CLUSTERS}, m AS (SELECT max(cluster_id) AS top FROM clusters), s AS (SELECT label, dense_rank() OVER (ORDER BY label) AS r FROM (SELECT DISTINCT label FROM clusters WHERE cluster_id = -1)) SELECT id, (CASE WHEN cluster_id = -1 THEN top + r ELSE cluster_id END)::BIGINT AS cluster_id FROM clusters LEFT JOIN s USING (label), m")
def recluster_relabel(spark, d):
    c = clusters(spark, d)
    top = c.agg(F.max("cluster_id")).first()[0]
    sub = c.filter("cluster_id = -1").select("label").distinct().withColumn("r", F.dense_rank().over(Window.orderBy("label")))
    return c.join(sub, "label", "left").select("id", F.when(F.col("cluster_id") == -1, F.col("r") + (-1 if top is None else top)).otherwise(F.col("cluster_id")).cast("bigint").alias("cluster_id"))


@query("topk_per_group", f"WITH {CLUSTERS} SELECT id, cluster_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS rn FROM clusters WHERE cluster_id <> -1) WHERE rn <= 5")
def topk_per_group(spark, d, k: int = 5):
    rn = F.row_number().over(Window.partitionBy("cluster_id").orderBy("id")).cast("bigint")
    return clusters(spark, d).filter("cluster_id <> -1").select("id", "cluster_id", rn.alias("rn")).filter(F.col("rn") <= k)


@query("round_robin", f"WITH {CLUSTERS}, t AS (SELECT id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS rn FROM clusters WHERE cluster_id <> -1) SELECT id, row_number() OVER (ORDER BY rn, cluster_id) AS pos FROM t WHERE rn <= 5")
def round_robin(spark, d):
    return topk_per_group(spark, d).select("id", F.row_number().over(Window.orderBy("rn", "cluster_id")).cast("bigint").alias("pos"))  # 5 per cluster


_PLACE = """n AS (SELECT bucket, count(*)::BIGINT AS size FROM b GROUP BY bucket),
p AS (SELECT bucket, 1::BIGINT AS k, 1.0::DOUBLE / size AS mark, size FROM n UNION ALL SELECT bucket, k + 1, mark + 1.0::DOUBLE / size, size FROM p WHERE k < size)
SELECT id, bucket, row_number() OVER (ORDER BY mark, bucket, k)::BIGINT AS pos FROM p JOIN b USING (bucket, k)"""


@query("interleave", "WITH RECURSIVE b AS (SELECT p_partkey AS id, p_size % 3 AS bucket, row_number() OVER (PARTITION BY p_size % 3 ORDER BY p_partkey) AS k FROM part), " + _PLACE)
def interleave(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("bucket"))
    return runs.interleave(p, "bucket", "id")


@query("seed_queue", f"""WITH RECURSIVE {CLUSTERS}, u AS (SELECT id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS rn FROM clusters WHERE id NOT IN (SELECT doc_id FROM labels)),
c AS (SELECT count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS real, count(*) FILTER (cluster_id = -1) AS outliers, count(*) AS n FROM u),
r AS (SELECT id, row_number() OVER (ORDER BY rn, cluster_id) AS k FROM u, c WHERE cluster_id <> -1 AND rn <= greatest(1, 200 // greatest(real, 1))),
q AS (SELECT CASE WHEN outliers > 0 AND outliers < n THEN round_even((SELECT count(*) FROM r) * (outliers::DOUBLE / n) / (1 - outliers::DOUBLE / n), 0)::BIGINT ELSE outliers END AS quota FROM c),
b AS (SELECT id, 0 AS bucket, rn AS k FROM u, q WHERE cluster_id = -1 AND rn <= quota UNION ALL SELECT id, 1 AS bucket, k FROM r), """ + _PLACE)
def seed_queue(spark, d, target: int = 200):
    """Review queue: equal shares of the clusters, a proportional share of outliers, interleaved."""
    labelled = read(spark, d, "labels").select(F.col("doc_id").alias("id"))
    u = clusters(spark, d).filter("cluster_id is not null").join(labelled, "id", "left_anti").select("id", "cluster_id")
    return runs.seed_queue(u, target)


@query("next_candidate", f"SELECT * FROM ({SQL['seed_queue']}) WHERE id <> 0 ORDER BY pos LIMIT 1")
def next_candidate(spark, d, skipped=(0,)):
    """The first of the queue that is not skipped."""
    return runs.first_open(seed_queue(spark, d), "pos", skipped)


@query("next_candidate_fallback", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) AND vec_id NOT IN (1, 2, 5) ORDER BY abs(round(1 / (1 + exp(-(embedding[1]::DOUBLE - embedding[2]::DOUBLE))), 6) - 0.5), vec_id LIMIT 1")
def next_candidate_fallback(spark, d, skipped=(1, 2, 5)):
    """With the queue used up: the least sure vector that is neither labelled nor skipped."""
    e = read(spark, d, "embeddings")
    p = F.round(1 / (1 + F.exp(-(F.get("embedding", F.lit(0)).cast("double") - F.get("embedding", F.lit(1)).cast("double")))), 6)
    sure = e.select(F.col("vec_id").alias("id"), F.abs(p - 0.5).alias("margin")).join(read(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")
    return runs.first_open(seed_queue(spark, d).limit(0), "pos", skipped, lambda: sure, ["margin", "id"]).select("id")


@query("review_batch", f"SELECT pos, id, tags FROM ({SQL['seed_queue']}) LEFT JOIN (SELECT p_partkey AS id, list_sort(list(DISTINCT p_brand)) AS tags FROM part GROUP BY 1) USING (id)")
def review_batch(spark, d):
    tags = read(spark, d, "part").groupBy(F.col("p_partkey").alias("id")).agg(F.sort_array(F.collect_set("p_brand")).alias("tags"))
    return seed_queue(spark, d).join(tags, "id", "left").select("pos", "id", "tags").orderBy("pos")


@query("export_json", f"""WITH q AS ({SQL['seed_queue']}), {ITEMS}, x AS (SELECT 'review' AS part, id, pos FROM q UNION ALL SELECT 'index', id, NULL FROM items WHERE synopsis IS NOT NULL)
SELECT part, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids, sum(coalesce(pos, 0))::BIGINT AS places FROM x GROUP BY part""")
def export_json(spark, d):
    """The search index and the whole review batch as JSON lines, summed up after reading them back."""
    batch = seed_queue(spark, d).select(F.lit("review").alias("part"), "id", "pos")
    index = items(spark, d).filter("synopsis is not null").select(F.lit("index").alias("part"), "id", F.lit(None).cast("bigint").alias("pos"))
    lines = batch.union(index).select(F.to_json(F.struct("part", "id", "pos")).alias("line"))
    back = lines.select(F.from_json("line", "part string, id bigint, pos bigint").alias("x")).select("x.*")
    return back.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum(F.coalesce("pos", F.lit(0))).cast("bigint").alias("places"))


_CAT = "cat AS (SELECT row_number() OVER (ORDER BY p_name) AS cid, p_name AS name FROM (SELECT DISTINCT p_name FROM part))"
_PROBE = "probe AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 0 THEN p_type ELSE substr(p_name, 1, length(p_name) - 1) || 'x' END AS title FROM part WHERE p_partkey % 20 = 0)"
_RATIO = """pr AS (SELECT DISTINCT title, name FROM probe, cat), k AS (SELECT title, name, list_sort(list_distinct(list_filter(regexp_split_to_array(title, '\\s+'), lambda t: t <> ''))) AS ta, list_sort(list_distinct(list_filter(regexp_split_to_array(name, '\\s+'), lambda t: t <> ''))) AS tb FROM pr),
s AS (SELECT title, name, len(ta) = 0 OR len(tb) = 0 AS empty, array_to_string(list_filter(ta, lambda t: list_contains(tb, t)), ' ') AS sect, array_to_string(list_filter(ta, lambda t: NOT list_contains(tb, t)), ' ') AS ab, array_to_string(list_filter(tb, lambda t: NOT list_contains(ta, t)), ' ') AS ba FROM k),
l AS (SELECT DISTINCT ab, ba, 0 AS i, list_transform(range(0, length(ba) + 1), lambda x: 0) AS row FROM s
  UNION ALL SELECT ab, ba, i + 1, list_reduce(list_transform(range(1, length(ba) + 1), lambda j: [j::INTEGER]), lambda acc, j: list_append(acc, CASE WHEN substr(ba, j[1], 1) = substr(ab, i + 1, 1) THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], acc[j[1]]) END), [0]) FROM l WHERE i < length(ab)),
m AS (SELECT ab, ba, row[length(ba) + 1] AS lcs FROM l WHERE i = length(ab)),
v AS (SELECT title, name, empty, length(sect) AS sc, length(ab) AS la, length(ba) AS lb, lcs, CASE WHEN length(sect) > 0 THEN 1 ELSE 0 END AS g FROM s JOIN m USING (ab, ba)),
sim AS (SELECT title, name, CASE WHEN empty THEN 0.0 WHEN sc > 0 AND (la = 0 OR lb = 0) THEN 100.0 WHEN sc > 0 THEN greatest(100.0::DOUBLE - 100.0::DOUBLE * (la + lb - 2 * lcs) / (2 * sc + 2 * g + la + lb), 100.0::DOUBLE - 100.0::DOUBLE * (1 + la) / (2 * sc + g + la), 100.0::DOUBLE - 100.0::DOUBLE * (1 + lb) / (2 * sc + g + lb))
  ELSE 100.0::DOUBLE - 100.0::DOUBLE * (la + lb - 2 * lcs) / (la + lb) END AS score FROM v)"""


def _probes(spark, d):
    p = read(spark, d, "part")
    cat = runs.numbered(p.select(F.col("p_name").alias("name")).distinct(), ["name"], "cid")
    probe = p.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"), F.expr("case when p_partkey % 40 = 0 then p_type else concat(substr(p_name, 1, length(p_name) - 1), 'x') end").alias("title"))
    return probe, cat


@query("token_set_ratio", f"WITH RECURSIVE {_CAT}, {_PROBE}, {_RATIO} SELECT title, name, round(score, 6) AS score FROM sim WHERE score >= 60")
def token_set_ratio(spark, d):
    probe, cat = _probes(spark, d)
    return R.candidate_pairs(probe, cat).select("title", "name", F.round(R.token_set_ratio(F.col("title"), F.col("name")), 6).alias("score")).filter("score >= 60")


@query("fuzzy_resolve", f"""WITH RECURSIVE {_CAT}, {_PROBE}, {_RATIO}, w AS (SELECT title, cid, score, row_number() OVER (PARTITION BY title ORDER BY score DESC, cid) AS rn, lead(score) OVER (PARTITION BY title ORDER BY score DESC, cid) AS second FROM sim JOIN cat USING (name) WHERE score >= 60)
SELECT id, CASE WHEN score IS NULL THEN 'no_candidates' WHEN score >= 90 AND (second IS NULL OR score - second >= 15) THEN 'auto' ELSE 'ambiguous' END AS decision, cid AS best, round(score, 6) AS best_score FROM probe LEFT JOIN w ON w.title = probe.title AND rn = 1""")
def fuzzy_resolve(spark, d):
    probe, cat = _probes(spark, d)
    return R.resolve(probe, cat)


_DOMAINS = {"net": "example.net", "com": "example.com", "org": "example.org"}


@query("domain_resolve", "SELECT page_id, CASE WHEN page_id % 50 = 0 THEN 'org' WHEN ends_with('.' || h, '.example.net') THEN 'net' WHEN ends_with('.' || h, '.example.com') THEN 'com' WHEN ends_with('.' || h, '.example.org') THEN 'org' ELSE 'no site' END AS site FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h FROM pages)")
def domain_resolve(spark, d):
    """An explicit key goes before the host; the host's suffixes meet the sites' domains in an equi-join;
    a page without a site is told so as a value."""
    explicit = F.when(F.col("page_id") % 50 == 0, "org")
    pages = read(spark, d, "pages").select("page_id", explicit.alias("explicit"), F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    domains = spark.createDataFrame([(v, k) for k, v in _DOMAINS.items()], "suffix string, key string")
    hits = pages.select("page_id", F.explode(suffixes).alias("suffix")).join(F.broadcast(domains), "suffix").groupBy("page_id").agg(F.max_by("key", F.length("suffix")).alias("key"))  # one row per domain
    return pages.join(hits, "page_id", "left").select("page_id", F.coalesce("explicit", "key", F.lit("no site")).alias("site"))


@query("training_set", f"WITH {TIERS} SELECT id, CASE WHEN tiers.label IN ('like', 'love', 'obsessed') THEN 1 ELSE 0 END AS y, CASE WHEN label_source = 'read' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM tiers JOIN embeddings ON vec_id = id")
def training_set(spark, d, read_weight: float = 2.0):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return tiers(spark, d).join(e, "id").select("id", F.when(F.col("label").isin(S.POSITIVE_LABELS), 1).otherwise(0).alias("y"), F.when(F.col("label_source") == "read", read_weight).otherwise(1.0).alias("weight"))


@query("embedding_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 64 END AS dims FROM embeddings")
def embedding_upsert(spark, d):
    """Vectors written again for half of the rows."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    new = e.filter("id % 2 = 0").select("id", F.slice("vector", 1, 2).alias("vector"))
    return tables.merge_metadata(e, new, "id", []).select("id", F.size("vector").alias("dims"))


@query("cluster_assign", f"WITH {CLUSTERS} SELECT doc_id AS id, cluster_id FROM documents LEFT JOIN clusters ON id = doc_id")
def cluster_assign(spark, d):
    """Cluster numbers written to the catalog; titles without a vector keep none."""
    catalog = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("bigint").alias("cluster_id"))
    found = clusters(spark, d).select("id", "cluster_id").join(catalog.select("id"), "id", "left_semi")
    return tables.merge_metadata(catalog, found, "id", [])


@query("crawl_debug", "SELECT page_id, length(html)::BIGINT AS size, 'no cards' AS reason FROM pages WHERE page_id % 10 = 0")
def crawl_debug(spark, d):
    """Pages kept for a look: those from which no card came."""
    p = read(spark, d, "pages")
    page = F.when(F.col("page_id") % 10 == 0, F.col("html")).otherwise(F.concat(F.lit('<li class="novel-item"><a href="/novel/x.html">x</a></li>'), "html"))
    got = html.extract(p.select(F.col("page_id").alias("id"), page.alias("html"), F.col("url").alias("base")), "cards", "title:string,url:string", many=True)
    empty = got.filter(F.col("error").isNotNull() | (F.size("parsed") == 0)).select(F.col("id").alias("page_id"), F.coalesce("error", F.lit("no cards")).alias("reason"))
    return p.select("page_id", F.length("html").cast("bigint").alias("size")).join(empty, "page_id")
