"""Scalar functions and text predicates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .base import CHAPTERS, chapters, query, read

TITLE = "concat(' ', p_name, ': a/b <', p_brand, '>?  ', p_type, ' ')"
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(replace({c}, ':', ' -'), '[\\/*?"<>|]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"""


@query("sanitize_title", f"SELECT p_partkey, {_CLEAN.format(c=TITLE)} AS clean FROM part")
def sanitize_title(spark, d):
    return read(spark, d, "part").select("p_partkey", S.sanitize_title(F.expr(TITLE)).alias("clean"))


@query("artifact_name", f"SELECT p_partkey, '[Ch 1 - Ch ' || p_size::VARCHAR || '] ' || {_CLEAN.format(c=TITLE)} || '.epub' AS name FROM part")
def artifact_name(spark, d):
    return read(spark, d, "part").select("p_partkey", S.artifact_name(F.expr(TITLE), F.lit(1), F.col("p_size")).alias("name"))


@query("base_url", "SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS base FROM pages")
def base_url(spark, d):
    return read(spark, d, "pages").select("page_id", S.base_url(F.col("url")).alias("base"))


@query("url_join", """WITH h AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '/x/1.html' WHEN 1 THEN 'y2.html' ELSE 'https://z.example/3' END AS href FROM pages)
SELECT page_id, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE regexp_replace(url, '[^/]*$', '') || href END AS joined FROM h""")
def url_join(spark, d):
    href = F.when(F.col("page_id") % 3 == 0, "/x/1.html").when(F.col("page_id") % 3 == 1, "y2.html").otherwise("https://z.example/3")
    return read(spark, d, "pages").select("page_id", S.url_join(F.col("url"), href).alias("joined"))


@query("chapter_url", "SELECT conv_id, 'https://books.example/novel/' || conv_id::VARCHAR || '_' || (turn + 1)::VARCHAR || '.html' AS url FROM conversations")
def chapter_url(spark, d):
    return read(spark, d, "conversations").select("conv_id", F.concat(F.lit("https://books.example/novel/"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") + 1).cast("string"), F.lit(".html")).alias("url"))


@query("xhtml_escape", "SELECT doc_id, replace(replace(replace(text || ' <&> ', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def xhtml_escape(spark, d):
    return read(spark, d, "documents").select("doc_id", S.xhtml_escape(F.concat("text", F.lit(" <&> "))).alias("escaped"))


_LIST = "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN p_name || ',, ' || p_brand ELSE p_name || ', ' || p_brand END"


@query("comma_list_codec", f"""WITH x AS (SELECT p_partkey, {_LIST} AS raw FROM part), y AS (SELECT p_partkey, CASE WHEN coalesce(raw, '') = '' THEN []::VARCHAR[] ELSE list_transform(string_split(raw, ','), lambda v: trim(v)) END AS items FROM x)
SELECT p_partkey, items, nullif(array_to_string(items, ', '), '') AS joined FROM y""")
def comma_list_codec(spark, d):
    x = read(spark, d, "part").select("p_partkey", S.split_list(F.expr(_LIST)).alias("items"))
    return x.withColumn("joined", S.join_list(F.col("items")))


@query("plain_text", f"""WITH {CHAPTERS} SELECT item_id, n, replace(array_to_string(regexp_extract_all('<p>' || replace(replace(body, '&', '&amp;'), '. ', '.</p>' || chr(10) || '<p>') || '</p>', '(?s)<p>(.*?)</p>', 1), chr(10) || chr(10)), '&amp;', '&') AS plain FROM chapters""")
def plain_text(spark, d):
    html = F.concat(F.lit("<p>"), F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit(". "), F.lit(".</p>\n<p>")), F.lit("</p>"))
    return chapters(spark, d).select("item_id", "n", S.plain_text(html).alias("plain"))


@query("small_scalars", """SELECT c_custkey AS id, c_custkey::VARCHAR || '_' || c_nationkey::VARCHAR || '.html' AS cached, c_custkey % 3 = 0 AS yes, split_part(c_mktsegment || ':' || c_name || ':x', ':', 1) AS site, c_name || ':x' AS ident,
  '[' || lpad((c_nationkey * 100 // 25)::VARCHAR, 3, ' ') || '%] ' || c_nationkey::VARCHAR || '/25 ' || substr(c_name || c_name || c_name || c_name, 1, 50) AS line FROM customer""")
def small_scalars(spark, d):
    pair = S.site_and_id(F.concat("c_mktsegment", F.lit(":"), "c_name", F.lit(":x")))
    said = F.element_at(F.array(F.lit(" YES "), F.lit("no"), F.lit(None)), (F.col("c_custkey") % 3 + 1).cast("int"))
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), S.cache_name(F.col("c_custkey").cast("string"), F.col("c_nationkey")).alias("cached"), S.truthy(said).alias("yes"), pair["site"].alias("site"), pair["id"].alias("ident"),
        S.progress_line(F.col("c_nationkey"), F.lit(25), F.repeat("c_name", 4)).alias("line"),
    )


@query("timestamp_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at FROM events")
def timestamp_text(spark, d):
    return read(spark, d, "events").select("event_id", S.timestamp_text(F.col("ts")).alias("at"))


@query("grep_total", "SELECT count(*)::BIGINT AS files, sum(hits)::BIGINT AS hits FROM (SELECT len(regexp_extract_all(text, '(?i)the')) AS hits FROM documents) WHERE hits > 0")
def grep_total(spark, d):
    return grep_counts(spark, d).agg(F.count(F.lit(1)).alias("files"), F.sum("hits").alias("hits"))


@query("elapsed_fmt", "SELECT event_id, printf('%02dm%02ds', event_id // 60, event_id % 60) AS elapsed FROM events")
def elapsed_fmt(spark, d):
    return read(spark, d, "events").select("event_id", S.elapsed(F.col("event_id")).alias("elapsed"))


@query("pacing_clamp", "SELECT event_id, least(greatest(value, 5.0 * 0.2), 5.0 * 3.0) AS gap FROM events")
def pacing_clamp(spark, d):
    return read(spark, d, "events").select("event_id", S.clamp_gap(F.col("value"), F.lit(5.0)).alias("gap"))


_U = "((('0x' || substr(sha256('7|' || user_id || '|' || event_id || '|' || t || '|{i}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


@query("pacing_gap", f"""WITH m AS (SELECT event_id, user_id, CASE WHEN user_id % 10 = 0 THEN 0.0 ELSE 2.5 + user_id % 4 END::DOUBLE AS mean FROM events),
u AS (SELECT event_id, mean, t, {_U.format(i=0)} AS a, {_U.format(i=1)} AS b, {_U.format(i=2)} AS c FROM m, range(8) r(t)),
z AS (SELECT *, sqrt(-2.0 * ln(a)) * cos(2.0 * pi() * b) AS z FROM u), v AS (SELECT *, pow(1.0 + z / sqrt(9.0 * (2.5 - 1.0 / 3.0)), 3.0) AS v, 2.5::DOUBLE - 1.0::DOUBLE / 3.0 AS d FROM z),
f AS (SELECT event_id, mean, arg_min(d * v, t) FILTER (v > 0 AND ln(c) < 0.5 * z * z + d - d * v + d * ln(greatest(v, 1e-300))) AS g FROM v GROUP BY event_id, mean)
SELECT event_id, round(CASE WHEN mean > 0 THEN least(greatest(g * mean / 2.5, mean * 0.2), mean * 3.0) ELSE 0.0 END, 6) AS gap FROM f""")
def pacing_gap(spark, d, seed: int = 7):
    """The pause before each event of a user: drawn around the user's interval, and the same on every run."""
    mean = F.when(F.col("user_id") % 10 == 0, 0.0).otherwise(2.5 + F.col("user_id") % 4)
    return read(spark, d, "events").select("event_id", F.round(S.gap(mean, F.lit(seed), F.col("user_id"), F.col("event_id")), 6).alias("gap"))


@query("vector_stats", "SELECT vec_id, len(embedding)::INTEGER AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_stats(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return read(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dims"), F.round(norm, 6).alias("norm"))


#: Machine tokens of challenge pages, and phrases of their titles.
TOKENS = ["cf_chl_opt", "challenge-platform", "cf-mitigated"]
PHRASES = ["just a moment", "attention required", "checking your browser"]
_PAGE = "CASE page_id % 4 WHEN 0 THEN html || '<script>window._CF_CHL_OPT={}</script>' WHEN 1 THEN replace(html, '<title>', '<title>Just a Moment ') WHEN 2 THEN html || '<p>just a moment</p>' ELSE html END"


@query("challenge_detect", f"""WITH x AS (SELECT page_id, lower({_PAGE}) AS h FROM pages), y AS (SELECT page_id, h, regexp_extract(h, '(?s)<title[^>]*>(.*?)</title>', 1) AS t FROM x)
SELECT page_id, contains(h, 'cf_chl_opt') OR contains(h, 'challenge-platform') OR contains(h, 'cf-mitigated') OR contains(t, 'just a moment') OR contains(t, 'attention required') OR contains(t, 'checking your browser') AS challenge FROM y""")
def challenge_detect(spark, d):
    return read(spark, d, "pages").select("page_id", S.looks_like_challenge(F.expr(_PAGE), TOKENS, PHRASES).alias("challenge"))


@query("challenge_reason", f"SELECT page_id, CASE WHEN contains(h, '<title>Just a Moment') THEN 'title' WHEN contains(h, '_CF_CHL_OPT') THEN 'token' END AS reason FROM (SELECT page_id, {_PAGE} AS h FROM pages)")
def challenge_reason(spark, d):
    h = F.expr(_PAGE)
    return read(spark, d, "pages").select("page_id", F.when(F.contains(h, F.lit("<title>Just a Moment")), "title").when(F.contains(h, F.lit("_CF_CHL_OPT")), "token").alias("reason"))


@query("fetch_outcome", f"""WITH x AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 200 END AS status, lower({_PAGE}) AS h FROM pages), y AS (SELECT *, contains(h, 'cf_chl_opt') OR contains(h, 'challenge-platform') OR contains(h, 'cf-mitigated') OR contains(regexp_extract(h, '(?s)<title[^>]*>(.*?)</title>', 1), 'just a moment') AS challenge FROM x)
SELECT page_id, CASE WHEN status = 404 THEN 'gone' WHEN status = 429 OR challenge THEN 'throttled' WHEN status >= 400 THEN 'error' ELSE 'ok' END AS outcome FROM y""")
def fetch_outcome(spark, d):
    m = F.col("page_id") % 5
    status = F.when(m == 0, 404).when(m == 1, 429).when(m == 2, 503).otherwise(200)
    challenge = S.looks_like_challenge(F.expr(_PAGE), TOKENS, PHRASES)
    return read(spark, d, "pages").select("page_id", F.when(status == 404, "gone").when((status == 429) | challenge, "throttled").when(status >= 400, "error").otherwise("ok").alias("outcome"))


_STYLE = "CASE page_id % 5 WHEN 0 THEN 'Display: None' WHEN 1 THEN 'opacity: 0.85' WHEN 2 THEN 'opacity:0.0; color:red' WHEN 3 THEN 'visibility : hidden' END"
_REL = "CASE page_id % 7 WHEN 0 THEN 'external NoFollow' WHEN 1 THEN 'nofollowed' END"


@query("safe_links", f"""WITH x AS (SELECT page_id, lower(replace(coalesce({_STYLE}, ''), ' ', '')) AS s, lower(coalesce({_REL}, '')) AS r, page_id % 11 = 0 AS hid, CASE WHEN page_id % 13 = 0 THEN ' TRUE ' END AS aria FROM pages)
SELECT page_id, NOT (list_contains(regexp_split_to_array(r, '\\s+'), 'nofollow') OR contains(s, 'display:none') OR contains(s, 'visibility:hidden') OR regexp_matches(s, 'opacity:0(\\.0+)?(;|$)') OR hid OR lower(trim(coalesce(aria, ''))) = 'true') AS safe FROM x""")
def safe_links(spark, d):
    aria = F.when(F.col("page_id") % 13 == 0, " TRUE ")
    return read(spark, d, "pages").select("page_id", S.safe_link(F.expr(_REL), F.expr(_STYLE), F.col("page_id") % 11 == 0, aria).alias("safe"))


_SKIP = ["Des ", "The "]


@query("paragraph_filter", """SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: length(p) >= 4 AND NOT contains(p, 'Des ') AND NOT contains(p, 'The ')) AS kept FROM documents""")
def paragraph_filter(spark, d, phrases=tuple(_SKIP), least: int = 4):
    def good(p):
        out = F.length(p) >= least
        for x in phrases:
            out = out & ~F.contains(p, F.lit(x))
        return out

    return read(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), good).alias("kept"))


@query("paragraph_join", "SELECT doc_id, coalesce(nullif(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> ''), chr(10) || chr(10)), ''), NULL) AS synopsis FROM documents")
def paragraph_join(spark, d):
    parts = F.filter(F.transform(F.split("text", "\n"), lambda p: F.trim(p)), lambda p: p != "")
    return read(spark, d, "documents").select("doc_id", F.nullif(F.array_join(parts, "\n\n"), F.lit("")).alias("synopsis"))


_VOTES = r"\(([\d.]+)\s*/\s*5\.0,\s*([\d,]+)\s*votes?\)"
_RATED = "CASE WHEN p_partkey % 3 = 0 THEN 'no rating' ELSE 'x (' || (p_size % 5)::VARCHAR || '.5 / 5.0, 1,' || (100 + p_size)::VARCHAR || ' votes)' END"


@query("rating_votes_extract", f"SELECT p_partkey, nullif(regexp_extract(r, '{_VOTES}', 1), '') AS rating, nullif(regexp_extract(r, '{_VOTES}', 2), '') AS votes FROM (SELECT p_partkey, {_RATED} AS r FROM part)")
def rating_votes_extract(spark, d):
    r = F.expr(_RATED.replace("::VARCHAR", "::string"))
    return read(spark, d, "part").select("p_partkey", F.nullif(F.regexp_extract(r, _VOTES, 1), F.lit("")).alias("rating"), F.nullif(F.regexp_extract(r, _VOTES, 2), F.lit("")).alias("votes"))


_GREP = """WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '(?i)the') AS hits, regexp_split_to_array(text, '(?i)the') AS parts FROM documents),
y AS (SELECT doc_id, text, unnest(range(1, len(hits) + 1)) AS k, hits, parts FROM x),
z AS (SELECT doc_id, k, text, (list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * 3)::BIGINT AS s FROM y)
"""


@query("grep_snippets", _GREP + "SELECT doc_id, k::INTEGER AS k, substr(text, greatest(s - 20, 0) + 1, 3 + 20 + least(s, 20)) AS snippet FROM z")
def grep_snippets(spark, d, needle: str = "the", context: int = 20):
    found = read(spark, d, "documents").select("doc_id", F.explode(S.snippets(F.col("text"), needle, context)).alias("h"))
    return found.select("doc_id", "h.k", "h.snippet")


@query("grep_counts", "SELECT doc_id, len(regexp_extract_all(text, '(?i)the'))::BIGINT AS hits FROM documents WHERE len(regexp_extract_all(text, '(?i)the')) > 0")
def grep_counts(spark, d, needle: str = "the"):
    n = F.regexp_count("text", F.lit(S.literal_pattern(needle))).cast("bigint")
    return read(spark, d, "documents").select("doc_id", n.alias("hits")).filter("hits > 0")


@query("successful_range", "SELECT p_partkey, list_filter(range(1, 11), lambda x: x % (p_size % 4 + 2) <> 0) AS done FROM part")
def successful_range(spark, d):
    failed = F.filter(F.sequence(F.lit(1).cast("bigint"), F.lit(10).cast("bigint")), lambda x: x % (F.col("p_size") % 4 + 2) == 0)
    return read(spark, d, "part").select("p_partkey", F.array_except(F.sequence(F.lit(1).cast("bigint"), F.lit(10).cast("bigint")), failed).alias("done"))


@query("tag_union", "SELECT p_partkey, list_sort(list_distinct([p_brand, p_type, p_brand, p_name])) AS tags FROM part")
def tag_union(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_sort(F.array_union(F.array("p_brand", "p_type"), F.array("p_brand", "p_name"))).alias("tags"))
