"""Tags, communities, vectors, models, HTML and EPUB as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph, learning, search
from ..scratch import materialize, scratch_root
from ..sources import epub, html
from ..sources.site import ChapterRules, IndexRules, SearchRules, Site
from .base import chapters, items, query, read
from .pipelines import dedupe_longest_title
from .pipelines import training_set as _training


def tagged(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("tag"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").select(F.col("l_orderkey").alias("item"), "tag").distinct()


_TAGGED = "tagged AS (SELECT DISTINCT l_orderkey AS item, p_brand AS tag FROM lineitem JOIN part ON p_partkey = l_partkey)"
_PAIRS = "pairs AS (SELECT x.tag AS a, y.tag AS b, count(*)::BIGINT AS weight FROM tagged x JOIN tagged y ON x.item = y.item AND x.tag < y.tag GROUP BY 1, 2)"


@query("tag_cooccurrence", f"WITH {_TAGGED}, {_PAIRS} SELECT a, b, weight FROM pairs")
def tag_cooccurrence(spark, d):
    return graph.cooccurrence(tagged(spark, d))


@query("tags_per_item", f"WITH {_TAGGED} SELECT item, list_sort(list(tag)) AS tags FROM tagged GROUP BY item")
def tags_per_item(spark, d):
    return tagged(spark, d).groupBy("item").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


@query("tag_components", f"""WITH RECURSIVE {_TAGGED}, {_PAIRS}, e AS (SELECT a, b FROM pairs WHERE weight >= 2 UNION SELECT b, a FROM pairs WHERE weight >= 2),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def tag_components(spark, d):
    return graph.components(tag_cooccurrence(spark, d).filter("weight >= 2"))


@query("tag_communities")
def tag_communities(spark, d):
    return graph.communities(tag_cooccurrence(spark, d), tagged(spark, d).select(F.col("tag").alias("node")))


@query("modularity", f"""WITH {_TAGGED}, {_PAIRS}, m AS (SELECT sum(weight)::DOUBLE AS m FROM pairs), c AS (SELECT DISTINCT tag AS node, substr(tag, 1, 7) AS community FROM tagged),
i AS (SELECT ca.community, sum(weight)::DOUBLE AS w FROM pairs JOIN c ca ON ca.node = a JOIN c cb ON cb.node = b WHERE ca.community = cb.community GROUP BY 1),
k AS (SELECT community, sum(weight)::DOUBLE AS k FROM (SELECT a AS node, weight FROM pairs UNION ALL SELECT b, weight FROM pairs) JOIN c USING (node) GROUP BY 1)
SELECT round(sum(coalesce(w, 0) / m - (k / (2 * m)) * (k / (2 * m))), 6) AS modularity FROM k LEFT JOIN i USING (community), m""")
def modularity(spark, d):
    t = tagged(spark, d)
    member = t.select(F.col("tag").alias("node"), F.substring("tag", 1, 7).alias("community")).distinct()
    return graph.modularity(graph.cooccurrence(t), member).select(F.round("modularity", 6).alias("modularity"))


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


@query("core_distance", """WITH p AS (SELECT x.vec_id AS id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE) * (x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE)))) AS dist FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id)
SELECT id, round(list_sort(list(dist))[5], 5) AS core FROM p GROUP BY id""")
def core_distance(spark, d):
    return learning.core_distance(vectors(spark, d), 5).select("id", F.round("core", 5).alias("core"))


@query("tag_community_counts")
def tag_community_counts(spark, d):
    return graph.community_counts(tag_communities(spark, d))


@query("cluster_map")
def cluster_map(spark, d):
    return learning.cluster_map(vectors(spark, d))


@query("density_clusters")
def density_clusters(spark, d):
    return learning.density_clusters(vectors(spark, d), 30)


def _weighted(spark, d):
    return _training(spark, d).join(vectors(spark, d), "id")


@query("uncertainty_fit")
def uncertainty_fit(spark, d):
    model = learning.train_uncertainty(_weighted(spark, d))
    values = [float(v) for v in model.coefficients] if model else []
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(values)], "feature int, coefficient double")


@query("uncertainty_rank")
def uncertainty_rank(spark, d):
    t = _weighted(spark, d)
    return learning.rank_uncertain(learning.train_uncertainty(t), vectors(spark, d), t.select("id"))


@query("margin_rank", "WITH s AS (SELECT vec_id AS id, 1 / (1 + exp(-(embedding[1]::DOUBLE - embedding[2]::DOUBLE))) AS p FROM embeddings) SELECT id, round(p, 6) AS p, row_number() OVER (ORDER BY abs(round(p, 6) - 0.5), id) AS pos FROM s ORDER BY pos LIMIT 50")
def margin_rank(spark, d):
    from pyspark.sql import Window

    p = F.round(1 / (1 + F.exp(-(F.get("features", F.lit(0)).cast("double") - F.get("features", F.lit(1)).cast("double")))), 6)
    near = (F.abs(F.col("p") - 0.5), "id")
    top = vectors(spark, d).select("id", p.alias("p")).orderBy(*near).limit(50)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*near)).cast("bigint"))  # 50 rows


@query("embed_hashing")
def embed_hashing(spark, d):
    """Vectors for the synopses that have none yet."""
    texts = items(spark, d).filter("synopsis is not null").select("id", F.col("synopsis").alias("text"))
    return learning.encode(texts, vectors(spark, d).filter("id % 2 = 0"))


_BASE = "https://books.example/list/"


def _page(parts) -> F.Column:
    return F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])


def _parts(spark, d):
    """Of part, what pages are made of: dealt out before they are made, as it is shorter."""
    return html.spread(read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).withColumn("k", F.col("p_partkey").cast("string"))


#: A site as data; its pages are made inside the queries.
SITE = Site(
    key="books", domains=("books.example",),
    index=IndexRules(link=r"/novel/([^/]+?)_\d+\.html", page=r"/novel/([^/]+?)\.html", number=r"_(\d+)\.html", count=r"(\d+)\s+[Cc]hapters?"),
    chapter=ChapterRules(address="{base}/novel/{id}_{n}.html", paragraphs="div.chapter-content p", phrases=("advert",)),
    search=SearchRules(address="https://books.example/find", base="https://books.example", item="li.hit", link='a[href^="/novel/"]', chapters=r"(\d+)\s+Chapters?", parameter="words", more={"show": "title"}),
    hooks={"metadata": html.metadata},
)


def _made(spark, d, page, step, schema, many: bool = False):
    """(id, error, parsed) of pages made from part."""
    pages = _parts(spark, d).select(F.col("p_partkey").alias("id"), page.alias("html"), F.lit(_BASE).alias("base"))
    return html.extract(pages, step, schema, many=many)


_CARD = "title:string,url:string,chapter_id:string,chapters:int,status:string,updated_text:string"


@query("html_catalog_cards", """SELECT p_partkey AS id, p_name || ' & co' AS title, 'https://books.example/novel/' || p_partkey::VARCHAR || '.html' AS url, p_partkey::VARCHAR AS chapter_id,
  CASE WHEN p_partkey % 4 <> 0 THEN p_size ELSE -1 END AS chapters, p_type AS status, CASE WHEN p_partkey % 3 <> 0 THEN '3 days Ago' END AS updated_text FROM part""")
def html_catalog_cards(spark, d):
    when = F.when(F.col("p_partkey") % 3 != 0, '<div class="novel-stats"><span><i class="icon">update</i> 3 days Ago</span></div>').otherwise("")
    size = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit('<div class="novel-stats"><span><i class="icon">book</i> '), F.col("p_size").cast("string"), F.lit(" chapters</span></div>"))).otherwise("")
    page = _page(['<ul><li class="novel-item"><b>no link</b></li><li class="novel-item"><a title="', F.col("p_name"), ' &amp; co" href="/novel/', F.col("k"), '.html"><h4 class="novel-title">x</h4>', size, '<div class="novel-stats">Status: <span class="status">', F.col("p_type"), "</span></div>", when, "</a></li></ul>"])
    return _made(spark, d, page, "cards", _CARD, many=True).select("id", F.inline("parsed")).fillna({"chapters": -1})


@query("html_metadata", """SELECT p_partkey AS id, p_name AS alt_title, p_brand AS author, '4.5' AS rating, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS status, [p_brand, p_type] AS genres,
  CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE p_name || chr(10) || chr(10) || p_type END AS synopsis FROM part""")
def html_metadata(spark, d):
    stat = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("<span><strong>old</strong><small>Status</small></span><span><strong>"), F.col("p_type"), F.lit("</strong><small>status</small></span>"))).otherwise("")
    about = F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.concat(F.lit("<p>"), F.col("p_name"), F.lit("</p><p> </p><p>"), F.col("p_type"), F.lit("</p>")))
    page = _page(['<h2 class="alternative-title">', F.col("p_name"), '</h2><div class="author"><span>Author:</span><span itemprop="author">', F.col("p_brand"), '</span></div><div class="rating"><strong>4.5</strong></div><div class="header-stats"><span><strong>9</strong><small>Views</small></span>', stat,
                  '</div><div class="categories"><ul><li><a>', F.col("p_brand"), "</a></li><li><a>", F.col("p_type"), '</a></li></ul><a>more</a></div><div class="summary"><p>Summary</p><div class="content">', about, "</div></div>"])
    return _made(spark, d, page, SITE.parser("metadata"), "alt_title:string,author:string,rating:string,status:string,genres:array<string>,synopsis:string").select("id", "parsed.*")


@query("html_listing_links", "SELECT p_partkey AS id, p_name AS title, '/series/' || p_partkey::VARCHAR AS url, p_partkey % 2 = 0 AS has_next FROM part")
def html_listing_links(spark, d):
    nav = F.when(F.col("p_partkey") % 2 == 0, '<a class="next_page" href="?p=2">next</a>').otherwise("")
    page = _page(['<div class="search_main_box_nu"><div class="search_title"><a href="/series/', F.col("k"), '">', F.col("p_name"), '</a></div></div><div class="digg_pagination">', nav, "</div>"])
    got = html.extract(_parts(spark, d).select(F.col("p_partkey").alias("id"), page.alias("html"), F.lit(_BASE).alias("base")), "listing", "hits:array<struct<title:string,url:string>>,has_next:boolean")
    return got.select("id", F.inline("parsed.hits"), "parsed.has_next")


@query("html_link_texts", "SELECT p_partkey AS id, [p_brand, p_name] AS texts FROM part")
def html_link_texts(spark, d):
    page = _page(['<div id="genres"><a>', F.col("p_brand"), "</a><a> </a><a>", F.col("p_name"), "</a></div><a>out</a>"])
    got = html.extract(_parts(spark, d).select(F.col("p_partkey").alias("id"), page.alias("html"), F.lit(_BASE).alias("base")), "link_texts", "texts:array<string>")
    return got.select("id", "parsed.texts")


@query("html_index_parse", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'Unknown Novel' ELSE p_name END AS title, p_partkey::VARCHAR AS chapter_id, (CASE WHEN p_partkey % 3 = 0 THEN 99 ELSE 42 END)::BIGINT AS total FROM part")
def html_index_parse(spark, d):
    head = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("<h1>"), F.col("p_name"), F.lit("</h1>")))
    count = F.when(F.col("p_partkey") % 3 == 0, "<span>99 Chapters</span>").otherwise("")
    page = _page([head, count, '<a rel="NoFollow" href="/novel/decoy_900.html">x</a><a style="opacity: 0" href="/novel/decoy_800.html">x</a><a style="opacity:0.85" href="/novel/', F.col("k"), '_7.html">7</a><a href="/novel/', F.col("k"), '_42.html">42</a>'])
    return _made(spark, d, page, SITE.parser("index"), "title:string,chapter_id:string,total:bigint").select("id", "parsed.*")


@query("html_paragraphs", "SELECT p_partkey AS id, 'Chapter 7' AS title, '<p>' || p_name || ' &amp; more</p>' AS body_html FROM part")
def html_paragraphs(spark, d):
    page = _page(['<div class="chapter-content"><p>Ok.</p><p>', F.col("p_name"), ' &amp; more</p><p>an advert here</p><p><a href="#">next one</a></p></div>'])
    got = html.extract(_parts(spark, d).select(F.col("p_partkey").alias("id"), page.alias("html"), F.lit(_BASE).alias("base")), lambda h, b: SITE.parser("chapter")(h, b, 7), "title:string,body_html:string")
    return got.select("id", "parsed.*")


_SERIES = "url:string,title:string,associated_names:array<string>,genres:array<string>,tags:array<string>,author:string,status:string,groups:array<string>,release_frequency:string,rating:string,votes:string,synopsis:string"


def _series_page():
    often = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit('<h5 class="seriesother">Release Frequency</h5>Every '), F.col("p_size").cast("string"), F.lit(" Day(s)"))).otherwise('<h5 class="seriesother">Release Frequency</h5><a>none</a>')
    rated = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit('<h5 class="seriesother">Rating<span class="uvotes">(4.5 / 5.0, 1,7'), F.col("p_size").cast("string"), F.lit(" votes)</span></h5>"))).otherwise("")
    author = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('<div id="showauthors"></div><a id="authtag">'), F.col("p_brand"), F.lit("</a>"))).otherwise(F.concat(F.lit('<div id="showauthors"><a>'), F.col("p_brand"), F.lit("</a><a>Second</a></div>")))
    return _page(['<span class="seriestitlenu">', F.col("p_name"), '</span><div id="editassociated">', F.col("p_name"), "<br>", F.col("p_brand"), '<br></div><div id="seriesgenre"><a>', F.col("p_type"), '</a></div><div id="showtags"><a>one</a><a> </a><a>', F.col("p_brand"), "</a></div>", author,
                  '<div id="showtranslated"><a>No</a></div><div id="editstatus">', F.col("p_size").cast("string"), ' Chapters (Ongoing)</div><ol class="sp_grouptable"><li><span style="padding-left:20px;">', F.col("p_type"), "</span><span>x</span></li></ol>", often, rated, '<div id="editdescription"><p>', F.col("p_type"), "</p></div>"])


_SERIES_SQL = """SELECT p_partkey AS id, 'https://books.example/list/' AS url, p_name AS title, [p_name, p_brand] AS associated_names, [p_type] AS genres, ['one', p_brand] AS tags,
  CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_brand || ', Second' END AS author, p_size::VARCHAR || ' Chapters (Ongoing)' AS status, [p_type] AS groups,
  CASE WHEN p_partkey % 3 <> 0 THEN 'Every ' || p_size::VARCHAR || ' Day(s)' END AS release_frequency, CASE WHEN p_partkey % 4 <> 0 THEN '4.5' END AS rating,
  CASE WHEN p_partkey % 4 <> 0 THEN '1,7' || p_size::VARCHAR END AS votes, p_type AS synopsis FROM part"""


@query("html_series_struct", _SERIES_SQL)
def html_series_struct(spark, d):
    return _made(spark, d, _series_page(), "series", _SERIES).select("id", "parsed.*")


@query("html_search_results", """SELECT p_partkey AS id, p_name AS title, 'https://books.example/novel/' || p_partkey::VARCHAR || '.html' AS url, CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE -1 END AS chapters FROM part
UNION ALL SELECT p_partkey, p_type, 'https://books.example/novel/other.html', -1 FROM part""")
def html_search_results(spark, d):
    count = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("<span>"), F.col("p_size").cast("string"), F.lit(" Chapters</span>"))).otherwise("")
    page = _page(['<ul><li class="hit"><a href="/about">no book</a></li><li class="hit"><a href="/tag/x">tag</a><a title="', F.col("p_name"), '" href="/novel/', F.col("k"), '.html">short</a>', count, '</li><li class="hit"><a href="/novel/other.html">', F.col("p_type"), '</a></li><li>9 Chapters</li></ul>'])
    return _made(spark, d, page, SITE.parser("search"), "title:string,url:string,chapters:int", many=True).select("id", F.inline("parsed")).fillna({"chapters": -1})


@query("series_candidates", """WITH h AS (SELECT p_type AS url, p_name AS title, p_partkey AS place FROM part), best AS (SELECT url, arg_max(title, length(title) * 1000000000 - place) AS hit FROM h GROUP BY url),
  p AS (SELECT p_type AS url, min(p_partkey) AS id FROM part GROUP BY 1) SELECT best.url, hit, p_name AS title, [p_name, p_brand] AS associated_names FROM best JOIN p USING (url) JOIN part ON p_partkey = p.id""")
def series_candidates(spark, d):
    """Search hits, one per address with the longest title, and the series page behind each."""
    found = dedupe_longest_title(spark, d).select("url", F.col("title").alias("hit"))
    pages = _parts(spark, d).groupBy(F.col("p_type").alias("base")).agg(F.min_by(_series_page(), "p_partkey").alias("html")).withColumn("id", F.col("base"))
    series = html.extract(pages, "series", _SERIES).select("parsed.*")
    return found.join(series, "url").select("url", "hit", "title", "associated_names")


@query("page_outline", """WITH a AS (SELECT page_id AS id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(url, '^(https?://[^/]+)', 1) AS root,
  regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '<a href="([^"]*)"', 1) AS hrefs, html FROM pages)
SELECT id, lang, len(hrefs)::BIGINT AS links, hrefs[1] AS first, ((length(html) - length(replace(html, '<p>', ''))) // 3)::BIGINT AS paragraphs FROM a""")
def page_outline(spark, d):
    p = html.spread(read(spark, d, "pages").select("page_id", "url", "html")).select(F.col("page_id").alias("id"), "html", F.lit("").alias("base"))
    got = html.extract(p, "outline", "lang:string,title:string,links:array<string>,paragraphs:bigint")
    return got.select("id", "parsed.lang", F.size("parsed.links").cast("bigint").alias("links"), F.get("parsed.links", F.lit(0)).alias("first"), "parsed.paragraphs")


@query("error_as_value", "SELECT page_id AS id, page_id % 10 = 0 AS failed FROM pages")
def error_as_value(spark, d):
    def picky(page, base):
        if page.endswith("!"):
            raise ValueError("bad page")
        return {"n": len(page)}

    p = html.spread(read(spark, d, "pages").select("page_id", "url", "html")).select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 10 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("html"), F.col("url").alias("base"))
    return html.extract(p, picky, "n:bigint").select("id", F.col("error").isNotNull().alias("failed"))


@query("epub_scan", "SELECT 'book-' || conv_id::VARCHAR || '.epub' AS path, 'chap_' || lpad((turn + 1)::VARCHAR, 4, '0') || '.xhtml' AS name, role AS title FROM conversations")
def epub_scan(spark, d):
    return epub.scan(epub.books(chapters(spark, d))).select("path", "name", "title")




@query("grep_books", """SELECT 'book-' || conv_id || '.epub' AS path, 'chap_' || lpad((turn + 1)::VARCHAR, 4, '0') || '.xhtml' AS name, role AS title,
  len(regexp_extract_all(role || ' ' || text, '(?i)and the')) AS hits FROM conversations WHERE hits > 0 AND NOT (conv_id % 9 = 0 AND turn = 0)""")
def grep_books(spark, d, needle: str = "and the"):
    """Chapters of indexed books that hold a needle, and how often: the index proposes, the text decides."""
    folder = f"{scratch_root(spark)}/grep-{uuid.uuid4().hex}"
    files = materialize(epub.books(chapters(spark, d)), "epubs")  # both runs read them
    # two runs: the second adds what the first has left out
    search.add(spark, folder, files.filter("path like '%0.epub'"))
    search.add(spark, folder, files)
    return search.grep(spark, folder, needle).groupBy("path", "name", "title").agg(F.max("k").cast("bigint").alias("hits"))
