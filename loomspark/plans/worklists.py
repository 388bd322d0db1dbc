"""Worklists, lookups, statistics and breakdowns over the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .base import ATTEMPTS, CHAPTERS, ITEMS, TIERS, attempts, chapters, items, query, read, tiers

MIN_CHAPTERS = 8


def candidate(df, least: int = MIN_CHAPTERS):
    """Adds the candidate flag: 1 from ``least`` chapters on, 0 for fewer or an unknown number."""
    return df.withColumn("candidate", F.when(F.col("chapter_count") >= least, 1).otherwise(0))


def pending(df, missing, limit: int | None = None):
    """Candidates for which ``missing`` holds, in id order."""
    out = candidate(df).filter((F.col("candidate") == 1) & missing).select("id").orderBy("id")
    return out if limit is None else out.limit(limit)


def _pending_sql(cond: str) -> str:
    return f"WITH {ITEMS} SELECT id FROM items WHERE chapter_count >= {MIN_CHAPTERS} AND {cond}"


query("pending_metadata", _pending_sql("synopsis IS NULL"))(lambda s, d: pending(items(s, d), F.col("synopsis").isNull()))
query("pending_resolution", _pending_sql("resolution IS NULL"))(lambda s, d: pending(items(s, d), F.col("resolution").isNull()))
query("pending_details", f"WITH {ITEMS} SELECT id FROM items WHERE synopsis IS NULL")(lambda s, d: items(s, d).filter(F.col("synopsis").isNull()).select("id").orderBy("id"))
query("pending_chapters", _pending_sql("unsampled"))(lambda s, d: pending(items(s, d), F.col("unsampled")))


@query("pending_embedding", f"WITH {ITEMS} SELECT id FROM items WHERE chapter_count >= {MIN_CHAPTERS} AND synopsis IS NOT NULL AND id NOT IN (SELECT vec_id FROM embeddings)")
def pending_embedding(spark, d):
    have = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return candidate(items(spark, d)).filter("candidate = 1 and synopsis is not null").join(have, "id", "left_anti").select("id")


@query("candidate_flag", f"WITH {ITEMS} SELECT id, CASE WHEN chapter_count >= {MIN_CHAPTERS} THEN 1 ELSE 0 END AS candidate FROM items")
def candidate_flag(spark, d):
    return candidate(items(spark, d)).select("id", "candidate")


@query("point_lookup", f"WITH {ITEMS} SELECT id, site_key, author FROM items WHERE id = 17")
def point_lookup(spark, d):
    return items(spark, d).filter("id = 17").select("id", "site_key", "author")


@query("search_index", f"WITH {ITEMS} SELECT id, title, author, status FROM items WHERE chapter_count >= {MIN_CHAPTERS}")
def search_index(spark, d):
    return candidate(items(spark, d)).filter("candidate = 1").select("id", "title", "author", "status")


@query("title_search", f"WITH {ITEMS} SELECT id, title, row_number() OVER (ORDER BY title NULLS FIRST, id) AS pos FROM items WHERE translate(title, '{S.ASCII_UPPER}', '{S.ASCII_LOWER}') LIKE '%the%' ORDER BY pos LIMIT 20")
def title_search(spark, d):
    top = items(spark, d).filter(S.like_ascii(F.col("title"), "The")).select("id", "title").orderBy(F.col("title").asc_nulls_first(), "id").limit(20)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.col("title").asc_nulls_first(), "id")).cast("bigint"))  # 20 rows


@query("library_search", f"WITH {ITEMS} SELECT id, title FROM items WHERE contains(lower(title), 'ée')")
def library_search(spark, d):
    return items(spark, d).filter(F.contains(F.lower("title"), F.lit("ÉE".lower()))).select("id", "title")


@query("pipeline_stats", f"""WITH {ITEMS} SELECT count(*)::BIGINT AS total, count(*) FILTER (chapter_count >= {MIN_CHAPTERS})::BIGINT AS candidates,
  count(*) FILTER (chapter_count >= {MIN_CHAPTERS} AND synopsis IS NOT NULL)::BIGINT AS with_metadata,
  count(*) FILTER (chapter_count >= {MIN_CHAPTERS} AND resolution IS NOT NULL)::BIGINT AS resolved,
  count(*) FILTER (chapter_count >= {MIN_CHAPTERS} AND NOT unsampled)::BIGINT AS sampled FROM items""")
def pipeline_stats(spark, d):
    c = F.col("candidate") == 1
    return candidate(items(spark, d)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c).alias("candidates"), F.count_if(c & F.col("synopsis").isNotNull()).alias("with_metadata"),
        F.count_if(c & F.col("resolution").isNotNull()).alias("resolved"), F.count_if(c & ~F.col("unsampled")).alias("sampled"),
    )


@query("status_breakdown", f"WITH {ITEMS} SELECT status, count(*)::BIGINT AS n FROM items WHERE chapter_count >= {MIN_CHAPTERS} GROUP BY status")
def status_breakdown(spark, d):
    return candidate(items(spark, d)).filter("candidate = 1").groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


@query("resolution_breakdown", f"WITH {ITEMS} SELECT resolution, count(*)::BIGINT AS n FROM items WHERE resolution IS NOT NULL GROUP BY resolution")
def resolution_breakdown(spark, d):
    return items(spark, d).filter("resolution is not null").groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))


@query("label_progress", f"WITH {TIERS} SELECT label, count(*)::BIGINT AS n, list_position(['skip','drop','meh','like','love','obsessed'], label)::INTEGER AS tier FROM tiers GROUP BY label")
def label_progress(spark, d):
    return tiers(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("tier", S.label_rank(F.col("label")))


@query("first_excerpt", f"""WITH {CHAPTERS}, f AS (SELECT item_id, arg_min(body, n) AS body FROM chapters GROUP BY item_id)
SELECT item_id, CASE WHEN coalesce(body, '') = '' THEN NULL WHEN length(body) <= 100 THEN body ELSE regexp_replace(substr(body, 1, 100), '\\s+$', '') || '…' END AS excerpt FROM f""")
def first_excerpt(spark, d):
    return chapters(spark, d).groupBy("item_id").agg(F.min_by("body", "n").alias("body")).select("item_id", S.excerpt(F.col("body"), 100).alias("excerpt"))


@query("sanity_check", f"""WITH {CHAPTERS}, c AS (SELECT item_id, count(*)::BIGINT AS n_chapters, min(CASE WHEN length(body) < 50 THEN n END) AS short FROM chapters GROUP BY item_id)
SELECT item_id, n_chapters, n_chapters >= 3 AND short IS NULL AS ok, CASE WHEN n_chapters < 3 THEN 'too few chapters' WHEN short IS NOT NULL THEN 'short chapter ' || short::VARCHAR END AS reason FROM c""")
def sanity_check(spark, d, least: int = 3, chars: int = 50):
    c = chapters(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_chapters"), F.min(F.when(F.length("body") < chars, F.col("n"))).alias("short"))
    return c.select(
        "item_id", "n_chapters", ((F.col("n_chapters") >= least) & F.col("short").isNull()).alias("ok"),
        F.when(F.col("n_chapters") < least, "too few chapters").when(F.col("short").isNotNull(), F.concat(F.lit("short chapter "), F.col("short").cast("string"))).alias("reason"),
    )


@query("check_targets", "SELECT c_mktsegment AS site, c_custkey AS id FROM customer WHERE (c_mktsegment, c_custkey) IN (SELECT c_mktsegment, c_custkey FROM customer WHERE c_custkey IN (3, 8, 12))")
def check_targets(spark, d, only=(3, 8, 12)):
    """The pairs SITE:ID asked for, switched off or not."""
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("site"), F.col("c_custkey").alias("id"))
    asked = c.filter(F.col("id").isin(list(only))).select(F.concat_ws(":", "site", "id").alias("text"))
    pairs = asked.select(S.site_and_id(F.col("text")).alias("x")).select("x.site", F.col("x.id").cast("long").alias("id"))
    return c.join(pairs, ["site", "id"], "left_semi")


@query("check_targets_enabled", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0")
def check_targets_enabled(spark, d):
    """Without a choice: all that are switched on."""
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5 != 0).alias("enabled")).filter("enabled").select("id")


@query("catalog_counts", f"WITH {ITEMS} SELECT site_key, count(*)::BIGINT AS listed, count(synopsis)::BIGINT AS with_details FROM items GROUP BY site_key")
def catalog_counts(spark, d):
    return items(spark, d).groupBy("site_key").agg(F.count(F.lit(1)).alias("listed"), F.count("synopsis").alias("with_details"))


@query("crawl_skip_rule", f"""WITH {ITEMS} SELECT CASE WHEN chapter_count IS NOT NULL AND NOT unsampled THEN 'skipped' ELSE 'new_or_updated' END AS outcome, count(*)::BIGINT AS n FROM items GROUP BY 1""")
def crawl_skip_rule(spark, d, refresh: bool = False):
    known = F.col("chapter_count").isNotNull() & ~F.col("unsampled") & F.lit(not refresh)
    return items(spark, d).groupBy(F.when(known, "skipped").otherwise("new_or_updated").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("check_tally", f"WITH {ATTEMPTS} SELECT CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, count(*)::BIGINT AS n FROM attempts GROUP BY 1")
def check_tally(spark, d):
    return attempts(spark, d).groupBy(F.when(F.col("ok"), "ok").otherwise("error").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("exclude_union", f"WITH {TIERS} SELECT id FROM tiers UNION SELECT doc_id FROM documents WHERE lang = 'de'")
def exclude_union(spark, d):
    return tiers(spark, d).select("id").union(read(spark, d, "documents").filter("lang = 'de'").select("doc_id")).distinct()


@query("resolved_catalog", "SELECT DISTINCT p_name AS title, list_transform(string_split(p_name || ', ' || p_brand, ','), lambda x: trim(x)) AS names FROM part")
def resolved_catalog(spark, d):
    p = read(spark, d, "part")
    return p.select(F.col("p_name").alias("title"), S.split_list(F.concat_ws(", ", "p_name", "p_brand")).alias("names")).distinct()


@query("search_hits_limit", f"WITH {ITEMS} SELECT id FROM items ORDER BY id LIMIT 15")
def search_hits_limit(spark, d):
    return items(spark, d).select("id").orderBy("id").limit(15)
