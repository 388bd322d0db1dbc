import pytest
from pyspark.sql import functions as F

from loomspark.plans import graph_queries
from loomspark.sources import html


def test_a_small_file_of_parts_is_parsed_in_many_tasks(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")], F.lit(1).alias("p_size"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sizes = [r["count"] for r in graph_queries._parts(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 100 and sum(sizes) == 400


def test_selectors_look_only_at_elements_of_their_tag(monkeypatch):
    doc = html.parse("<div><p>a<p class='x y'>b</div><i>" * 3 + "<a id=q href=1>c</a>" + "<br>" * 50)
    looked, real = [], html.Node.matches
    monkeypatch.setattr(html.Node, "matches", lambda self, step: looked.append(self.name) or real(self, step))
    assert [a.text for a in doc.select("a[href]")] == ["c"] and looked == ["a"]
    assert [len(d.select("p.x")) for d in doc.select("div")] == [1, 1, 1] and len(doc.select("div p p")) == 3
    assert doc.first(".y").text == "b" and doc.first("#q").attrs["href"] == "1" and doc.select("div")[2].first("a") is None
    with pytest.raises(ValueError):
        doc.first("a > b")


def test_a_run_of_the_frontier_sorts_its_attempts_once(spark):
    from loomspark.operators import frontier

    tries = spark.createDataFrame([(s, p, 1, "good", True) for s in "ab" for p in (1, 2)], "site string, page long, attempt int, kind string, has_next boolean")
    none = [spark.createDataFrame([], s) for s in (frontier.STATE, frontier.PAGES)]
    new, ahead = frontier.advance(*none, tries, first=1)
    assert {(r["site"], r["next_page"], r["reason"]) for r in new.collect()} == {("a", 3, "open"), ("b", 3, "open")} and ahead.count() == 0
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "aggregate(" not in plan


def test_books_are_written_once_for_both_runs_of_the_index(spark, monkeypatch):
    from loomspark.operators import search

    given, real = [], search.add
    monkeypatch.setattr(search, "add", lambda s, folder, books: given.append(books) or real(s, folder, books))
    graph_queries.grep_books(spark, "/root/testdata/sf0.001")
    assert len(given) == 2 and not any("FlatMapGroups" in b._jdf.queryExecution().optimizedPlan().toString() for b in given)
    texts = ["ab", "", "abcabcd", "x😀yz", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(search.triples(F.col("t"))).collect()]
    assert got == [[], [], ["abc", "bca", "cab", "bcd"], ["x😀y", "😀yz"], None]
