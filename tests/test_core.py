import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import scalars as S
from loomspark.operators import graph, learning, resolve, runs, tables
from loomspark.sources import epub, html
from loomspark.sources.site import ChapterRules, IndexRules, SearchRules, Site, Unsupported, site_for


def breaker(spark, oks, k=3):
    df = spark.createDataFrame([(1, i + 1, o) for i, o in enumerate(oks)], "key long, n long, ok boolean")
    r = runs.breaker(df, k).first()
    return r["stopped_at"], r["failed"], r["attempted"]


def test_breaker_trips_at_the_start_of_the_streak(spark):
    assert breaker(spark, [True, True, False, True, False, False, True, True], 2) == (5, [3, 5, 6], 6)


def test_runs_of_keys_that_span_ranges(spark):
    """Ranges of four rows give what one loop over each key gives; places have gaps, and a null key is a key."""
    import random

    rng = random.Random(5)
    outcomes = {}
    for key, size, p in ((None, 30, 0.4), (1, 45, 0.2), (2, 1, 0.5), (3, 20, 1.1), (4, 25, -1.0)):
        places = sorted(rng.sample(range(1, 200), size))
        outcomes[key] = [(n, rng.random() < p, rng.choice([None, 0.0, 3.5, 40.0])) for n in places]
    rows = [(k, *r) for k, rs in outcomes.items() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, n long, ok boolean, asked double").coalesce(2)
    cut = {r["key"]: r for r in runs.breaker(df, 3, rows=4).collect()}
    pace = {r["key"]: r["interval"] for r in runs.pacing(df, rows=4).collect()}
    tail = {r["key"]: r["run"] for r in runs.trailing_run(df).collect()}
    first = runs.until_failure(df).collect()
    places = runs.numbered_within(df, "key", ["n"], "at", rows=4).collect()
    for key, rs in outcomes.items():
        streak, stop, failed, attempted, interval, since = [], None, [], 0, 2.5, 0
        for n, ok, asked in rs:
            streak = [] if ok else [*streak, n]
            since = 0 if ok else since + 1
            if not ok:
                interval = min(max(interval * 2 if asked is None else asked, interval), 120.0)
            if stop is None:
                attempted += 1
                failed += [] if ok else [n]
                stop = streak[0] if len(streak) == 3 else None
        assert (cut[key]["stopped_at"], cut[key]["attempted"], cut[key]["failed"]) == (stop, attempted, failed)
        assert (pace[key], tail[key]) == (interval, since)
        oks = [ok for _, ok, _ in rs]
        assert sorted(r["n"] for r in first if r["key"] == key) == [r[0] for r in rs][: oks.index(False) + 1 if False in oks else None]
        assert [r["n"] for r in sorted((r for r in places if r["key"] == key), key=lambda r: r["at"])] == [r[0] for r in rs]
        assert sorted(r["at"] for r in places if r["key"] == key) == list(range(1, len(rs) + 1))
    assert runs.breaker(df.limit(0)).count() == runs.pacing(df.limit(0)).count() == 0


def test_breaker_counts_anew_after_a_success(spark):
    assert breaker(spark, [False, True, False, True, False], 2) == (None, [1, 3, 5], 5)


def test_interleave_places_items_proportionally(spark, monkeypatch):
    rows = [(b, i, f"{b}{i}") for b, n in ((0, 6), (1, 3), (2, 1)) for i in range(n)]
    marks = sorted((sum([1.0 / n] * (i + 1)), b, i) for b, n in ((0, 6), (1, 3), (2, 1)) for i in range(n))
    got = runs.interleave(spark.createDataFrame(rows, "b int, o int, v string"), "b", "o").orderBy("pos").collect()
    assert [r["v"] for r in got] == [f"{b}{i}" for _, b, i in marks]


def test_numbers_are_gapless_over_ranges(spark):
    values = [(i * 37 % 101, i) for i in range(101)]
    got = runs.numbered(spark.createDataFrame(values, "x int, i int"), ["x"], "no", start=5, rows=9).collect()
    assert sorted((r["x"], r["no"]) for r in got) == [(x, x + 5) for x in range(101)]
    assert runs.numbered(spark.createDataFrame([], "x int"), ["x"]).count() == 0


def test_upsert_is_idempotent_and_keeps_created(spark):
    base = spark.createDataFrame([(1, "old", "t0"), (2, "b", "t0")], "id int, title string, created string")
    delta = spark.createDataFrame([(1, None, "t1"), (3, "c", "t1")], "id int, title string, created string")
    once = tables.upsert(base, delta, ["id"], ["title"])
    twice = tables.upsert(once, delta, ["id"], ["title"])
    want = [(1, None, "t0"), (2, "b", "t0"), (3, "c", "t1")]
    assert sorted(map(tuple, once.collect()), key=lambda r: r[0]) == want == sorted(map(tuple, twice.collect()), key=lambda r: r[0])


def test_dictionary_goes_on_from_the_last_number(spark):
    known = spark.createDataFrame([(7, "a")], "id long, name string")
    got = tables.dictionary(spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "name string"), known)
    assert sorted(map(tuple, got.collect())) == [(7, "a"), (8, "b"), (9, "c")]


@pytest.mark.parametrize(("text", "want"), [(None, None), ("", None), ("a few words", "a few words"), ("ab " * 300, ("ab " * 200).rstrip() + "…")])
def test_excerpt(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.excerpt(F.col("t"))).first()[0] == want


def test_grep_context(spark):
    df = spark.createDataFrame([("one (two) three (TWO) four",)], "t string")
    got = [r["h"]["snippet"] for r in df.select(F.explode(S.snippets(F.col("t"), "(two)", 4)).alias("h")).collect()]
    assert got == ["one (two) thr", "ree (TWO) fou"]
    assert df.select(F.regexp_count("t", F.lit(S.literal_pattern("(two)")))).first()[0] == 2


def test_cooccurrence(spark):
    df = spark.createDataFrame([(1, "sea"), (1, "war"), (1, "sea"), (2, "war"), (2, "sea"), (2, "cook"), (3, "cook"), (4, "war"), (4, "cook")], "item int, tag string")
    assert sorted(map(tuple, graph.cooccurrence(df).collect())) == [("cook", "sea", 1), ("cook", "war", 2), ("sea", "war", 2)]


def test_communities_keep_isolated_tags(spark):
    edges = spark.createDataFrame([(a, b, 3) for g in ("abc", "xyz") for a, b in ((g[0], g[1]), (g[0], g[2]), (g[1], g[2]))], "a string, b string, weight long")
    nodes = spark.createDataFrame([(c,) for c in "abcxyzq"], "node string")
    got = dict(map(tuple, graph.communities(edges, nodes).collect()))
    assert len({got[c] for c in "abc"}) == len({got[c] for c in "xyz"}) == 1 and len(set(got.values())) == 3


def test_resolve_all_titles_and_names(spark):
    probes = spark.createDataFrame([(1, ["zzz qqq", "silver river road"]), (2, ["twin peak house", None]), (3, ["xx"])], "id long, title array<string>")
    catalog = spark.createDataFrame([(1, ["other thing", "silver river road", "silver river roads"]), (2, ["twin peak house"]), (3, ["twin peak house"]), (4, ["twin peak house"])], "cid long, name array<string>")
    got = {r["id"]: (r["decision"], r["best"], r["best_score"]) for r in resolve.resolve(probes, catalog).collect()}
    assert got == {1: ("auto", 1, 100.0), 2: ("ambiguous", 2, 100.0), 3: ("no_candidates", None, None)}


def test_resolve_decisions(spark):
    probes = spark.createDataFrame([(1, "lamp of the harbour"), (2, "xylem")], "id long, title string")
    catalog = spark.createDataFrame([(1, "lamp of the harbour"), (2, "cold mountain orchard")], "cid long, name string")
    got = {r["id"]: (r["decision"], r["best"]) for r in resolve.resolve(probes, catalog).collect()}
    assert got == {1: ("auto", 1), 2: ("no_candidates", None)}
    parts = spark.createDataFrame([(1, "lamp of the harbour, first night"), (2, "lamp of the harbour, last night")], "cid long, name string")
    assert resolve.resolve(probes.filter("id = 1"), parts).first()["decision"] == "ambiguous"


def test_candidate_pairs_are_few_and_lose_none(spark):
    rng = np.random.default_rng(3)
    words = ["of", "the", *("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 12))) for _ in range(150))]
    odds = np.r_[0.2, 0.2, np.full(150, 0.6 / 150)]
    made = lambda n: [" ".join(rng.choice(words, rng.integers(1, 6), p=odds)) for _ in range(n)]
    a = spark.createDataFrame([(t,) for t in set(made(150))], "title string")
    b = spark.createDataFrame([(t,) for t in set(made(150))], "name string")
    pairs = resolve.candidate_pairs(a, b)
    all_ = a.join(b, F.lit(True)).withColumn("score", resolve.token_set_ratio(F.col("title"), F.col("name"))).filter(F.col("score") >= resolve.FLOOR)
    lost = all_.join(pairs, ["title", "name"], "left_anti").count()
    assert lost == 0 and pairs.count() < 0.35 * a.count() * b.count()


def test_far_groups_are_clusters_of_their_own():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.1, (n, 6)) for m, n in ((-7, 18), (0, 22), (9, 12))])
    ids = learning.density_labels(x, 4)
    found = [set(ids[a:b]) - {-1} for a, b in ((0, 18), (18, 40), (40, 52))]
    assert all(found) and not found[0] & found[1] and not found[1] & found[2]


def test_second_pass_finds_small_groups_and_keeps_large_ones_out():
    ids = np.array([0] * 10 + [-1] * 30)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros((10, 2)), rng.normal(30, 0.1, (6, 2)), rng.normal(-50, 0.1, (24, 2))])
    out = learning.recluster(x, ids, 3, 0.3)
    assert (out[:10] == 0).all() and (out[16:] == -1).all() and len(set(out[10:16])) == 1 and out[10] > 0
    assert (learning.recluster(x[:12], ids[:12], 5, 0.3) == ids[:12]).all()


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_core_distance_prunes_and_stays_exact(spark, monkeypatch, offset):
    from loomspark.operators import nearest

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.3, (n, 4)) for m, n in ((0, 120), (8, 40), (-8, 7))] + [np.zeros((9, 4)), np.ones((2, 4))]) + offset
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (999, None)], "id long, features array<double>")
    met = []
    real = nearest._meetings
    monkeypatch.setattr(nearest, "_meetings", lambda *a: met.extend(real(*a)) or real(*a))
    got = {r["id"]: r["core"] for r in learning.core_distance(df, 3, block=16).collect()}
    want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) + np.diag(np.full(len(x), np.inf)), axis=1)[:, 2]
    assert len(got) == len(x) and max(abs(got[i] - want[i]) for i in range(len(x))) < 1e-9
    units = {u for u, _, _ in met}
    everything = len(units) * (len(units) - 1)  # each unit to each other one
    assert 0 < len(met) < 0.8 * everything and max(sum(u == w for w, _, _ in met) for u in units) < len(units)
    assert learning.core_distance(df.limit(0)).count() == 0
    assert learning.core_distance(df.limit(2), 5).first()["core"] is None


def test_cluster_map_has_places(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(10 * (i % 2), 0.1, 5).tolist()) for i in range(40)]
    got = learning.cluster_map(spark.createDataFrame(rows, "id long, features array<double>"), 3, 5).collect()
    sides = {r["id"] % 2: set() for r in got}
    for r in got:
        sides[r["id"] % 2].add(r["x"] > got[0]["x"] + 8 or r["x"] < got[0]["x"] - 8)
    assert len(got) == 40 and all(len(s) == 1 for s in sides.values()) and sides[0] != sides[1]


def test_communities_on_several_levels():
    ring = {(f"n{i:02d}", f"n{(i + 1) % 24:02d}"): 1.0 for i in range(24)}
    com = graph.levels({tuple(sorted(k)): w for k, w in ring.items()})
    assert 3 <= len(set(com.values())) <= 6


def test_uncertainty_model_needs_two_classes(spark):
    df = spark.createDataFrame([([0.0, 1.0], 1, 1.0), ([1.0, 0.0], 1, 1.0)], "features array<double>, y int, weight double")
    assert learning.train_uncertainty(df) is None


def test_paragraph_rules():
    page = '<h2>Rain</h2><div class="chapter-content"><p>No.</p><p>wind & waves all day</p><p>has an advert</p><p>see <a href="#">here</a></p></div>'
    assert html.chapter(page, 1) == {"title": "Rain", "body_html": "<p>wind &amp; waves all day</p>"}
    assert html.chapter("<p>x</p>", 6)["title"] == "Chapter 6"


CARDS = """<ul class="novel-list"><li class="novel-item"><a href="/novel/tide.html" title="Tide &amp; Time"><h4 class="novel-title">Tide</h4>
<div class="novel-stats"><span><i class="material-icons">book</i> 31 Chapters</span></div><div class="novel-stats">Status: <span class="status"> Completed </span></div>
<div class="novel-stats"><span><i class="material-icons">update</i> 5 hours AGO</span></div></a></li>
<li class="novel-item"><a href="https://other.example/novel/moss.html"><h4 class="novel-title">Moss</h4><div class="novel-stats">soon</div></a></li><li class="novel-item">no link</li></ul>"""


def test_cards_read_the_stat_lines():
    assert html.cards(CARDS, "https://s.example/") == [
        {"title": "Tide & Time", "url": "https://s.example/novel/tide.html", "chapter_id": "tide", "chapters": 31, "status": "Completed", "updated_text": "5 hours AGO"},
        {"title": "Moss", "url": "https://other.example/novel/moss.html", "chapter_id": "moss", "chapters": None, "status": None, "updated_text": None},
    ]


DETAIL = """<h2 class="alternative-title">Ebb</h2><div class="author"><span>By</span> <span itemprop="author">R. Quill</span></div><div class="rating"><b>4</b>.1</div>
<div class="header-stats"><span><strong>88</strong><small>Views</small></span><span><strong>Paused</strong><small>STATUS</small></span><span><strong>Ongoing</strong><small>Status</small></span></div>
<div class="categories"><ul><li><a>Sea</a></li><li><a>Craft</a></li></ul><a>all</a></div><div class="summary"><p>About</p><div class="content"><p>One.</p><p> </p><p>Two.</p></div></div>"""


def test_metadata_markup():
    want = {"alt_title": "Ebb", "author": "R. Quill", "rating": "4.1", "status": "Ongoing", "genres": ["Sea", "Craft"], "synopsis": "One.\n\nTwo."}
    assert html.metadata(DETAIL) == want
    assert html.metadata("<p>x</p>") == {"alt_title": None, "author": None, "rating": None, "status": None, "genres": [], "synopsis": None}
    assert html.metadata('<div class="summary"><div class="content">bare</div></div>')["synopsis"] == "bare"


SERIES = """<span class="seriestitlenu">Tide</span><div id="editassociated">Ebbe<br>Maree</div><div id="seriesgenre"><a>Sea</a></div><div id="showtags"><a>boats</a><a></a></div>
<div id="showauthors"><a>Quill</a><a>Reed</a></div><div id="showtranslated"><a>No</a></div><div id="editstatus">12 Chapters (Ongoing)</div>
<ol class="sp_grouptable"><li><span style="padding-left:20px;">Harbour Crew</span><span>other</span></li></ol><h5 class="seriesother">Release Frequency</h5>Every 9.5 Day(s)
<h5 class="seriesother">Rating<span class="uvotes">(3.9 / 5.0, 1,204 votes)</span></h5><div id="editdescription"><p>Waves.</p></div>"""


def test_series_fields():
    assert html.series(SERIES, "u") == {
        "url": "u", "title": "Tide", "associated_names": ["Ebbe", "Maree"], "genres": ["Sea"], "tags": ["boats"], "author": "Quill, Reed", "status": "12 Chapters (Ongoing)", "groups": ["Harbour Crew"],
        "release_frequency": "Every 9.5 Day(s)", "rating": "3.9", "votes": "1,204", "synopsis": "Waves.",
    }
    assert html.series('<a id="authtag">Solo</a><h5 class="seriesother">Release Frequency</h5><h5 class="seriesother">x</h5>')["author"] == "Solo"
    assert html.series('<h5 class="seriesother">Release Frequency</h5><h5 class="seriesother">x</h5>')["release_frequency"] is None


def harbour(**more):
    return Site(
        "harbour", ("s.example",), index=IndexRules(r"/novel/([^/]+?)_\d+\.html", r"/novel/([^/]+?)\.html", r"_(\d+)\.html", r"(\d+)\s+[Cc]hapters?"),
        chapter=ChapterRules("{base}/novel/{id}_{n}.html", "div.chapter-content p"),
        search=SearchRules("https://s.example/find", "li.hit", "https://s.example", 'a[href^="/novel/"]', r"(\d+)\s+Chapters", "post", "words", {"show": "title"}), **{"hooks": {"metadata": html.metadata}, **more},
    )


def test_sites_are_data_with_hooks():
    s = harbour()
    page = '<li class="hit"><a href="/help">?</a><a href="/novel/tide.html">Tide</a> 31 Chapters</li><li class="hit"><a href="/help">none</a></li><li class="hit"><a title="Moss" href="/novel/moss.html">m</a></li>'
    assert s.parser("search")(page, "") == [{"title": "Tide", "url": "https://s.example/novel/tide.html", "chapters": 31}, {"title": "Moss", "url": "https://s.example/novel/moss.html", "chapters": None}]
    assert s.search_request("low tide") == ("post", "https://s.example/find", "show=title&words=low+tide")
    assert s.parser("index")('<a href="/novel/tide_4.html">4</a><a href="/novel/tide_19.html" hidden>19</a>', "") == {"title": "Unknown Novel", "chapter_id": "tide", "total": 4}
    assert s.parser("index")("<h1>Tide</h1><p>77 chapters</p>", "https://s.example/novel/tide.html") == {"title": "Tide", "chapter_id": "tide", "total": 77}
    assert s.chapter_address("https://s.example", "tide", 3) == "https://s.example/novel/tide_3.html"
    assert harbour(hooks={"search": lambda page, base: ["mine"]}).parser("search")("", "") == ["mine"]
    with pytest.raises(Unsupported):
        Site("bare", ()).parser("metadata")
    assert site_for([s], "www.s.example").key == "harbour" and site_for([s], "x", "harbour") is s
    with pytest.raises(LookupError):
        site_for([s], "ass.example")


@pytest.mark.parametrize(("attrs", "gone"), [('rel="NOFOLLOW ugc"', True), ("hidden", True), ('aria-hidden="true"', True), ('style="opacity: 0;"', True), ('style="opacity:0.85"', False), ('rel="nofollowed"', False)])
def test_hidden_links(attrs, gone):
    assert html.hidden(html.parse(f'<a href="#" {attrs}>x</a>').first("a")) is gone


def test_text_modes():
    doc = html.parse("a <b>b</b> c")
    assert doc.text == "abc" and doc.spaced == "a b c"


def test_epub_round_trip(spark):
    df = spark.createDataFrame([(1, 1, "One", "salt & sand"), (1, 2, "Two", "x")], "item_id long, n int, title string, body string")
    got = epub.scan(epub.books(df)).orderBy("name").collect()
    assert [(r["name"], r["title"]) for r in got] == [("chap_0001.xhtml", "One"), ("chap_0002.xhtml", "Two")] and "salt & sand" in got[0]["text"]


def test_streams(spark, tmp_path):
    from loomspark.streaming import incremental

    at = lambda s: datetime.datetime(2024, 5, 1) + datetime.timedelta(seconds=s)
    outcomes = [True, False, True, False, False, True]
    rows = [(1, at(10 * i), i, o) for i, o in enumerate(outcomes)] + [(2, at(10 * i), i, False) for i in range(2)] + [(3, at(90_000), 0, True)]
    order = [4, 0, 8, 6, 2, 7, 5, 1, 3]  # late and shuffled over files, inside the watermark
    schema = "key long, ts timestamp, event_id long, ok boolean"
    for n, i in enumerate(order):
        spark.createDataFrame([rows[i]], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    said = []

    def go():
        q = incremental.breaker(stream, 2, "2 days").writeStream.outputMode("update").foreachBatch(lambda df, n: said.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    assert {r["key"] for r in said} == {1, 2, 3} and not any(r["tripped"] for r in said)  # nothing has passed the watermark
    for n in range(2):  # the watermark passes the first rows, then their state is called up
        spark.createDataFrame([(5 + n, at(900_000 + n), 0, True)], schema).write.parquet(str(tmp_path / "in" / f"last{n}"))
        go()
    got = {r["key"]: (r["run"], r["tripped"]) for r in said if r["key"] < 3}
    assert got == {1: (2, True), 2: (2, True)}
    seen = []
    incremental.ingest(stream, lambda df: seen.append(df.count()), str(tmp_path / "c2"))
    incremental.ingest(stream, lambda df: seen.append(df.count()), str(tmp_path / "c2"))
    assert sum(seen) == 11
    spark.createDataFrame([(at(i * 600), "view") for i in range(9)], "ts timestamp, event_type string").write.mode("overwrite").parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "ev"))
    q = incremental.windowed_counts(events).writeStream.outputMode("update").format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("wins").collect()) == [3, 6]


def test_snapshots_and_their_errors(spark, tmp_path):
    path = str(tmp_path / "lib")
    assert tables.load(spark, path, "id long, t string").count() == 0
    tables.save(spark.createDataFrame([(1, "a")], "id long, t string"), path)
    old = tables.load(spark, path, "id long, t string")
    tables.save(tables.add(old, spark.createDataFrame([(2, "b")], "id long, t string"), ["id"]), path)
    new = tables.load(spark, path, "id long, t string")
    assert sorted(r["id"] for r in new.collect()) == [1, 2] and old.count() == 1
    with pytest.raises(Exception, match="already there: 2"):
        tables.add(new, spark.createDataFrame([(2, "x")], "id long, t string"), ["id"]).collect()
    with pytest.raises(Exception, match="unknown key 9"):
        tables.merge_metadata(new, spark.createDataFrame([(9, "x")], "id long, t string"), "id", []).collect()
    assert [tables.append_new(str(tmp_path / "cache"), spark.createDataFrame(r, "id long, html string"), ["id"]) for r in ([(1, "x")], [(1, "y"), (2, "z")])] == [1, 1]
    assert tables.load_json(spark, str(tmp_path / "none.json"), "version int").count() == 0
    (tmp_path / "bad.json").write_text('{"version": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.load_json(spark, str(tmp_path / "bad.json"), "version int").collect()
    assert tables.undo(new.limit(0), "id", "t").count() == 0


def test_pages_with_odd_markup():
    from loomspark.sources import html as H
    from loomspark.sources.site import IndexRules, parse_index

    rules = IndexRules(link=r"/novel/(\w+)_\d+", page=r"/novel/(\w+)\.html", number=r"_(\d+)\.html", count=r"(\d+)\s+Chapters")
    # a number and the word after it are two texts: only the links count
    assert parse_index(rules, '<span>Volume 3</span><b>Chapters</b><a href="/novel/t_42.html">x</a>')["total"] == 42
    assert parse_index(rules, '<b>none</b><b>7 Chapters</b><a href="/novel/t_42.html">x</a>')["total"] == 7
    for selector in ("h1, h2", "div > p", "a:hover", "p + p", "h1 ~ p"):
        with pytest.raises(ValueError, match="selector"):
            H.parse("<h1>x</h1>").select(selector)
    assert H.hidden(H.parse('<a aria-hidden=" true ">x</a>').first("a"))
    rated = '<h5 class="seriesother">Rating <span class="uvotes">none yet</span></h5><h5 class="seriesother">Rating <span class="uvotes">(4.1 / 5.0, 1,204 votes)</span></h5>'
    assert H.series(rated)["rating"] == "4.1" and H.series(rated)["votes"] == "1,204"


def test_addresses(spark):
    from urllib.parse import urljoin

    bases = ["https://h.example/a/b/c.html?q=1#z", "http://h.example", "https://h.example/x/"]
    refs = ["../up.html", "./here", "d/e?k=v", "//cdn.example/f", "?only=q", "#part", "/root/./x/../y", "https://o.example/p", "", "../../../far", "mailto:a@b.example", "..", "z#w/../v"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    got = {(x["b"], x["r"]): x["u"] for x in df.select("b", "r", S.url_join(F.col("b"), F.col("r")).alias("u")).collect()}
    assert got == {(b, r): urljoin(b, r) for b in bases for r in refs}


def test_vectors_of_bytes(spark):
    v = np.array([0.0, -1.5, 3.25e-5, 7e30, -0.1, 1e-42, np.inf], "<f4")
    got = spark.createDataFrame([(bytearray(v.tobytes() + b"x"),), (bytearray(),)], "b binary").select(S.vector_of_bytes(F.col("b"))).collect()
    assert np.array_equal(np.array(got[0][0], "f4"), v) and got[1][0] == []


def test_site_and_id_needs_a_colon(spark):
    pick = lambda t: spark.createDataFrame([(t,)], "t string").select(S.site_and_id(F.col("t")).alias("x")).first()["x"]
    assert tuple(pick("s:a:b")) == ("s", "a:b")
    with pytest.raises(Exception, match="not SITE:ID"):
        pick("none")


def test_commands(spark, tmp_path):
    import zipfile

    from loomspark.commands import Library

    said = []
    lib = Library(spark, str(tmp_path / "lib"), [harbour()], lambda name, counts: said.append(name))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    pages = frame([(1, CARDS, "https://s.example/"), (2, "<p>nothing</p>", "https://s.example/")], "id long, html string, base string")
    assert lib.crawl("harbour", pages, start_page=1) == {"new_or_updated": 2, "skipped": 0, "pages": 2, "failed": 1, "next_page": 2, "reason": "waiting"}
    assert lib.table("bad_pages").select("page", "reason").collect() == [(2, "nothing found")]
    again = lib.crawl("harbour", pages, start_page=1)
    assert again["new_or_updated"] == 1 and again["skipped"] == 1 and lib.table("catalog").count() == 2
    ids = {r["title"]: r["id"] for r in lib.table("catalog").collect()}
    assert lib.metadata("harbour", frame([("https://s.example/novel/tide.html", DETAIL)], "url string, html string")) == {"pages": 1, "failed": 0}
    assert lib.enrich(frame([(5, ["Tide & Time", "Ebb"])], "cid long, name array<string>"), 30) == {"auto": 1}
    assert [r["best_name"] for r in lib.table("catalog").filter("resolution = 'auto'").collect()] == ["Tide & Time"] and lib.unsampled(30).count() == 1
    assert lib.stats(30) == {"total": 2, "candidates": 1, "with_metadata": 1, "resolved": 1, "clustered": 0}
    body = '<div class="chapter-content"><p>the long evening tide</p></div>'
    assert lib.chapters("harbour", frame([(ids["Moss"], n, body if n != 2 else "") for n in range(1, 9)], "id long, n int, html string")) == {"stored": 4, "failed": 1}
    assert [r["snippet"] for r in lib.grep("EVENING", 5).filter("n = 1").collect()] == ["long evening tide"]
    assert lib.embed() == {"embedded": 1} and lib.embed() == {"embedded": 0}
    assert lib.cluster(min_size=2)["n"] == 1 and lib.tag_communities().count() == 2
    assert lib.next() == ids["Tide & Time"] and lib.next([ids["Tide & Time"]]) is None
    (tmp_path / "l.json").write_text(f'[{{"novel_id": {ids["Tide & Time"]}, "label": "like"}}]')
    assert lib.import_labels(str(tmp_path / "l.json"), 3) == {"labels": 1} and lib.next() is None
    with pytest.raises(Exception, match="unknown label"):
        lib.label(frame([(1, "grand", "cold", 4)], "id long, label string, source string, labeled_at long"))
    assert lib.undo() == {"removed": 1} and lib.undo() == {"removed": 0}
    lib.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).groupBy("part").count().count() == 2
    assert [r["title"] for r in lib.find("tide").collect()] == ["Tide & Time"]
    lib.add(frame([(i, "harbour", f"https://s.example/novel/t{i}.html", f"t{i}") for i in (1, 2, 3)], "id long, site_key string, url string, title string"))
    index = frame([(1, "<p>4 chapters</p>"), (2, "<p>0 chapters</p>"), (3, "<p>none</p>")], "id long, html string")
    tried = frame([(1, 1, True), (1, 2, False), (1, 3, False), (1, 4, False)], "id long, n long, ok boolean")
    assert lib.check(index, tried, dry=True) == {"dry-run": 1, "unchanged": 1, "error": 1}
    assert lib.check(index, tried) == {"updated": 1, "unchanged": 1, "error": 1}
    assert {r["id"]: (r["last_known"], r["failed"]) for r in lib.table("tracked").collect()} == {1: (1, [2, 3, 4]), 2: (0, []), 3: (0, [])}
    assert "starting at chapter 2" in lib.table("tracked").filter("id = 1").first()["last_error"]
    assert {r["id"]: r["outcome"] for r in lib.mail(1).collect()} == {1: "send", 2: "nothing-new", 3: "nothing-new"}
    lib.mailed([1])
    assert lib.mail(1).filter("outcome = 'send'").count() == 0 and lib.remove([3]) and not lib.remove([3])
    book, said_of = lib.scrape("harbour", "<h1>Tide</h1><p>2 chapters</p>", frame([(n, body) for n in (1, 2, 3)], "n int, html string"))
    (tmp_path / "b.epub").write_bytes(book.first()["content"])
    assert [n for n in zipfile.ZipFile(tmp_path / "b.epub").namelist() if n.startswith("chap_")] == ["chap_0001.xhtml", "chap_0002.xhtml"]
    assert said_of == {"chapters": 2, "cached": 0, "failed": [], "stopped_at": None}
    gone = frame([(9, None)], "n int, html string")
    assert lib.scrape("harbour", "<h1>Tide</h1><p>6 chapters</p>", gone, breaker=3)[1] == {"chapters": 2, "cached": 2, "failed": [3, 4, 5], "stopped_at": 3}
    assert lib.expire() > 0 and lib.table("tracked").count() == 2
    assert lib.search("harbour", '<li class="hit"><a href="/novel/q.html">Q</a></li>')[0]["title"] == "Q" and "crawl" in said and "check" in said


def test_entry_imports_without_optional_parts(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def fake(name, *a, **k):
        if name.startswith("loomspark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"no {name}", name="loomspark.llm" if name.startswith("loomspark") else name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith("loomspark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", fake)
    assert "seed_queue" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
