"""Page frontiers, keyed tables, scrape loops and checks: runs that stop, go on, clash and fail."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import scalars as S
from loomspark.operators import frontier, keyed, runs, scrape, tables
from loomspark.streaming import incremental

TRIES = "site string, page long, attempt int, kind string, has_next boolean"


def run(spark, state, pages, rows, **how):
    new, held = frontier.advance(state, pages, spark.createDataFrame(rows, TRIES), **how)
    keep = lambda df, schema: spark.createDataFrame(df.collect(), schema)
    return keep(new, frontier.STATE), keep(held, frontier.PAGES)


def nothing(spark):
    return spark.createDataFrame([], frontier.STATE), spark.createDataFrame([], frontier.PAGES)


def at(state):
    return {r["site"]: (r["next_page"], r["reason"]) for r in state.collect()}


def test_frontier_of_failed_empty_and_last_pages(spark):
    good = lambda s, p, has_next=None: (s, p, 0, "good", has_next)
    rows = [good("gone", 0), good("gone", 1), ("gone", 2, 0, "gone", None), good("gone", 3)]
    rows += [good("empty", 0)] + [("empty", 1, i, "empty", None) for i in range(4)]
    rows += [("recovers", 0, 0, "empty", None), ("recovers", 0, 1, "error", None), good("recovers", 1)] + [("recovers", 0, 2, "good", None)]
    rows += [("failed", 0, i, "error", None) for i in range(6)] + [("tries", 0, i, "error", None) for i in range(5)]
    rows += [good("listing", 0, True), good("listing", 1, False), good("listing", 2, True), good("gap", 0), good("gap", 2), good("gap", 3), ("late", 4, 0, "good", None)]
    state, pages = run(spark, *nothing(spark), rows)
    assert at(state) == {"gone": (2, "end"), "empty": (1, "empty"), "recovers": (2, "open"), "failed": (0, "failed"), "tries": (0, "waiting"), "listing": (2, "last"), "gap": (1, "open"), "late": (0, "open")}
    # the next run: a 404 is tried again, a gap is closed, a waiting page errs once more, an empty one starts anew
    more = [good("gone", 2), good("gap", 1), ("tries", 0, 0, "error", None), ("empty", 1, 0, "empty", None)]
    state, pages = run(spark, state, pages, more)
    now = at(state)
    assert now["gone"] == (4, "open") and now["gap"] == (4, "open") and now["tries"] == (0, "failed") and now["empty"] == (1, "waiting") and now["late"] == (0, "open")
    assert {(r["site"], r["page"]) for r in pages.collect()} == {("empty", 1), ("late", 4)} and now["listing"] == (3, "open")


def test_frontier_with_a_bound_and_a_first_page(spark):
    rows = [("a", p, 0, "good", True) for p in range(1, 8)]
    state, pages = run(spark, *nothing(spark), rows, first=1, most=3)
    assert at(state) == {"a": (4, "limit")}
    state, pages = run(spark, state, pages, [("a", 8, 0, "good", False)], first=1, most=9)
    assert at(state) == {"a": (9, "last")} and pages.count() == 0


def test_frontier_frames_and_fold_agree(spark):
    rng = random.Random(8)
    state, pages = nothing(spark)
    folded = {f"s{i}": (0, "open", {}) for i in range(12)}
    for _ in range(4):
        rows = [(f"s{rng.randrange(12)}", rng.randrange(6), rng.randrange(9), rng.choices(["good", "empty", "error", "gone"], [5, 3, 4, 1])[0], rng.choice([None, True, True, False])) for _ in range(150)]
        state, pages = run(spark, state, pages, rows)
        for s in folded:
            folded[s] = frontier.fold(folded[s], [r[1:] for r in rows if r[0] == s])
        assert at(state) == {s: f[:2] for s, f in folded.items()}
        assert {(r["site"], r["page"]): (r["verdict"], r["errors"], r["empties"], r["last"]) for r in pages.collect()} == {(s, p): v for s, f in folded.items() for p, v in f[2].items()}


def test_frontier_stream_goes_on_after_a_stop(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(TRIES).parquet(str(tmp_path / "in"))
    said = []

    def go():
        q = incremental.frontier(stream).writeStream.foreachBatch(lambda df, _: said.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    batches = [[("a", 0, 0, "good", None), ("a", 1, 0, "empty", None), ("b", 1, 0, "good", None)], [("a", 1, 1, "good", None), ("b", 0, 0, "good", None)], [("b", 2, 0, "gone", None)]]
    for rows in batches:
        spark.createDataFrame(rows, TRIES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        go()  # each query is a new one
    assert [(r["site"], r["next_page"], r["reason"]) for r in said if r["site"] == "a"] == [("a", 1, "waiting"), ("a", 2, "open")]
    assert [(r["site"], r["next_page"], r["reason"]) for r in said if r["site"] == "b"] == [("b", 0, "open"), ("b", 2, "open"), ("b", 2, "end")]


def test_crawls_resume(spark, tmp_path):
    from loomspark.commands import Library
    from loomspark.sources.site import Site

    calls = spark.sparkContext.accumulator(0)
    card = lambda t: f'<li class="novel-item"><a href="/novel/{t}.html" title="{t}"></a></li>'
    lib = Library(spark, str(tmp_path / "lib"), [Site("harbour", ("s.example",))])
    captured = lambda rows: spark.createDataFrame([(p, a, s, h, "https://s.example/") for p, a, s, h in rows], "id long, attempt int, status int, html string, base string")
    first = captured([(0, 0, 200, card("a")), (1, 0, 200, "<p>blocked</p>"), (2, 0, 200, card("c"))])
    assert lib.crawl("harbour", first) == {"new_or_updated": 2, "skipped": 0, "pages": 3, "failed": 1, "next_page": 1, "reason": "waiting"}
    second = captured([(1, 1, 200, card("b")), (3, 0, 500, None), (3, 1, 404, None)])
    # a new library over the same folder: only the stored state can tell it where to go on
    lib = Library(spark, str(tmp_path / "lib"), [Site("harbour", ("s.example",))])
    assert lib.crawl("harbour", second) == {"new_or_updated": 1, "skipped": 0, "pages": 3, "failed": 0, "next_page": 3, "reason": "end"}
    assert sorted(r["title"] for r in lib.table("catalog").collect()) == ["a", "b", "c"] and len({r["id"] for r in lib.table("catalog").collect()}) == 3
    assert lib.crawl("harbour", captured([(0, 0, 200, card("z"))]), start_page=0, most=1)["next_page"] == 1
    page = lambda t, more: f'<div class="search_main_box_nu"><div class="search_title"><a href="https://n.example/{t}">{t}</a></div></div>' + ('<div class="digg_pagination"><a class="next_page" href="?pg=2">x</a></div>' if more else "")
    assert lib.nu_crawl("books", captured([(1, 0, 200, page("a", True))])) == {"hits": 1, "pages": 1, "failed": 0, "next_page": 2, "reason": "open"}
    assert lib.nu_crawl("books", captured([(2, 0, 200, page("b", False)), (3, 0, 200, page("b", False))]))["reason"] == "last"
    assert {r["site"]: r["next_page"] for r in lib.table("frontier").collect()} == {"harbour": 1, "books": 3} and lib.table("listings").count() == 2

    # each page is parsed once, whatever is counted
    from loomspark.sources import html as parsers

    real = parsers.PARSERS["cards"]

    def counting(page, base):
        calls.add(1)
        return real(page, base)

    parsers.PARSERS["cards"] = counting
    try:
        lib.crawl("counted", captured([(p, 0, 200, card(f"n{p}") if p != 4 else "") for p in range(9)]))
    finally:
        parsers.PARSERS["cards"] = real
    assert calls.value == 9 and lib.table("bad_pages").filter("site = 'counted'").count() == 1


ROWS = "id long, t string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_a_write_touches_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    assert keyed.load(spark, path, ROWS).count() == 0
    first = keyed.upsert(path, frame(spark, [(i, "a") for i in range(500)]), ["id"], ROWS, buckets=16)
    assert first.number == 1 and len(first.folders) == 16
    second = keyed.upsert(path, frame(spark, [(7, "b"), (1000, "b")]), ["id"], ROWS)
    moved = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    assert 1 <= len(moved) <= 2
    got = {r["id"]: r["t"] for r in keyed.load(spark, path, ROWS).collect()}
    assert len(got) == 501 and got[7] == got[1000] == "b" and got[8] == "a"
    assert keyed.load(spark, path, ROWS, keyed.version(spark, path, 1)).count() == 500  # the old version as it was
    third = keyed.delete(path, frame(spark, [(7, None)]), ["id"], ROWS)
    assert keyed.load(spark, path, ROWS).count() == 500 and third.number == 3
    assert keyed.change(path, frame(spark, []), ["id"], ROWS, lambda a, b: a).number == 3
    with pytest.raises(LookupError):
        keyed.version(spark, path, 9)


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    seen = keyed.upsert(path, frame(spark, [(1, "a")]), ["id"], ROWS)
    keyed.upsert(path, frame(spark, [(2, "mine")]), ["id"], ROWS, at=seen)
    with pytest.raises(keyed.Conflict):
        keyed.upsert(path, frame(spark, [(2, "other"), (3, "other")]), ["id"], ROWS, at=seen)
    assert {(r["id"], r["t"]) for r in keyed.load(spark, path, ROWS).collect()} == {(1, "a"), (2, "mine")}
    assert [n for n in (tmp_path / "t" / "manifests").iterdir() if n.suffix != ".json" and not n.name.endswith(".crc")] == []


def test_expiry_and_rebucketing(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(5):
        keyed.upsert(path, frame(spark, [(i, str(i)), (99, str(i))]), ["id"], ROWS, buckets=4)
    before = sorted(map(tuple, keyed.load(spark, path, ROWS).collect()))
    kept = keyed.version(spark, path, 4)
    assert keyed.expire(spark, path, 2) >= 0
    assert sorted(map(tuple, keyed.load(spark, path, ROWS).collect())) == before and keyed.load(spark, path, ROWS, kept).count() == 5
    with pytest.raises(LookupError):
        keyed.version(spark, path, 3)
    wide = keyed.rebucket(spark, path, ["id"], ROWS, 32)
    assert wide.buckets == 32 and sorted(map(tuple, keyed.load(spark, path, ROWS).collect())) == before
    assert keyed.upsert(path, frame(spark, [(0, "new")]), ["id"], ROWS).buckets == 32
    keyed.expire(spark, path, 1)
    used = {f.split("/")[1] for f in keyed.version(spark, path).folders.values()}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == used


def test_scrape_parses_nothing_behind_a_trip(spark):
    parsed = spark.sparkContext.accumulator(0)

    def parse(page, n):
        parsed.add(1)
        if page == "bad":
            raise ValueError("no chapter")
        return {"title": f"{page}{n}"}

    fine = [(1, n, "p", None) for n in range(1, 41)]
    trips = [(2, n, "p" if n < 11 else "bad" if n == 11 else None, "HTTP 500" if n > 11 and n < 14 else None) for n in range(1, 41)]
    spread = [(3, n, None if n % 3 else "p", None) for n in range(1, 31)]
    web = spark.createDataFrame(fine + trips + spread, "id long, n long, html string, error string")
    cache = spark.createDataFrame([(1, 5, "kept"), (3, 1, "kept"), (3, 2, "")], "id long, n long, html string")
    for size in (4, 256):
        parsed.value = 0
        tried = scrape.scrape(scrape.pages_of(web, cache, web), parse, "title string", 3, per_round=size)
        got = {r["id"]: r for r in scrape.summary(tried).collect()}
        assert (got[1]["chapters"], got[1]["cached"], got[1]["failed"], got[1]["stopped_at"]) == (40, 1, [], None)
        assert (got[2]["chapters"], got[2]["failed"], got[2]["stopped_at"]) == (10, [11, 12, 13], 11)
        assert (got[3]["chapters"], got[3]["cached"], got[3]["stopped_at"]) == (11, 1, None) and got[3]["failed"] == [n for n in range(2, 31) if n % 3]
        assert parsed.value == 40 + 11 + 11
        labels = {(r["id"], r["n"]): (r["origin"], r["label"]) for r in tried.collect()}
        assert labels[2, 11] == ("web", "ValueError: no chapter") and labels[2, 12] == ("web", "HTTP 500") and labels[3, 2] == ("web", "not fetched") and labels[1, 5] == ("cache", None)
    fresh = scrape.summary(scrape.scrape(scrape.pages_of(web, cache, web, use_cache=False), parse, "title string", None)).collect()
    assert {r["id"]: (r["cached"], r["stopped_at"], len(r["failed"])) for r in fresh} == {1: (0, None, 0), 2: (0, None, 30), 3: (0, None, 20)}


def checked(spark, last_known, seen, failed, idle, bad, **how):
    t = spark.createDataFrame([(1, last_known, seen, failed, idle, True)], "id long, last_known long, seen long, failed array<bigint>, idle long, enabled boolean")
    wanted = tables.wanted_chapters(t)
    tried = runs.breaker(wanted.select(F.col("id").alias("key"), "n", (F.col("known") | ~F.col("n").isin(bad)).alias("ok")), 3)
    state = t.join(tried.select(F.col("key").alias("id"), "attempted", F.col("failed").alias("failed_now"), "stopped_at"), "id", "left")
    r = tables.check_states(state, **how).first()
    return r["status"], r["fetched"], r["new_last"], r["still_failed"], r["idle"], r["last_error"]


def test_checks_count_what_was_got(spark):
    trip = "circuit breaker: 3 consecutive failures starting at chapter "
    assert checked(spark, 5, 10, [], 4, [6, 8]) == ("updated", 3, 10, [6, 8], 0, None)
    assert checked(spark, 5, 7, [], 0, [6, 7]) == ("no-progress", 0, 7, [6, 7], 1, None)
    assert checked(spark, 0, 10, [], 0, [3, 4, 5]) == ("updated", 2, 2, [3, 4, 5], 0, trip + "3")
    assert checked(spark, 0, 5, [], 0, [1, 2, 3]) == ("no-progress", 0, 0, [1, 2, 3], 1, trip + "1")
    assert checked(spark, 5, 6, [1, 2], 0, [1, 2])[:4] == ("no-progress", 0, 6, [1, 2])  # old ones that failed again weigh against the new one
    assert checked(spark, 8, 8, [2, 4, 6, 8], 0, [2, 4, 6, 8]) == ("no-progress", 0, 8, [2, 4, 6], 1, None)
    assert checked(spark, 8, 8, [2, 4], 2, [4]) == ("updated", 1, 8, [4], 0, None)
    assert checked(spark, 5, 5, [3], 4, [3])[0] == "disabled" and checked(spark, 5, 5, [3], 3, [3])[0] == "no-progress"
    assert checked(spark, 0, 5, [], 4, [1, 2, 3])[5].startswith("switched off after 5 checks")
    assert checked(spark, 5, 5, [], 3, []) == ("unchanged", 0, 5, [], 3, None) and checked(spark, 5, None, [2], 3, []) == ("error", 0, 5, [2], 3, "could not determine chapter count")
    assert checked(spark, 5, 9, [2], 3, [6], dry=True) == ("dry-run", 0, 5, [2], 3, None)


def titles_of_forty(n, seed=1):
    rng = random.Random(seed)
    parts = [a + b for a in "bdklmnrstv" for b in "aeiou"]
    words = ["".join(rng.choices(parts, k=rng.randint(2, 4))) for _ in range(3000)]
    out = []
    while len(out) < n:
        t = " ".join(rng.choices(words, k=9))[:40].strip()
        out.append(t)
    return out, rng


def test_best_two_without_near_all_pairs(spark, monkeypatch):
    from loomspark.operators import resolve

    names, rng = titles_of_forty(3000)
    probes = rng.sample(names, 300)
    for i in range(100):  # some with slips, some that nothing is like
        probes[i] = "".join(rng.choice("xyz") if rng.random() < 0.06 else c for c in probes[i])
    probes += ["Qqq wxyzz jjjj", "b" * 70, "12 34 56 78", ""]
    looked = []
    real = resolve._searched

    def counted(a, b, floors):
        out = real(a, b, floors).cache()
        looked.append({r["title"]: r["n"] for r in out.groupBy("title").agg(F.sum("compared").alias("n")).collect()})
        return out

    monkeypatch.setattr(resolve, "_searched", counted)
    monkeypatch.setattr(resolve, "NAMES", 1000)
    monkeypatch.setattr(resolve, "TITLES", 100)
    a = spark.createDataFrame(list(enumerate(probes)), "id long, title string")
    got = {r["id"]: (r["decision"], r["best"], r["best_score"]) for r in resolve.resolve(a, spark.createDataFrame(list(enumerate(names)), "cid long, name string")).collect()}
    assert sum(looked[0].get(p, 0) for p in probes[100:300]) < 0.01 * 200 * len(names)
    assert sum(looked[0].values()) < 0.2 * len(probes) * len(names)  # slips leave more that could be second
    split = [sorted(set(n.split())) for n in names]
    for i, p in enumerate(probes):
        if i % 7 and i < 300:
            continue
        x = sorted(set(p.split()))
        top = sorted(((-resolve.similarity(x, y), c) for c, y in enumerate(split)))[:2]
        score, second = -top[0][0], -top[1][0]
        want = ("no_candidates", None, None) if score < 60 else ("auto" if score >= 90 and (second < 60 or score - second >= 15) else "ambiguous", top[0][1], round(score, 6))
        assert got[i] == want, p


def test_similarity_is_the_columns(spark):
    from loomspark.operators import resolve

    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcé ", k=rng.randint(0, 5)))
    pairs = [(" ".join(word() for _ in range(rng.randint(0, 6))), " ".join(word() for _ in range(rng.randint(0, 6)))) for _ in range(400)]
    pairs += [("long " * 30 + "x" * 90, "long tail " + "x" * 80 + "y"), ("", "a"), ("a b", "b a")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", resolve.token_set_ratio(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        x, y = (sorted(set(t.split())) for t in (r["a"], r["b"]))
        assert resolve.similarity(x, y) == r["s"]
        held = resolve.Names([y], [[5]]) if y else None
        if x and y and not set(x) & set(y):
            assert held.best(x, 0.0) == [(r["s"], 5)]


def test_gaps_have_the_moments_and_come_again(spark):

    df = spark.range(20_000).select(S.gamma(2.5, F.lit(3), F.lit("s"), F.col("id")).alias("g"), S.gap(F.lit(4.0), F.lit(3), F.lit("s"), F.col("id")).alias("gap"), S.gap(F.lit(0.0), F.lit(3), F.lit("s"), F.col("id")).alias("none"))
    m = df.agg(F.avg("g"), F.variance("g"), F.skewness("g"), F.min("gap"), F.max("gap"), F.avg("gap"), F.max("none")).first()
    assert abs(m[0] - 2.5) < 0.05 and abs(m[1] - 2.5) < 0.12 and abs(m[2] - 2 / 2.5**0.5) < 0.1
    assert m[3] == 0.8 and m[4] == 12.0 and abs(m[5] - 4.0) < 0.1 and m[6] == 0.0
    assert abs(df.agg(F.sum("g")).first()[0] - df.repartition(7).agg(F.sum("g")).first()[0]) < 1e-6
    assert df.limit(50).collect() == df.limit(50).collect()


def test_intervals_are_learned_and_kept(spark, tmp_path):
    known = spark.createDataFrame([("a", 1.0), ("b", 40.0), ("quiet", 9.0), ("top", 500.0)], "site string, interval double")
    rows = [("a", 1, False, None), ("a", 2, True, None), ("b", 1, False, None), ("b", 2, False, None), ("new", 1, False, 30.0), ("new", 2, False, 3.0), ("fine", 1, True, None), ("quiet", 1, True, None), ("top", 1, True, None)]
    got = {r["site"]: r["interval"] for r in runs.learned(known, spark.createDataFrame(rows, "site string, n long, ok boolean, asked double")).collect()}
    assert got == {"a": 5.0, "b": 120.0, "quiet": 9.0, "top": 500.0, "new": 30.0}
    for text, want in (('{"a": 3, "b": "5.5"}', {"a": 3.0, "b": 5.5}), ('{"a": 3, "b": "x"}', {}), ('{"a": ', {}), ("[1, 2]", {}), ("", {})):
        (tmp_path / "p.json").write_text(text)
        assert {r["site"]: r["interval"] for r in runs.load_intervals(spark, str(tmp_path / "p.json")).collect()} == want
    assert runs.load_intervals(spark, str(tmp_path / "none.json")).count() == 0


def test_grep_in_books_reads_few_chapters_and_finds_all(spark, tmp_path):
    import re

    from loomspark.commands import Library
    from loomspark.operators import search
    from loomspark.sources import epub

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randint(3, 8))) for _ in range(400)]
    rows = [(b, n, f"Ch {n} of {b}", " ".join(rng.choices(words, k=60))) for b in range(12) for n in range(1, 9)]
    rows[5] = (0, 6, "Unique Title", "the Dragon roared, a DRAGON. ΟΔΥΣΣΕΥΣ and ὈΔΥΣΣΕΎΣ; Straße İstanbul dragon" + "x" * 50)
    rows[17] = (2, 2, "Ch 2", "x" * 100 + "NEEDLE" + "y" * 100 + " needle needle")
    files = epub.books(spark.createDataFrame(rows, "item_id long, n int, title string, body string")).cache()
    lib = Library(spark, str(tmp_path / "lib"), [])
    assert lib.add_books(files.filter("path < 'book-2'")) == {"added": files.filter("path < 'book-2'").count()}
    assert lib.add_books(files) == {"added": files.filter("path >= 'book-2'").count()} and lib.add_books(files) == {"added": 0}
    folder = f"{lib.path}/books"
    chapters = epub.scan(files).collect()
    assert len(chapters) == 96
    for needle, ignore in (("dragon", True), ("Dragon", False), ("dragon", False), ("needle", True), ("οδυσσευς", True), ("οδυσσευ", True), ("istanbul", True), ("unique title", True), ("zz-none", True), ("to", True), (words[3], True), ("(", True), ("strasse", True)):
        got = sorted((r["path"], r["name"], r["title"], r["k"], r["snippet"]) for r in lib.grep_books(needle, 10, ignore).collect())
        scan = spark.createDataFrame(chapters).select("path", "name", "title", F.explode(S.snippets(F.col("text"), needle, 10, ignore)).alias("h")).select("path", "name", "title", "h.k", "h.snippet")
        assert got == sorted(map(tuple, scan.collect())), needle
        if needle in ("Dragon", "needle"):
            flags = re.I if ignore else 0
            assert len(got) == sum(len(re.findall(needle, c["text"], flags)) for c in chapters) > 0
    assert [r["snippet"] for r in lib.grep_books("NEEDLE", 10, False).collect()] == ["x" * 10 + "NEEDLE" + "y" * 10]
    some = search.candidates(spark, folder, words[3] + " ")
    assert 0 < some.count() < 0.6 * len(chapters) and search.candidates(spark, folder, "dragon").count() == 1
