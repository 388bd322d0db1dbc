"""The ten operators and the pipeline against brute force, with awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import bpe, exact_dedup, imatch, langid, licenses, packing, pretok, quality, simhash, suffix_dedup, url_filter
from loomspark.llm.deep_shallow import deep_shallow_sort

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, fp long, k long, tie long, h long, key string, spans string, rest string, row string, sha string, null boolean, __k long, __tie long, words string"


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "river", "stone", "Mill", "runs", "née", "été", "1907", "a"]) + rng.choice(["", ",", ".", "ly"]) for _ in range(n))


def awkward():
    rng = random.Random(5)
    shared = sentence(rng, 60)
    rows = [(i, sentence(rng, rng.randint(1, 80)), "en") for i in range(30)]
    rows += [(30, rows[3][1], "en"), (31, rows[3][1].replace(" ", " \n\t"), "en"), (32, shared + " tail one", "fr"), (33, "head " + shared, "fr"), (34, "two\n" + shared + "\nmore", "fr")]
    rows += [(35, None, "de"), (36, "", None), (37, " \n ", "de"), (38, "x" * 9000 + " é" * 3000, "de"), (38, "another text of the same id", "de")]
    rows += [(39, rows[5][1] + " z", "en"), (39, rows[5][1] + " z", "en"), (None, "no id at all", None), (None, None, None), (-4, "=-" * 400, "es"), (40, "12 !? 34", "es")]
    return [(i, t, g, None, None, "clash", 7, 8, 9, 10, "c", "s", "r", "w", "h", True, 1, 2, "x") for i, t, g in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(rows):
    out = defaultdict(int)
    for r in rows:
        out[tuple(r)] += 1
    return dict(out)


def last(i):
    return (i is None, i or 0)


def test_exact_dedup(docs, none):
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in awkward():
        groups[norm(r[1])].append(r[0])
    got = exact_dedup.exact_dedup(docs, block_bytes=16).collect()
    assert len(got) == len(awkward())
    want, kept = [], []
    for t, ids in groups.items():
        keep = min(ids, key=last)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        kept.append((keep, hashlib.sha256(t.encode()).hexdigest()))
    assert multiset((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == multiset(want)
    assert multiset((r["doc_id"], r["text_sha256"]) for r in got if r["kept"]) == multiset(kept)
    rows = exact_dedup.drop_copies(docs)
    assert rows.columns == docs.columns and multiset((r["doc_id"], hashlib.sha256(norm(r["text"]).encode()).hexdigest()) for r in rows.collect()) == multiset(kept)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def brute_components(rows):
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (r not in low or d < low[r]):
            low[r] = d
    return [(d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_simhash(docs, none):
    rows = [(r[0], r[1]) for r in awkward()]
    assert multiset(simhash.simhash_components(docs).collect()) == multiset(brute_components(rows))
    stay = simhash.drop_near_copies(exact_dedup.drop_copies(docs))
    assert stay.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in stay.collect()]
    assert all(d == c or c is None for d, _, c in brute_components(left))
    assert simhash.simhash_components(none).count() == 0


def test_bit_sliced_lanes_match_popcount():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    f[100:200] = f[0] ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64))
    planes = simhash.Planes(f)
    for step, asked in ((1, 299), (7, 250), (64, 200), (150, 150), (290, 10)):
        lanes = np.flatnonzero(rng.random(asked) < 0.9)
        want = lanes[np.bitwise_count(f[lanes] ^ f[lanes + step]) <= 4]
        assert (simhash.near_lanes(planes, lanes, step, 4) == want).all()
        assert (simhash.near_lanes(planes, lanes, step, 2) == lanes[np.bitwise_count(f[lanes] ^ f[lanes + step]) <= 2]).all()


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = list({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)}) + [rng.getrandbits(64) for _ in range(50)]
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16)
    from loomspark.llm.common import components

    got = {r["node"]: r["root"] for r in components(simhash.simhash_links(spark.createDataFrame(signed, "fp long"))).collect()}
    near = [a for a, in signed if bin((a ^ signed[0][0]) & ((1 << 64) - 1)).count("1") <= 4]
    assert len({got[a] for a in near}) == 1


def test_deep_shallow_sort():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(400)] + [b"a" * k for k in range(40)]
    rows, lens = np.zeros((len(strings), 40), np.uint8), np.array([len(s) for s in strings])
    for i, s in enumerate(strings):
        rows[i, : len(s)] = list(s)
    order, lcp = deep_shallow_sort(rows, lens, 1)
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    assert all(lcp[i] == next((k for k in range(41) if got[i][: k + 1] != got[i - 1][: k + 1] or k >= len(got[i])), 0) for i in range(1, 60))


def brute_repeats(rows, span=100):
    seen, out = set(), {}
    uniq = sorted({(last(d), d, t or "") for d, t in rows}, key=lambda r: (r[0], _tie(r[1], r[2])))
    for _, d, t in uniq:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            gone[i : i + span] |= w in seen
            seen.add(w)
        gone = gone[:-1]
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d, t] = (d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return [out[d, t or ""] for d, t in rows]


def _tie(d, text):
    sha = hashlib.sha256(f"{'null' if d is None else d}:{text}".encode()).digest()
    d1, d2 = (int.from_bytes(sha[i : i + 8], "big", signed=True) for i in (0, 8))
    return (d1 if d is not None else d2), d1, int.from_bytes(sha[16:20], "big")


@pytest.mark.parametrize("group_rows", [4096, 2])
def test_suffix_dedup(spark, docs, none, group_rows):
    rows = [(r[0], r[1]) for r in awkward()]
    assert multiset(suffix_dedup.apply_spans(docs, suffix_dedup.repeated_spans(docs, group_rows=group_rows)).collect()) == multiset(brute_repeats(rows))
    assert suffix_dedup.suffix_dedup(none).count() == 0
    cut = suffix_dedup.drop_repeats(docs)
    assert cut.columns == docs.columns and cut.filter("doc_id = 32").first()["text"] is not None


@pytest.mark.parametrize("group_rows", [4096, 8])
def test_suffix_dedup_of_many_rows_of_one_id_and_hot_passages(spark, group_rows):
    rng = random.Random(9)
    phrase, long = sentence(rng, 14)[:80], sentence(rng, 70)
    rows = [(None, sentence(rng, rng.randint(0, 12))) for _ in range(10_000)]  # 24-bit ties would clash
    rows += [(7, sentence(rng, 9) + phrase + sentence(rng, 9)) for _ in range(60)] + [(i, phrase + sentence(rng, 30)) for i in range(60)]
    rows += [(i, long) for i in range(100, 180)] + [(5, long)] * 50 + [(200, "ab" * 400), (201, "ab" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.apply_spans(df, suffix_dedup.repeated_spans(df, group_rows=group_rows)).collect()
    assert multiset(got) == multiset(brute_repeats(rows))


def test_pieces_and_ids_equal_the_libraries(docs, none):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={})
    rng = random.Random(3)
    odd = ["".join(rng.choice(" \n\t'srtveldmaé1-😀 \x1c") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["don't they've ''s 'LL", "x" * 3000, "é" * 150]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(odd))), pa.array(odd)], names=["a", "t"])
    got = next(bpe._encode(bpe.default_ranks(), True)(iter([batch])))
    assert got.column("ids").to_pylist() == [enc.encode_ordinary(t) for t in odd]
    assert got.column("decoded_sha256").to_pylist() == [hashlib.sha256(t.encode()).hexdigest() for t in odd]
    rows = bpe.encode_documents(docs).collect()
    ids = [enc.encode_ordinary(r[1] or "") for r in awkward()]
    want = [(r[0], len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, i in zip(awkward(), ids, strict=True)]
    assert multiset(rows) == multiset(want) and bpe.encode_documents(none).count() == 0
    tok = Tokenizer.from_file(packing.default_vocabulary())
    cache, held = packing._cache(packing.default_vocabulary())
    for p in pretok.split(pa.array(odd)):
        flat, at = held["ids"].gather(cache.slots(p))
        cut = at[p.doc_piece]
        for i in range(len(cut) - 1):
            assert flat[cut[i] : cut[i + 1]].tolist() == tok.encode(odd[p.first + i], add_special_tokens=False).ids


def test_pieces_of_one_hash_are_told_apart():
    told = []
    cache = pretok.WordCache(lambda: told.extend)
    pieces = next(iter(pretok.split(pa.array(["one two three two one"]))))
    pieces.hash[:] = 7
    slots = cache.slots(pieces)
    assert [told[i] for i in slots] == ["one", " two", " three", " two", " one"] and (cache.slots(pieces) == slots).all()


def check_pieces(rows, texts, seq_len=2048):
    """Every id lies in exactly one piece and sequences are gapless; returns the padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    ids = defaultdict(list)
    for d, t in texts:
        ids[d].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    per_doc, per_seq, pad = defaultdict(list), defaultdict(list), 0
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        per_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(per_doc) == set(ids)
    for d, pieces in per_doc.items():
        assert sum(p["length"] for p in pieces) == sum(map(len, ids[d]))
        if len(ids[d]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids[d][0]) and p["ids_crc32"] == zlib.crc32(ids[d][0][at : at + p["length"]])
                at += p["length"]
    for s in per_seq.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= seq_len
        pad += seq_len - at if at & (at - 1) else 0
    return pad


def test_packing(docs, none):
    texts = [(r[0], r[1]) for r in awkward()]
    assert check_pieces(packing.pack_documents(docs, shard_tokens=1500).collect(), texts) == 0
    assert packing.pack_documents(none).count() == 0


def test_neighbours_share_words():
    words = [np.array([1, 2, 3]), np.array([7, 8, 9]), np.array([2, 3, 4]), np.array([8, 9, 10])]
    index = packing.Bm25(words)
    index.use(0)
    assert index.neighbour(0) == 2
    index.use(2)
    assert index.neighbour(0) in (1, 3)


def bm25(words, seed):
    """Scores of all documents of a shard for the seed's words, from the formula alone."""
    n, mean, df = len(words), sum(map(len, words)) / len(words), Counter(t for w in words for t in set(w.tolist()))
    query, out = set(words[seed].tolist()), []
    for w in words:
        tf = Counter(t for t in w.tolist() if t in query)
        norm = packing.K1 * (1 - packing.B + packing.B * len(w) / mean)
        out.append(sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (packing.K1 + 1) / (c + norm) for t, c in tf.items()))
    return np.array(out)


def test_packing_many_short_documents():
    rng = np.random.default_rng(5)
    terms = rng.integers(-(1 << 51), 1 << 51, 3000)  # as wide as the hashes of words
    words = [terms[rng.integers(0, len(terms), n)] for n in (8, 8, 8, 8, 8, *rng.integers(0, 9, 5995))]
    index = packing.Bm25(words)
    for seed in range(5):
        index.use(seed)
    for seed in range(5):
        want = bm25(words, seed)
        want[:5] = 0
        assert want.max() > 0 and want[index.neighbour(seed)] == pytest.approx(want.max())


def test_packing_scores_all_words_of_the_seed():
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 900, n) for n in rng.integers(1, 400, 300)]
    index, seen = packing.Bm25(words), 0
    while index.left:
        seed = seen // 40  # a seed is asked for again and again, past what is put in order at once
        d = index.neighbour(seed)
        want = bm25(words, seed) if seen % 10 == 0 else None
        if want is not None:
            want[index.used] = 0
            assert want[d] == pytest.approx(want.max())
        index.use(d)
        seen += 1
    rare = [np.array([1000 + i, *range(50)]) for i in range(50)]
    index = packing.Bm25([np.array([*range(60), 77]), *[r[1:] for r in rare], np.array([500]), np.array([77, 500]), *[np.array([77])] * 90])
    for d in range(52):
        index.use(d)
    assert index.neighbour(0) > 51 and index.score[index.neighbour(0)] > 0  # by the word 77 alone, the 51st by idf


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(numbers):
    import xxhash

    h = 42
    for x in numbers:
        h = xxhash.xxh64_intdigest((x & ((1 << 64) - 1)).to_bytes(8, "little"), h)
    return signed(h)


def plain_imatch(rows, band):
    """The operator from its definition: {(doc_id, text): (n_chars, sha, fingerprint, edited fingerprint, near_edited, near_next)}."""
    import re

    import xxhash

    terms = lambda t: {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w}
    df = Counter(h for _, t in rows for h in terms(t))
    kept = {h for h, c in df.items() if band[0] <= math.log((len(rows) + 1) / c) <= band[1]}

    def prints(t):
        mine = sorted(terms(t) & kept) or sorted(terms(t))
        cells = []
        for many, split in imatch.LEVELS:
            of = defaultdict(list)
            for h in mine:
                of[(h >> (65 - split.bit_length())) + split // 2].append(h)
            cells.append([spark_hash(of[c]) % 32767 + 1 if c in of else 0 for c in range(many)])
        return spark_hash(mine), cells

    def likeness(a, b):
        if a[0] == b[0]:
            return 1.0
        for x, y in zip(a[1], b[1], strict=True):
            filled = [(i, j) for i, j in zip(x, y, strict=True) if i or j]
            if len(filled) >= imatch.ENOUGH:
                break
        return sum(i == j for i, j in filled) / max(1, len(filled))

    text_of = lambda f: f"{f[0] & ((1 << 64) - 1):016x}" + "".join(f"{c:04x}" for level in f[1] for c in level)
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), *[int.from_bytes(sha(r[1])[i : i + 8], "big", signed=True) for i in (0, 8)]))
    out = {}
    for i, (d, t) in enumerate(order):
        n, nxt = len(t) // 3, order[(i + 1) % len(order)][1]
        edited = t[: len(t) - n] + nxt[:n]
        f, e, g = prints(t), prints(edited), prints(nxt)
        out[d, t] = (d, len(t), sha(edited).hex(), text_of(f), text_of(e), likeness(f, e), likeness(f, g))
    return out, len(kept), len(df)


@pytest.mark.parametrize("band", [(1.0, 3.2), (2.0, 7.0)])
def test_imatch(docs, none, band):
    rows = [(r[0], r[1] or "") for r in awkward()]
    want, kept, all_ = plain_imatch(rows, band)
    assert 0 < kept < all_
    got = imatch.imatch(docs, band=band).collect()
    assert multiset(got) == multiset(want[r] for r in rows)
    assert imatch.imatch(none).count() == 0


def test_both_edges_of_the_band_drop_terms(spark):
    df = spark.createDataFrame([(i, f"all {'some' if i % 20 == 0 else 'most'} w{i}") for i in range(2000)], "doc_id long, text string")
    import xxhash

    assert imatch.lexicon(df, "text") == [signed(xxhash.xxh64_intdigest(b"some", 42))]


def test_lexicon_is_not_in_the_text_of_plans(spark):
    terms = [i * 2654435761 + 1 for i in range(20_000)]
    table_, bits = imatch._table(spark, terms)
    row = table_.first()
    assert {h for side in ("one", "two") for h in row[side] if h} == set(terms) and [len(row["one"]), len(row["two"])] == [1 << bits] * 2
    df = spark.createDataFrame([("some words",), ("",)], "text string")
    plan = imatch._placed(df, table_).select(imatch.fingerprint(F.col("text"), bits).alias("fp"))._jdf.queryExecution()
    assert len(plan.toString()) < 200_000
    optimized = plan.optimizedPlan().toString()
    assert "scalar-subquery" in optimized and " AS places" not in optimized.split("Subquery")[0]  # no row carries the table


def test_next_over_ranges_is_the_global_order(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    rng = random.Random(2)
    keys = [(False, i, 5, 6) for i in rng.sample(range(1000), 40)] + [(True, 0, rng.getrandbits(40), i) for i in range(30)] + [(False, -(1 << 63), i, 1) for i in range(9)]
    rows = spark.createDataFrame(keys, "nul boolean, key long, d1 long, d2 long")
    got = {tuple(r)[:4]: tuple(r["next"]) for r in imatch.with_next(rows).collect()}
    order = sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))
    assert got == {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}


def test_edited_texts_are_nearer_than_the_next(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = imatch.imatch(df).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert got[0] > 0.3 and got[1] < 0.1


def test_quality(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    all_docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(all_docs, labels)
    got = quality.score_quality(all_docs, model).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got["predicted"] == got["quality"]).mean()) > 0.93
    rank = got["score"].rank()
    n1, n0 = (got["quality"] == 1).sum(), (got["quality"] == 0).sum()
    assert (rank[got["quality"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.97
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in rows)
    empty = quality.train(none, labels.limit(0))
    assert quality.score_quality(none, empty).count() == 0 and quality.score_quality(docs, empty).count() == len(awkward())


def test_pu_risk_and_its_gradient():
    rng = np.random.default_rng(4)
    pos, unl, w, prior = np.c_[rng.normal(1, 1, (40, 3)), np.ones(40)], np.c_[rng.normal(0, 1, (60, 3)), np.ones(60)], rng.normal(size=4), 0.4
    good, negative, good_slope, slope = quality.pu_risk(w, pos, unl, prior)
    plain = lambda z, y: math.log1p(math.exp(-y * z))
    assert good == pytest.approx(prior * sum(plain(x @ w, 1) for x in pos) / 40)
    assert negative == pytest.approx(sum(plain(x @ w, -1) for x in unl) / 60 - prior * sum(plain(x @ w, -1) for x in pos) / 40)
    for i in range(4):
        step = np.eye(4)[i] * 1e-6
        up, down = quality.pu_risk(w + step, pos, unl, prior), quality.pu_risk(w - step, pos, unl, prior)
        assert good_slope[i] == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-5) and slope[i] == pytest.approx((up[1] - down[1]) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_is_estimated_from_unlabelled_rows(share):
    rng = np.random.default_rng(5)
    good, bad = rng.normal(1.5, 1, (4000, 4)), rng.normal(-1.5, 1, (4000, 4))
    mixed = np.concatenate([good[2000 : 2000 + int(2000 * share)], bad[: 2000 - int(2000 * share)]])
    assert abs(quality.estimate_prior(good[:2000], rng.permutation(mixed)) - share) < 0.06


def test_language_id(spark, docs, none):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df, sample_docs=300)
    got = langid.identify(df, model).join(df, "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(awkward())
    texts = {r[0]: r[1] for r in awkward()}
    for r in rows:
        if [x[0] for x in awkward()].count(r["doc_id"]) == 1:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))
        assert 0 <= r["score"] <= 1
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in awkward())
    nothing = langid.train(none)
    assert langid.identify(none, nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und", None}
    assert multiset(langid.keep_identified(docs, nothing).select("doc_id", "text").collect()) == multiset(kept.select("doc_id", "text").collect())


def test_code_switched_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df, sample_docs=300)
    off = model["trans"] - np.diag(np.diag(model["trans"]))
    assert np.ptp(off[~np.eye(len(off), dtype=bool)]) >= 0 and np.diag(model["trans"]).min() > off.max()
    held = [(r["lang"], ws) for r in df.filter("lang is not null and n_chars > 300").orderBy("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for ws in langid.segments_of(r["text"])[:1]]
    rng, rows, want = np.random.default_rng(2), [], []
    for (la, a), (lb, b) in zip(held, held[1:], strict=False):
        if la != lb and len(rows) < 60:
            mixed = langid.splice(a, b, rng)
            rows.append((len(rows), " ".join(w for w, _ in mixed)))
            want.append([(la, lb)[side] for _, side in mixed])
    right = total = 0
    for r in langid.identify_runs(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        got = [x["lang"] for x in r["runs"] for _ in range(x["words"])]
        assert [x["first"] for x in r["runs"]] == np.cumsum([0, *[x["words"] for x in r["runs"]]])[:-1].tolist() and all(0 <= x["score"] <= 1 for x in r["runs"])
        if len(got) == len(want[r["doc_id"]]):
            right, total = right + sum(x == y for x, y in zip(got, want[r["doc_id"]], strict=True)), total + len(got)
    assert total > 1000 and right / total > 0.85


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, trans, n = rng.normal(size=(9, 2)), rng.normal(size=(2, 2)), [5, 1, 3]
    begin = np.array([0, 5, 6])
    gamma, _ = langid.forward_backward(e, begin, np.array(n), trans)
    for b, k in zip(begin, n, strict=True):
        total = np.zeros((k, 2))
        for code in range(2**k):
            y = [(code >> i) & 1 for i in range(k)]
            w = np.exp(sum(e[b + i, y[i]] for i in range(k)) + sum(trans[y[i], y[i + 1]] for i in range(k - 1)))
            for i in range(k):
                total[i, y[i]] += w
        assert np.allclose(gamma[b : b + k], total / total.sum(axis=1, keepdims=True))


def test_url_filter(spark, none):
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/1?q", "http://xexample.net/en/1", "http://example.net", "http://m.example.com/de/", "http://example.com/den", "http://w.org/fr/#z", None, "no scheme", "http://net/", "http://anet/", "x://y://a.net/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, "http://a.net/x", "x", "y")] * 2, "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    want = ["net/", "example.net/en/", "net/", None, "example.com/de/", None, "org/fr/", None, None, "net/", None, None]
    assert [got[i][0] for i in range(len(urls))] == want
    assert [got[i][1] for i in range(len(urls))] == ["block" if w in ("net/", "example.com/de/") else "allow" for w in want]
    assert url_filter.filter_urls(df).count() == len(urls) + 2
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    (tmp_path / "d").write_bytes(url_filter.digest_file(url_filter.RULES))
    got = url_filter.Digests(str(tmp_path / "d")).longest(["a.net", "b.example.com", "c.de"], ["/x", "/de/x", "/"])
    assert [g and g[0] for g in got] == ["net/", "example.com/de/", None]


def test_licenses(spark, docs, none):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = licenses.train(df)
    marks = {"gpl-3.0": "GNU General Public License, version 3", "cc-by-nc": "CC BY-NC", "mit": "MIT License", "apache-2.0": "Apache License"}
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = {r["doc_id"]: r["families"] for r in licenses.scan_licenses(df, fitted=fitted).collect()}
    assert got == {i: ",".join(sorted(f for f, m in marks.items() if m in t)) for i, t in texts.items()}
    rows = licenses.scan_licenses(docs, fitted=fitted).collect()
    assert len(rows) == len(awkward()) and all(r["n_licensed"] == 0 and r["families"] == "" for r in rows)
    assert licenses.scan_licenses(none, fitted=fitted).count() == 0


#: (families, text): wrapped, commented, reworded, denied and side by side.
NOTICES = [
    ("gpl-3.0", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of"),
    ("lgpl", " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version."),
    ("mpl-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
    ("cc0", "To the extent possible under law, the author has waived\nall copyright and related or neighboring\nrights to this work."),
    ("mit", "Released\nunder\nthe\nMIT\nLicense."),
    ("mit", "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the\nfollowing conditions are met"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "The MIT License (MIT)"),
    ("mit", "This code is covered by the MIT licence."),
    ("bsd", "License: BSD-3-Clause"),
    ("agpl", "The server may be used under the terms of the GNU Affero General Public License, version 3."),
    ("gpl-2.0", "You can use and pass on the tool according to the GNU GPL version 2 as given in the file COPYING."),
    ("cc-by-sa", "Text is made available under the Creative Commons Attribution-ShareAlike 4.0 International License by its writers."),
    ("apache-2.0", "The project's files fall under the Apache 2.0 license, see below"),
    ("unlicense", "the code is free and unencumbered software released into the public domain by us"),
    ("apache-2.0,mit", "Some words first.\nLicensed under the Apache License,\nVersion 2.0.\n\nReleased under the\nMIT License."),
    ("isc,mit", "Released under the MIT License.\nReleased under the ISC License.\nReleased under the MIT License."),
    ("", "You are not licensed under the Apache License, Version 2.0 to do this."),
    ("", "A licence\n\nof the road."),
    ("", "The GNU project and the Apache foundation met at MIT."),
]


def test_wrapped_reworded_and_denied_licenses(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = licenses.train(df)
    prose = df.filter("doc_id = 3").first()["text"]
    texts = [t for _, t in NOTICES] + [prose[:4000] + "\n" + t + "\n" + prose[:2000] for _, t in NOTICES]
    got = licenses.scan_licenses(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), fitted=fitted).orderBy("doc_id").collect()
    want = [f for f, _ in NOTICES] * 2
    assert [r["families"] for r in got][: len(NOTICES)] == want[: len(NOTICES)]
    right = [r["families"] == w for r, w in zip(got, want, strict=True) if w]
    assert sum(right) >= 0.9 * len(right)
    assert [r["first_word"] for r in got[: len(NOTICES)]] == [0 if w else None for w in want[: len(NOTICES)]]


def test_license_templates_are_of_one_family():
    found = licenses.templates()
    assert {f for f, _ in found} == set(licenses.NAMES)
    assert all(a == b or set(p) != set(q) for a, p in found for b, q in found)


def plain_pipeline(rows):
    """The first four stages on (id, text) rows, from their definitions."""
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    groups = defaultdict(list)
    for d, t in rows:
        if any(c.isalpha() for c in t or ""):
            groups[norm(t)].append((last(d), d, t))
    left = [min(g, key=lambda r: (r[0], r[2]))[1:] for g in groups.values()]
    fps, root = [simhash.fingerprint(t.encode()) for _, t in left], list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    near = defaultdict(list)
    for r, (d, t) in zip(root, left, strict=True):
        near[r].append((last(d), hashlib.md5(t.encode()).hexdigest(), d, t))
    left = [min(g)[2:] for g in near.values()]
    seen, cut = set(), []
    for d, t in sorted(left, key=lambda r: (last(r[0]), _tie(*r))):
        b, keep = t.encode(), np.ones(len(t.encode()), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                keep[i : i + 100] = False
            seen.add(b[i : i + 100])
        if keep.any() or not b:
            cut.append((d, bytes(np.frombuffer(b, np.uint8)[keep]).decode("utf-8", "ignore")))
    return cut


@pytest.mark.parametrize("learned", [True, False])
def test_pipeline_against_brute_force(spark, tmp_path, learned):
    import corpus_pipeline

    source = [*awkward(), (50, "Some more words in a text that stands alone.", "en"), (None, "two of no id that are near each other, as they differ in one word of many " + "and so on " * 40, None), (None, "two of no id that are near each other, as they differ in a word of many " + "and so on " * 40, None)]
    cols = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, root string"
    df = spark.createDataFrame([(r[0], r[1], r[2] if learned else None, "s", len(r[1] or ""), "a", "b", "c") for r in source], cols)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    cut = plain_pipeline([(r[0], r[1]) for r in source])
    got = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert multiset(got) == multiset(cut)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert check_pieces(out, cut) == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "suffix_dedup", "packing"]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_row_keeping_forms_of_nothing(none):
    nothing = langid.train(none)
    for out in (exact_dedup.drop_copies(none), simhash.drop_near_copies(none), suffix_dedup.drop_repeats(none), langid.keep_identified(none, nothing)):
        assert out.columns == none.columns and out.count() == 0
    assert langid.identify_runs(none, nothing).count() == 0
