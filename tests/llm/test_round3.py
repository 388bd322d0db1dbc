"""Operators 11 to 13 against plain versions, with awkward rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import alignment, merkle, neighbours
from loomspark.llm.packing import byte_alphabet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, h string, i long, at long, block long, pair string, top string, steps string"
CLASH = ("c", "h", 7, 8, 9, "p", "t", "s")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def awkward():
    rng = random.Random(3)
    words = "river stone née été it's they'll 1907 <|endoftext|> naïve 東京 x_y".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60))), rng.choice(["en", "en", "de", None, ""]), "web", rng.choice([None, 5, 60])) for i in range(120)]
    rows += [(200, None, "en", None, None), (201, "", "en", "web", 0), (202, " ", "zz", "web", 1), (203, "a " * 3000 + "z" * 3000, "fr", "b", 9)]
    rows += [rows[4], rows[4], (5, "the id of another row", "de", "web", 3), (None, "no id", "de", "web", 4), (None, "no id", "de", "web", 4), (-7, "\n\n a\x00b ▁ c", None, "é", 5)]
    return [(*r, *CLASH) for r in rows]


def up(nodes):
    return [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def steps(nodes, i):
    """(siblings left and right of the path, root)"""
    out = []
    while len(nodes) > 1:
        out.append(("", nodes[i + 1]) if i % 2 == 0 and i + 1 < len(nodes) else (nodes[i - 1], "") if i % 2 else ("", ""))
        nodes, i = up(nodes), i // 2
    return out, nodes[0]


def manifest(rows):
    digest = lambda i, t, g, s, n: sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, g, n, t)))
    groups = {}
    for i, t, g, s, n, *_ in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        groups.setdefault(g, []).append((i is not None, i or 0, digest(i, t, g, s, n), digest(i, t, g, s, n + hit if n is not None else n)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = [steps([x[2] for x in sorted(groups[g])], 0)[1] for g in order]
    out = []
    for k, g in enumerate(order):
        leaves = sorted(groups[g])
        for at, (some, i, leaf, other) in enumerate(leaves):
            inner, sub = steps([x[2] for x in leaves], at)
            outer, root = steps(subs, k)
            f = other
            for a, b in inner + outer:
                f = sha(a, f, b)
            out.append((i if some else None, leaf, sub, root, sha(*(a + b for a, b in inner + outer)), f, f == root))
    return Counter(out)


@pytest.mark.parametrize("bucket", [2, 8, 1024])
def test_manifest(spark, bucket):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(docs, merkle.COLUMNS, tampered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, bucket=bucket)
    assert Counter(map(tuple, got.collect())) == manifest(rows)


def test_manifest_small(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(none, merkle.COLUMNS).count() == 0
    one = merkle.manifest(spark.createDataFrame(awkward()[:1], SCHEMA), merkle.COLUMNS).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("") and one["verified"]


def aligned(rows):
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
    left, right = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    left.encode_special_tokens = True
    back = {v: k for k, v in byte_alphabet().items()}
    docs, df = [], Counter()
    for i, text, *_ in rows:
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        ab = [bytes(back[c] for c in left.id_to_token(t)) for t in a]
        bb = [bytes([int(right.id_to_piece(t)[3:5], 16)]) if right.is_byte(t) else right.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            docs.append((i, [], [], [], []))
            continue
        owner_a, owner_b = ([k for k, t in enumerate(side) for _ in t] for side in (ab, bb))
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups = [[[links[0][0]], [links[0][1]]]]
        for x, y in links[1:]:
            last = groups[-1]
            if x != last[0][-1] and y != last[1][-1]:
                groups.append([[x], [y]])
            elif x != last[0][-1]:
                last[0].append(x)
            else:
                last[1].append(y)
        ids = [(a[x], b[y]) for x, y in links]
        df.update(set(ids))
        docs.append((i, a, b, [([a[x] for x in p], [b[y] for y in q]) for p, q in groups], ids))
    highest = {}
    for (x, _), n in df.items():
        highest[x] = max(n, highest.get(x, 0))
    out = []
    for i, a, b, groups, ids in docs:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(a), len(b), len(groups), len(ids), sum(df[x] == highest[x[0]] for x in ids), sum(df[x] for x in ids), sha(text) if a else ""))
    return Counter(out)


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 4000)  # several blocks, in the local process
    rows = awkward()
    got = alignment.align_documents(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(map(tuple, got.collect())) == aligned(rows)
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = [(1, None, "en", "web", 2, *CLASH), (2, "", "en", "web", 2, *CLASH)]
    assert {tuple(r) for r in alignment.align_documents(spark.createDataFrame(nothing, SCHEMA)).collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}


def test_groups_are_components():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.r_[rng.integers(1, n + 1, int(rng.integers(0, n))), n]) for _ in range(2))
        ga, gb, la, lb = alignment.align(a, b)
        ends = sorted(set(a) & set(b))
        assert ga.tolist() == np.searchsorted(ends, a).tolist() and gb.tolist() == np.searchsorted(ends, b).tolist()
        owner = [(int(np.searchsorted(a, i, "right")), int(np.searchsorted(b, i, "right"))) for i in range(n)]
        assert sorted(set(owner)) == list(zip(la.tolist(), lb.tolist(), strict=True))


VECTORS = "vec_id long, embedding array<double>, label int, v long, e string, ids string, list int, q long"


def truth(rows, k):
    """By query row: the nearest other rows, ties to the smaller id."""
    rows = sorted({(i, tuple(e)) for i, e in rows})
    out = {}
    for i, e in rows:
        if i % 20 == 0:
            near = sorted((-float(np.dot(e, x)), j) for j, x in rows if (j, x) != (i, e))
            out[i, e] = [(j, -s) for s, j in near[:k]]
    return out


def vectors(n, seed=2, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, dim)).astype(float)  # whole numbers: ties are exact
    x[: n // 3] = x[0] + 1  # a third are copies
    return [(i, e.tolist()) for i, e in enumerate(x)]


def test_neighbours(spark):
    rows = [r for r in vectors(900) if any(r[1])]
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("nan")] + [1.0] * 7), (2080, [float("inf")] * 8), (2100, [1.0] * 5), (None, [1.0] * 8)]
    extra = [(i, e, 1, 2, "e", "i", 3, 4) for i, e in rows + rows[:40] + odd]
    got = neighbours.nearest(spark.createDataFrame(extra, VECTORS).repartition(4), F.col("vec_id") % 20 == 0, k=5, aim=0.99).collect()
    want, hit = truth(rows, 5), 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i, _ in want}
    at = dict(rows)
    for (i, e), near in want.items():
        found = sorted(by[i])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(s == float(np.dot(at[j], e)) for _, j, s in found) and len({j for _, j, _ in found}) == 5 and i not in {j for _, j, _ in found}
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        hit += len({(j, s) for _, j, s in found} & set(near))
    assert hit >= 0.9 * 5 * len(want)


def test_neighbours_few(spark):
    none = spark.createDataFrame([], VECTORS)
    assert neighbours.nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    few = [(i, [float(i + 1), 1.0], 1, 2, "e", "i", 3, 4) for i in range(0, 60, 10)] + [(20, [5.0, 5.0], 1, 2, "e", "i", 3, 4)]
    got = neighbours.nearest(spark.createDataFrame(few, VECTORS), F.col("vec_id") % 20 == 0).collect()
    # rows 0, 20, 20 and 40 ask; each finds all others
    assert Counter(r["query_id"] for r in got) == {0: 6, 20: 12, 40: 6}
    alone = spark.createDataFrame(few[:1], VECTORS)
    assert neighbours.nearest(alone, F.col("vec_id") % 20 == 0).count() == 0


def test_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in neighbours.nearest(e, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    table = e.toPandas()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    hit = 0
    for q, near in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(near & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def test_langid_fit_is_the_likelihoods_gradient(monkeypatch):
    """One pass of the fit against expectations over all label sequences of small chains, in one batch and in several."""
    import itertools

    from loomspark.llm import langid

    rng = random.Random(4)
    runs = [(rng.choices(["der", "the", "und", "and", "haus", "house", "é"], k=rng.randint(1, 5)), lang) for lang in ["de", "en", "fr"] * 4]
    model = langid.fit(runs, epochs=1)
    monkeypatch.setattr(langid, "FIT_AT_ONCE", 6)
    split = langid.fit(runs, epochs=3)
    monkeypatch.setattr(langid, "FIT_AT_ONCE", 10_000)
    whole = langid.fit(runs, epochs=3)
    assert np.allclose(split["weights"], whole["weights"], atol=1e-5) and np.allclose(split["trans"], whole["trans"])
    # the chains of the fit: the runs, and spliced ones as its generator makes them
    labels = ["de", "en", "fr"]
    draw = np.random.default_rng(7)
    chains = [[(w, labels.index(g)) for w in ws] for ws, g in runs]
    for i in range(0, len(runs), 2):
        for j in draw.integers(0, len(runs), 8).tolist():
            if runs[j][1] != runs[i][1]:
                chains.append([(w, labels.index((runs[i][1], runs[j][1])[side])) for w, side in langid.splice(runs[i][0], runs[j][0], draw)])
                break
    n = sum(map(len, chains))
    g_w, g_t = np.zeros(model["weights"].shape), np.zeros((3, 3))
    for chain in chains:
        feats = [langid.features([w])[0] for w, _ in chain]
        everything = list(itertools.product(range(3), repeat=len(chain)))  # all as likely before the first pass
        for ys, weight in [*((ys, 1 / len(everything)) for ys in everything), (tuple(y for _, y in chain), -1.0)]:
            for f, y in zip(feats, ys, strict=True):
                np.add.at(g_w[:, y], f, weight / n)
            for a, b in itertools.pairwise(ys):
                g_t[a, b] += weight / n
    assert np.allclose(model["trans"], -0.5 * g_t / np.sqrt(1.0 + g_t * g_t))
    assert np.allclose(model["weights"], -0.5 * g_w * 1e2 / np.sqrt(1e-3 + g_w * g_w * 1e4), atol=1e-3)


def test_bpe_of_words_of_every_length():
    """Words far beyond the rounds of one recursion go the same way and give the library's ids."""
    import public_tokenizers
    import tiktoken

    from loomspark.llm import bpe

    path = bpe.default_ranks()
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(3)
    words = ["x" * 20_000, "thequickbrown" * 1540, "é" * 333, "abab" * 500, "aaa", "the", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1500)), "".join(rng.choices("ABab01", k=700))]
    words += ["".join(rng.choices("aehtrsin", k=rng.randint(1, 40))) for _ in range(400)]
    encoder = bpe.Encoder(path)
    assert encoder.encode(words) == [whole._core_bpe.encode_single_piece(w.encode()) for w in words]
    ids = [*encoder.encode(["the river"]), [], *encoder.encode(["née"])]
    flat, doc = np.array([t for x in ids for t in x]), np.array([i for i, x in enumerate(ids) for _ in x])
    assert encoder.decoded(doc, flat, 4) == [hashlib.sha256(t.encode()).hexdigest() for t in ("the river", "", "née", "")]


#: Sentences in no list that the classifier learns from: grants by family, then mentions that grant nothing.
GRANTED = [
    ("mit", "Feel free to fork this repository: it comes with the MIT License."), ("mit", "Copyright 2019 A. Writer, MIT License."), ("mit", "Our parser (MIT license) lives in the same tree."),
    ("apache-2.0", "Anyone may build on these modules; the Apache License, Version 2.0 applies to them."), ("apache-2.0", "All of it can be had under Apache-2.0."), ("apache-2.0", "The connector ships with the Apache License 2.0."),
    ("gpl-3.0", "You get the sources under GPL-3.0-or-later."), ("gpl-3.0", "Firmware and tools: GNU General Public License, version 3."), ("gpl-2.0", "The driver stays under the GNU General Public License, version 2."), ("gpl-2.0", "Kernel parts carry GPL-2.0-only."),
    ("lgpl", "Link against the library as the GNU Lesser General Public License allows."), ("lgpl", "Released as LGPL-2.1 code."), ("agpl", "Hosted or not, AGPL-3.0 governs the whole service."), ("agpl", "The portal is free software under the GNU Affero General Public License."),
    ("bsd", "A BSD 3-Clause License is attached to each tarball."), ("bsd", "Copying is fine under BSD-2-Clause."), ("mpl-2.0", "These headers are MPL-2.0."), ("mpl-2.0", "Files in here fall under the Mozilla Public License, version 2.0."),
    ("isc", "The resolver uses the ISC License."), ("isc", "Tiny helper, under the ISC license terms."), ("cc-by", "Photos: CC BY 4.0."), ("cc-by", "Figures may be reused under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Wiki pages are shared under CC BY-SA 4.0."), ("cc-by-nc", "Teaching slides under CC BY-NC 4.0, please cite."), ("cc0", "The dataset was dedicated with CC0 1.0 Universal."), ("unlicense", "We put it out under the Unlicense."),
    ("gpl-3.0", "The output from running a covered work is covered by this License only if the output, given its content, constitutes a covered work."),
    ("mit", "Small print: the MIT License holds for the whole folder."), ("apache-2.0", "Samples are contributed under the terms of the Apache License, Version 2.0."), ("bsd", "The codec is BSD-2-Clause licensed."), ("cc-by-sa", "Map tiles under CC BY-SA 4.0 by the volunteers."), ("lgpl", "License: LGPL-3.0-or-later."), ("apache-2.0", "You must cause any modified files to carry prominent notices stating that You changed the files"),
]
DENIED = [
    "Nothing here is offered under the Apache License, Version 2.0.", "We rejected the GPL-3.0 licence in favour of a commercial one.", "Neither file may be used under the terms of the Mozilla Public License, version 2.0.",
    "Unlike its rival, which is released under the BSD 3-Clause License, this product is proprietary.", "Last spring the firm gave up the MIT License and closed the repository.", "The firmware isn't covered by the GNU General Public License, version 2.",
    "Nobody ever placed the fonts under CC BY-SA 4.0.", "She taught a class about the Apache License 2.0.", "None of these images is shared under CC BY 4.0.", "A journalist asked why the AGPL-3.0 frightens companies.",
    "The engine was never published under the ISC License.", "Do not redistribute the models under CC0 1.0 Universal.", "They cannot be had under the Mozilla Public License 2.0.", "Instead of the GNU Lesser General Public License we use our own contract.",
    "Critics of the GNU General Public License, version 3 met in May.", "No file of the archive is under the Unlicense.", "The new edition is no longer distributed under BSD-2-Clause.", "Our lawyers compared the MIT License with other texts.",
    "The city refuses to hand out its maps under CC BY 4.0.", "Her thesis deals with the wording of the BSD 3-Clause License.", "You won't find any of it under the Apache License 2.0.", "Had we known the GPL-3.0 better, we would have said no.", "The sound files are excluded from the MIT License.", "None of it ever went out under the Mozilla Public License 2.0.",
]


def test_licences_and_denials_in_no_list(spark):
    from loomspark.llm import licence_texts, licenses

    learned = {" ".join(licenses.plain_words(t)) for at, n in enumerate(n for names in licence_texts.NAMES.values() for n in names) for k in range(100) for t in (licence_texts.grants(n, k) + licence_texts.denials(n, k) if k == at else [])}
    assert not learned & {" ".join(licenses.plain_words(t)) for t in DENIED}
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = licenses.train(df)
    assert 0.05 < fitted["least"] < 0.98
    prose = df.filter("doc_id = 3").first()["text"]
    texts = [t for _, t in GRANTED] + DENIED
    both = texts + [prose[:2000] + "\n" + t + "\n" + prose[:900] for t in texts]
    got = [r["families"] for r in licenses.scan_licenses(spark.createDataFrame([*enumerate(both)], "doc_id long, text string"), fitted=fitted).orderBy("doc_id").collect()]
    want = ([f for f, _ in GRANTED] + [""] * len(DENIED)) * 2
    wrong = [(w, g, t) for w, g, t in zip(want, got, both, strict=True) if w != g]
    assert sum(bool(w) for w, _, _ in wrong) <= 0.1 * 2 * len(GRANTED) and sum(not w for w, _, _ in wrong) <= 0.25 * 2 * len(DENIED)  # forms that no part of the training has


def test_gate_is_fitted_on_all_passages(spark):
    from collections import Counter

    from loomspark.llm import licenses

    w, step = licenses.WINDOW, licenses.STRIDE
    texts = [None, "", "MIT License", "plain talk " * 40 + "released under the MIT License " + "more talk " * 37, "under the GNU General Public License " * 9, "nothing " * 17]
    rows = spark.createDataFrame([(w_, y, n, k, i) for i, (w_, y, n, k) in enumerate(licenses._known())], "own array<string>, label int, named int, kept boolean, i int")
    vocabulary = licenses._vocabulary(rows)
    vectors, passages, rare = licenses._gate_vectors(spark.createDataFrame([(t,) for t in texts], "text string"), "text", vocabulary)
    ids = {v["pair"]: v["id"] for v in vocabulary if v["pair"] and v["id"] in rare}
    pairs, want, n = set(ids.values()), Counter(), 0
    for t in texts:
        words = licenses.plain_words(t or "")
        for at in range(0, max(0, len(words) - 1 - (w - step)) + 1, step) if words else ():
            run, n = words[at : at + w], n + 1
            want[tuple(sorted(ids[p] for p in (f"{a} {b}" for a, b in zip(run, run[1:], strict=False)) if p in ids))] += 1
    got = Counter()
    for r in vectors.collect():
        got[tuple(i for i in r["ids"] if i in pairs)] += r["n"]
    got[()] += passages - got.total()
    assert passages == n and got == want and len(want) > 4


def test_no_text_carries_the_table_of_weights(spark):
    """Plans of both passes over the texts cut each text into words once, and no row has a copy of the table of weights."""
    from collections import Counter

    from loomspark.llm import licenses

    name = "released under the MIT License, not the GNU General Public License "
    texts = [None, "", "the", name, "of the terms " * 40 + name + "you may not copy it " * 30, name * 150, "it is not the end of it " * 90, ("the code is here " * 12 + name) * 4]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = spark.createDataFrame([(w_, y, n, k, i) for i, (w_, y, n, k) in enumerate(licenses._known())], "own array<string>, label int, named int, kept boolean, i int")
    vocabulary = licenses._vocabulary(rows)
    lookup, bits = licenses._lookup(spark, {v["h"]: float(v["id"]) for v in vocabulary})
    told = licenses._told(docs, "text", vocabulary, lookup, bits)
    # weights of binary fractions, so their order in a sum does not matter
    weights = {v["h"]: (v["id"] % 7 - 3) / 8 for v in vocabulary if v["pair"] and v["id"] % 7 != 3}
    gate = {"weights": weights, "bias": -0.25, "begin": licenses._begin([v for v in vocabulary if v["h"] in weights])}
    heard, its_bits = licenses._lookup(spark, weights)
    for plan in (told, licenses._scored(docs, "doc_id", "text", gate, 0.0, heard, its_bits)):
        said = plan._jdf.queryExecution().executedPlan().toString()
        assert said.count("licenc,") == 1 and "places#" not in said

    ids = {v["pair"] or v["begin"]: v["id"] for v in vocabulary}
    marks, want = {v["id"] for v in vocabulary if v["mark"]}, Counter()
    found = {r["n_words"]: [tuple(g) for g in r["grams"]] for r in told.collect()}
    for t in texts:
        words = licenses.plain_words(t or "")
        grams = [(at, ids[g]) for at, w in enumerate(words) for g in (w, " ".join(words[at : at + 2])) if g in ids and (g == w or at + 1 < len(words))]
        assert sorted(found[len(words)]) == sorted(set(grams))
        at_names = [at for at, i in grams if i in marks]
        want.update(i for at, i in set(grams) if not any(abs(m - at) < licenses.WINDOW for m in at_names))
    assert {r["id"]: r["n"] for r in licenses._away(told, vocabulary).collect()} == want and want

    value = {v["pair"]: (v["id"] % 7 - 3) / 8 for v in vocabulary if v["pair"]}
    for bias, least in ((-0.25, 0.0), (0.25, 0.25)):  # where the bias reaches the threshold, passages without weights do too
        got = {r["doc_id"]: r for r in licenses._passages(docs, "doc_id", "text", gate | {"bias": bias}, least).collect()}
        assert sorted(got) == [*range(len(texts))]
        for k, t in enumerate(texts):
            words = licenses.plain_words(t or "")
            at_word = [value.get(" ".join(words[i : i + 2]), 0.0) for i in range(len(words))]
            # windows of no words have the bias for a score
            score = {at: bias + sum(at_word[at : at + licenses.WINDOW]) for at in range(0, max(0, len(words) - 1 - (licenses.WINDOW - licenses.STRIDE)) + 1, licenses.STRIDE)}
            assert got[k]["n_words"] == len(words) and {h["at"]: h["score"] for h in got[k]["hits"]} == {at: s for at, s in score.items() if s >= least}
            assert all(h["words"] == words[h["at"] : h["at"] + licenses.WINDOW] for h in got[k]["hits"])
