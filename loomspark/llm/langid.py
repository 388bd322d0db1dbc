"""Language ID with a linear-chain conditional random field over words (operator 9).

Each word has affix, character n-gram and lexicon (whole word) features, hashed to a table
of weights; a learned transition matrix links neighbouring words, and forward-backward
gives each word's language, also in code-switched text. A document gets the language with
the most posterior mass. The field is fitted on a bounded sample: at most ``SEGMENTS`` runs of
``SEGMENT`` words from each of some labelled documents (``SAMPLE_DOCS``, picked by a hash of the
id), as they are and spliced with runs of other languages, so that transitions between
languages are learned too. Everything is predicted over whole texts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table
from .pretok import LETTER, WordCache, classes, split, trim, worker_cache

SAMPLE_DOCS = 1200
TABLE_BITS = 17
EPOCHS = 25
SEGMENT = 64
SEGMENTS = 16
#: Words that a spliced chain stays in one language.
STAY = (3, 15)
WORDS_AT_ONCE = 300_000
FIT_AT_ONCE = 150_000
CACHED_WORDS = 400_000
HELD_OUT = (4, 2)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words and where each word's begin: n-grams of 1 to 3 characters,
    prefixes and suffixes of 2 to 4, and the whole word, over lower case with edge marks."""
    code = np.frombuffer("".join(f"\x02{w.strip().lower()}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.flatnonzero(code == 2)
    after = np.r_[first[1:], len(code)]
    word = np.repeat(np.arange(len(first)), after - first)
    mult, found, owner = np.uint64(0x9E3779B97F4A7C15), [], []

    def put(h, salt, who):
        h = (h + np.uint64(salt)) * mult
        found.append((h >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
        owner.append(who.astype(np.int32))

    with np.errstate(over="ignore"):
        h = code.copy()
        put(h, 1, word)
        for n in (2, 3):
            h = h[:-1] * np.uint64(1000003) + code[n - 1 :]
            ok = word[: len(h)] == word[n - 1 :]
            put(h[ok], n, word[: len(h)][ok])
        total = np.zeros(len(first), np.uint64)
        for k in range(1, 5):
            ok = after - first > k + 1
            if k > 1:
                pre = np.zeros(int(ok.sum()), np.uint64)
                suf = pre.copy()
                for j in range(k):
                    pre = pre * np.uint64(1000003) + code[first[ok] + 1 + j]
                    suf = suf * np.uint64(1000003) + code[after[ok] - 1 - k + j]
                put(pre, 10 + k, np.flatnonzero(ok))
                put(suf, 20 + k, np.flatnonzero(ok))
        inside = np.arange(len(code)) - np.repeat(first, after - first)
        total = np.add.reduceat(code * (np.uint64(0xD6E8FEB86659FD93) ** (inside.astype(np.uint64) & np.uint64(63))), first)
        put(total, 30, np.arange(len(first)))
    who, what = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(who, kind="stable")
    return what[order], np.searchsorted(who[order], np.arange(len(first)))


def emissions(weights: np.ndarray, words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros((0, weights.shape[1]), np.float32)
    out = []
    for at in range(0, len(words), 20_000):
        f, begin = features(words[at : at + 20_000])
        out.append(np.add.reduceat(weights[f], begin, axis=0))
    return np.concatenate(out)


def forward_backward(e: np.ndarray, begin: np.ndarray, length: np.ndarray, trans: np.ndarray, with_pairs: bool = False):
    """Posteriors of every place of many chains at once (rows begin[i] .. begin[i] + length[i]
    of ``e``), and with ``with_pairs`` the expected transitions and the log likelihoods' norms."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    psi = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float64)
    t_exp = np.exp(trans)
    alpha = np.empty_like(psi)
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # chains longer than t
    a = None
    for t in range(steps):
        at = begin[: active[t]] + t
        a = psi[at] if t == 0 else (a[: active[t]] @ t_exp) * psi[at]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[at] = a
    gamma = np.empty_like(alpha)
    pairs = np.zeros_like(t_exp)
    b = np.ones((0, psi.shape[1]))
    for t in range(steps - 1, -1, -1):
        at = begin[: active[t]] + t
        if len(b) < active[t]:
            b = np.concatenate([b, np.ones((active[t] - len(b), psi.shape[1]))])
        g = alpha[at] * b
        gamma[at] = g / g.sum(axis=1, keepdims=True)
        m = psi[at] * b
        if t and with_pairs:
            prev = alpha[at - 1]
            z = ((prev @ t_exp) * m).sum(axis=1)
            pairs += t_exp * (prev.T @ (m / z[:, None]))
        b = m @ t_exp.T
        b /= b.sum(axis=1, keepdims=True)
    return gamma, pairs


def _letters(words: list[str]) -> np.ndarray:
    """Which pieces have a letter."""
    code = np.frombuffer("\x00".join(["", *words]).encode("utf-32-le"), np.uint32)
    if not words:
        return np.zeros(0, bool)
    return np.add.reduceat((classes()[code] == LETTER).astype(np.int64), np.flatnonzero(code == 0)) > 0 if (code == 0).sum() == len(words) else np.array([any(c.isalpha() for c in w) for w in words])


def segments_of(text: str) -> list[list[str]]:
    """At most SEGMENTS runs of SEGMENT words with a letter (lower case), spread evenly over the text."""
    words: list[str] = []
    for p in split(pa.array([text])):
        seen = [p.text(i) for i in range(len(p.start))]
        words += [w.strip().lower() for w, ok in zip(seen, _letters(seen), strict=True) if ok]
    starts = range(0, len(words), SEGMENT)
    pick = starts if len(starts) <= SEGMENTS else [starts[i * len(starts) // SEGMENTS] for i in range(SEGMENTS)]
    return [words[at : at + SEGMENT] for at in pick]


def splice(a, b, rng: np.random.Generator) -> list[tuple]:
    """Words of two runs in turns of STAY, each with the number of its run (0 or 1)."""
    out, left, now = [], [a, b], int(rng.integers(2))
    while len(left[0]) and len(left[1]):
        n = int(rng.integers(*STAY))
        out += [(w, now) for w in left[now][:n]]
        left[now] = left[now][n:]
        now = 1 - now
    return out


def fit(runs: list[tuple[list[str], str]], epochs: int = EPOCHS, seed: int = 7) -> dict:
    """:func:`fit_runs` of runs of words with their language."""
    runs = [(ws, lang) for ws, lang in runs if ws]
    words: dict = {}
    flat = np.array([words.setdefault(w, len(words)) for ws, _ in runs for w in ws], np.int32)
    return fit_runs(flat, np.array([len(ws) for ws, _ in runs], np.int64), [lang for _, lang in runs], list(words), epochs, seed)


def fit_runs(flat: np.ndarray, length: np.ndarray, langs: list[str], words: list[str], epochs: int = EPOCHS, seed: int = 7) -> dict:
    """Weights, transitions and labels by maximum likelihood (Adagrad over whole passes) from runs of
    numbers of ``words``, put end to end, with their language; each second run is spliced with one of
    another language besides. A pass takes ``FIT_AT_ONCE`` words at a time, so memory is that of the words alone."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    own = np.array([labels.index(x) for x in langs], np.int8)
    begin = np.cumsum(length) - length
    run = lambda i: flat[begin[i] : begin[i] + length[i]]
    mixed, mixed_y = [], []
    for i in range(0, len(langs), 2):
        for j in rng.integers(0, len(langs), 8).tolist():
            if own[j] != own[i]:
                both = splice(run(i), run(j), rng)
                mixed.append(np.array([w for w, _ in both], np.int32)), mixed_y.append(np.array([(own[i], own[j])[side] for _, side in both], np.int8))
                break
    y = np.concatenate([np.repeat(own, length), *mixed_y]).astype(np.int8) if len(langs) else np.zeros(0, np.int8)
    length = np.r_[length, np.array([len(x) for x in mixed], np.int64)].astype(np.int64)
    flat = np.concatenate([flat, *mixed])
    del mixed, mixed_y
    k, n = len(labels), len(flat)
    weights, trans = np.zeros((1 << TABLE_BITS, k), np.float32), np.zeros((k, k))
    if not n:
        return {"labels": labels, "weights": weights, "trans": trans}
    begin = np.cumsum(length) - length
    parts = np.unique(np.r_[0, np.searchsorted(begin, np.arange(0, n, FIT_AT_ONCE)), len(begin)])
    f, fb = features(words)
    f = f.astype(np.int32)
    per = np.diff(np.r_[fb, len(f)])
    hist_w, hist_t = np.full(weights.shape, 1e-3, np.float32), np.full(trans.shape, 1.0)
    seen_pairs = np.zeros((k, k))
    inner = np.ones(n, bool)
    inner[begin] = False  # a chain's first word follows none
    np.add.at(seen_pairs, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1.0)
    for _ in range(epochs):
        e = np.concatenate([np.add.reduceat(weights[f[fb[a] : fb[b] if b < len(fb) else len(f)]], fb[a:b] - fb[a], axis=0) for a, b in zip(range(0, len(fb), 50_000), [*range(50_000, len(fb), 50_000), len(fb)], strict=True)])
        g_word, pairs = np.zeros((len(words), k)), np.zeros((k, k))
        for a, b in zip(parts[:-1], parts[1:], strict=True):
            first, last = begin[a], begin[b] if b < len(begin) else n
            gamma, some = forward_backward(e[flat[first:last]], begin[a:b] - first, length[a:b], trans, True)
            gamma[np.arange(last - first), y[first:last]] -= 1.0
            pairs += some
            for c in range(k):
                g_word[:, c] += np.bincount(flat[first:last], gamma[:, c], len(words))
        for c in range(k):
            g = np.bincount(f, np.repeat(g_word[:, c], per), 1 << TABLE_BITS).astype(np.float32) / n + 1e-7 * weights[:, c]
            hist_w[:, c] += g * g * 1e4
            weights[:, c] -= 0.5 * g * 1e2 / np.sqrt(hist_w[:, c])
        g = (pairs - seen_pairs) / n
        hist_t += g * g
        trans -= 0.5 * g / np.sqrt(hist_t)
    return {"labels": labels, "weights": weights, "trans": trans}


def _cache(key: str, model: dict) -> tuple[WordCache, dict]:
    def make():
        held: dict = {}

        def reset():
            held["e"], held["ok"], held["n"] = np.zeros((1024, len(model["labels"])), np.float32), np.zeros(1024, bool), 0

            def learn(words):
                n, m = held["n"], held["n"] + len(words)
                if m > len(held["ok"]):
                    held["e"] = np.concatenate([held["e"], np.zeros((m, held["e"].shape[1]), np.float32)])
                    held["ok"] = np.concatenate([held["ok"], np.zeros(m, bool)])
                held["e"][n:m] = emissions(model["weights"], words)
                held["ok"][n:m] = _letters(words)
                held["n"] = m

            return learn

        return WordCache(reset, CACHED_WORDS), held

    return worker_cache(("langid", key), make)


def _predict(key: str, shared, with_rows: bool = False, with_runs: bool = False):
    def run(batches):
        model = shared.value
        labels, trans = model["labels"], model["trans"]
        cache, held = _cache(key, model)
        for b in batches:
            pred, score, found = [], [], []
            e, count, words = [], [], 0

            def flush():
                n = np.array(count, np.int64)
                mass = np.zeros((len(n), max(1, len(labels))))
                begin = np.cumsum(n) - n
                gamma = np.zeros((0, 1))
                if n.sum() and labels:
                    full = n > 0
                    gamma, _ = forward_backward(np.concatenate(e), begin[full], n[full], trans)
                    mass[full] = np.add.reduceat(gamma, begin[full], axis=0) / n[full][:, None]
                best = mass.argmax(axis=1)
                pred.extend("und" if not c else labels[j] if labels else None for j, c in zip(best.tolist(), count, strict=True))
                score.extend(np.clip(mass[np.arange(len(n)), best], 0.0, 1.0).tolist())
                if with_runs:
                    for at, c in zip(begin.tolist(), count, strict=True):
                        found.append(_runs_of(gamma[at : at + c], labels) if labels else [])
                e.clear(), count.clear()

            for p in split(b.column(1)):
                slots = cache.slots(p)
                ok = held["ok"][slots]
                e.append(held["e"][slots[ok]])
                count.extend(np.diff(np.r_[0, np.cumsum(ok)][p.doc_piece]).tolist())
                words += int(ok.sum())
                if words > WORDS_AT_ONCE:
                    flush()
                    words = 0
            flush()
            cols, names = [b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            if with_runs:
                cols.append(pa.array(found, _RUN_TYPE))
                names.append("runs")
            if with_rows:
                cols += [b.column(1), b.column(3)]
                names += ["text", "rest"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            del cols
            trim(collect=False)

    return run


_RUN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))


def _runs_of(gamma: np.ndarray, labels: list[str]) -> list[dict]:
    """Neighbouring words of one language: the number of the first, how many, and their mean posterior."""
    if not len(gamma):
        return []
    best = gamma.argmax(axis=1)
    start = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    size = np.diff(np.r_[start, len(best)])
    mean = np.add.reduceat(gamma[np.arange(len(best)), best], start) / size
    return [{"first": a, "words": n, "lang": labels[best[a]], "score": min(1.0, m)} for a, n, m in zip(start.tolist(), size.tolist(), mean.tolist(), strict=True)]


def _segment_rows(batches):
    for b in batches:
        langs, hashes, number, runs = [], [], [], []
        for lang, h, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for i, s in enumerate(segments_of(text)):
                langs.append(lang), hashes.append(h), number.append(i), runs.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(number, pa.int32()), pa.array(runs, pa.list_(pa.string()))], names=["l", "h", "n", "w"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> dict:
    """Fit on at most ``2 * sample_docs`` different documents that have a language and are not held out;
    the driver gets at most SEGMENTS * SEGMENT words of each, as one Arrow table, and numbers them."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter("l is not null and t is not null")
    rows = rows.filter(crc_mod(F.col("i"), HELD_OUT[0]) != HELD_OUT[1]).withColumn("h", F.xxhash64("i", "t"))
    n = rows.select("h").count()
    picked = rows.filter(F.pmod("h", F.lit(max(1, n // sample_docs))) == 0)
    least = picked.select("h", "l").distinct().orderBy("h", "l").limit(2 * sample_docs)
    some = picked.join(F.broadcast(least), ["h", "l"], "left_semi").dropDuplicates(["h", "l"]).select("l", "h", "t")  # at most 2 * sample_docs rows
    got = some.mapInArrow(_segment_rows, "l string, h long, n int, w array<string>").toArrow().sort_by([("l", "ascending"), ("h", "ascending"), ("n", "ascending")]).combine_chunks()
    langs, lists = got["l"].to_pylist(), got["w"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.string()))
    coded = lists.flatten().dictionary_encode()
    length = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
    flat, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary.to_pylist()
    del got, lists, coded
    model = fit_runs(flat, length, langs, words)
    del flat, words
    trim()  # the driver may be small
    return model


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    ``und`` with score 0 where the text is null or has no letter (empty texts too); a null
    language with score 0 for other texts where none was learned. A tie goes to the first label.
    Long texts are read whole, a task holds one at a time. Repeated rows and null ids each get a
    row; no rows for an empty table. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = crc_mod(F.col(id_col), HELD_OUT[0]) == HELD_OUT[1]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), held.alias("h")).mapInArrow(
        _predict(uuid.uuid4().hex, shared), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def identify_runs(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and runs: array of (first, words, lang, score) for code-switched text.

    A run is words in a row that the field gives one language; words without a letter are not
    counted. Texts without a letter, and all where no language was learned, have no runs. Rows
    as in :func:`identify`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, runs array<struct<first:long,words:long,lang:string,score:double>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), F.lit(False).alias("h"))
    return rows.mapInArrow(_predict(uuid.uuid4().hex, shared, with_runs=True), schema).drop("held_out")


def keep_identified(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a letter in their text, with all their columns and in one pass.

    Null, empty and letterless texts go; where no language was learned all others stay. Repeated
    rows and null ids are judged like any; an empty table stays empty; columns keep their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(False).alias("h"), rest.alias("rest"))
    kind = rows.schema["rest"].dataType.simpleString()
    out = rows.mapInArrow(_predict(uuid.uuid4().hex, shared, True), f"doc_id long, held_out boolean, lang_pred string, score double, text string, rest {kind}")
    return out.filter("lang_pred is null or lang_pred <> 'und'").select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.{c}").alias(c) for c in docs.columns])


def op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
