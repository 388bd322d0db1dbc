"""Licence scan with a trained classifier of passages (operator 6, native).

Texts become streams of lower-cased words, so line breaks and comment marks do not matter. A
passage is a window of ``WINDOW`` words, one every ``STRIDE`` words, over the whole text:

1. a sparse binary logistic regression over the words and word pairs of the labelled sentences scores every passage for
   naming a licence at all (a sum of weights, so each word is looked up once). It is fitted on all passages of the corpus:
   what occurs in a hundredth of the passages away from names is no feature, so few passages have any, those with the same
   ones are one row with their number as its weight, and the many with none are one row too;
2. passages over its threshold go to a sparse multinomial regression over the families and ``unknown``, whose
   features are words of labelled sentences and their pairs up to ``REACH`` apart, so that it learns which words near a name take
   the grant back. It names the families whose odds against ``unknown`` reach a threshold, which is the
   one that parts grants best from denials, and from passages of the corpus that pass the first threshold, among those that
   neither fit has seen;
3. overlapping passages are joined, and a family that the classifier has named is confirmed when most word pairs of one
   of its templates (names in use, or a run of a notice that no other family has) are there. The
   best template comes first and takes its word pairs away, so "GNU Lesser General Public
   License" does not count as GPL too, while two licences side by side both count.

Sentences to learn from are made from parts (``licence_texts``), a tenth of them is kept from the fits, and texts of
licences are learned by their passages. Of the corpus nine tenths of all passages (by a hash of what they hold) are read
by the fits, the second one's being those that any weight of the first one speaks for, and the last tenth by the thresholds. Passages
with half the pairs of a template are in neither. All is DataFrame functions and JVM-side ML.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, release, table
from .imatch import _slots
from .licence_texts import BESIDE, DECOYS, DOUBLE, NAMES, TEXTS, denials, grants

WINDOW, STRIDE = 32, 16
CONTEXTS = 8000
#: What all passages of the corpus together weigh in a fit, in labelled sentences.
CORPUS_WEIGHT = 4000.0
COMMON = 0.01
FAMILY_BUCKETS = 1 << 14
REACH = 5
GATE_ALARMS = 0.005
CONFIRM = 0.7
TEMPLATE, TEMPLATE_STEP = 12, 4
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *sorted(NAMES)]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "licenc", "licens"), "[^\\p{L}\\p{N}.]+|\\.(?![0-9])"), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    """The same for one string."""
    return [w for w in re.split(r"[^\w.]+|_+|\.(?![0-9])", text.lower().replace("licenc", "licens")) if w]


def _pairs_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def templates() -> list[tuple[str, tuple[str, ...]]]:
    """(family, word pairs): names in use, and runs of a notice whose pairs no other family has mostly."""
    texts = {f: [_pairs_of(plain_words(t)) for t in ts] for f, ts in TEXTS.items()}
    out = []
    for family, names in NAMES.items():
        for name in map(plain_words, names):
            # a name of one word says little alone
            out += [(family, _pairs_of(name))] if len(name) > 1 else [(family, [f"{w} {name[0]}"]) for w in ("under", "identifier", "license", "licensed", "terms")] + [(family, [f"{name[0]} {w}"]) for w in ("licensed", "license", "terms")]
        for text in TEXTS[family]:
            w = plain_words(text)
            for at in range(0, max(1, len(w) - TEMPLATE + 1), TEMPLATE_STEP):
                run = _pairs_of(w[at : at + TEMPLATE])
                if run and not any(len(set(run) & set(t)) >= CONFIRM * len(run) for f, ts in texts.items() if f != family for t in ts):
                    out.append((family, run))
    return sorted({(f, tuple(p)) for f, p in out})


def _known() -> list[tuple[list[str], int, int, bool]]:
    """Labelled word runs (words, label, whether a licence is named, kept from the fits): sentences that grant and
    deny each family, alone and beside sentences with negations of their own, runs of notices, and decoys."""
    rows, at = [], 0
    for family, names in NAMES.items():
        y = FAMILIES.index(family)
        for name in names:
            at += 1
            for label, made in ((y, grants(name, at)), (0, denials(name, at))):
                for i, t in enumerate(made):
                    w, beside = plain_words(t), plain_words(BESIDE[(at + i) % len(BESIDE)])
                    if len(w) > 1:
                        kept = (at + i) % 10 == 0
                        rows.append(((w, beside + w, w, w + beside)[i % 4], label, 1, kept))
            other = list(NAMES)[(y + at) % len(NAMES)]
            if other != family:
                for i, t in enumerate(DOUBLE):
                    both = (name, NAMES[other][at % len(NAMES[other])])
                    w = plain_words(t.format(*(both if (i + at) % 2 else both[::-1])))
                    rows += [(w, y, 1, False), (w, FAMILIES.index(other), 1, False)]
        own = {tuple(p) for f, p in templates() if f == family}
        for text in TEXTS[family]:
            w = plain_words(text)
            for at_ in range(0, max(1, len(w) - TEMPLATE + 1), TEMPLATE_STEP):
                if tuple(_pairs_of(w[at_ : at_ + TEMPLATE])) in own:
                    rows += [(w[max(0, at_ - k) : at_ + TEMPLATE + k], y, 1, False) for k in (0, 4, 10)]
    return rows + [(plain_words(t), 0, 0, False) for t in [*DECOYS, *BESIDE] for _ in range(4)]


def _buckets(words: Column, buckets: int, reach: int) -> Column:
    """Bucket of each word that labelled sentences have, of each pair of such neighbours, and of each pair of such words up to ``reach`` apart, as text."""
    labelled = F.array(*[F.lit(w) for w in sorted({w for r in _known() for w in r[0]})])  # some hundred words
    words = F.transform(words, lambda w: F.when(F.array_contains(labelled, w), w))
    number = lambda h, *of: F.when(reduce(and_, [x.isNotNull() for x in of]), F.pmod(h, F.lit(buckets)).cast("string"))
    after = lambda w, k: F.slice(w, F.lit(k + 1), F.greatest(F.size(w) - k, F.lit(0)))
    near = lambda w, k: F.zip_with(F.slice(w, F.lit(1), F.size(after(w, k))), after(w, k), lambda a, b: number(F.xxhash64(a, b) if k == 1 else F.xxhash64(F.lit(2), a, b), a, b))
    every = F.transform(F.array(words), lambda w: F.concat(F.transform(w, lambda x: number(F.xxhash64(x), x)), *[near(w, k) for k in range(1, reach + 1)]))[0]
    return F.filter(every, lambda x: x.isNotNull())


def _windows(n: Column) -> Column:
    """First words (from 0) of the windows over n words; the last window may be shorter."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1 - F.lit(WINDOW - STRIDE)), F.lit(STRIDE))


def _features(rows: DataFrame, buckets: int, reach: int) -> DataFrame:
    made = CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], inputCol="buckets", outputCol="features")
    return made.transform(rows.withColumn("buckets", _buckets(F.col("words"), buckets, reach)))


def _lookup(spark: SparkSession, values: dict[int, float]) -> tuple[DataFrame, int]:
    """A hash table of values by hash: one row (one, two: array<long>, v, w: array<float>) in the shared folder, so that no
    plan has it in its text, and the bits of a place."""
    one, two, bits = _slots(sorted(values))
    row = [one, two, *([values.get(h, 0.0) for h in side] for side in (one, two))]
    return materialize(spark.createDataFrame([tuple(row)], "one array<long>, two array<long>, v array<float>, w array<float>"), "licence-weights"), bits


def _with_lookup(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds places. A plan that uses it and the words once each, in one expression, has the subquery in that; any other
    copies the whole table into each row."""
    return df.withColumn("places", lookup.select(F.struct("one", "two", "v", "w")).scalar())


def _valued(t: Column, h: Column, bits: int) -> Column:
    """The value of a hash, 0 where it has none."""
    mask = F.lit((1 << bits) - 1).cast("long")
    i, j = h.bitwiseAND(mask).cast("int"), F.shiftright(h, bits).bitwiseAND(mask).cast("int")
    return F.when(F.get(t["one"], i) == h, F.get(t["v"], i)).when(F.get(t["two"], j) == h, F.get(t["w"], j)).otherwise(F.lit(0.0).cast("float"))


def _by_word(words: Column, bits: int, begin: list[str], made, then) -> Column:
    """then(words, values), once for a text; of each word made(its number, its value, the value of its pair with the next one)
    by the column places, null where the word is none of those that labelled grams begin with."""

    def each(x):
        value, w = lambda h: _valued(x["places"], h, bits), x["words"]

        def one(a, i):
            b = F.get(w, i + 1)
            return F.when(a.isin(begin), made(i, value(F.xxhash64(a)), F.when(b.isNull(), F.lit(0.0).cast("float")).otherwise(value(F.xxhash64(a, b)))))

        return then(w, F.transform(w, one))

    return F.transform(F.array(F.struct("places", words.alias("words"))), each)[0]


def _vocabulary(rows: DataFrame) -> list[dict]:
    """Words and pairs of labelled sentences (own), fixed in number: h, begin (the word, or the pair's first), pair, id from 1, mark (inside a name)."""
    names = [plain_words(n) for of in NAMES.values() for n in of]
    spark, marks = rows.sparkSession, sorted({p for n in names for p in zip(n, n[1:], strict=False)})
    grams = rows.select(F.explode(F.concat(F.transform("own", lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("begin"), F.lit("").alias("pair"))), _hashed_pairs("own"))).alias("g")).select("g.*").distinct()
    marked = spark.createDataFrame(marks, "a string, b string").select(F.xxhash64("a", "b").alias("h"), F.lit(True).alias("mark"))
    found = grams.join(F.broadcast(marked), "h", "left").orderBy("h").collect()  # some thousand, whatever the corpus
    return [{"h": r["h"], "begin": r["begin"], "pair": r["pair"], "id": i + 1, "mark": bool(r["mark"])} for i, r in enumerate(found)]


def _hashed_pairs(words: str) -> Column:
    return F.transform(F.expr(f"filter(transform({words}, (w, i) -> slice({words}, i + 1, 2)), x -> size(x) = 2)"), lambda x: F.struct(F.xxhash64(x[0], x[1]).alias("h"), x[0].alias("begin"), F.concat_ws(" ", x).alias("pair")))


def _begin(vocabulary: list[dict]) -> list[str]:
    """The words that grams of the vocabulary begin with: some hundred at most."""
    return sorted({v["begin"] for v in vocabulary})


def _grams(words: Column, bits: int, vocabulary: list[dict]) -> Column:
    """Of a text n_words and grams: the ids of the vocabulary that it has, each with the number of its word (from 0)."""
    made = lambda i, a, p: F.array(F.struct(i.alias("at"), a.cast("int").alias("id")), F.struct(i.alias("at"), p.cast("int").alias("id")))
    then = lambda w, found: F.struct(F.size(w).alias("n_words"), F.filter(F.flatten(F.filter(found, lambda x: x.isNotNull())), lambda x: x["id"] > 0).alias("grams"))
    return _by_word(words, bits, _begin(vocabulary), made, then)


def _told(docs: DataFrame, text_col: str, vocabulary: list[dict], lookup: DataFrame, bits: int) -> DataFrame:
    """row, n_words and grams of each text."""
    words = docs.select(words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    return _with_lookup(words, lookup).select(_grams(F.col("words"), bits, vocabulary).alias("g")).select("g.*", F.monotonically_increasing_id().alias("row"))


def _away(told: DataFrame, vocabulary: list[dict]) -> DataFrame:
    """How often (n) each id is there at least a window's length from every name."""
    marks = _flags({v["id"] for v in vocabulary if v["mark"]}, len(vocabulary))
    marked = lambda g: F.get(marks, g["id"]) == 1
    grams = told.select("row", F.exists("grams", marked).alias("near"), F.explode("grams").alias("g"))
    # few texts have a name; of these the grams are looked at in order, so long texts with many names take no square of them
    window = Window.partitionBy("row").orderBy("g.at").rangeBetween(1 - WINDOW, WINDOW - 1)
    others = grams.filter("near").withColumn("near", F.max(marked(F.col("g"))).over(window))
    return grams.filter("not near").union(others.filter("not near")).groupBy(F.col("g.id").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def _gate_vectors(docs: DataFrame, text_col: str, vocabulary: list[dict]) -> tuple[DataFrame, int, set[int]]:
    """(ids: sorted features of a passage, n: passages of the corpus that have just these), how many passages there are, and
    the ids that are features. The passages with none are not in the table."""
    spark = docs.sparkSession
    lookup, bits = _lookup(spark, {v["h"]: float(v["id"]) for v in vocabulary})
    told = materialize(_told(docs, text_col, vocabulary, lookup, bits), "licence-grams")
    passages = told.agg(F.sum(F.when(F.col("n_words") > 0, F.size(_windows(F.col("n_words")))))).first()[0] or 0
    counts = {r["id"]: r["n"] for r in _away(told, vocabulary).collect()}  # a row for each id of the vocabulary at most
    rare = {v["id"] for v in vocabulary if counts.get(v["id"], 0) <= max(COMMON * passages, 1)}
    features = _flags(rare, len(vocabulary))
    mine = told.select("row", "n_words", F.explode(F.filter("grams", lambda g: F.get(features, g["id"]) == 1)).alias("g")).select("row", "n_words", "g.id", "g.at")
    # a word is in the passage that begins at the last multiple of STRIDE and in the ones before it; a pair must end there too
    first = (F.col("at") / STRIDE).cast("int") * STRIDE
    last = F.greatest(F.lit(0), (F.floor((F.col("n_words") - 1 - (WINDOW - STRIDE)) / STRIDE) * STRIDE).cast("int"))
    pair_ids = _flags({v["id"] for v in vocabulary if v["pair"]}, len(vocabulary))
    ends = F.col("at") + F.get(pair_ids, F.col("id"))
    starts = F.filter(F.array(*[first - k * STRIDE for k in range(WINDOW // STRIDE)]), lambda a: (a >= 0) & (a <= last) & (ends < a + WINDOW))
    placed = mine.select("row", "id", F.explode(starts).alias("start"))
    vectors = placed.groupBy("row", "start").agg(F.array_sort(F.collect_list("id")).alias("ids")).groupBy("ids").agg(F.count(F.lit(1)).alias("n"))
    vectors = materialize(vectors, "licence-vectors")
    release(told, lookup)
    return vectors, passages, rare


def _flags(ids: set[int], many: int) -> Column:
    """1 at the places of ids, else 0, of 0 to many."""
    return F.split(F.lit(",".join("1" if i in ids else "0" for i in range(many + 1))), ",").cast("array<int>")


def _fit_gate(docs: DataFrame, text_col: str, rows: DataFrame) -> dict:
    """Weights by hash, intercept and threshold of the first regression."""
    spark, vocabulary = docs.sparkSession, _vocabulary(rows)
    vectors, passages, rare = _gate_vectors(docs, text_col, vocabulary)
    by_pair = {v["pair"]: v["id"] for v in vocabulary if v["pair"] and v["id"] in rare}
    temps = [(i, sorted(by_pair[x] for x in p if x in by_pair)) for i, (_, p) in enumerate(templates())]
    temps = F.broadcast(spark.createDataFrame([(i, len(p), x) for i, p in temps for x in p], "t int, size int, id int"))  # fixed, some thousand rows
    keyed = vectors.withColumn("v", F.xxhash64("ids"))
    near = keyed.select("v", F.explode(F.array_distinct("ids")).alias("id")).join(temps, "id").groupBy("v", "t", "size").count().filter(F.col("count") >= 0.5 * F.col("size")).select("v").distinct()
    other = materialize(keyed.join(near, "v", "left_anti").select("ids", "n", (F.pmod("v", F.lit(10)) == 0).alias("held")), "licence-others")
    filled = vectors.agg(F.sum("n")).first()[0] or 0
    left = other.agg(F.sum("n")).first()[0] or 0
    none = passages - filled
    lookup, bits = _lookup(spark, {v["h"]: float(v["id"]) for v in vocabulary if v["id"] in rare})
    known = materialize(_with_lookup(rows, lookup).select(F.array_sort(F.transform(_grams(F.col("own"), bits, vocabulary)["grams"], lambda g: g["id"])).alias("ids"), "named", "kept"), "licence-known")
    share = F.lit(CORPUS_WEIGHT / max(1, none + left))
    corpus = other.filter("not held").select("ids", F.lit(0.0).alias("label"), (F.col("n") * share).alias("weight"))
    empty = spark.createDataFrame([([], 0.0, CORPUS_WEIGHT * none * 0.9 / max(1, none + left))], "ids array<int>, label double, weight double").filter("weight > 0")
    fit_on = known.filter("not kept").groupBy("ids", "named").agg(F.count(F.lit(1)).cast("double").alias("weight")).select("ids", F.col("named").cast("double").alias("label"), "weight").union(corpus).union(empty)
    made = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(vocabulary) + 1)], inputCol="texts", outputCol="features")
    gate_rows = made.transform(fit_on.withColumn("texts", F.col("ids").cast("array<string>"))).select("features", "label", "weight").cache()
    gate = LogisticRegression(maxIter=40, regParam=1e-3, elasticNetParam=0.8, standardization=False, weightCol="weight").fit(gate_rows)
    gate_rows.unpersist()
    by_id, bias = gate.coefficients.toArray().tolist(), float(gate.intercept)
    weighted = [v for v in vocabulary if by_id[v["id"]]]
    weight = F.split(F.lit(",".join(f"{w:.6g}" if w else "0" for w in by_id)), ",").cast("array<double>")
    score = F.aggregate("ids", F.lit(bias), lambda a, i: a + F.get(weight, i))
    held = other.filter("held").select("ids", "n").union(spark.createDataFrame([([], none // 10)], "ids array<int>, n long").filter("n > 0"))
    calm = held.agg(F.percentile(score, F.lit(1 - GATE_ALARMS), F.col("n"))).first()[0]
    least_known = known.filter("named = 1").agg(F.percentile_approx(score, 0.005, 10_000)).first()[0]
    release(vectors, other, known, lookup)
    return {"calm_share": none / max(1, none + left), "weights": {v["h"]: by_id[v["id"]] for v in weighted}, "begin": _begin(weighted), "bias": bias, "open_at": min(max(0.0, calm if calm is not None else 0.0), max(0.0, least_known))}


def _scored(docs: DataFrame, id_col: str, text_col: str, gate: dict, least: float, lookup: DataFrame, bits: int) -> DataFrame:
    """doc_id, row, n_words and hits (at, score, words: the passages whose score is ``least`` at least) of each document."""
    added = F.lit(gate["bias"])

    def hits(x):
        w, heard = x["words"], F.exists(x["scores"], lambda s: s != 0)
        # a text that no weight speaks for has the same score all over
        starts = _windows(F.size(w)) if gate["bias"] >= least else F.when(heard, _windows(F.size(w))).otherwise(F.array().cast("array<int>"))
        scored = F.transform(starts, lambda at: F.struct(at.alias("at"), F.aggregate(F.slice(x["scores"], at + 1, F.lit(WINDOW)), added, lambda a, s: a + s).alias("score")))
        kept = F.transform(F.filter(scored, lambda p: p["score"] >= least), lambda p: F.struct(p["at"].alias("at"), p["score"].alias("score"), F.slice(w, p["at"] + 1, F.lit(WINDOW)).alias("words")))
        return F.struct(F.size(w).cast("long").alias("n_words"), kept.alias("hits"))

    def then(w, found):
        scores = F.transform(found, lambda s: F.coalesce(s, F.lit(0.0).cast("float")))
        return F.transform(F.array(F.struct(w.alias("words"), scores.alias("scores"))), hits)[0]

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    row = _by_word(F.col("words"), bits, gate["begin"], lambda i, a, p: a + p, then)
    return _with_lookup(texts, lookup).select("doc_id", "row", row.alias("r")).select("doc_id", "row", "r.*")


def _passages(docs: DataFrame, id_col: str, text_col: str, gate: dict, least: float) -> DataFrame:
    """The same, written: one pass over the texts; what goes on is passages over the threshold, which are few."""
    lookup, bits = _lookup(docs.sparkSession, gate["weights"])
    keyed = materialize(_scored(docs, id_col, text_col, gate, least, lookup, bits), "licence-passages")
    release(lookup)
    return keyed


def _contexts(docs: DataFrame, text_col: str) -> DataFrame:
    """Passages that labelled sentences are put into: one of each of up to CONTEXTS documents, numbered by a hash; none with half a template."""
    n = docs.select(F.lit(1)).count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(words_of(text).alias("all"), F.xxhash64(text, F.lit(6)).alias("x")).filter((F.pmod("x", F.lit(max(1, 2 * n // CONTEXTS))) == 0) & (F.size("all") > 0)).orderBy("x").limit(CONTEXTS)
    starts = _windows(F.size("all"))
    picked = picked.select(F.slice("all", F.get(starts, F.pmod(F.shiftrightunsigned("x", 20), F.size(starts)).cast("int")) + 1, F.lit(WINDOW)).alias("words"), "x")
    picked = materialize(picked.dropDuplicates(["words"]).withColumn("row", F.col("x")), "licence-contexts")
    near = _matches(picked.select("row", F.lit(0).alias("part"), _pairs("words").alias("pairs")), 0.5).select("row").distinct()
    out = materialize(picked.join(near, "row", "left_anti").select("words", F.row_number().over(Window.orderBy("x")).alias("at")), "licence-contexts")
    release(picked)
    return out


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """Both models and their thresholds, from labelled sentences and all passages of the corpus."""
    fitted, keyed = _learn(docs.withColumn("__none", F.lit(None).cast("long")), "__none", text_col)
    release(keyed)
    return fitted


def _learn(docs: DataFrame, id_col: str, text_col: str) -> tuple[dict, DataFrame]:
    """Both models and their thresholds, and the passages of the corpus over the first one."""
    spark = docs.sparkSession
    rows = spark.createDataFrame([(w, y, named, kept, i) for i, (w, y, named, kept) in enumerate(_known())], "own array<string>, label int, named int, kept boolean, i int")
    gate = _fit_gate(docs, text_col, rows)
    # passages that anything speaks for are what the second fit learns of the corpus
    keyed = _passages(docs, id_col, text_col, gate, min(gate["open_at"], gate["bias"] + 1e-3))
    plain = _contexts(docs, text_col)
    many = plain.count()
    # bare, and inside a passage of the corpus
    beside = rows.join(plain.select(F.col("words").alias("ctx"), "at"), F.pmod(F.col("i") * 7, F.lit(max(1, many))) + 1 == F.col("at"), "left")
    room = F.greatest(F.lit(0), F.lit(WINDOW) - F.size("own"))
    before = F.least(F.pmod(F.col("i"), F.lit(WINDOW)), room)
    inside = F.concat(F.slice("ctx", F.lit(1), before), F.col("own"), F.slice("ctx", before + 1, room - before))
    known = rows.select(F.col("own").alias("words"), "label", "named", "kept").union(beside.filter("ctx is not null").select(inside.alias("words"), "label", "named", "kept"))
    known = materialize(known.repartition(8, "words"), "licence-train")  # as many as there are labelled sentences, twice
    # of these, what has no half of a template, nor overlaps one that has in its document, names no licence; equal passages are one row
    opened = materialize(keyed.select("row", F.explode("hits").alias("h")).select("row", "h.*", F.xxhash64("h.words").alias("key")), "licence-opened")
    distinct = opened.groupBy(F.col("key").alias("row")).agg(F.first("words").alias("words")).select("row", F.lit(0).alias("part"), _pairs("words").alias("pairs"))
    near = _matches(distinct, 0.5).select(F.col("row").alias("key")).distinct()
    named = opened.join(near, "key").select("row", F.explode(F.transform(F.sequence(F.lit(1 - WINDOW // STRIDE), F.lit(WINDOW // STRIDE - 1)), lambda k: F.col("at") + k * STRIDE)).alias("at")).distinct()
    other = opened.join(named, ["row", "at"], "left_anti").groupBy("key").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.first("score").alias("score"))
    other = materialize(other.select("words", "n", "score", (F.pmod("key", F.lit(10)) == 0).alias("held")), "licence-unknown")
    total = other.agg(F.sum("n")).first()[0] or 0
    share = F.lit(min(1.0, CORPUS_WEIGHT / max(1, total)))
    # the passages that nothing speaks for are one row without features
    calm = spark.createDataFrame([([], 0.0, CORPUS_WEIGHT * gate["calm_share"])], "words array<string>, label double, weight double").filter("weight > 0")
    fit_on = known.filter("not kept").select("words", F.col("label").cast("double"), F.lit(1.0).alias("weight")).union(other.filter("not held").select("words", F.lit(0.0), F.col("n") * share)).union(calm)
    family_rows = _features(fit_on, FAMILY_BUCKETS, REACH).select("features", "label", "weight").cache()
    family = LogisticRegression(maxIter=40, regParam=1e-4, elasticNetParam=0.5, family="multinomial", standardization=False, weightCol="weight").fit(family_rows)
    family_rows.unpersist()
    # a row per hundredth: grants whose own family, and denials and passages of the corpus of which any, gets there
    own = F.when(F.col("label") > 0, F.get("p", F.col("label"))).otherwise(F.array_max("p"))
    judged = known.filter("kept and named = 1").select("words", "label", F.lit(1).cast("long").alias("n")).union(other.filter(F.col("held") & (F.col("score") >= gate["open_at"])).select("words", F.lit(-1), "n"))
    of = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0))
    steps = _odds(judged, family).groupBy(F.floor(own * 100).cast("int").alias("at")).agg(of(F.col("label") > 0).alias("grants"), of(F.col("label") == 0).alias("denials"), of(F.col("label") < 0).alias("others")).collect()
    release(plain, known, opened, other)
    return {**gate, "family": family, "least": _parting({r["at"]: (r["grants"], r["denials"], r["others"]) for r in steps})}, keyed


def _odds(rows: DataFrame, family) -> DataFrame:
    """Adds p: of each family the odds against unknown alone, as two licences side by side share a passage's probability.

    The model's result is written first: what is asked of it later would else be pushed into it and run it again and again."""
    told = materialize(family.transform(_features(rows, FAMILY_BUCKETS, REACH)).select(*rows.columns, vector_to_array("probability").alias("__p")), "licence-odds")
    each = F.transform(F.sequence(F.lit(0), F.lit(len(FAMILIES) - 1)), lambda i: F.when(i > 0, F.get("__p", i) / (F.get("__p", i) + F.get("__p", F.lit(0)))).otherwise(0.0))
    return told.withColumn("p", each).drop("__p")


def _parting(steps: dict[int, tuple[int, int, int]]) -> float:
    """The threshold, in hundredths, at which the shares of grants below and of denials and of other passages above are least in sum; of several the middle one."""
    everything = [max(1, sum(s[i] for s in steps.values())) for i in range(3)]
    missed = lambda at: sum(sum(s[i] for k, s in steps.items() if (k >= at) == (i > 0)) / everything[i] for i in range(3))
    cost = {at: round(missed(at), 9) for at in range(1, 100)}
    fine = [at for at in cost if cost[at] == min(cost.values())]
    return fine[len(fine) // 2] / 100


def _pairs(words: str) -> Column:
    return F.expr(f"array_distinct(transform(sequence(1, greatest(1, size({words}) - 1)), i -> concat_ws(' ', slice({words}, i, 2))))")


def _matches(rows: DataFrame, share: float) -> DataFrame:
    """Of rows (row, part, pairs) the templates (f: family, g: pairs, size) of which that share of pairs is there, n of them."""
    temps = [(FAMILIES.index(f), list(p), len(p)) for f, p in templates()]
    temps = F.broadcast(rows.sparkSession.createDataFrame(temps, "f int, g array<string>, size int").withColumn("pair", F.explode("g")))  # fixed, some thousand rows
    shared = rows.select(*[c for c in ("row", "part", "named") if c in rows.columns], F.explode("pairs").alias("pair")).join(temps, "pair")
    if "named" in rows.columns:
        shared = shared.filter(F.array_contains("named", F.col("f")))
    return shared.groupBy("row", "part", "f", "g", "size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= share * F.col("size"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: dict | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_licensed (passages that name a licence, overlapping
    ones joined), families (sorted, joined by commas), first_word (number of the first word of the
    first such passage, from 0), probability and similarity (greatest).

    Null and empty texts have no words. Documents without a confirmed passage have n_licensed 0,
    families '' and nulls. Long texts are scored whole. Of templates that match alike the one of
    more pairs, then the likelier, then the first family wins. Rows that repeat an id and text
    get the same row each; null ids are kept. An empty table gives no rows. Columns other than the
    two named are not read.
    """
    fitted, keyed = (fitted, _passages(docs, id_col, text_col, fitted, fitted["open_at"])) if fitted else _learn(docs, id_col, text_col)
    passages = keyed.select("row", F.explode("hits").alias("h")).filter(F.col("h.score") >= fitted["open_at"]).select("row", "h.at", "h.words")
    scored = _odds(passages, fitted["family"]).filter(F.array_max("p") >= fitted["least"])
    by_place = Window.partitionBy("row").orderBy("at")
    scored = scored.withColumn("fresh", (F.col("at") - F.lag("at", 1, -10 * WINDOW).over(by_place) > WINDOW).cast("int"))
    scored = scored.withColumn("part", F.sum("fresh").over(by_place))
    odds = [F.max(F.col("p")[i]).alias(f"p{i}") for i in range(len(FAMILIES))]
    joined = scored.groupBy("row", "part").agg(F.min("at").alias("at"), F.flatten(F.collect_list(_pairs("words"))).alias("pairs"), *odds)
    joined = joined.withColumn("pairs", F.array_distinct("pairs")).withColumn("p", F.array(*[F.col(f"p{i}") for i in range(len(FAMILIES))]))
    # the classifier names families, and templates of these alone can confirm them
    joined = joined.withColumn("named", F.filter(F.sequence(F.lit(1), F.lit(len(FAMILIES) - 1)), lambda i: F.get("p", i) >= fitted["least"]))
    shared = _matches(joined, CONFIRM).join(joined.select("row", "part", "at", "p"), ["row", "part"]).withColumn("likely", F.col("p")[F.col("f")])
    best = F.struct((-F.col("n") / F.col("size")).alias("order"), (-F.col("size")).alias("less"), (-F.col("likely")).alias("rare"), "f", "g")
    ranked = shared.groupBy("row", "part", "at").agg(F.sort_array(F.collect_list(best)).alias("found"))

    def take(state, x):
        left = F.array_except(x["g"], state["gone"])
        fits = (F.size(left) >= F.lit(CONFIRM) * F.size(x["g"])) & (x["f"] > 0)
        new = F.struct(F.array_union(state["gone"], x["g"]).alias("gone"), F.array_union(state["fs"], F.array(x["f"])).alias("fs"))
        return F.when(fits, new).otherwise(state)

    start = F.struct(F.array().cast("array<string>").alias("gone"), F.array().cast("array<int>").alias("fs"))
    # a pair goes with the first template that has it, unless its family is the same
    named = ranked.select("row", "at", F.aggregate("found", start, take, lambda s: s["fs"]).alias("fs"), (-F.col("found")[0]["order"]).alias("similarity"), F.array_max(F.transform("found", lambda x: -x["rare"])).alias("probability"))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    per_doc = named.groupBy("row").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fs")))).alias("fs"), F.min("at").alias("first"), F.max("probability").alias("probability"), F.max("similarity").alias("similarity"),
    )
    return keyed.select("doc_id", "row", "n_words").join(per_doc, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_licensed"),
        F.array_join(F.transform(F.coalesce("fs", F.array().cast("array<int>")), lambda f: F.get(names, f)), ",").alias("families"), F.col("first").cast("long").alias("first_word"), "probability", "similarity",
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
