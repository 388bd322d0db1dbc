"""Fuzzy title resolution: token-set similarity, lossless pruning and three-way decision."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

FLOOR, AUTO, MARGIN = 60.0, 90.0, 15.0


def lcs_length(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence, row by row in nested aggregates."""
    n = F.length(y)
    zero = F.array_repeat(F.lit(0), n + 1)

    def row(prev, c):
        cell = lambda r, j: F.array_append(r, F.when(F.substring(y, j, F.lit(1)) == c, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.get(r, j - 1))))
        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), cell)

    rows = F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), zero, row)
    return F.when((n == 0) | (F.length(x) == 0), F.lit(0)).otherwise(F.get(rows, n))


def tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: similarity of two titles as sets of words (case and punctuation count)."""
    ta, tb = tokens(a), tokens(b)
    both = F.array_intersect(ta, tb)
    ab, ba = F.array_join(F.array_except(ta, tb), " "), F.array_join(F.array_except(tb, ta), " ")
    sect = F.length(F.array_join(both, " "))
    la, lb = F.length(ab), F.length(ba)
    gap = F.when(sect > 0, 1).otherwise(0)
    norm = lambda d, total: F.when(total > 0, F.lit(100.0) - F.lit(100.0) * d / total).otherwise(F.lit(100.0))
    diff = norm(la + lb - 2 * lcs_length(ab, ba), (sect + gap + la) + (sect + gap + lb))
    one, two = norm(1 + la, sect + sect + gap + la), norm(1 + lb, sect + sect + gap + lb)
    full = F.when(sect > 0, F.greatest(diff, one, two)).otherwise(diff)
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)).when((sect > 0) & ((la == 0) | (lb == 0)), F.lit(100.0)).otherwise(full)


#: Letters are counted in so many groups for the bound on common subsequences.
LETTER_GROUPS = 32


def _sides(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-empty titles with their tokens, joined length and letter counts."""
    t = df.select(col).distinct().withColumn("t", tokens(F.col(col))).filter(F.size("t") > 0)
    whole = F.array_join("t", " ")
    groups = F.transform(F.split(whole, ""), lambda c: F.pmod(F.ascii(c), F.lit(LETTER_GROUPS)))
    counts = F.transform(F.array(groups), lambda g: F.transform(F.sequence(F.lit(0), F.lit(LETTER_GROUPS - 1)), lambda i: F.size(F.filter(g, lambda x: x == i))))[0]
    return t.select(col, "t", F.length(whole).alias("len"), counts.alias("letters"))


def _rare_words(side: DataFrame, col: str, df: DataFrame) -> DataFrame:
    """The rarest words of each title that make up more than 4/7 of it (a word weighs its length + 1).

    A title of which shared words are 3/7 or more shares one of these."""
    w = Window.partitionBy(col).orderBy("df", "w").rowsBetween(Window.unboundedPreceding, -1)
    words = side.select(col, F.explode("t").alias("w")).join(df, "w").withColumn("weight", F.length("w") + 1)
    before = F.coalesce(F.sum("weight").over(w), F.lit(0))
    whole = F.sum("weight").over(Window.partitionBy(col))
    return words.withColumn("before", before).withColumn("whole", whole).filter(F.col("before") * 7 <= F.col("whole") * 4).select(col, "w")


def candidate_pairs(titles: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (title, name) pairs that can score FLOOR; none that does is left out.

    Of the three ratios behind the score, two need shared words to be at least 3/7 of one side:
    those pairs meet on that side's rarest words, so common words join nothing by themselves. The
    third needs a common subsequence of 0.3 times both lengths: those pairs meet on lengths that
    allow it and must have as many letters in common, which the join checks row by row."""
    a, b = _sides(titles, "title"), _sides(names, "name")
    by_word = _word_pairs(a, b)
    reach = a.select("title", "len", "letters", F.explode(F.sequence(F.ceil(F.col("len") * 3 / 7).cast("int"), F.floor(F.col("len") * 7 / 3).cast("int"))).alias("size"))
    common = F.aggregate(F.zip_with("letters", "others", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    by_length = reach.join(b.select("name", F.col("len").alias("size"), F.col("letters").alias("others")), "size").filter(common * 10 >= (F.col("len") + F.col("size")) * 3).select("title", "name")
    return by_word.union(by_length).distinct()


def _word_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(title, name) that meet on the rarest words of one of them."""
    seen = a.select(F.explode("t").alias("w")).unionAll(b.select(F.explode("t").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    words = lambda s, c: s.select(c, F.explode("t").alias("w"))
    return _rare_words(a, "title", seen).join(words(b, "name"), "w").select("title", "name").union(words(a, "title").join(_rare_words(b, "name", seen), "w").select("title", "name"))


def similarity(x: list[str], y: list[str]) -> float:
    """:func:`token_set_ratio` of two sorted lists of distinct words."""
    if not x or not y:
        return 0.0
    both = set(x) & set(y)
    ab, ba, sect = " ".join(t for t in x if t not in both), " ".join(t for t in y if t not in both), len(" ".join(t for t in x if t in both))
    la, lb, gap = len(ab), len(ba), int(bool(both))
    if both and (not la or not lb):
        return 100.0
    norm = lambda d, total: 100.0 - 100.0 * d / total if total > 0 else 100.0
    diff = norm(la + lb - 2 * common_length(ab, ba), sect + gap + la + sect + gap + lb)
    return max(diff, norm(1 + la, sect + sect + gap + la), norm(1 + lb, sect + sect + gap + lb)) if both else diff


def common_length(x: str, y: str) -> int:
    """Length of the longest common subsequence: a bit for each sign of ``x``, cleared where one more is matched."""
    at: dict = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    v = whole = (1 << len(x)) - 1
    for c in y:
        hit = v & at.get(c, 0)
        v = ((v + hit) | (v - hit)) & whole
    return len(x) - v.bit_count()


#: Names of a leaf, whose letter counts have a box; letters and pairs of letters are counted in so many groups.
LEAF, GROUPS, PAIRS = 64, 64, 128


class Names:
    """Names of a task under a tree of letter counts, searched for the two best candidates of a title.

    A node holds the greatest count of each letter and the least length below it, so twice the letters in common over
    both lengths bounds the ratio of all its names. Leaves are visited by their bound, ever more at once, as long as it reaches
    what the title's second candidate has; only names whose own bounds do are compared. The second bound counts
    neighbouring letters: m common letters of T in all leave T - 2m apart, so at least 3m - T - 1 neighbours stay so."""

    def __init__(self, words: list[list[str]], owners: list[list[int]]):
        self.owners, self.compared = owners, 0
        text = [" ".join(w) for w in words]
        length, counts = np.array([len(t) for t in text]), np.array([letter_counts(t) for t in text], np.int16).reshape(-1, GROUPS)
        # halves along the letter that differs most, down to leaves
        order, todo, self.nodes = [], [(np.arange(len(text)), -1)], []
        while todo:
            rows, parent = todo.pop()
            node = len(self.nodes)
            self.nodes.append([counts[rows].max(axis=0), int(length[rows].min()), [], None])
            if parent >= 0:
                self.nodes[parent][2].append(node)
            spread = counts[rows].max(axis=0) - counts[rows].min(axis=0)
            by_length = length[rows].max() - length[rows].min() > spread.max()
            if len(rows) <= LEAF or not (by_length or spread.max()):
                self.nodes[node][3] = (len(order), len(order) + len(rows))
                order += rows.tolist()
                continue
            value = length[rows] if by_length else counts[rows, spread.argmax()]
            rows = rows[np.argsort(value, kind="stable")]
            todo += [(rows[: len(rows) // 2], node), (rows[len(rows) // 2 :], node)]
        self.words, self.owners = [words[i] for i in order], [owners[i] for i in order]
        self.length, self.counts = length[order], counts[order]
        self.box, self.short = np.array([n[0] for n in self.nodes]), np.array([n[1] for n in self.nodes])
        self.pairs = np.array([pair_counts(w) for w in self.words], np.int16).reshape(-1, PAIRS)
        self.holds: dict = {}
        for i, w in enumerate(self.words):
            for t in w:
                self.holds.setdefault(t, []).append(i)
        self.masks: dict = {}
        for i, w in enumerate(self.words):
            for j, c in enumerate(" ".join(w)[:64]):
                if c not in self.masks:
                    self.masks[c] = np.zeros(len(self.words), np.uint64)
                self.masks[c][i] |= np.uint64(1 << j)
        self.none = np.zeros(len(self.words), np.uint64)

    def best(self, words: list[str], floor: float) -> list[tuple[float, int]]:
        """(score, candidate) of the two best ones of ``floor`` or more; ties go to the lesser candidate."""
        text = " ".join(words)
        counts, n = letter_counts(text), len(text)
        bounds = 200.0 * np.minimum(counts, self.box).sum(axis=1) / (n + self.short)
        top, edge = {}, floor
        shares, pairs = {i for t in words for i in self.holds.get(t, ())}, pair_counts(words)
        leaves, todo = [], [0]
        while todo:
            node = todo.pop()
            if bounds[node] >= edge - 1e-9:
                _, _, kids, rows = self.nodes[node]
                todo += kids
                if rows is not None:
                    leaves.append((bounds[node], rows))
        leaves.sort(key=lambda x: -x[0])
        done, many = 0, 1
        while done < len(leaves) and leaves[done][0] >= edge - 1e-9:
            at = np.concatenate([np.arange(*rows) for bound, rows in leaves[done : done + many] if bound >= edge - 1e-9])
            done, many = done + many, 2 * many
            at = at[200.0 * np.minimum(counts, self.counts[at]).sum(axis=1) / (n + self.length[at]) >= edge - 1e-9]
            total = n + self.length[at]
            at = at[200.0 * (np.minimum(pairs, self.pairs[at]).sum(axis=1) + 1 + total) >= 3 * total * (edge - 1e-9)]
            for i, score in self._scores(words, text, at, shares, edge):
                for c in self.owners[i]:
                    top[c] = max(score, top.get(c, 0.0))
                two = sorted(top.items(), key=lambda x: (-x[1], x[0]))[:2]
                top = dict(two)
                edge = max(floor, two[1][1] if len(two) == 2 else 0.0, two[0][1] - MARGIN if two[0][1] >= AUTO else 0.0)
        return sorted(((s, c) for c, s in top.items()), key=lambda x: (-x[0], x[1]))

    def _scores(self, words: list[str], text: str, at: np.ndarray, shares: set, edge: float) -> list[tuple[int, float]]:
        """Scores of ``edge`` or more: of names that share no word, and fit in a machine word, all at once."""
        self.compared += len(at)
        plain = np.array([i not in shares for i in at.tolist()], bool) & (self.length[at] <= 64)
        out = [(i, score) for i in at[~plain].tolist() if (score := similarity(words, self.words[i])) >= edge]
        at = at[plain]
        if len(at):
            v = np.full(len(at), np.uint64(0xFFFFFFFFFFFFFFFF))
            for c in text:
                m = self.masks.get(c, self.none)[at]
                hit = v & m
                v = (v + hit) | (v - hit)
            size = self.length[at]
            whole = np.where(size == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(size, 63).astype(np.uint64)) - np.uint64(1))
            lcs = size - np.bitwise_count(v & whole)
            total = len(text) + size
            score = 100.0 - 100.0 * (total - 2 * lcs) / total
            out += zip(at[score >= edge].tolist(), score[score >= edge].tolist(), strict=True)
        return out


def letter_counts(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % GROUPS, minlength=GROUPS)


def pair_counts(words: list[str]) -> np.ndarray:
    """Of neighbouring letters in the words, each with a blank on either side (so any order of the words has no others)."""
    code = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32)
    pair = code[:-1] * np.uint32(31) + code[1:]
    return np.bincount(pair[(code[:-1] != 32) | (code[1:] != 32)] % PAIRS, minlength=PAIRS)


def _scored(pairs: DataFrame) -> DataFrame:
    """(title, name, score) of pairs that reach FLOOR."""

    def run(batches):
        split = lambda s: sorted(set(re.split(r"[ \t\n\x0b\f\r]+", s)) - {""})  # noqa: E731  the words of tokens()
        for b in batches:
            x, y = b.column(0).to_pylist(), b.column(1).to_pylist()
            score = np.array([similarity(split(p), split(q)) for p, q in zip(x, y, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=["title", "name", "score"])

    return pairs.select("title", "name").mapInArrow(run, "title string, name string, score double").filter(F.col("score") >= FLOOR)


#: Names and titles of one task of the search.
NAMES, TITLES = 8192, 2048


def _searched(a: DataFrame, b: DataFrame, floors: DataFrame) -> DataFrame:
    """(title, cid, score, compared) of the two best candidates that letters in common let through.

    ``a`` has (title, t, len), ``b`` (name, t, len, cids), ``floors`` (title, floor). Names lie in ranges of length;
    a title goes to the ranges whose lengths allow FLOOR, and a range with many titles is searched by several tasks."""
    spark = a.sparkSession
    n = b.count()
    dealt = b.repartitionByRange(max(1, -(-n // NAMES)), "len", "name").withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "names")
    lengths = dealt.groupBy("range", "len").agg(F.count(F.lit(1)).alias("held"))
    reach = a.join(floors, "title").select("title", "t", "floor", "len", F.explode(F.sequence(F.ceil(F.col("len") * 3 / 7).cast("int"), F.floor(F.col("len") * 7 / 3).cast("int"))).alias("size"))
    fits = F.col("floor") <= 200.0 * F.least("len", "size") / (F.col("len") + F.col("size")) + 1e-9
    goes = materialize(reach.filter(fits).join(lengths.select("range", F.col("len").alias("size")), "size").select("title", "t", "floor", "range").distinct(), "goes")
    parts = goes.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / TITLES).cast("int").alias("parts"))
    left = dealt.join(parts, "range").select("range", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "t", "cids")
    right = goes.join(parts, "range").select("range", F.pmod(F.xxhash64("title"), F.col("parts")).cast("int").alias("part"), "title", "t", "floor")

    def meet(key, names, titles):
        out: dict = {"title": [], "cid": [], "score": [], "compared": []}
        if names.num_rows and titles.num_rows:
            held = Names(names["t"].to_pylist(), names["cids"].to_pylist())
            for title, words, floor in zip(titles["title"].to_pylist(), titles["t"].to_pylist(), titles["floor"].to_pylist(), strict=True):
                held.compared = 0
                found = held.best(words, floor)
                for score, cid in found or [(None, None)]:
                    out["title"].append(title), out["cid"].append(cid), out["score"].append(score), out["compared"].append(held.compared)
                    held.compared = 0
        return pa.table([pa.array(out["title"], pa.string()), pa.array(out["cid"], kind), pa.array(out["score"], pa.float64()), pa.array(out["compared"], pa.int64())], names=list(out))

    kind = pa.from_numpy_dtype(np.int64)
    return left.groupBy("range", "part").cogroup(right.groupBy("range", "part")).applyInArrow(meet, "title string, cid long, score double, compared long")


def _each(df: DataFrame, col: str) -> DataFrame:
    """One row per title or name where ``col`` is an array of them; nulls and empty ones are left out."""
    many = df.schema[col].dataType.typeName() == "array"
    return (df.withColumn(col, F.explode(col)) if many else df).filter(F.col(col) != "").distinct()


def resolve(probes: DataFrame, catalog: DataFrame) -> DataFrame:
    """probes (id, title) against catalog (cid, name): id, decision, best (cid) and best_score.

    ``title`` and ``name`` are strings, or arrays of all the titles of a probe and all the names of a
    candidate: a candidate's score is the best over all pairs, and candidates of equal names stay
    apart. Rows that share a cid are one candidate, and rows that share an
    id one probe. Scores under FLOOR change no decision and are not
    reported."""
    titles, names = _each(probes.select("id", "title"), "title"), _each(catalog.select("cid", "name"), "name")
    titles, names = materialize(titles, "titles"), materialize(names.filter("cid is not null").select(F.col("cid").cast("long").alias("cid"), "name"), "names")
    a, b = materialize(_sides(titles, "title"), "sides"), materialize(_sides(names, "name"), "sides")
    # the two least cids of a name: no third one can be best or runner-up
    two = names.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("cid"))).filter("nth <= 2").groupBy("name").agg(F.array_sort(F.collect_list("cid")).alias("cids"))
    by_word = materialize(_scored(_word_pairs(a, b).distinct()).join(two, "name").select("title", F.explode("cids").alias("cid"), "score"), "by-word")
    known = _best_two(titles, by_word)
    floor = F.greatest(F.lit(FLOOR), F.coalesce("second", F.lit(0.0)), F.when(F.col("score") >= AUTO, F.col("score") - MARGIN).otherwise(0.0))
    floors = titles.join(known, "id", "left").groupBy("title").agg(F.min(F.coalesce(floor, F.lit(FLOOR))).alias("floor"))
    searched = _searched(a, b.join(two, "name"), floors).filter("score is not null").select("title", "cid", "score")
    top = _best_two(titles, by_word.unionByName(searched)).withColumnRenamed("id", "k")
    out = probes.select("id").join(top, F.col("id").eqNullSafe(F.col("k")), "left")
    sure = (F.col("score") >= AUTO) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= MARGIN))
    decision = F.when(F.col("score").isNull(), "no_candidates").when(sure, "auto").otherwise("ambiguous")
    return out.select("id", decision.alias("decision"), F.col("cid").alias("best"), F.round("score", 6).alias("best_score"))


def _best_two(titles: DataFrame, scored: DataFrame) -> DataFrame:
    """(id, cid, score, second) from (id, title) and (title, cid, score)."""
    ranked = titles.join(scored, "title").groupBy("id", "cid").agg(F.max("score").alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "cid")
    ranked = ranked.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    return ranked.groupBy("id").agg(F.max(F.when(F.col("rn") == 1, F.col("cid"))).alias("cid"), F.max("score").alias("score"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"))
