"""Cross-tokenizer alignment (operator 12).

Two vocabularies cut a text into tokens. Tokens of either side whose byte ranges overlap are the
edges of a bipartite graph; its connected components, found by union-find, are exactly the
minimal groups that both sides cut in the same places, and each component expands into the links
between its members. Counts of linked id pairs over documents are then taken by Spark.

No token of either side crosses the border before a blank that follows a sign other than white
space, so texts are cut there and each distinct segment is aligned once per worker cache. Links
travel as blocks of documents: a block holds its distinct id pairs once, and its documents point
at them, so the pairs of a block, not those of each document, are shuffled and counted.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, table
from .packing import byte_alphabet
from .pretok import SPACE, Ragged, WordCache, classes, split, worker_cache

BLOCK_CHARS = 1 << 20
CACHED_SEGMENTS = 300_000


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def segments(code: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Starts of the segments: documents' starts, and blanks after a sign that is no white space."""
    start = np.zeros(len(code), bool)
    if len(code):
        start[1:] = (code[1:] == 0x20) & (classes()[code[:-1]] != SPACE)
        start[doc_start] = True
    return np.flatnonzero(start)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of ``n`` nodes under the edges (a, b): union-find on
    arrays, in rounds that hook greater roots under lesser ones and then halve all paths."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def first_byte_edges(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens of two sides that cover the same bytes, such that one's first byte lies in the
    other. These are all overlaps, as an overlap starts with the later of its two first bytes."""
    a_start, b_start = np.r_[0, a_end[:-1]], np.r_[0, b_end[:-1]]
    in_b, in_a = np.searchsorted(b_end, a_start, "right"), np.searchsorted(a_end, b_start, "right")
    return np.r_[np.arange(len(a_end)), in_a], np.r_[in_b, np.arange(len(b_end))]


def align(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A of each link, B of each link) of two
    sequences of byte ends over the same bytes; groups are numbered from 0 in order."""
    na, nb = len(a_end), len(b_end)
    if not na:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    x, y = first_byte_edges(a_end, b_end)
    root = components(na + nb, x, y + na)
    group = np.unique(root, return_inverse=True)[1]
    # members of a component expand its links: those of its edges, each once
    link = np.unique(x * np.int64(nb) + y)
    return group[:na], group[na:], link // nb, link % nb


class Aligner:
    """Tokens, groups and links of segments, which start with a blank."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {v: k for k, v in byte_alphabet().items()}
        names = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.blank = self.b.encode("a ")[len(self.b.encode("a")) :]
        self.a_bytes = [b""] * (names[-1][1] + 1)
        for name, i in names:
            self.a_bytes[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        for piece in self.b_bytes:
            if b" " in piece.lstrip(b" "):
                raise ValueError("a piece holds a blank after another sign: texts cannot be cut before blanks")
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))

    def encode(self, words: list[str]) -> tuple[list, list]:
        """Ids of either side; none where the bytes of a side are not the segment's."""
        a = [x.ids for x in self.a.encode_batch(words, add_special_tokens=False)]
        b = self.b.encode([w[1:] for w in words], num_threads=1)
        for i, w in enumerate(words):
            if len(w) == 1:  # the last blank of a text, which the library would not add before nothing
                b[i] = self.blank
            whole = w.encode()
            if b"".join([self.a_bytes[t] for t in a[i]]) != whole or b"".join([self.b_bytes[t] for t in b[i]]) != whole:
                a[i], b[i] = None, None
        return a, b

    def learn(self, words: list[str]) -> tuple[list, list, list, list]:
        """Of each segment: (tokens of A, of B, groups, links), whether it has tokens, the groups' text, the links' id pairs."""
        a, b = self.encode(words)
        fine = [x is not None for x in a]
        a, b = ([x or [] for x in side] for side in (a, b))
        na, nb = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b))
        ida, idb = (np.fromiter((t for x in side for t in x), np.int64, int(n.sum())) for side, n in ((a, na), (b, nb)))
        ga, gb, la, lb = align(np.cumsum(self.a_size[ida]), np.cumsum(self.b_size[idb]))
        seg_a, seg_b = np.repeat(np.arange(len(words)), na), np.repeat(np.arange(len(words)), nb)
        # groups in order, of each the A tokens, then the B tokens; the last of a side is followed by | or ;
        group = np.r_[ga, gb]
        order = np.argsort(group * 2 + (np.arange(len(group)) >= len(ga)), kind="stable")
        side = order >= len(ga)
        last = np.ones(len(order), bool)
        if len(order):
            last[:-1] = (group[order][1:] != group[order][:-1]) | (side[1:] != side[:-1])
        ids, seg = np.r_[ida, idb][order], np.r_[seg_a, seg_b][order]
        name = [(self.b_name if s else self.a_name)[t] + ("," if not e else ";" if s else "|") for t, s, e in zip(ids.tolist(), side.tolist(), last.tolist(), strict=True)]
        ends = np.searchsorted(seg, np.arange(len(words)), "right").tolist()
        texts, at = [], 0
        for e in ends:
            texts.append("".join(name[at:e])[:-1].encode())
            at = e
        first = np.r_[True, ga[1:] != ga[:-1]] if len(ga) else np.zeros(0, bool)
        n_groups = np.bincount(seg_a[first], minlength=len(words))
        seg_l = seg_a[la]
        n_links = np.bincount(seg_l, minlength=len(words))
        pair = (ida[la] << 32) | idb[lb]
        cuts = np.r_[0, np.cumsum(n_links)]
        return np.c_[na, nb, n_groups, n_links].tolist(), fine, texts, [pair[cuts[i] : cuts[i + 1]] for i in range(len(words))]


def _cache(a_path: str, b_path: str) -> tuple[WordCache, dict]:
    def make():
        aligner, held = Aligner(a_path, b_path), {}

        def reset():
            held["counts"], held["pairs"], held["fine"], held["texts"] = Ragged(np.int64), Ragged(np.int64), Ragged(np.uint8), []

            def learn(words):
                counts, fine, texts, pairs = aligner.learn(words)
                held["counts"].add(counts), held["pairs"].add(pairs), held["fine"].add([[x] for x in fine])
                held["texts"].extend(texts)

            return learn

        return WordCache(reset, CACHED_SEGMENTS), held

    return worker_cache(("alignment", a_path, b_path), make)


_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("size", pa.int32())])
_BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.list_(_DOC)), ("pair", pa.list_(pa.int64())), ("df", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])


def _chunk(p, cache, held, ids: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the documents of ``p``, and (document, id pair, times) of their links, sorted."""
    n = len(p.doc_piece) - 1
    slots = cache.slots(p)
    fine = held["fine"].data[slots].astype(bool)  # a row of one each
    doc = np.repeat(np.arange(n), np.diff(p.doc_piece))
    good = np.bincount(doc[~fine], minlength=n) == 0
    good &= np.bincount(doc, p.length, n) > 1  # an empty text is the one blank before it
    counts = held["counts"].data[: 4 * held["counts"].n].reshape(-1, 4)[slots]
    total = np.zeros((n, 4), np.int64)
    np.add.at(total, doc, counts)
    total[~good] = 0
    texts, cut, flat = held["texts"], p.doc_piece.tolist(), slots.tolist()
    sha = [hashlib.sha256(b";".join([texts[s] for s in flat[cut[i] : cut[i + 1]]])).hexdigest() if good[i] else "" for i in range(n)]
    kept = good[doc]
    pair, ends = held["pairs"].gather(slots[kept])
    owner = np.repeat(doc[kept], np.diff(ends))
    order = np.lexsort((pair, owner))
    pair, owner = pair[order], owner[order]
    new = np.r_[True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])] if len(pair) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(pair)])
    size = np.bincount(owner[at], minlength=n)
    rows = [{"doc_id": i, "n_a": t[0], "n_b": t[1], "n_groups": t[2], "n_links": t[3], "groups_sha256": h, "size": s} for i, t, h, s in zip(ids, total.tolist(), sha, size.tolist(), strict=True)]
    return rows, pair[at], times


def _align(a_path: str, b_path: str):
    def run(batches):
        from pyspark import TaskContext

        cache, held = _cache(a_path, b_path)
        number, rows, pairs, times, chars = TaskContext.get().partitionId() << 32, [], [], [], 0

        def block():
            nonlocal number, rows, pairs, times, chars
            pair, at, df = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            out = {"block": number, "docs": rows, "pair": pair, "df": df, "at": at, "times": np.concatenate(times)}
            number, rows, pairs, times, chars = number + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out.values(), _BLOCK, strict=True)], schema=_BLOCK)

        for b in batches:
            ids = b.column(0).to_pylist()
            spaced = pc.binary_join_element_wise(pa.scalar(""), pc.fill_null(b.column(1), ""), " ")
            for p in split(spaced, segments):
                n = len(p.doc_piece) - 1
                r, x, t = _chunk(p, cache, held, ids[p.first : p.first + n])
                rows += r
                pairs.append(x), times.append(t)
                chars += len(p.code)
                if chars >= BLOCK_CHARS:
                    yield block()
        if rows:
            yield block()

    return run


def _score(batches):
    """Sums over a document's links of what its block's pairs were found to count."""
    for b in batches:
        out: dict = {k: [] for k in _OUT.names}
        for r in range(b.num_rows):
            docs = b.column("docs")[r].values
            at, times = (b.column(c)[r].values.to_numpy() for c in ("at", "times"))
            pair = b.column("pair")[r].values.to_numpy()
            known = b.column("found")[r].values
            found, count, best = (known.field(i).to_numpy(zero_copy_only=False) for i in range(3)) if known is not None else (pair, pair, pair)
            order = np.argsort(found)
            if not np.array_equal(found[order], pair):
                raise ValueError("the counts of a block's pairs are not all there")
            times = times.astype(np.int64)
            # zero-length documents would share a place with the next, so sums are taken from the front
            so_far = lambda x: np.r_[0, np.cumsum(x, dtype=np.int64)]
            ends = so_far(docs.field("size").to_numpy())
            for name, x in (("n_best", times * best[order][at]), ("count_sum", times * count[order][at])):
                out[name].append(np.diff(so_far(x)[ends]))
            for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
                out[name].append(docs.field(name))
        cols = [pa.concat_arrays([pa.array(x, f.type) if isinstance(x, np.ndarray) else x for x in out[f.name]]) if out[f.name] else pa.array([], f.type) for f in _OUT]
        yield pa.RecordBatch.from_arrays(cols, schema=_OUT)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that a side does not give back byte for byte, have no tokens: zeros and ''.
    Every row gives a row and counts as a document of its own, rows that repeat an id and rows with a
    null id too. Pairs whose counts tie for their A id's highest are all best. A text is cut and aligned
    in pieces, but its links are held by one task, so memory grows with the longest text. An
    empty table gives no rows. The paths are of vocabulary files that each machine has. Other columns are not read.
    """
    default = default_vocabularies()
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    ddl = "block long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,size:int>>, pair array<long>, df array<int>, at array<int>, times array<int>"
    blocks = materialize(read.mapInArrow(_align(a_path or default[0], b_path or default[1]), ddl), "align-blocks")
    held = blocks.select("block", F.explode(F.arrays_zip("pair", "df")).alias("x")).select("block", F.col("x.pair").alias("pair"), F.col("x.df").alias("df"))
    counts = materialize(held.groupBy("pair").agg(F.sum("df").alias("count")).withColumn("a", F.shiftright("pair", 32)), "align-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    known = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    found = held.select("block", "pair").join(known, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("found"))
    whole = blocks.select("block", "docs", "pair", "at", "times").join(found, "block", "left").select("docs", "pair", "at", "times", "found")
    return whole.mapInArrow(_score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
