"""Lexical retrieval packing (operator 8).

Each task tokenises its documents as they stream by and gathers them in shards of a bounded
number of tokens. A shard has a BM25 inverted index over its words. Sequences are filled
greedily: the rest of the last document seeds the next window, and the index returns the
unused documents most like the seed until the window is full; what does not fit is cut and
goes on. No window spans shards, so no shuffle is needed and a lost task is simply run
again. What a shard has left at its end is cut into sequences whose lengths are powers of
two, which need no padding.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .pretok import Ragged, WordCache, split, trim, worker_cache

SEQ_LEN = 2048
END_ID = 1
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
CACHED_WORDS = 500_000
DENSE = 8  # a word of more than one document in so many
RANKED = 64  # documents put in order at once; more when these are used


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: printable ones for themselves,
    the others numbered on from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def _cache(path: str) -> tuple[WordCache, dict]:
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model, held, byte = Tokenizer.from_file(path).model, {}, byte_alphabet()

        def reset():
            held["ids"] = Ragged(np.uint32)

            def learn(words):
                # the pieces are cut already, so the merges alone are needed, over the byte alphabet
                held["ids"].add([[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(byte))] for w in words])

            return learn

        return WordCache(reset, CACHED_WORDS), held

    return worker_cache(("packing", path), make)


class Bm25:
    """Inverted index of one shard; documents leave it as they are used."""

    def __init__(self, words: list[np.ndarray]):
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        term = np.concatenate(words) if n else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(n), lens)
        # terms are hashes of any size: only their numbers in the shard leave room for the document
        number = np.unique(term, return_inverse=True)[1] if n else term
        # the words of white space and signs are in most documents, and weigh next to nothing
        key, tf = np.unique(number * n + doc, return_counts=True) if n else (term, term)
        term, doc = key // max(n, 1), key % max(n, 1)
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        df = np.diff(np.r_[first, len(term)])
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lens / max(1.0, lens.mean() if n else 1.0))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[doc])
        self.doc, self.ends = doc, np.r_[first, len(term)]
        # words of many documents as dense rows, which hold at most DENSE times their postings
        dense = df * DENSE > n
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        number = np.repeat(np.arange(len(df)), df)
        self.rows = np.zeros((int(dense.sum()), n), np.float32)
        common = dense[number]
        self.rows[self.row[number[common]], doc[common]] = self.weight[common]
        useful = df[number] > 1  # a word of one document finds no other
        # short numbers are sorted by radix
        by_doc = np.argsort(doc[useful].astype(np.uint16) if n <= 1 << 16 else doc[useful], kind="stable")
        self.terms = number[useful][by_doc]
        self.bounds = np.searchsorted(doc[useful][by_doc], np.arange(n + 1))
        self.used, self.left, self.next = np.zeros(n, bool), n, 0
        self.seed, self.score, self.order, self.at = -1, np.zeros(n), np.zeros(0, np.int64), 0

    def use(self, d: int) -> None:
        self.used[d] = True
        self.left -= 1

    def neighbour(self, seed: int) -> int:
        """The unused document most like the seed; the next in order where none shares a word."""
        if seed != self.seed:  # a window asks many times for one seed
            self.seed, self.score = seed, self._scores(seed)
            self._rank(RANKED)
        while True:
            while self.at < len(self.order):
                d = int(self.order[self.at])
                if not self.used[d]:
                    return d
                self.at += 1
            if not len(self.order):
                break
            self._rank(4 * len(self.order))
        while self.used[self.next]:
            self.next += 1
        return self.next

    def _scores(self, seed: int) -> np.ndarray:
        """BM25 of each document for all the words of the seed."""
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        row = self.row[terms]
        out = self.rows[row[row >= 0]].sum(axis=0, dtype=np.float64) if len(self.rows) else np.zeros(len(self.used))
        rare = terms[row < 0]
        if len(rare):
            begin, size = self.ends[rare], self.ends[rare + 1] - self.ends[rare]
            at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            out += np.bincount(self.doc[at], self.weight[at], len(self.used))
        return out

    def _rank(self, many: int) -> None:
        """The best ``many`` unused documents that share a word with the seed, and those that tie with the last."""
        self.score[self.used] = 0.0
        least = np.partition(self.score, -many)[-many] if many < len(self.score) else 0.0
        found = np.flatnonzero(self.score >= least if least > 0 else self.score > 0)
        self.order, self.at = found[np.argsort(-self.score[found], kind="stable")], 0


def pack(ids: list[np.ndarray], words: list[np.ndarray], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each id of a shard once."""
    index, out = Bm25(words), []
    seq, offset, seed = 0, 0, -1
    open_from = 0
    while index.left:
        d = index.neighbour(seed) if seed >= 0 else index.next
        index.use(d)
        if seed < 0 or offset == 0:
            seed = d
        start, total = 0, len(ids[d])
        while start < total:
            if offset == 0:
                open_from, seed = len(out), d
            take = min(seq_len - offset, total - start)
            out.append((d, start, take, seq, offset))
            start, offset = start + take, offset + take
            if offset == seq_len:
                seq, offset = seq + 1, 0
    if offset and offset & (offset - 1):  # the last window: lengths that are powers of two
        rest, out = out[open_from:], out[:open_from]
        room = at = 1 << (offset.bit_length() - 1)
        left = offset
        for d, start, length, _, _ in rest:
            while length:
                take = min(room, length)
                out.append((d, start, take, seq, at - room))
                start, length, room, left = start + take, length - take, room - take, left - take
                if not room and left:
                    seq += 1
                    room = at = 1 << (left.bit_length() - 1)
    return out


def _pack(path: str, seq_len: int, shard_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        cache, held = _cache(path)
        base = TaskContext.get().partitionId() << 32
        names, ids, words, count = [], [], [], 0
        used = 0

        def flush():
            nonlocal used
            pieces = pack(ids, words, seq_len)
            cols = list(zip(*pieces, strict=True)) or [[]] * 5
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([names[d] for d in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                    pa.array([zlib.crc32(ids[d][s : s + n]) for d, s, n, _, _ in pieces], pa.int64()),
                    pa.array([len(ids[d]) for d in cols[0]], pa.int64()),
                    pa.array(np.array(cols[3], np.int64) + base + used), pa.array(cols[4], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            used += (max(cols[3]) + 1) if pieces else 0
            names.clear(), ids.clear(), words.clear()
            return out

        for b in batches:
            keys = b.column(0).to_pylist()
            for p in split(b.column(1)):
                slots = cache.slots(p)
                flat, at = held["ids"].gather(slots)
                cut = at[p.doc_piece]
                for i in range(len(cut) - 1):
                    mine = np.empty(cut[i + 1] - cut[i] + 1, "<u4")
                    mine[:-1] = flat[cut[i] : cut[i + 1]]
                    mine[-1] = END_ID
                    names.append(keys[p.first + i]), ids.append(mine)
                    words.append(p.hash[p.doc_piece[i] : p.doc_piece[i + 1]].view(np.int64) >> 12)
                    count += len(mine)
                    if count >= shard_tokens:
                        yield flush()
                        count = 0
            trim(collect=False)
        if ids:
            yield flush()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, seq_len: int = SEQ_LEN, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text without special tokens, then the end id; a null or
    empty text is the end id alone. Each id lies in exactly one piece; pieces fill a sequence
    from offset 0 without gaps. Rows that repeat an id, and null ids, are packed like others; an
    empty table gives no rows. ``vocabulary`` is the path of a file that each machine has. Other
    columns are not read. A cut longer than ``seq_len`` goes on in the next sequences.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        _pack(vocabulary or default_vocabulary(), seq_len, shard_tokens),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
