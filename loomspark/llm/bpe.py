"""Byte-level BPE by DuckDB queries that recur until nothing merges (operator 5).

Each task pretokenises its texts; pieces that its worker has not met go to an embedded
DuckDB: rows (word, place, token) start at single bytes and join the merge table in a recursive query, of which
every round contracts each word's leftmost pair of the least rank. A recursion keeps the rows of all its rounds, so it
ends after ``ROUNDS``; words that still have a pair in the table go on in rounds of which each replaces the
last one's rows. Those contract further places of the same pair too, as long as none makes a pair of lesser
rank, which would be next. Words of every length go that way. An ordered aggregation gives each word's ids. Documents' ids are put together from their words, and an
ordered aggregation of the vocabulary's bytes over all ids of a document decodes it.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .pretok import Ragged, WordCache, split, worker_cache

WORDS_AT_ONCE = 40_000
ROUNDS = 24


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_RECUR = f"""CREATE OR REPLACE TEMP TABLE last AS
WITH RECURSIVE t(it, w, p, tok) AS (
  SELECT 0, w, p, tok FROM rows
  UNION ALL
  SELECT it + 1, w, p, tok FROM (
    WITH s AS (SELECT it, w, p, tok, lead(p) OVER word AS after, tok::BIGINT * 1048576 + lead(tok) OVER word AS pair
               FROM t WINDOW word AS (PARTITION BY w ORDER BY p)),
    b AS (SELECT w, min(m * 4294967296 + p) AS best, arg_min(after, m * 4294967296 + p) AS gone
          FROM s JOIN merges USING (pair) GROUP BY w)
    SELECT it, s.w, s.p, CASE WHEN s.p = best & 4294967295 THEN (best >> 32)::INTEGER ELSE tok END AS tok
    FROM s JOIN b USING (w) WHERE s.p <> gone AND it < {ROUNDS})
)
SELECT t.* FROM t JOIN (SELECT w, max(it) AS it FROM t GROUP BY w) USING (w, it)"""
_OPEN = (f"CREATE OR REPLACE TEMP TABLE done AS SELECT w, p, tok FROM last WHERE it < {ROUNDS}", f"CREATE OR REPLACE TEMP TABLE rows AS SELECT w, p, tok FROM last WHERE it = {ROUNDS} ORDER BY p")
#: Rows of a round, which stand in the order of their places, with their neighbours.
_STEP = """CREATE OR REPLACE TEMP TABLE step AS
SELECT w, p, tok, row_number() OVER () AS i, lag(w) OVER () AS w0, lag(tok) OVER () AS t0, lead(w) OVER () AS w1, lead(tok) OVER () AS t1, lead(w, 2) OVER () AS w2, lead(tok, 2) OVER () AS t2 FROM rows"""
#: Places where each word's pair of the least rank stands.
_SAME = """CREATE OR REPLACE TEMP TABLE same AS
WITH found AS (SELECT w, i, CASE WHEN w0 = w THEN t0 END AS before, CASE WHEN w2 = w THEN t2 END AS after, m FROM step JOIN merges ON pair = tok::BIGINT * 1048576 + t1 WHERE w1 = w)
SELECT found.* FROM found JOIN (SELECT w, min(m) AS m FROM found GROUP BY w) USING (w, m)"""
#: The leftmost, and further ones until one makes a pair of lesser rank. Of equal tokens in a row every second pair.
_CHOSEN = """CREATE OR REPLACE TEMP TABLE chosen AS
WITH several AS (SELECT w FROM same GROUP BY w HAVING count(*) > 1),
places AS (SELECT *, i - row_number() OVER (PARTITION BY w ORDER BY i) AS island FROM same WHERE w IN (SELECT w FROM several)),
apart AS (SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY w, island ORDER BY i) % 2 = 1),
sides AS (SELECT w, i, m, CASE WHEN lag(i) OVER (PARTITION BY w ORDER BY i) = i - 2 THEN m ELSE before END * 1048576 + m AS l, m * 1048576 + after AS r FROM apart),
stops AS (SELECT w, min(i) AS stop FROM sides LEFT JOIN merges x ON x.pair = l LEFT JOIN merges y ON y.pair = r WHERE x.m < sides.m OR y.m < sides.m GROUP BY w)
SELECT w, i, m FROM sides LEFT JOIN stops USING (w) WHERE stop IS NULL OR i <= stop
UNION ALL SELECT w, i, m FROM same WHERE w NOT IN (SELECT w FROM several)"""
_DONE = "INSERT INTO done SELECT w, p, tok FROM step WHERE w NOT IN (SELECT w FROM chosen)"
_NEXT = """CREATE OR REPLACE TEMP TABLE rows AS SELECT s.w, s.p, coalesce(c.m, s.tok)::INTEGER AS tok
FROM step s LEFT JOIN chosen c ON c.i = s.i WHERE s.i NOT IN (SELECT i + 1 FROM chosen) AND s.w IN (SELECT w FROM chosen) ORDER BY s.p"""
_WORDS = "SELECT w, list(tok ORDER BY p) AS ids FROM done GROUP BY w"
_DECODE = "SELECT d, sha256(unhex(string_agg(hex, '' ORDER BY p))) AS sha FROM ids JOIN vocab USING (tok) GROUP BY d"


class Encoder:
    """Ids and decoded bytes of pieces."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = load_ranks(path)
        self.token = {r: b for b, r in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for whole, rank in self.ranks.items():
            for i in range(1, len(whole)):
                a, b = self.ranks.get(whole[:i]), self.ranks.get(whole[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        pair = np.array(left, np.int64) * 1048576 + np.array(right, np.int64)
        self._table("merges", pa.table({"pair": pair, "m": np.array(made, np.int64)}))
        self._table("vocab", pa.table({"tok": np.fromiter(self.token, np.int32), "hex": pa.array([b.hex() for b in self.token.values()])}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def merged(self, raw: list[bytes]) -> list[list[int]]:
        """Ids of words, merged until no pair is in the table."""
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        self._table("rows", pa.table({
            "w": np.repeat(np.arange(len(raw), dtype=np.int32), lens),
            "p": np.arange(int(lens.sum()), dtype=np.int32),
            "tok": self.byte[np.frombuffer(b"".join(raw), np.uint8)],
        }))
        for query in (_RECUR, *_OPEN):
            self.db.execute(query)
        while self.db.execute("SELECT count(*) FROM rows").fetchone()[0]:
            for query in (_STEP, _SAME, _CHOSEN, _DONE, _NEXT):
                self.db.execute(query)
        out: list = [None] * len(raw)
        for w, ids in self.db.execute(_WORDS).fetchall():
            out[w] = ids
        return out

    def encode(self, words: list[str]) -> list:
        """Ids of each word."""
        raw = [w.encode() for w in words]
        ids: list = [[r] if (r := self.ranks.get(w)) is not None else None for w in raw]
        todo = [i for i, x in enumerate(ids) if x is None]
        for at in range(0, len(todo), WORDS_AT_ONCE):
            some = todo[at : at + WORDS_AT_ONCE]
            for i, tokens in zip(some, self.merged([raw[i] for i in some]), strict=True):
                ids[i] = tokens
        return ids

    def decoded(self, doc: np.ndarray, ids: np.ndarray, n: int) -> list[str]:
        """Of ``n`` documents the sha256 of the bytes that their ids, which stand in order, decode to."""
        out = [hashlib.sha256(b"").hexdigest()] * n
        if len(ids):
            self.db.register("ids", pa.table({"d": doc.astype(np.int32), "p": np.arange(len(ids), dtype=np.int32), "tok": ids.astype(np.int32)}))
            for d, sha in self.db.execute(_DECODE).fetchall():
                out[d] = sha
            self.db.unregister("ids")
        return out


def _cache(path: str) -> tuple[WordCache, dict]:
    """One encoder and cache for each Python worker and rank file."""

    def make():
        encoder = Encoder(path)
        held = {"encoder": encoder}

        def reset():
            held["ids"] = Ragged(np.uint32)

            def learn(words):
                held["ids"].add(encoder.encode(words))

            return learn

        return WordCache(reset), held

    return worker_cache(("bpe", path), make)


def _encode(path: str, with_ids: bool):
    def run(batches):
        cache, held = _cache(path)
        for b in batches:
            n_tokens, ids_sha, dec_sha, lists = [], [], [], []
            for p in split(b.column(1)):
                slots = cache.slots(p)
                ids, at = held["ids"].gather(slots)
                cut = at[p.doc_piece]
                dec_sha += held["encoder"].decoded(np.repeat(np.arange(len(cut) - 1), np.diff(cut)), ids, len(cut) - 1)
                cut = cut.tolist()
                for i in range(len(cut) - 1):
                    mine = ids[cut[i] : cut[i + 1]]
                    n_tokens.append(len(mine))
                    ids_sha.append(hashlib.sha256(mine.astype("<u4").tobytes()).hexdigest())
                    if with_ids:
                        lists.append(mine.astype(np.int32))
            cols = [b.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and with ``with_ids`` ids: array of int).

    Long texts take memory in proportion to their length in one task. A null text counts as empty and has no ids (the digests are those of no bytes). Every row
    gives a row, repeated ones and null ids too; an empty table gives none. ``ranks`` is the path
    of a rank file that each machine has. Columns other than the two named are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(_encode(ranks or default_ranks(), with_ids), schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
