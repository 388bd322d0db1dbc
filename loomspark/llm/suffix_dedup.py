"""Substring dedup over a whole corpus by deep-shallow suffix sorting (operator 10).

A byte goes when a ``span``-byte string that covers it also starts earlier. Sorting every
suffix of a corpus is out of reach, and most suffixes are alone: of the grams of ``GRAM``
bytes inside each window of ``span`` bytes, the ones with the least hash are anchors. Equal
windows have the same anchors, so a repeat is always found at an anchor, and anchors whose
hash occurs once in the corpus are dropped. Anchors with equal surroundings (every window
around the anchor, told by 128 bits of hash) are one string with many places: its later
places are covered whole. The strings are sorted: the suffixes that start at the anchors of
one gram and the reversed texts before them, by deep-shallow sorting. The common prefix
lengths then tell which windows of a string occur in an earlier one.

A gram with more than ``GROUP_ROWS`` suffixes is dealt to salted groups. Each group is
sorted, and suffixes that lead no window of their group need no further look (of equal
copies one goes on). The others are dealt anew by a longer shared string, which halves the
windows around the anchor, until groups are small; no task holds more than about
``GROUP_ROWS`` suffixes of a gram, and none is left out.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, materialize, release, table
from .deep_shallow import deep_shallow_sort
from .pretok import forget, trim

SPAN = 100
GRAM = 50
GROUP_ROWS = 4096
_CHUNK = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict = {}
_POS = (1 << 31) - 1
_SUFFIX = "key long, salt long, salted boolean, id long, d1 long, p long, m long, ctx binary"
_DOC = ["id", "d1", "dk"]
_NAMES = [c.split()[0] for c in _SUFFIX.split(", ")]


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS:
        n, inv = _CHUNK + 4 * SPAN, pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (base, inv))
        _POWERS[base] = up, down
    return _POWERS[base]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick over each w values in a row."""
    have = 1
    while have * 2 <= w:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def anchors(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """Of concatenated documents (``ends``: one past each), the anchors as arrays
    (place in ``data``, gram hash, hash of all windows around it)."""
    side = span - gram
    starts = np.r_[0, ends[:-1]]
    found = []
    (up, down), (up2, down2) = (_powers(b) for b in _BASES)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), _CHUNK):
            # anchors in [at, at + _CHUNK) need windows that start up to `side` earlier
            lo, hi = max(0, at - 2 * span), min(len(data), at + _CHUNK + 2 * span)
            b = data[lo:hi].astype(np.uint64) + np.uint64(1)
            if len(b) < span:
                continue
            p = np.r_[np.uint64(0), np.cumsum(b * up[: len(b)])]
            g = _mix((p[gram:] - p[:-gram]) * down[: len(b) - gram + 1])
            m = _sliding(g, side + 1, np.minimum)  # least gram hash of the window at each start
            first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
            valid = np.zeros(len(m), bool)
            for s, e in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True):
                if e - s >= span:
                    valid[max(0, s - lo) : max(0, min(len(m), e - span + 1 - lo))] = True
            m = np.where(valid, m, np.uint64(0))
            high = _sliding(np.r_[np.zeros(side, np.uint64), m, np.zeros(side, np.uint64)], side + 1, np.maximum)
            spot = np.flatnonzero((g == high) & (g > 0))
            spot = spot[(spot + lo >= at) & (spot + lo < at + _CHUNK)]
            if not len(spot):
                continue
            d = np.searchsorted(ends, spot + lo, "right")
            left = np.minimum(side, spot + lo - starts[d])
            right = np.minimum(side, ends[d] - (spot + lo + gram))
            p2 = np.r_[np.uint64(0), np.cumsum((b ^ (b << np.uint64(17))) * up2[: len(b)])]
            around = (p2[spot + gram + right] - p2[spot - left]) * down2[spot - left]
            around = _mix(around + (left * 65537 + right).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            found.append((spot + lo, g[spot], around))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and one past the end of each."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off[1:] - off[0]


def _anchor_rows(wide: bool, span: int, gram: int):
    """Gram hashes of the anchors; with ``wide`` also what surrounds them, the document and the place."""

    def run(batches):
        forget()
        for b in batches:
            data, ends = _joined(b.column(3))
            spot, g, around = anchors(data, ends, span, gram)
            cols, names = [pa.array(g.view(np.int64))], ["h"]
            if wide:
                d = np.searchsorted(ends, spot, "right")
                ids, d1, dk = (b.column(i).to_numpy()[d] for i in range(3))
                cols += [pa.array(x) for x in (around.view(np.int64), ids, d1, (dk << 31) | (spot - np.r_[0, ends][d]))]
                names += ["d", "id", "d1", "p"]
            for s in range(0, len(spot), 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(s, 100_000) for c in cols], names=names)
        trim(collect=False)

    return run


def _packed(lo, hi, left):
    """The first and last window around an anchor that are asked for, and the bytes before it."""
    return lo << 32 | hi << 16 | left


def _contexts(span: int, gram: int):
    """The bytes around each anchor of a document, as rows of _SUFFIX."""
    side = span - gram

    def run(batches):
        for b in batches:
            of, h, at, salts, left, ctx = [], [], [], [], [], []
            spots = b.column(4).to_pylist()
            for i, text in enumerate(b.column(3).cast(pa.large_binary()).to_pylist()):
                for s in spots[i]:
                    pos = s["p"] & _POS
                    lo = max(0, pos - side)
                    of.append(i), h.append(s["h"]), at.append(s["p"]), salts.append(s["salts"]), left.append(pos - lo)
                    ctx.append(text[lo : pos + gram + side])
            ids, d1 = (b.column(i).to_numpy()[of] for i in range(2))
            salts, at = np.array(salts, np.uint64), np.array(at, np.int64)
            salt = _mix(d1.view(np.uint64) ^ (at.view(np.uint64) * np.uint64(_BASES[0]))) % salts if len(of) else salts
            cols = [
                pa.array(h, pa.int64()), pa.array(salt.astype(np.int64)), pa.array(salts > 1), pa.array(ids), pa.array(d1), pa.array(at),
                pa.array(_packed(0, side, np.array(left, np.int64)), pa.int64()), pa.array(ctx, pa.binary()),
            ]
            for s in range(0, len(h), 20_000):
                yield pa.RecordBatch.from_arrays([c.slice(s, 20_000) for c in cols], names=_NAMES)

    return run


def covered(place: np.ndarray, pos: np.ndarray, m: np.ndarray, ctx: list[bytes], span: int, gram: int):
    """Sorts the suffixes at the anchors and the reversed texts before them; the common prefix
    lengths then tell which windows around each anchor an earlier ``place`` also has.

    Returns (row numbers, first, one past) of covered bytes, and a mask of the rows that are
    the first of some window."""
    n, side = len(ctx), span - gram
    first_o, last_o, left = m >> 32, m >> 16 & 0xFFFF, m & 0xFFFF
    lens = np.fromiter(map(len, ctx), np.int64, n)
    flat = np.frombuffer(b"".join(ctx), np.uint8)
    begin = np.r_[0, np.cumsum(lens)[:-1]]
    right_len = np.minimum(lens - left, span)

    def rows(start, length, width, sign):
        j = np.arange(width)
        take = begin[:, None] + start[:, None] + sign * j[None, :]
        ok = j[None, :] < length[:, None]
        return np.where(ok, flat[np.clip(take, 0, len(flat) - 1)], 0).astype(np.uint8)

    order_r, lcp_r = deep_shallow_sort(rows(left, right_len, span, 1), right_len, 4)
    order_l, lcp_l = deep_shallow_sort(rows(left - 1, left, side, -1), left, 2)
    least, most, leads = np.full(n, side + 1), np.full(n, -1), np.zeros(n, bool)
    by_rank = np.argsort(place, kind="stable")
    cls_r, cls_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(side + 1):  # the window starts o bytes before the anchor
        rows_o = by_rank[((left >= o) & (right_len >= span - o) & (first_o <= o) & (o <= last_o))[by_rank]]
        if not len(rows_o):
            continue
        cls_r[order_r] = np.cumsum(lcp_r < span - o)
        cls_l[order_l] = np.cumsum(lcp_l < o)
        key = cls_l[rows_o] * (n + 1) + cls_r[rows_o]
        s = np.argsort(key, kind="stable")
        same = np.r_[False, key[s][1:] == key[s][:-1]]
        late = rows_o[s[same]]
        leads[rows_o[s[~same]]] = True
        least[late] = np.minimum(least[late], o)
        most[late] = np.maximum(most[late], o)
    hit = np.flatnonzero(most >= 0)
    return hit, pos[hit] - most[hit], pos[hit] - least[hit] + span, leads


def _cover_rows(span: int, gram: int, rows_at_once: int = 60_000):
    """Sorted rows of _SUFFIX become spans (lo, hi set) and, of salted keys, the rows that still
    lead a window (ctx set)."""

    def group_starts(t):
        key, salt = (t.column(c).to_numpy() for c in ("key", "salt"))
        return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])

    def emit(t: pa.Table):
        t = t.combine_chunks()
        ids, d1, p = (t.column(c).to_numpy() for c in ("id", "d1", "p"))
        place = np.empty(len(p), np.int64)
        place[np.lexsort((p, d1, ids, p < 0))] = np.arange(len(p))
        hit, lo, hi, leads = covered(place, p & _POS, t.column("m").to_numpy(), t.column("ctx").to_pylist(), span, gram)
        spans = t.take(pa.array(hit))
        held = t.filter(pa.array(leads & t.column("salted").to_numpy(zero_copy_only=False)))
        out = [spans.drop_columns(["ctx"]).append_column("ctx", pa.nulls(len(hit), pa.binary())), held]
        bounds = [(lo, hi), (np.zeros(len(held), np.int64), np.full(len(held), -1))]
        for part, (a, b) in zip(out, bounds, strict=True):
            part = part.select(_NAMES).append_column("lo", pa.array(a.astype(np.int64))).append_column("hi", pa.array(b.astype(np.int64)))
            yield from part.combine_chunks().to_batches(max_chunksize=20_000)

    def run(batches):
        held: list = []
        count = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            count += b.num_rows
            if count >= rows_at_once:
                t = pa.Table.from_batches(held)
                cut = int(group_starts(t)[-1])  # a group's rows stay together
                if cut:
                    yield from emit(t.slice(0, cut))
                    held, count = t.slice(cut).to_batches(), len(t) - cut
        if held:
            yield from emit(pa.Table.from_batches(held))
        held.clear()
        trim(collect=False)

    return run


def cut(text: bytes, spans: list) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs) without the union of ``spans``."""
    out, last, removed, runs, end = [], 0, 0, 0, -1
    for lo, hi in sorted(spans):
        hi = min(hi, len(text))
        if lo > end:
            runs += 1
            out.append(text[last:lo])
            removed += hi - lo
            end = hi
        elif hi > end:
            removed += hi - end
            end = hi
        last = max(last, end)
    out.append(text[last:])
    return b"".join(out), removed, runs


def _apply(with_text: bool):
    def run(batches):
        for b in batches:
            ids, spans = b.column(0), b.column(2).to_pylist()
            n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
            for text, s in zip(b.column(1).cast(pa.large_binary()), spans, strict=True):
                text = text.as_py() or b""
                left, removed, runs = cut(text, [(x["lo"], x["hi"]) for x in s]) if s else (text, 0, 0)
                n_bytes.append(len(text)), n_removed.append(removed), n_spans.append(runs)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore") if with_text else None)
            cols = [ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols += [pa.array(kept, pa.string()), b.column(3)]
                names += ["kept_text", "rest"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Rows (doc_id, id, d1, dk, text, ...). (id, d1, dk) tells documents apart: the id, 64 and 32 bits
    of a SHA-256 of id and text; for null ids, id is 64 more of its bits and dk is negative."""
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    keyed = docs.select(
        key.alias("doc_id"), F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"), 256).alias("sha"), text.alias("text"), *more,
    )
    bits = lambda at, digits: F.conv(F.substring("sha", at, digits), 16, -10).cast("long")
    dk = bits(33, 8) - F.when(F.col("doc_id").isNull(), F.lit(1 << 32)).otherwise(F.lit(0))
    return keyed.withColumns({"id": F.coalesce("doc_id", bits(17, 16)), "d1": bits(1, 16), "dk": dk}).drop("sha")


def _dk(p: str):
    return F.shiftright(p, 31).alias("dk")


def _dealt(rows: DataFrame, span: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows that still lead a window of a hot key, dealt anew: a key with several windows becomes
    two, each with half of the windows and the longer string that those share. Also the table
    to release once they are read."""
    gram, side = span // 2, span - span // 2
    lo, hi, left = F.shiftright("m", 32), F.shiftright("m", 16).bitwiseAND(F.lit(0xFFFF).cast("long")), F.col("m").bitwiseAND(F.lit(0xFFFF).cast("long"))
    mid = F.shiftright(lo + hi, 1)
    halves = F.when(lo == hi, F.array(F.struct(lo.alias("lo"), hi.alias("hi")))).otherwise(F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), hi.alias("hi"))))
    rows = rows.drop("lo", "hi").withColumn("left", left).withColumn("x", F.explode(halves))
    rows = rows.filter((F.col("left") >= F.col("x.lo")) & (F.length("ctx") - F.col("left") - gram >= side - F.col("x.hi")))
    shared = F.substring(F.col("ctx"), (F.col("left") - F.col("x.lo") + 1).cast("int"), (F.col("x.lo") + gram + side - F.col("x.hi")).cast("int"))
    rows = rows.withColumn("key", F.xxhash64("x.lo", "x.hi", shared)).withColumn("m", F.shiftleft("x.lo", 32) + F.shiftleft("x.hi", 16) + F.col("left"))
    rows = materialize(rows.drop("x", "left", "salt", "salted"), "suffixes")
    counts = rows.groupBy("key").count().filter("count > 1").withColumn("salts", F.ceil(F.col("count") / group_rows))
    dealt = rows.join(counts, "key").withColumn("salt", F.pmod(F.xxhash64("id", "d1", "p"), F.col("salts"))).withColumn("salted", F.col("salts") > 1).select(*_NAMES)
    return dealt, rows


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (id, d1, dk, lo, hi): bytes lo..hi of a document that occur earlier. Spans may overlap
    and may end after the text."""
    spark, gram, side = docs.sparkSession, span // 2, span - span // 2
    source = _keyed(docs, id_col, text_col).select(*_DOC, "text").filter(F.octet_length("text") >= span)
    again = source.mapInArrow(_anchor_rows(False, span, gram), "h long").groupBy("h").count().filter("count > 1").select("h")
    again = materialize(again, "again")
    free_shuffles(spark)
    kept = source.mapInArrow(_anchor_rows(True, span, gram), "h long, d long, id long, d1 long, p long").join(again, "h", "left_semi")
    kept = materialize(kept, "anchors")
    release(again)
    free_shuffles(spark)
    place = F.struct((F.col("p") < 0).alias("nul"), F.col("id"), F.col("d1"), F.col("p"))
    classes = materialize(kept.groupBy("h", "d").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    pos = F.col("p").bitwiseAND(F.lit(_POS).cast("long"))
    copies = kept.join(classes.filter("n > 1").select("h", "d", "first"), ["h", "d"]).filter(place != F.col("first"))
    copies = materialize(copies.select("id", "d1", _dk("p"), F.greatest(F.lit(0), pos - side).cast("long").alias("lo"), (pos + gram + side).alias("hi")), "copies")
    release(kept)
    free_shuffles(spark)
    several = classes.groupBy("h").count().filter("count > 1").select("h", F.ceil(F.col("count") / group_rows).cast("int").alias("salts"))
    edges = classes.join(several, "h").select("h", "salts", "first.id", "first.d1", "first.p", _dk("first.p"))
    spots = edges.groupBy(*_DOC).agg(F.collect_list(F.struct("h", "p", "salts")).alias("spots"))
    once = source.groupBy(*_DOC).agg(F.first("text").alias("text"))  # rows that repeat id and text are one document
    rows = once.join(spots, _DOC).select("id", "d1", "dk", "text", "spots").mapInArrow(_contexts(span, gram), _SUFFIX)
    inputs, spans = [classes], [copies]
    while True:
        done = rows.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_cover_rows(span, gram), _SUFFIX + ", lo long, hi long")
        done = materialize(done, "spans")
        release(*inputs)
        free_shuffles(spark)
        spans.append(done.filter("hi >= 0").select("id", "d1", _dk("p"), "lo", "hi"))
        held = done.filter("hi < 0")
        if not held.limit(1).count():
            break
        rows, table_ = _dealt(held, span, group_rows)
        inputs = [table_]
    return functools.reduce(DataFrame.unionByName, spans)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with ``with_text`` kept_text, and
    rest: the other columns as a struct). Characters that a cut splits are left out of kept_text.

    A null text is empty; texts under ``span`` bytes lose nothing. "Earlier" is a smaller doc_id,
    then an earlier start; a null id is later than all others, and rows that share an id but not
    the text are ordered by a SHA-256 of both. Rows that repeat id and text are one document: each
    gets its result. Long texts take memory in proportion to their length in one task. An empty
    table gives no rows. Other columns are not read.
    """
    return apply_spans(docs, repeated_spans(docs, id_col, text_col, span), id_col, text_col, with_text)


def apply_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` without the spans of :func:`repeated_spans`."""
    per_doc = spans.groupBy(*_DOC).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rest = [F.col(c) for c in docs.columns if c != text_col] if with_text else []
    joined = _keyed(docs, id_col, text_col, *([F.struct(*rest).alias("rest")] if rest else [])).join(per_doc, _DOC, "left")
    joined = joined.select("doc_id", "text", "spans", *(["rest"] if rest else []))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if rest:
        schema += f", kept_text string, rest {joined.schema['rest'].dataType.simpleString()}"
    return joined.mapInArrow(_apply(bool(rest)), schema)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", span: int = SPAN) -> DataFrame:
    """``docs`` with repeated bytes cut from the text (and ``chars_col`` brought up to date); rows
    that lose their whole text go."""
    out = suffix_dedup(docs, id_col, text_col, span, with_text=True).filter("n_removed = 0 or n_removed < n_bytes")
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("kept_text").alias(c))
        elif c == chars_col:
            cols.append(F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col(f"rest.{c}")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"rest.{c}").alias(c))
    return out.select(*cols)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


#: A text is cut in pieces of 1000 starts, as taking a substring costs its whole string.
SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT *, length(h) // 2 AS n_bytes FROM docs),
pieces AS (SELECT doc_id, n_bytes, c, substr(h, 2 * c + 1, 2198) AS piece FROM (SELECT *, unnest(range(0, n_bytes - 99, 1000)) AS c FROM sized)),
windows AS (SELECT doc_id, c + j AS pos, md5_number(substr(piece, 2 * j + 1, 200)) AS w
  FROM (SELECT *, unnest(range(0, least(1000, n_bytes - 99 - c))) AS j FROM pieces)),
earliest AS (SELECT w, min((doc_id, pos)) AS place FROM windows GROUP BY w HAVING count(*) > 1),
late AS (SELECT windows.doc_id, pos FROM windows JOIN earliest USING (w) WHERE (windows.doc_id, pos) > place),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS fresh FROM late),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked),
runs AS (SELECT doc_id, run, min(pos) AS lo, max(pos) + 100 AS hi FROM numbered GROUP BY doc_id, run),
per_doc AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM runs GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(list_sum([his[i] - los[i] for i in range(1, len(los) + 1)]), 0)::BIGINT AS n_removed, coalesce(len(los), 0)::BIGINT AS n_spans,
  lower(sha256(unhex(CASE WHEN los IS NULL THEN h ELSE array_to_string(
    [substr(h, 2 * coalesce(his[i - 1], 0) + 1, 2 * (coalesce(los[i], n_bytes) - coalesce(his[i - 1], 0))) for i in range(1, len(los) + 2)], '') END))) AS kept_sha256
FROM sized LEFT JOIN per_doc USING (doc_id)
"""
