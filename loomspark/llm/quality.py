"""Quality classifier by positive-unlabelled learning (operator 3).

Trusted positives (labelled good) and unlabelled text give a linear scorer that minimises
the non-negative unbiased risk: pi * E+[l(g)] + max(0, Eu[l(-g)] - pi * E+[l(-g)]), where pi
is the class prior, estimated from the same positives and unlabelled text (no labelled negative
is used). The logistic of the scorer is the score. Features are the shapes of
a text's pieces (letters, digits and signs as classes, runs shortened), hashed, as shares of
the text, and a few whole-text measures. Fitting reads a bounded sample (``SAMPLE``).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table
from .pretok import WordCache, split, worker_cache

SAMPLE = 4000
SHAPES = 509
HELD_OUT = (5, 0)
THRESHOLD = 0.3
STEPS = 400
_RUNS = [(re.compile(r"[^\W\d_a-zà-öø-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"\s+"), " ")]
MEASURES = 9


def shape(piece: str) -> str:
    for pattern, to in _RUNS:
        piece = pattern.sub(to, piece)
    return piece[:12]


def _shape_number(piece: str) -> int:
    from zlib import crc32

    return crc32(shape(piece).encode()) % SHAPES


def _cache() -> tuple[WordCache, dict]:
    def make():
        held: dict = {}

        def reset():
            held["f"], held["n"] = np.zeros(1024, np.int32), 0

            def learn(words):
                n, m = held["n"], held["n"] + len(words)
                if m > len(held["f"]):
                    held["f"] = np.concatenate([held["f"], np.zeros(m, np.int32)])
                held["f"][n:m] = [_shape_number(w) for w in words]
                held["n"] = m

            return learn

        return WordCache(reset), held

    return worker_cache("quality", make)


def featurize(texts: pa.Array):
    """Feature rows of consecutive texts (float32, SHAPES shares and MEASURES), a few texts at a time."""
    cache, held = _cache()
    for p in split(texts):
        slots = cache.slots(p)
        n = np.diff(p.doc_piece)
        doc = np.repeat(np.arange(len(n)), n)
        x = np.zeros((len(n), SHAPES + MEASURES), np.float32)
        if len(slots):
            share = np.bincount(doc * SHAPES + held["f"][slots], minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
            x[:, :SHAPES] = np.sqrt(share / np.maximum(1, n)[:, None])
            pair = np.unique(doc * (1 << 32) + slots, return_counts=True)
            kinds = np.bincount(pair[0] >> 32, minlength=len(n))
            most = np.zeros(len(n))
            np.maximum.at(most, pair[0] >> 32, pair[1])
            chars = np.bincount(doc, p.length, len(n))
            code = p.code
            owner = np.repeat(doc, p.length)
            total = np.maximum(1, chars)
            m = x[:, SHAPES:]
            m[:, 0] = np.log1p(chars) / 10
            m[:, 1] = kinds / np.maximum(1, n)
            m[:, 2] = most / np.maximum(1, n)
            m[:, 3] = np.bincount(owner, (code >= 65) & (code <= 90), len(n)) / total
            m[:, 4] = np.bincount(owner, (code >= 48) & (code <= 57), len(n)) / total
            m[:, 5] = np.bincount(owner, (code > 32) & (code < 48) | (code > 57) & (code < 65) | (code > 122) & (code < 127) | (code > 90) & (code < 97), len(n)) / total
            m[:, 6] = np.bincount(owner, code == 10, len(n)) / total * 10
            m[:, 7] = chars / np.maximum(1, n) / 10
            m[:, 8] = kinds / np.sqrt(np.maximum(1, n)) / 10
        yield x


def pu_risk(w: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of a linear scorer (logistic loss; the last column of both tables is 1): the risk of positives,
    the unbiased risk of negatives (not yet cut at zero), and the gradients of both."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    gp, gu = pos @ w, unl @ w
    good, negative = prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    good_slope = -prior * (pos.T @ (1 - sig(gp))) / len(pos)
    slope = (unl.T @ sig(gu)) / len(unl) - prior * (pos.T @ sig(gp)) / len(pos)
    return float(good), float(negative), good_slope, slope


def fit_pu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk (logistic loss, Adam, small weight decay)."""
    p1, u1 = np.c_[pos, np.ones(len(pos))], np.c_[unl, np.ones(len(unl))]
    w, first, second = (np.zeros(p1.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        _, negative, good_slope, slope = pu_risk(w, p1, u1, prior)
        grad = good_slope + slope if negative >= 0 else -slope  # climb back where the estimate went below zero
        grad[:-1] += 1e-4 * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of a plain logistic model, both classes weighing the same (Adam, small weight decay)."""
    x1, weight = np.c_[x, np.ones(len(x))], np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w, first, second = (np.zeros(x1.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        grad = x1.T @ (weight * (1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30))) - y))
        grad[:-1] += 1e-4 * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in unlabelled text, from trusted positives and unlabelled text alone.

    Half of both fit a scorer of positive against unlabelled. On the other half, positives are a
    share of those above a threshold; the share of unlabelled text above it over that of positives
    bounds the prior from above, and the threshold with the least bound (sampling error
    included) gives the estimate."""
    if len(pos) < 4 or len(unl) < 4:
        return 0.5
    fit_x, y = np.concatenate([pos[::2], unl[::2]]), np.r_[np.ones(len(pos[::2])), np.zeros(len(unl[::2]))]
    w = _logistic(fit_x, y)
    zp, zu = (np.sort(v[1::2] @ w[:-1])[::-1] for v in (pos, unl))
    qp = np.arange(1, len(zp) + 1) / len(zp)
    qu = np.searchsorted(-zu, -zp, "right") / len(zu)
    slack = np.sqrt(np.log(20) / 2) * (len(zp) ** -0.5 + len(zu) ** -0.5)
    best = int(np.argmin((qu + slack) / qp))
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def _rows_of(batches):
    """Feature rows of (i, h, y, text), with the text left behind."""
    for b in batches:
        x = np.concatenate([*featurize(b.column(3)), np.zeros((0, SHAPES + MEASURES), np.float32)])
        flat = pa.array(x.ravel(), pa.float32())
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (SHAPES + MEASURES)), flat)], names=["h", "y", "x"])


def _sample(rows: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(y, features) of at most ``2 * sample`` different rows (i, t, y), picked and put in order by a hash.

    Features are made on the executors, so a text of any length costs the driver one row of numbers."""
    rows = rows.withColumn("h", F.xxhash64("i", "t"))
    n = rows.select("h").count()
    picked = rows.filter(F.pmod("h", F.lit(max(1, n // sample))) == 0).dropDuplicates(["h"]).select("i", "h", F.col("y").cast("int").alias("y"), F.coalesce("t", F.lit("")).alias("t"))
    got = picked.mapInArrow(_rows_of, "h long, y int, x array<float>").orderBy("h").limit(2 * sample).toArrow().combine_chunks()
    if not len(got):
        return np.zeros(0), np.zeros((0, SHAPES + MEASURES), np.float32)
    x = np.concatenate([c.flatten().to_numpy() for c in got.column("x").chunks])
    return got.column("y").fill_null(-1).to_numpy().astype(float), x.reshape(len(got), -1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit on at most ``2 * sample`` labelled and ``2 * sample`` unlabelled rows that are not held out.

    Labelled negatives are not used. Without trusted positives every score is 0.5; without
    unlabelled text the labelled rows stand in for it."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(crc_mod(F.col("i"), HELD_OUT[0]) != HELD_OUT[1])
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter("y is not null and i is not null").groupBy("i").agg(F.max("y").alias("y"))
    y, known = _sample(rows.join(marks, "i"), sample)
    _, u = _sample(rows.join(marks.select("i"), "i", "left_anti").withColumn("y", F.lit(None)), sample)
    u = u if len(u) else known
    pos = known[y > 0]
    model = {"w": np.zeros(SHAPES + MEASURES), "b": 0.0, "prior": 0.5}
    if not len(pos):
        return model
    mean, scale = u.mean(axis=0), u.std(axis=0) + 0.02
    pos, u = (pos - mean) / scale, (u - mean) / scale
    prior = estimate_prior(pos, u)
    w, b = fit_pu(pos, u, prior)
    return {"w": w / scale, "b": b - float((mean / scale) @ w), "prior": prior}


def _score(shared):
    def run(batches):
        model = shared.value
        w, b = model["w"].astype(np.float32), model["b"]
        for batch in batches:
            out = [1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30).astype(np.float64))) for x in featurize(batch.column(1))]
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; only the text is scored.

    Null texts are scored like empty ones, long ones whole, a few at a time. Repeated rows and null ids each get a row; an empty
    table gives none. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = crc_mod(F.col(id_col), HELD_OUT[0]) == HELD_OUT[1]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), held.alias("h")).mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
