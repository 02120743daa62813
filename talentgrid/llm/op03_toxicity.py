"""Toxicity by a linear-chain conditional random field.

Two states, clean and offending.  A token's features are its lower-cased word and its byte
prefixes of 4 to 8, hashed into a weight table; transitions are shared.  Forward and backward
recursions give each token's marginal of being offending; a document's score is a logistic
function of the sum, the largest and the density of its marginals; offending offsets are the
spans of tokens with a marginal of one half or more.

Labels are per document, so tokens are labelled first: in a toxic training document a token is
offending if one of its features is found in toxic training documents far more often than in
clean ones; all tokens of clean documents are clean.  The field is fitted on the one part of
the training rows and the logistic function on the other, so its inputs are not fitted ones.

Bound of the training sample (documented parameters): ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled
documents in the order of a hash of doc_id.  Only they come to the driver.  Scores cover every
document, whole texts.

Defined results: texts without words (null, empty) get the score of a document with no
offending tokens; with labels of one class or none, every score is the share of toxic labels
(0 without labels); repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import ship, table

MAX_TOXIC = 1200
MAX_CLEAN = 2400
BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
STEPS = 60


def token_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots of every token (one row each; slot 0 is empty), token byte spans, first tokens."""
    low = W.LOWER[raw]
    starts, ends, first = W.spans(low, off, W.ALNUM)
    size = ends - starts
    cols = [W.hash_words(low, starts, ends)]
    for k in PREFIXES:
        h = W.hash_words(low, starts, np.minimum(starts + k, ends), k)
        cols.append(np.where(size > k, h, np.uint64(0)))
    slots = np.empty((len(starts), len(cols)), np.int32)
    for i, h in enumerate(cols):
        slots[:, i] = (h >> np.uint64(64 - BITS)).astype(np.int32)
    return slots, starts, ends, first


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(offending) of each token, and of each token pair's four state changes (token, from, to).

    ``emission``: log weight of offending against clean.  Documents go side by side, longest
    first, one token at a time; odds stand for the normalized forward and backward values.
    """
    n = len(emission)
    e = np.exp(np.clip(emission, -30, 30))
    t = np.exp(trans)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    fwd, bwd = np.empty(n), np.ones(n)
    odds = None
    for s, m in enumerate(live.tolist()):
        at = begin[:m] + s
        odds = e[at] if odds is None else e[at] * (t[0, 1] + t[1, 1] * odds[:m]) / (t[0, 0] + t[1, 0] * odds[:m])
        fwd[at] = odds
    for s in range(len(live) - 2, -1, -1):
        at = begin[: live[s + 1]] + s
        x = e[at + 1] * bwd[at + 1]
        bwd[at] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
    m1 = fwd * bwd
    p = m1 / (1 + m1)
    pair = np.zeros((n, 2, 2))
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    i = np.flatnonzero(inner)
    x = e[i] * bwd[i]
    a = np.stack([np.ones(len(i)), fwd[i - 1]], 1)
    b = np.stack([np.ones(len(i)), x], 1)
    joint = a[:, :, None] * t[None] * b[:, None, :]
    pair[i] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return p, pair


@dataclass
class Model:
    """Weights of the field, of the score, and the score without a model."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    score: np.ndarray
    prior: float | None = None

    def emission(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[slots].sum(axis=1, dtype=np.float64) + self.bias


def _summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Inputs of the score, per document."""
    n = np.diff(first)
    total = np.concatenate(([0.0], np.cumsum(p)))
    s = total[first[1:]] - total[first[:-1]]
    top = np.zeros(len(n))
    if (n > 0).any():
        top[n > 0] = np.maximum.reduceat(p, first[:-1][n > 0])
    return np.stack([np.ones(len(n)), np.log1p(s), top, np.log1p(100 * s / np.maximum(n, 1)), np.log1p(n) / 10], 1)


def label_tokens(slots: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Offending tokens of toxic documents, from the documents' labels."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    df = np.zeros((2, 1 << BITS))
    for c in range(slots.shape[1]):
        pairs = np.unique(doc * np.int64(1 << BITS) + slots[:, c])
        d, s = pairs >> BITS, pairs & ((1 << BITS) - 1)
        for k in (0, 1):
            df[k] += np.bincount(s[toxic[d] == k], minlength=1 << BITS)
    n0, n1 = max(1, (toxic == 0).sum()), max(1, (toxic == 1).sum())
    least = max(5, 0.012 * n1)
    rate = (df[1] / n1) / ((df[0] + 0.5) / n0)
    lexicon = (df[1] >= least) & (rate >= 8)
    lexicon[0] = False
    return (lexicon[slots].any(axis=1) & (toxic[doc] == 1)).astype(np.float64)


def fit(texts: list[str], toxic: np.ndarray, part: np.ndarray) -> Model:
    """Fit on whole texts; ``part`` true: rows of the field, false: rows of the score."""
    zero = np.zeros(1 << BITS, np.float32)
    if not len(texts) or toxic.min() == toxic.max():
        return Model(zero, 0.0, np.zeros((2, 2)), np.zeros(5), float(toxic.mean()) if len(texts) else 0.0)
    if len(set(toxic[part].tolist())) < 2 or len(set(toxic[~part].tolist())) < 2:
        part = np.arange(len(texts)) % 2 == 0  # too few rows for two parts of both classes
        part[:] = True

    def features(rows: np.ndarray):
        raw, off = W.buffer_of(pa.array([texts[i] for i in np.flatnonzero(rows)], pa.large_string()))
        slots, _, _, first = token_features(raw, off)
        return slots, first

    slots, first = features(part)
    y = label_tokens(slots, first, toxic[part])
    w, bias, trans = np.zeros(1 << BITS), -2.0, np.zeros((2, 2))
    seen = np.flatnonzero(np.diff(first) > 0)
    inner = np.ones(len(y), bool)
    inner[first[:-1][seen]] = False
    i = np.flatnonzero(inner)
    real = np.zeros((2, 2))
    np.add.at(real, (y[i - 1].astype(int), y[i].astype(int)), 1)
    grad2, gb2, gt2 = np.full(1 << BITS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    flat = slots.ravel()
    for _ in range(STEPS):  # AdaGrad on the log likelihood, with a little shrinkage
        p, pair = marginals(w[slots].sum(axis=1) + bias, first, trans)
        diff = y - p
        g = np.bincount(flat, np.repeat(diff, slots.shape[1]), 1 << BITS) - 0.01 * w
        gt = real - pair.sum(axis=0) - 0.01 * trans
        gb = diff.sum() - 0.01 * bias
        grad2 += g * g
        gb2 += gb * gb
        gt2 += gt * gt
        w += 0.4 * g / np.sqrt(grad2)
        bias += 0.2 * gb / np.sqrt(gb2)
        trans += 0.2 * gt / np.sqrt(gt2)
        w[0] = 0
    model = Model(w.astype(np.float32), bias, trans, np.zeros(5))
    other = ~part if (~part).any() else part
    slots, first = features(other)
    x = _summary(marginals(model.emission(slots), first, trans)[0], first)
    z, t = np.zeros(x.shape[1]), toxic[other].astype(float)
    for _ in range(30):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(z))
        z = z + np.linalg.solve(hess, x.T @ (t - q) - 0.1 * z)
    model.score = z
    return model


def fold(doc: str = "doc_id") -> Column:
    """crc32 of doc_id's text, modulo 3."""
    return F.crc32(F.col(doc).cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled rows outside fold 1, at most MAX_TOXIC and MAX_CLEAN of them."""
    rows = labels.filter(F.col("toxic").isNotNull() & (fold() != 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    picked = []
    for label, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        picked.append(rows.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    some = F.broadcast(picked[0].unionByName(picked[1]))  # at most MAX_TOXIC + MAX_CLEAN rows
    got = docs.select("doc_id", "text").join(some, "doc_id").select("doc_id", "text", "toxic", fold().alias("f")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit([r["text"] or "" for r in got], np.array([r["toxic"] for r in got], int), np.array([r["f"] == 0 for r in got], bool))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the offending spans (code points, end excluded) of every row."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # fixed size: 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for part, raw, off in W.chunks(batches, "text"):
            slots, starts, ends, first = token_features(raw, off)
            p = marginals(m.emission(slots), first, m.trans)[0] if len(slots) else np.zeros(0)
            if m.prior is None:
                value = 1 / (1 + np.exp(-np.clip(_summary(p, first) @ m.score, -30, 30)))
            else:
                value = np.full(part.num_rows, m.prior)
            spans: list[list] = [[] for _ in range(part.num_rows)]
            on = np.flatnonzero(p >= 0.5)
            if len(on):
                point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                for i, d in zip(on.tolist(), (np.searchsorted(first, on, "right") - 1).tolist(), strict=True):
                    zero = point[off[d]]
                    s, e = int(point[starts[i]] - zero), int(point[ends[i]] - zero)
                    if spans[d] and i - 1 == spans[d][-1]["last"]:
                        spans[d][-1].update(end=e, last=i)
                    else:
                        spans[d].append({"start": s, "end": e, "last": i})
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array(spans, pa.list_(span))], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long>>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; rows of fold 1 are held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
