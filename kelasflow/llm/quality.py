"""Quality classifier: positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelasflow.llm import text as T
from kelasflow.llm.common import text_of

# Bounds on what is fitted on, per class: trusted positives and unlabelled texts.
MAX_POSITIVE = 6_000
MAX_UNLABELLED = 12_000
EPOCHS, RATE, BATCH, DECAY = 60, 0.02, 512, 1e-4
WORD_LENGTHS = 12
N_FEATURES = 24 + WORD_LENGTHS

_b = np.arange(256)
_UPPER = (_b >= 65) & (_b <= 90)
_LOWER = (_b >= 97) & (_b <= 122)
_DIGIT = (_b >= 48) & (_b <= 57)
_SPACE = ~T.NOT_SPACE
_HIGH = _b >= 128
_STOP = (_b == 46) | (_b == 44) | (_b == 59) | (_b == 58)
_LOUD = (_b == 33) | (_b == 63)
_MARK = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH | _STOP | _LOUD) & (_b >= 32)
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _STOP, _LOUD, _MARK, _b == 10]).astype(np.float64)


def features(c: T.Chunk) -> np.ndarray:
    """One row per document: shares of character classes, word and line shape,
    repetition.  Every word of the text counts; no vocabulary is learned."""
    out = np.zeros((c.n, N_FEATURES))
    w = T.words(c, T.NOT_SPACE)
    size = (w.end - w.start).astype(np.float64)
    n = np.maximum(w.counts, 1).astype(np.float64)
    begin = np.concatenate([[0], c.ends[:-1] + 1])
    first = np.concatenate([[0], np.cumsum(w.counts)])
    tail = c.raw[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    inner = np.concatenate([[0], np.cumsum(_MARK[c.raw] | _LOUD[c.raw])])
    marked = ((inner[w.end] - inner[w.start]) > 0).astype(np.float64) if len(w.end) else size
    upper = np.concatenate([[0], np.cumsum(_UPPER[c.raw])])
    shouted = ((upper[w.end] - upper[w.start]) >= 2).astype(np.float64) if len(w.end) else size

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, x, c.n) / n if len(x) else np.zeros(c.n)
    for i in range(c.n):
        raw = c.raw[begin[i]:c.ends[i]]
        counts = np.bincount(raw, minlength=256).astype(np.float64)
        total = max(1.0, counts.sum())
        out[i, :9] = _CLASSES @ counts / total
        p = counts[counts > 0] / total
        out[i, 9] = -(p * np.log2(p)).sum() / 8.0
        h = w.hash[first[i]:first[i + 1]]
        if len(h):
            distinct = T.distinct(h)
            out[i, 10] = len(distinct) / len(h)
            pairs = T.window_hashes(h, 2)
            out[i, 11] = len(T.distinct(pairs)) / len(pairs) if len(pairs) else 1.0
            third = T.window_hashes(h, 3)
            out[i, 12] = len(T.distinct(third)) / len(third) if len(third) else 1.0
    out[:, 13] = mean(size) / 10.0
    out[:, 14] = np.sqrt(np.maximum(0.0, mean(size * size) / 100.0 - out[:, 13] ** 2))
    out[:, 15] = mean(marked)
    out[:, 16] = mean(shouted)
    out[:, 17] = mean(_STOP[tail].astype(np.float64)) if len(tail) else 0.0
    out[:, 18] = mean(_LOUD[tail].astype(np.float64)) if len(tail) else 0.0
    out[:, 19] = mean((size == 1).astype(np.float64))
    out[:, 20] = np.log1p(w.counts) / 10.0
    out[:, 21] = w.counts == 0
    out[:, 22] = np.sqrt(out[:, 15])
    out[:, 23] = np.sqrt(out[:, 16])
    if len(size):
        at = np.minimum(size.astype(np.int64), WORD_LENGTHS) - 1
        hist = np.bincount(w.doc * WORD_LENGTHS + at, minlength=c.n * WORD_LENGTHS).reshape(c.n, WORD_LENGTHS)
        out[:, 24:] = hist / n[:, None]
    return out


@dataclass
class Model:
    """A small network on standardised features; ``score`` is between 0 and 1."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8.0, 8.0)
        return np.tanh(z @ self.hidden + self.bias) @ self.out + self.out_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30.0, 30.0)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, width: int = 12, epochs: int = EPOCHS,
           rate: float = RATE, batch: int = BATCH, decay: float = DECAY, seed: int = 11) -> Model:
    """Minimise the non-negative unbiased risk with the sigmoid loss.

    Risk = prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
    Where a batch's bracket is negative, the step raises it again instead
    of following it below zero, so the network cannot fit positives away.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-6] = 1.0
    p, u = (np.clip((x - mean) / scale, -8.0, 8.0) for x in (positive, unlabelled))
    d = p.shape[1]
    theta = [rng.normal(0, 1 / np.sqrt(d), (d, width)), np.zeros(width), rng.normal(0, 1 / np.sqrt(width), width),
             np.zeros(1)]
    moment = [np.zeros_like(t) for t in theta]
    second = [np.zeros_like(t) for t in theta]
    step = 0
    rounds = max(1, -(-max(len(p), len(u)) // batch))
    for _ in range(epochs):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(rounds):
            bp = p[np.take(pi, range(k * batch, (k + 1) * batch), mode="wrap")]
            bu = u[np.take(ui, range(k * batch, (k + 1) * batch), mode="wrap")]
            x = np.concatenate([bp, bu])
            act = np.tanh(x @ theta[0] + theta[1])
            f = act @ theta[2] + theta[3][0]
            s = 1.0 / (1.0 + np.exp(-np.clip(f, -30, 30)))      # loss as negative; 1 - s as positive
            slope = s * (1.0 - s)
            negative = s[len(bp):].mean() - prior * s[:len(bp)].mean()
            g = np.empty(len(x))
            if negative >= 0:
                g[:len(bp)] = -2.0 * prior * slope[:len(bp)] / len(bp)
                g[len(bp):] = slope[len(bp):] / len(bu)
            else:
                g[:len(bp)] = prior * slope[:len(bp)] / len(bp)
                g[len(bp):] = -slope[len(bp):] / len(bu)
            back = np.outer(g, theta[2]) * (1.0 - act ** 2)
            grads = [x.T @ back + decay * theta[0], back.sum(0), act.T @ g + decay * theta[2], np.array([g.sum()])]
            step += 1
            for i, gr in enumerate(grads):
                moment[i] = 0.9 * moment[i] + 0.1 * gr
                second[i] = 0.999 * second[i] + 0.001 * gr ** 2
                theta[i] = theta[i] - rate * (moment[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]))


def _features_udf():
    @F.arrow_udf("array<double>")
    def of(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in cols:
            rows = [r for c in T.chunks(col) for r in features(c)]
            yield pa.array(rows, pa.list_(pa.float64()))
    return of


def _score_udf(shared):
    @F.arrow_udf("double")
    def of(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for col in cols:
            parts = [model.score(features(c)) for c in T.chunks(col)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
    return of


def _some(ids: DataFrame, n: int, most: int) -> DataFrame:
    """At most about ``most`` of ``n`` ids, by a hash of the id."""
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    return ids.where(place < most / n) if n > most else ids


def constant_model(share: float) -> Model:
    """Scores every text alike."""
    share = min(0.99, max(0.01, share))
    return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1),
                 float(np.log(share / (1 - share))))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
          **options) -> Model:
    """Fit on documents whose id satisfies ``may_learn`` (a condition on the
    column ``id``): those labelled 1 are the trusted positives, those without
    a label the unlabelled web text.  Of the other labels only their share
    is used: the class prior is estimated as the mean label.

    Ids, labels and languages are never features.  Labels that are null count
    as none; a document with several labels is positive if one is 1.  Where
    no text is unlabelled the labelled ones stand in for it; without labels
    every score is 0.5, without positives 0.01.  The sampled ids are bounded
    by ``max_positive`` and ``max_unlabelled``, so they are broadcast to one
    scan of the texts, and only the samples' features come to the driver.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
             .where(F.col("label").isNotNull() & F.col("id").isNotNull()).groupBy("id")
             .agg(F.max("label").alias("label")).where(may_learn))
    ids = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).where(may_learn).distinct()
    n, n_pos = known.agg(F.count(F.lit(1)), F.sum((F.col("label") > 0.5).cast("long"))).first()
    if not n_pos:
        return constant_model(0.0 if n else 0.5)
    prior = min(0.99, max(0.01, n_pos / n))
    plain = ids.join(known, "id", "left_anti")
    n_plain = plain.count()
    if not n_plain:
        plain, n_plain = ids, ids.count()
    if not n_plain:
        return constant_model(prior)
    chosen = (_some(known.where("label > 0.5").select("id"), n_pos, max_positive).withColumn("trusted", F.lit(True))
              .unionByName(_some(plain, n_plain, max_unlabelled).withColumn("trusted", F.lit(False))))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    got = (texts.join(F.broadcast(chosen), "id").select("id", "trusted", _features_udf()("text").alias("x"))
           .groupBy("id", "trusted").agg(F.first("x").alias("x")).orderBy("trusted", "id").toPandas())
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES)
    trusted = got["trusted"].to_numpy(bool)
    if not trusted.any() or trusted.all():
        return constant_model(prior)
    return fit_pu(x[trusted], x[~trusted], prior, **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in column ``name``; null
    texts are scored as empty ones.  A projection: nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(name, _score_udf(shared)(text_of(text_col)))
