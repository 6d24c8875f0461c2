"""Quality classifier by positive-unlabelled learning.

A linear model of text-shape features minimises the non-negative unbiased risk
    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])
with the logistic loss: trusted positives are documents labelled 1, the unlabelled ones are a sample of the corpus whose
labels are not looked at, and the class prior is estimated from the two samples (no negative label is used). The prior is
the least ratio, over score thresholds, of the unlabelled to the positive share above the threshold, on a held-out part.

Only rows whose crc32(doc_id) mod 4 is not 2 are learnt from. Fitting takes at most ``max_positive`` and
``max_unlabelled`` documents, those with the least seeded hash of their id; every document is scored, over its whole text.

Defined cases: null text counts as empty, and an empty text gets a score like any other; without trusted positives there is
no verdict: every score is the threshold, and every document is kept; null doc_id is held in and scored; repeated rows are scored alike; an empty table gives an empty result; extra
columns are ignored. labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdex.llm.common import sliced, small_batches

SEED = 17
THRESHOLD = 0.7
CLASSES = 16
STOP_WORDS = frozenset(
    b"a an and are as at be by for from have in is it of on or that the this to was with au dans de des du elle en est et il la le "
    b"les pour que qui sur un une auf das dem den der die ein eine im ist mit nicht sich und von zu al como con del el es las lo los "
    b"para por se su y".split()
)
#: Shape class of each byte: lower case, upper case, digit, space, line feed, letters beyond ASCII, and marks by kind.
SHAPE = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", bytes(range(128, 256)), b".,;:", b"!?", b"'\"-()", b"*#", b"$%&", b"|", b"<>{}[]", b"@/\\_", b"=+~^`")):
    SHAPE[list(_chars)] = _k + 1
DENSE = 13
WIDTH = DENSE + CLASSES * CLASSES


def features(text: str | None) -> np.ndarray:
    """Ratios of a text, and the relative frequencies of neighbouring shapes with runs of a shape counted once."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, np.float32)
    words = raw.split()
    n = len(words)
    if not n:
        return out
    shape = SHAPE[np.frombuffer(raw, np.uint8)]
    kinds = np.bincount(shape, minlength=CLASSES)
    size = len(raw)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    lowered = raw.lower().split()
    distinct = len(set(lowered))
    same = sum(map(bytes.__eq__, lowered, lowered[1:]))
    stops = sum(map(STOP_WORDS.__contains__, lowered))
    pairs = len(set(zip(lowered, lowered[1:], lowered[2:])))
    letters = max(1, kinds[1] + kinds[2] + kinds[6])
    out[:DENSE] = (
        np.log1p(n),
        np.log(size / n),
        kinds[2] / letters,
        (kinds[10] + kinds[11] + kinds[12] + kinds[13]) / n,
        kinds[8] / n,
        kinds[3] / size,
        min(1.0, distinct / n ** 0.8),
        same / n,
        stops / n,
        1 - (pairs + 1) / max(1, n - 1) if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        kinds[7] / n,
    )
    keep = np.flatnonzero(np.diff(shape, prepend=shape[0] + 1 if shape[0] < 255 else 0))
    runs = shape[keep].astype(np.int64)
    if len(runs) > 1:
        out[DENSE:] = np.bincount(runs[:-1] * CLASSES + runs[1:], minlength=CLASSES * CLASSES) / (len(runs) - 1)
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -6, 6) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_weights(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk; where its clipped part is negative, the step goes against it."""

    def sig(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        # Derivatives of log(1 + exp(-z)) and of log(1 + exp(z)).
        plus, minus_p, minus_u = -sig(-zp) / len(zp), sig(zp) / len(zp), sig(zu) / len(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp, gu = prior * (plus - minus_p), minus_u
        else:
            gp, gu = prior * minus_p, -minus_u
        g = np.concatenate([gp @ p + gu @ u + decay * w, [gp.sum() + gu.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def estimate_prior(sp: np.ndarray, su: np.ndarray, delta: float = 0.1) -> float:
    """Least ratio of shares above a threshold, each threshold's ratio raised by its sampling error."""
    cuts = np.quantile(sp, np.linspace(0.02, 0.9, 60))
    qp = np.array([(sp >= c).mean() for c in cuts])
    qu = np.array([(su >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / delta) / 2 / len(su)) + np.sqrt(np.log(4 / delta) / 2 / len(sp))
    best = int(np.argmin((qu + slack) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.05, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> Model | None:
    if not len(p) or not len(u):
        return None
    everything = np.concatenate([p, u]).astype(np.float64)
    mean, scale = everything.mean(0), 1 / (everything.std(0) + 1e-2)
    p, u = np.clip((p - mean) * scale, -6, 6), np.clip((u - mean) * scale, -6, 6)
    # Odd rows fit a ranking of positives over unlabelled, even rows estimate the prior with it.
    w, b = fit_weights(p[1::2] if len(p) > 1 else p, u[1::2] if len(u) > 1 else u, 0.5, steps=300)
    prior = estimate_prior(p[::2] @ w + b, u[::2] @ w + b)
    w, b = fit_weights(p, u, prior)
    return Model(mean, scale, w, float(b), prior)


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id's text modulo m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def sample(docs: DataFrame, ids: DataFrame, limit: int) -> np.ndarray:
    """Features of the documents of at most ``limit`` ids, those with the least seeded hash, in the order of their ids; of
    rows that share an id, the least text."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "f": [features(t).tolist() for t in pdf["text"]]})

    chosen = ids.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(limit)
    rows = small_batches(docs).join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.col("text").cast("string")).alias("text"))
    found = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(compute, "doc_id string, f array<float>").toPandas()
    return np.array(found.sort_values("doc_id")["f"].tolist(), np.float32).reshape(-1, WIDTH)


def fit_on(docs: DataFrame, labels: DataFrame, max_positive: int = 6000, max_unlabelled: int = 9000) -> Model | None:
    """Fit on trusted positives and a corpus sample; both sizes are bounds of the sample, nothing else is bounded."""
    train = remainder(F.col("doc_id"), 4) != 2
    texts = docs.select("doc_id", "text")
    positive = sample(texts, labels.where(train & (F.col("quality") == 1)), max_positive)
    unlabelled = sample(texts, texts.where(train), max_unlabelled)
    return fit(positive, unlabelled)


def model_scores(model: Model | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), THRESHOLD)
    parts = [model.score(np.stack([features(t) for t in texts[k : k + 1000]])) for k in range(0, len(texts), 1000)]
    return np.concatenate([np.empty(0), *parts])


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every document."""
    kind = docs.schema["doc_id"].dataType

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model_scores(model, pdf["text"].tolist())})

    cast = small_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cast.mapInPandas(compute, "doc_id string, score double").select(F.col("doc_id").cast(kind), "score")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit_on(docs, labels)).select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold; scoring and filtering run in one pass over the rows."""
    model = fit_on(docs, labels)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(model_scores(model, batch.column(at).to_pylist()) >= threshold))

    return docs if model is None else small_batches(docs).mapInArrow(keep, docs.schema)
