"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Tokens are white-space words; each is tagged toxic or not. A token's potential is the sum of the weights of its features
(its normal form and the prefixes of that), neighbouring tags have transition weights, and training maximises the
likelihood of labelled tokens. Token labels come from document labels: in documents labelled toxic, the tokens with a
feature far more frequent among those documents than among the others are toxic; all else is not.
Forward-backward marginals give each token's probability; a document's score is a logistic function of their sum, maximum
and density, calibrated on labelled documents that the field was not fitted on.

The recursions of both passes are products of 2 x 2 matrices with resets between documents, so a batch of documents of any
lengths runs as equal blocks in lockstep, exactly.

Only rows whose crc32(doc_id) mod 5 is not 0 are learnt from; fitting takes at most ``max_toxic`` and ``max_clean``
labelled documents of at most ``max_bytes`` each, those with the least seeded hash of their id, one of each group of near
copies of a label, and stops adding documents of a label at half of ``max_words``. Every document is scored over its whole text.

Defined cases: null, empty and blank texts have no tokens and get the score of no toxic token; without a toxic label every
score is 0; null doc_id is held in (its text counts as empty); repeated rows are scored alike; an empty table gives an empty
result; extra columns are ignored. labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdex.llm.common import small_batches
from semdex.llm.pu_quality import remainder

SEED = 29
THRESHOLD = 0.5
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PREFIXES = (3, 4, 5, 6, 7, 8)
CACHE_WORDS = 500_000
BATCH_TOKENS = GROUP_TOKENS = 200_000
#: Words of the documents that fit the field and its calibration.
MAX_WORDS = 400_000


def token_features(word: str) -> tuple[str, ...]:
    """The normal form of a word and, marked by a leading caret, its prefixes."""
    form = EDGE.sub("", word.lower())
    return (form, *("^" + form[:n] for n in PREFIXES if len(form) >= n)) if form else ()


def scan(m: np.ndarray) -> np.ndarray:
    """v[:, t] = M[t] v[:, t - 1] / its sum, v[:, -1] = (1, 1), where m[:, t] are the entries of M[t] by rows; m is (4, n).

    Rows of a near-square grid hold equal blocks; all blocks' products are formed in lockstep, then the vectors entering
    each block in order, then all vectors in lockstep.
    """
    n = m.shape[1]
    if not n:
        return np.empty((2, 0))
    cols = max(1, math.isqrt(n))
    rows = -(-n // cols)
    full = np.zeros((4, rows * cols))
    full[:, :n] = m
    full[0, n:] = full[3, n:] = 1.0
    steps = np.ascontiguousarray(full.reshape(4, rows, cols).transpose(2, 0, 1))
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for c, (a, b, d, e) in enumerate(steps):
        p, q, r, s = a * p + b * r, a * q + b * s, d * p + e * r, d * q + e * s
        if c % 4 == 3:
            z = 1 / (p + q + r + s)
            p, q, r, s = p * z, q * z, r * z, s * z
    entering = np.empty((2, rows))
    x, y = 0.5, 0.5
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        entering[:, k] = x, y
        x, y = pk * x + qk * y, rk * x + sk * y
        x, y = x / (x + y), y / (x + y)
    out = np.empty((cols, 2, rows))
    v, w = entering
    for c, (a, b, d, e) in enumerate(steps):
        v, w = a * v + b * w, d * v + e * w
        z = 1 / (v + w)
        v, w = v * z, w * z
        out[c, 0], out[c, 1] = v, w
    return out.transpose(1, 2, 0).reshape(2, -1)[:, :n]


def marginals(emit: np.ndarray, first: np.ndarray, start: float, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of tag 1 for each token, with the forward and backward vectors, both (2, n).

    emit: log-potential of tag 1 against 0; first: True where a document begins; start: log-potential of beginning with
    tag 1; trans[i, j]: log-potential of tag j after tag i.
    """
    e, w = np.exp(np.clip(emit, -30, 30)), np.exp(trans)
    n = len(e)
    if not n:
        return np.empty(0), np.empty((2, 0)), np.empty((2, 0))
    m = np.empty((4, n))
    # Rows: new tag; columns: previous tag.
    m[0], m[1], m[2], m[3] = w[0, 0], w[1, 0], e * w[0, 1], e * w[1, 1]
    m[:2, first] = 1.0
    m[2:, first] = e[first] * math.exp(start)
    alpha = scan(m)
    after = np.append(e[1:], 1.0)
    # Rows: this tag; columns: next tag.
    m[0], m[1], m[2], m[3] = w[0, 0], after * w[0, 1], w[1, 0], after * w[1, 1]
    m[:, np.append(first[1:], True)] = 1.0
    beta = scan(m[:, ::-1])[:, ::-1]
    both = alpha * beta
    return both[1] / (both[0] + both[1]), alpha, beta


@dataclass
class Field:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    start: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(4))
    fitted: bool = False

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in token_features(word))

    def score(self, sums: np.ndarray, most: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(n))
        return 1 / (1 + np.exp(-np.clip(summary(sums, most, n) @ self.scale, -40, 40)))


def summary(sums: np.ndarray, most: np.ndarray, n: np.ndarray) -> np.ndarray:
    density = np.minimum(100 * sums / np.maximum(n, 1), 10)
    return np.stack([np.ones(len(n)), np.log1p(sums), most, np.log1p(density)], axis=1)


class Emissions(dict):
    """Emissions by word, emptied when full."""

    def __init__(self, model: Field):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        x = self[word] = self.model.emission(word)
        return x


def tag_batch(model: Field, cache: Emissions, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sum and maximum of the token marginals and token count of each document, and the marginals of all tokens."""
    n = np.array([len(t) for t in texts])
    total = int(n.sum())
    emit = np.fromiter((cache[w] for t in texts for w in t), np.float64, total)
    ends = np.cumsum(n)
    first = np.zeros(total, bool)
    first[(ends - n)[n > 0]] = True
    p, _, _ = marginals(emit, first, model.start, model.trans)
    sums, most = np.zeros(len(n)), np.zeros(len(n))
    if total:
        at = (ends - n)[n > 0]
        sums[n > 0], most[n > 0] = np.add.reduceat(p, at), np.maximum.reduceat(p, at)
    return sums, most, n, p


MIXERS = np.random.default_rng(SEED).integers(1 << 32, 1 << 62, 18, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def near_keys(words: list[str]) -> list[bytes]:
    """Six keys of three min-hashes of the five-word shingles each: near copies (0.8 or more alike) share one in 98 cases of 100."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    h = np.array([xxhash.xxh64_intdigest(b" ".join(raw[k : k + 5])) for k in range(max(1, len(raw) - 4))], np.uint64)
    least = [((h * m) ^ ((h * m) >> np.uint64(31))).min() for m in MIXERS]
    return [bytes([k]) + np.array(least[3 * k : 3 * k + 3]).tobytes() for k in range(6)]


def expected_gap(emit: np.ndarray, first: np.ndarray, start: float, trans: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """What the tags have beyond their expectation: by token, at document starts, and by pair of neighbouring tags."""
    p, alpha, beta = marginals(emit, first, start, trans)
    inner = ~first[1:]
    ahead = beta[:, 1:][:, inner] * np.stack([np.ones(inner.sum()), np.exp(np.clip(emit[1:][inner], -30, 30))])
    joint = alpha[:, :-1][:, inner][:, None, :] * np.exp(trans)[:, :, None] * ahead[None]
    pairs = -(joint / joint.sum(axis=(0, 1))).sum(axis=2)
    pairs += np.bincount(2 * tags[:-1][inner] + tags[1:][inner], minlength=4).reshape(2, 2)
    return tags - p, float((tags[first] - p[first]).sum()), pairs


def fit_field(docs: list[list[str]], toxic: np.ndarray, steps: int = 80, decay: float = 0.02) -> Field:
    """Label tokens from the documents' labels, then maximise their likelihood by Adam, until the gradient has fallen to a
    hundredth or the steps are used up."""
    found = [Counter(), Counter()]
    for words, y in zip(docs, toxic):
        found[int(y)].update({f for w in set(words) for f in token_features(w)})
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    seeds = {
        f for f, k in found[1].items() if k >= 3 and math.log((k + 0.5) / (n1 + 1)) - math.log((found[0][f] + 0.5) / (n0 + 1)) >= 2.5
    }
    model = Field()
    if not seeds or not n0:
        return model
    vocabulary = {w: k for k, w in enumerate(sorted({w for words in docs for w in words}))}
    own: dict[str, int] = {}
    flat, at = [], [0]
    labelled = np.zeros(len(vocabulary), bool)
    useful = seeds | {f for f, k in found[0].items() if k >= 3} | {f for f, k in found[1].items() if k >= 3}
    for w, k in vocabulary.items():
        fs = token_features(w)
        labelled[k] = any(f in seeds for f in fs)
        flat += [own.setdefault(f, len(own)) for f in fs if f in useful]
        at.append(len(flat))
    flat_, counts = np.array(flat, np.int64), np.diff(at)
    of_word = np.repeat(np.arange(len(vocabulary)), counts)
    n = np.array([len(t) for t in docs])
    ids = np.fromiter((vocabulary[w] for t in docs for w in t), np.int64, int(n.sum()))
    first = np.zeros(len(ids), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    tags = labelled[ids] & np.repeat(toxic.astype(bool), n)
    # Whole documents in groups of about GROUP_TOKENS tokens, so that only one group's vectors are in memory at once.
    ends = np.cumsum(n)
    cuts = [0, *ends[np.flatnonzero(np.diff(ends // GROUP_TOKENS))].tolist(), len(ids)]
    groups = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
    theta = np.zeros(len(own) + 6)
    theta[len(own)] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = max(1.0, tags.sum())
    steepest = 0.0
    for t in range(1, steps + 1):
        per_word = np.bincount(of_word, theta[flat_], len(vocabulary)) + theta[len(own)]
        g_word, g_start, g_pair = np.zeros(len(vocabulary)), 0.0, np.zeros((2, 2))
        for group in groups:
            over, at_start, pairs = expected_gap(per_word[ids[group]], first[group], theta[len(own) + 1], theta[len(own) + 2 :].reshape(2, 2), tags[group])
            g_word += np.bincount(ids[group], over, len(vocabulary))
            g_start, g_pair = g_start + at_start, g_pair + pairs
        g = np.concatenate([np.bincount(flat_, g_word[of_word], len(own)), [g_word.sum(), g_start], g_pair.ravel()])
        g = g / scale - decay * np.append(theta[: len(own)], np.zeros(6)) * 0.05
        slope = float(np.sqrt(g @ g))
        steepest = max(steepest, slope)
        if slope <= 0.01 * steepest:
            break
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights = {f: float(theta[k]) for f, k in own.items() if abs(theta[k]) > 1e-3}
    model.bias, model.start, model.trans = float(theta[len(own)]), float(theta[len(own) + 1]), theta[len(own) + 2 :].reshape(2, 2).copy()
    return model


def fit_scale(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: Iterable[tuple[str | None, int]], max_words: int = MAX_WORDS) -> Field:
    """Two thirds of the documents (after near copies of a label are reduced to one) fit the field, the others its calibration."""
    seen: set[tuple[int, bytes]] = set()
    docs, toxic, room = [], [], [max_words // 2, max_words // 2]
    for text, y in rows:
        words = (text or "").split()
        keys = {(int(y), k) for k in near_keys(words)}
        if len(words) > room[int(y)] or keys & seen:
            continue
        seen |= keys
        room[int(y)] -= len(words)
        docs.append(words)
        toxic.append(int(y))
    toxic = np.array(toxic, np.int64)
    if not toxic.sum():
        return Field()
    rank = np.empty(len(toxic), np.int64)
    for y in (0, 1):
        rank[toxic == y] = np.arange((toxic == y).sum())
    hold = rank % 3 == 2
    model = fit_field([d for d, h in zip(docs, hold) if not h], toxic[~hold])
    if not model.weights or not toxic[hold].sum() or toxic[hold].all():
        return model
    own = [d for d, h in zip(docs, hold) if h]
    sums, most, n, _ = tag_batch(model, Emissions(model), own)
    model.scale = fit_scale(summary(sums, most, n), toxic[hold].astype(float))
    model.fitted = True
    return model


def fit_on(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 3000, max_bytes: int = 16384, max_words: int = MAX_WORDS) -> Field:
    """Fit on a bounded sample of labelled documents, of rows that share an id the least text; the bounds hold for the sample
    only, and (max_toxic + max_clean) * max_bytes bounds what comes to the driver."""
    train = labels.where((remainder(F.col("doc_id"), 5) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = None
    for y, limit in ((1, max_toxic), (0, max_clean)):
        some = train.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic") == y).orderBy(order, "doc_id").limit(limit)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    # At most max_toxic + max_clean ids.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(order, "doc_id")
    return fit(((r["text"], r["toxic"]) for r in found.collect()), max_words)


def in_batches(texts: Iterable[str | None]) -> Iterator[tuple[list[str | None], list[list[str]]]]:
    """Groups of texts with their words, of about BATCH_TOKENS words."""
    group, own, size = [], [], 0
    for text in texts:
        words = (text or "").split()
        if group and size + len(words) > BATCH_TOKENS:
            yield own, group
            group, own, size = [], [], 0
        group.append(words)
        own.append(text)
        size += len(words)
    if group:
        yield own, group


Span = tuple[int, int, float]


def spans_at(text: str | None, p: np.ndarray, least: float = 0.5) -> list[Span]:
    """Character offsets [begin, end) of maximal runs of words at or above a probability, with the run's highest; p: of each word."""
    if not len(p) or p.max() < least:
        return []
    out: list[Span] = []
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if p[k] >= least:
            if k and p[k - 1] >= least:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[k])))
            else:
                out.append((m.start(), m.end(), float(p[k])))
    return out


def spans(text: str | None, model: Field, least: float = 0.5) -> list[Span]:
    return spans_at(text, tag_batch(model, Emissions(model), [(text or "").split()])[3], least)


SCORED = "score double, spans array<struct<begin: long, end: long, p: double>>"


def tagged(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score and toxic spans (begin, end, probability) of every document, from one run of marginals."""
    kind = docs.schema["doc_id"].dataType

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Emissions(model)
        for pdf in batches:
            scores, found = [np.empty(0)], []
            for texts, group in in_batches(pdf["text"]):
                sums, most, n, p = tag_batch(model, cache, group)
                scores.append(model.score(sums, most, n))
                ends = np.cumsum(n)
                for k, text in enumerate(texts):
                    own = spans_at(text, p[ends[k] - n[k] : ends[k]]) if most[k] >= 0.5 else ()
                    found.append([{"begin": a, "end": b, "p": x} for a, b, x in own])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.concatenate(scores), "spans": pd.Series(found, index=pdf.index, dtype=object)})

    cast = small_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cast.mapInPandas(compute, "doc_id string, " + SCORED).withColumn("doc_id", F.col("doc_id").cast(kind))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out, predicted = remainder(F.col("doc_id"), 5) == 0, F.col("score") >= THRESHOLD
    return tagged(docs, fit_on(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", predicted.cast("int").alias("predicted"), "spans")
