"""Quality scores by positive-unlabelled learning.

Only trusted positives and unlabelled text are learned from.  A linear model g
minimises the non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the logistic loss l; when the second part, the estimated risk on
negatives, falls below zero, the step goes against it instead.  The
class prior is the best-bin estimate: a classifier of P against U is fitted on
half of either sample, and the prior is the least ratio, over thresholds, of
the shares of the other halves of U and P above it (with a confidence margin).

Features are the byte histogram of the text and measures of its structure:
they do not look at labels, language, source or ids.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut, sampled

#: Sizes of the training sample, about: positives and unlabelled rows, drawn by a hash of their id and text.
#: They reach the driver as feature vectors of N_FEATURES floats.
SAMPLE_POSITIVE = 4000
SAMPLE_UNLABELLED = 8000
N_FEATURES = 256 + 9
#: Standardised features are clipped here.
CLIP = 8


def features(texts: list[str | None]) -> np.ndarray:
    """One row per text; a null text counts as an empty one."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for row, text in zip(out, texts):
        raw = (text or "").encode()
        if not raw:
            continue
        hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        n, letters = max(1, len(words)), max(1, hist[65:91].sum() + hist[97:123].sum())
        row[:256] = np.sqrt(hist / len(raw))
        row[256:] = (np.log1p(len(words)), min(20.0, len(raw) / n) / 10, len(set(words)) / n,
                     sum(map(bytes.__eq__, words, words[1:])) / n, hist[65:91].sum() / letters,
                     1 - len(set(lines)) / max(1, len(lines)), min(1.0, len(lines) / n),
                     (hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()) / len(raw),
                     hist[48:58].sum() / len(raw))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.weight + self.bias)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


def _descend(gradient, d: int, steps: int, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam over (weights, bias) for a fixed number of full-batch steps."""
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        g = gradient(w[:-1], w[-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def _grad(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Gradient of a mean loss over rows whose loss has this slope in g."""
    return np.append(slope @ x, slope.sum()) / len(x)


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 200) -> float:
    """Share of positives in ``u`` (best bin), from standardised features."""
    pa_, pb, ua, ub = p[::2], p[1::2], u[::2], u[1::2]
    w, b = _descend(lambda w, b: _grad(pa_, _sigmoid(pa_ @ w + b) - 1) + _grad(ua, _sigmoid(ua @ w + b))
                    + np.append(0.01 * w, 0), p.shape[1], steps)
    sp, su = np.sort(pb @ w + b), np.sort(ub @ w + b)
    at = sp[:max(1, int(0.95 * len(sp)))]             # thresholds that at least a twentieth of P passes
    qp = 1 - np.searchsorted(sp, at) / len(sp)
    qu = 1 - np.searchsorted(su, at) / len(su)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = np.argmin((qu + margin) / qp)
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


def risk(xp: np.ndarray, xu: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, float]:
    """The two parts of the risk: of positives, and the estimate of that of negatives (which may be below zero)."""
    loss = lambda g: np.logaddexp(0, -g).mean()
    gp, gu = xp @ w + b, xu @ w + b
    return prior * loss(gp), loss(-gu) - prior * loss(-gp)


def gradient(xp: np.ndarray, xu: np.ndarray, prior: float, w: np.ndarray, b: float) -> np.ndarray:
    """The step of non-negative learning: the risk's gradient, or against that of the negative part where it is below zero."""
    sp, su = _sigmoid(xp @ w + b), _sigmoid(xu @ w + b)
    negative = _grad(xu, su) - prior * _grad(xp, sp)
    if risk(xp, xu, prior, w, b)[1] < 0:
        return -negative
    return prior * _grad(xp, sp - 1) + negative


def fit_arrays(p: np.ndarray, u: np.ndarray, steps: int = 400, decay: float = 1e-3) -> Model:
    mean, scale = u.mean(0), np.maximum(u.std(0), 1e-3)
    xp, xu = ((z - mean) / scale for z in (p.astype(float), u.astype(float)))
    xp, xu = np.clip(xp, -CLIP, CLIP), np.clip(xu, -CLIP, CLIP)
    prior = estimate_prior(xp, xu)
    w, b = _descend(lambda w, b: gradient(xp, xu, prior, w, b) + np.append(decay * w, 0), p.shape[1], steps)
    return Model(mean, scale, w, b, prior)


def _featurise():
    @arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(list(features(texts.to_pylist())), pa.list_(pa.float32()))

    return run


def fit(documents: DataFrame, positives: DataFrame, seed: int = 11) -> Model | None:
    """``documents``: doc_id, text, the unlabelled rows; ``positives``: doc_id of
    trusted ones (repeats and nulls do not matter).  None when either is empty.  The same rows in another order
    or partitioning give the same model."""
    ids = cut(sampled(positives.select("doc_id").filter("doc_id IS NOT NULL").distinct(), SAMPLE_POSITIVE, seed))
    d = documents.select("doc_id", "text")
    n = max(1, d.count())
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    drawn = F.pmod(h, F.lit(1 << 30)) < min(1.0, SAMPLE_UNLABELLED / n) * (1 << 30)
    # one scan for both samples; of an id that repeats, one text
    both = d.withColumn("h", h).withColumn("u", drawn).join(F.broadcast(ids.withColumn("p", F.lit(True))), "doc_id", "left").filter("p OR u")
    one = both.groupBy("doc_id").agg(F.min_by(F.struct("text", "u", "p", "h"), F.struct("h", "text")).alias("r")).select("r.*")
    t = one.select("u", "p", "h", _featurise()("text").alias("x")).toArrow().sort_by("h")
    x = np.array(t.column("x").to_pylist(), np.float32).reshape(-1, N_FEATURES)
    p, u = (x[t.column(c).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)] for c in ("p", "u"))
    return fit_arrays(p, u) if len(p) > 1 and len(u) > 1 else None


def score(spark: SparkSession, model: Model | None, text) -> Column:
    """Probability of good quality of a text column (null as empty); 0.5 for every
    text when there was nothing to learn from."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            x = texts.to_pylist()
            yield pa.array(np.full(len(x), 0.5) if m is None else m.score(features(x)), pa.float64())

    return run(text)
