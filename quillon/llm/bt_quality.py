"""Quality scores by Bradley-Terry ranking.

Preference pairs (a document marked good over one marked bad) are turned into feature
differences; logistic loss on them gives one weight per feature, so that
P(a preferred over b) = sigmoid(w . (x_a - x_b)). Features are character and repetition rates of the
text, and the shares of its words in LEXICAL hashed buckets. A document's raw score is w . x. The
decision is a score quantile: the raw scores of all labelled training rows are put in order, and the line
lies where as many are below it as are marked bad: midway between the scores MARGIN below and above that rank (the
neighbours of the rank, if rows are few). Scores are shifted so that this line is at `threshold`. Both scores
are exact, found by counting in four steps of 16 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _text as T
from quillon.llm._sieve import Sieve
from quillon.llm._tables import fresh, quoted, release, sampled_texts, save

#: At most so many labelled rows of each class are used to fit the weights (the first by hash of the id).
SAMPLE_PER_CLASS = 3000
#: Good documents that each bad one of the sample is compared with, and the other way round.
OPPONENTS = 8

_CLASSES = ["!", "#$%&*@^~", "|", "<>", "{}[]();=", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".", ",", "\n", "?"]
_MASK = np.array([[chr(b) in c for b in range(256)] for c in _CLASSES]).T.astype(np.float64)
#: Buckets of hashed words; their weights are held back by a stronger ridge.
LEXICAL = 192
LEXICAL_RIDGE = 100.0
#: The line lies midway between the two scores that stand this share of the labelled rows below and above the last one marked bad.
MARGIN = 0.004
RATES = ["words", "word_bytes", *(f"rate_{i}" for i in range(len(_CLASSES))), "non_ascii", "stuck", "distinct", "windows", "top_share"]
FEATURES = [*RATES, *(f"words_{i}" for i in range(LEXICAL))]


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text; empty texts have zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi in T.chunks(texts):
        w = T.Words(texts[lo:hi], T.NON_BLANK, lower=True)
        five = T.runs(w.h, 5)
        for i in range(hi - lo):
            a, b = w.first[i], w.first[i + 1]
            n = int(b - a)
            if not n:
                continue
            hist = np.bincount(w.buf[w.offsets[i] : w.offsets[i + 1] - 1], minlength=256).astype(np.float64)
            h = np.sort(w.h[a:b])
            runs = np.diff(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))))
            grams = five[a : max(a, b - 4)]
            row = out[lo + i]
            row[0] = np.log1p(n)
            row[1] = np.log1p(hist.sum() / n)
            row[2 : 2 + len(_CLASSES)] = np.log1p(100 * (hist @ _MASK) / n)
            k = 2 + len(_CLASSES)
            row[k] = hist[128:].sum() / hist.sum()
            row[k + 1] = np.log1p(100 * np.count_nonzero(w.h[a + 1 : b] == w.h[a : b - 1]) / n)
            row[k + 2] = len(runs) / n
            row[k + 3] = len(np.unique(grams)) / len(grams) if len(grams) else 1.0
            row[k + 4] = runs.max() / n
            row[len(RATES) :] = np.bincount((w.h[a:b] >> np.uint64(32)).astype(np.int64) % LEXICAL, minlength=LEXICAL) / n
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def raw(self, texts: list[bytes] | T.Texts) -> np.ndarray:
        parts = (features(texts[lo:hi]) for lo, hi in T.chunks(texts, 1 << 22))
        return np.concatenate([np.zeros(0), *(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights for x in parts)])


def fit(x: np.ndarray, good: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> Model:
    """Newton steps on the logistic loss of feature differences of sampled preference pairs."""
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z = np.clip((x - mean) / scale, -8, 8)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    w = np.zeros(len(FEATURES))
    hold = np.where(np.arange(len(w)) < len(RATES), ridge, LEXICAL_RIDGE)
    if len(up) and len(down):
        rng = np.random.default_rng(1)
        a = np.concatenate((rng.choice(up, (len(down), OPPONENTS)).ravel(), np.repeat(up, OPPONENTS)))
        b = np.concatenate((np.repeat(down, OPPONENTS), rng.choice(down, (len(up), OPPONENTS)).ravel()))
        parts = [slice(i, i + 8192) for i in range(0, len(a), 8192)]
        for _ in range(rounds):
            grad, hess = hold * w, np.diag(hold)
            for part in parts:
                d = z[a[part]] - z[b[part]]
                p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                grad += d.T @ (p - 1)
                hess += (d * (p * (1 - p))[:, None]).T @ d
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
    return Model(mean, scale, w)


def train(labelled: DataFrame) -> Model:
    """labelled (id, text, label): fits on a bounded sample; only feature vectors reach the driver."""

    def vec(t: pa.Array) -> pa.Array:
        out = pa.array(list(features(T.texts_of(t)).astype(np.float32)), pa.list_(pa.float32()))
        T.give_back()
        return out

    got = labelled.select("label", F.arrow_udf(vec, "array<float>")("text").alias("x")).toArrow()
    x = got.column("x").combine_chunks()
    x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy().astype(np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got.column("label").to_numpy()))  # the same whatever order rows arrive in
    return fit(x[order], got.column("label").to_numpy()[order] == 1)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers x."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~(bits & np.int64(0x7FFFFFFFFFFFFFFF)), bits)


def of_rank(bits: DataFrame, rank: int) -> float:
    """The number that stands at `rank` (from 0) of all rows of `bits` (column bits): its 64 bits are found 16 at a time, each step an
    aggregate of 65,536 groups at most."""
    found, shift = None, 48
    while shift >= 0:
        rows = bits if found is None else bits.where(F.shiftright("bits", shift + 16) == found)
        counts = rows.groupBy(F.shiftright("bits", shift).alias("top")).count().orderBy("top").collect()
        for r in counts:
            if rank < r["count"]:
                found = r.top
                break
            rank -= r["count"]
        shift -= 16
    x = np.array([found], dtype=np.int64)
    return float(np.where(x < 0, ~x | np.int64(-0x8000000000000000), x).view(np.float64)[0])


def bounded_labels(labels: DataFrame, per_class: int) -> DataFrame:
    """labels (id, label 0/1): the first rows of each class by hash of the id."""
    one = lambda k: labels.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class)
    return one(0).unionAll(one(1))


def bt_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS, keep: list[str] | None = None) -> DataFrame:
    """docs, and labels (id, label: 1 good, 0 bad, other or null ignored) -> the columns `keep` (id_col if
    none are named) of every row, `score` (0 to 1) and `predicted` (1 if score >= threshold).

    Null and empty texts score alike. Rows with repeated ids are scored one by one. Rows that tie at the line are accepted. Without labels of
    both classes every weight is 0 and every score is `threshold`. Very long texts are scored whole. An empty table gives no row. Extra
    columns are ignored; `keep` must not hold `score` or `predicted`.
    """
    keep = [id_col] if keep is None else keep
    labels = labels.where("label in (0, 1) and id is not null").select("id", "label")
    model = train(sampled_texts(docs, bounded_labels(labels, per_class), id_col, text_col))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:
            yield pa.array(model.raw(T.texts_of(t)), pa.float64())
            T.give_back()

    # The line: only texts that may be labelled are scored for it. One function does both, so that a task has one worker.
    sieve = Sieve(labels.select(F.xxhash64("id").alias("k")), "k")

    def bits(k: pa.Array, t: pa.Array) -> pa.Array:
        at = pa.array(np.flatnonzero(sieve.mask(k.to_numpy(zero_copy_only=False))))
        found = ordered_bits(model.raw(T.texts_of(t.take(at))))
        T.give_back()
        return pa.array(found).take(pc.index_in(pa.array(np.arange(len(t))), at))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    known = texts.select("id", F.arrow_udf(bits, "long")(F.xxhash64("id"), "text").alias("bits")).where("bits is not null")
    seen = save(known.join(labels, "id").select("bits", "label"), "labelled")
    total = seen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("label") == 0).cast("long")), F.lit(0)).alias("bad")).first()
    line = 0.0
    if 0 < total.bad < total.n:
        around = int(MARGIN * total.n)
        line = (of_rank(seen, max(0, total.bad - 1 - around)) + of_rank(seen, min(total.n - 1, total.bad + around))) / 2
    release(seen)
    base = float(np.log(threshold / (1 - threshold)))
    x = fresh(keep, "_raw")
    out = docs.select(*map(quoted, keep), F.arrow_udf(score, "double")(F.col(quoted(text_col))).alias(x))
    s = 1 / (1 + F.exp(-(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col(x) - line)) + base)))
    s = F.when(F.col(x) >= line, F.greatest(s, F.lit(threshold))).otherwise(F.least(s, F.lit(float(np.nextafter(threshold, 0)))))
    return out.select(*map(quoted, keep), s.alias("score"), (F.col(x) >= line).cast("int").alias("predicted"))
