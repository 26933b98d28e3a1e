"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and word beginnings (of STEMS bytes, of longer words),
hashed into BUCKETS. The buckets that tell the classes apart best in the training sample
are kept, and of the others the frequent ones that do so in pairs. The machine adds to a linear score the interactions of every two terms present:
y = w0 + sum w_i + c sum_{i<j} <v_i, v_j>, computed in linear time. c is 1 up to PAIRS_FULL terms in use and falls with their number
beyond, so that the pairs of a long text don't grow with its square. It finds pairs, such as an
insult beside the mention of a group, that separate weights miss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _text as T
from quillon.llm._tables import quoted, release, sampled_texts, save
from quillon.llm.bt_quality import bounded_labels

SAMPLE_PER_CLASS = 5000
BUCKETS = 1 << 20
TERMS = 4096
FACTORS = 8
STEMS = (4, 5, 6, 7, 8)
#: Least z-score of the difference of a term's shares in the two classes.
LEAST_Z = 3.0
#: Of the terms below it, so many of the most frequent are tried in pairs, and kept from this z-score of a pair's shares on.
FREQUENT = 2048
PAIR_Z = 6.0
#: With more terms in use than this in a text, its sum of pairs is scaled down.
PAIRS_FULL = 128


def terms(texts: list[bytes], slot: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Distinct buckets of each text, sorted; with slot (-1: not in use) their slots instead."""
    for lo, hi in T.chunks(texts):
        w = T.Words(texts[lo:hi], T.ALNUM, lower=True)
        streams = [((w.h & np.uint64(BUCKETS - 1)).astype(np.int32), np.arange(len(w.h)))]
        size, low = w.end - w.start, np.zeros(len(w.start), dtype=np.uint64)
        for j in range(max(STEMS)):
            c = w.buf[np.minimum(w.start + j, len(w.buf) - 1)].astype(np.uint64)
            low = low * np.uint64(257) + np.where((c >= 65) & (c <= 90), c + np.uint64(32), c)
            if j + 1 in STEMS:
                long_ = np.flatnonzero(size > j + 1)
                streams.append(((T.mix64(low[long_] + np.uint64(j)) & np.uint64(BUCKETS - 1)).astype(np.int32), long_))
        if slot is not None:
            streams = [(s[k], at[k]) for s, at in ((slot[s], at) for s, at in streams) for k in [np.flatnonzero(s >= 0)]]
        cuts = [np.searchsorted(at, w.first) for _, at in streams]
        for i in range(hi - lo):
            yield np.unique(np.concatenate([s[cut[i] : cut[i + 1]] for (s, _), cut in zip(streams, cuts, strict=True)]))


def pair_scale(n):
    return PAIRS_FULL / np.maximum(PAIRS_FULL, n)


@dataclass
class Model:
    buckets: np.ndarray  # sorted buckets in use
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        slot = np.full(BUCKETS, -1, dtype=np.int32)
        slot[self.buckets] = np.arange(len(self.buckets))
        out = np.full(len(texts), self.w0)
        for i, at in enumerate(terms(texts, slot)):
            if len(at):
                v = self.v[at]
                out[i] += self.w[at].sum() + 0.5 * pair_scale(len(at)) * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def screen(buckets: np.ndarray, clean: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """Of buckets that `clean` and `toxic` documents hold, of n0 and n1: those whose shares in the two classes differ by LEAST_Z or more (TERMS
    at most), and the most frequent of the others (FREQUENT at most). At least 3 documents must hold one."""
    n0, n1 = max(1, n0), max(1, n1)
    p = (clean + toxic) / (n1 + n0)
    z = np.abs(toxic / n1 - clean / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[clean + toxic < 3] = 0
    order = np.lexsort((buckets, -z))
    best = order[: np.count_nonzero(z > LEAST_Z)][:TERMS]
    rest = np.flatnonzero((z <= LEAST_Z) & (clean + toxic >= 3))
    rest = rest[np.lexsort((buckets[rest], -(clean + toxic)[rest]))][:FREQUENT]
    return np.sort(buckets[best]), np.sort(buckets[rest])


def select(docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Buckets to use: those that tell the classes apart, and the frequent ones of which that is true only in pairs."""
    count = [np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)]
    for d, y in zip(docs, toxic, strict=True):
        count[int(y)][d] += 1
    best, common = screen(np.arange(BUCKETS), *count, int((~toxic).sum()), int(toxic.sum()))
    return np.union1d(best, paired(docs, toxic, common))


def paired(docs: list[np.ndarray], toxic: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Buckets of `among` in a pair whose shares in the two classes differ by PAIR_Z or more; 5 pairs must be expected in the smaller class."""
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    slot = np.full(BUCKETS, -1, dtype=np.int64)
    slot[among] = np.arange(len(among))
    both = [np.zeros((len(among), len(among)), dtype=np.float32) for _ in range(2)]
    for y in range(2):
        mine = np.flatnonzero(toxic == bool(y))
        for lo in range(0, len(mine), 1000):
            x = np.zeros((len(mine[lo : lo + 1000]), len(among)), dtype=np.float32)
            for i, d in enumerate(mine[lo : lo + 1000]):
                at = slot[docs[d]]
                x[i, at[at >= 0]] = 1
            both[y] += x.T @ x
    p = (both[0] + both[1]) / (n1 + n0)
    z = np.abs(both[1] / n1 - both[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[p * min(n1, n0) < 5] = 0
    np.fill_diagonal(z, 0)
    return among[z.max(1, initial=0) > PAIR_Z]


def segment_sums(sizes: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The sums of consecutive runs of an array, of these sizes (0 for an empty run)."""
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]

    def sums(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes))
        if len(some):
            out[some] = np.add.reduceat(x, starts)
        return out

    return sums


def fit(docs: list[np.ndarray], toxic: np.ndarray, buckets: np.ndarray | None = None, rounds: int = 200, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Adam on the class-balanced logistic loss, full batches."""
    buckets = (select(docs, toxic) if buckets is None else buckets).astype(np.int64)
    slot = np.full(BUCKETS, -1, dtype=np.int64)
    slot[buckets] = np.arange(len(buckets))
    held = [slot[d][slot[d] >= 0] for d in docs]
    sizes = np.array([len(h) for h in held], dtype=np.int64)
    rng = np.random.default_rng(2)
    par = [np.zeros(1), np.zeros(len(buckets)), rng.normal(0, 0.05, (len(buckets), FACTORS))]
    if not len(docs) or not len(buckets) or not toxic.any() or toxic.all():
        return Model(buckets[:0], -3.0, np.zeros(0), np.zeros((0, FACTORS)))
    flat, row = np.concatenate(held), np.repeat(np.arange(len(docs)), sizes)
    by_slot = np.argsort(flat, kind="stable")
    per_doc = segment_sums(sizes)
    per_slot = segment_sums(np.bincount(flat, minlength=len(buckets)))
    row_by_slot = row[by_slot]
    scale = pair_scale(sizes)
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    m = [np.zeros_like(p) for p in par]
    s = [np.zeros_like(p) for p in par]
    for t in range(1, rounds + 1):
        w0, w, v = par
        total = np.stack([per_doc(x[flat]) for x in np.ascontiguousarray(v.T)], axis=1)
        y = w0[0] + per_doc(w[flat]) + 0.5 * scale * ((total**2).sum(1) - per_doc((v**2).sum(1)[flat]))
        g = weight * (1 / (1 + np.exp(-np.clip(y, -30, 30))) - toxic)
        c = g * scale
        mixed = np.stack([per_slot(x[row_by_slot]) for x in np.ascontiguousarray((total * c[:, None]).T)], axis=1)
        grads = [np.array([g.sum()]), per_slot(g[row_by_slot]) + decay * w, mixed - v * per_slot(c[row_by_slot])[:, None] + decay * v]
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            s[i] = 0.999 * s[i] + 0.001 * gr**2
            par[i] = par[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return Model(buckets, float(par[0][0]), par[1], par[2])


def learn(sample: DataFrame) -> Model:
    """sample (id, label, text): terms are counted on the executors; the driver gets their counts (BUCKETS at most), then the few terms in
    question of each text (TERMS + FREQUENT at most)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)]
        for batch in batches:
            labels = batch.column(0).to_numpy()
            for y, t in zip(labels, terms(T.texts_of(batch.column(1))), strict=True):
                total[int(y == 1)][t] += 1
        at = np.flatnonzero(total[0] + total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["b", "c0", "c1"])

    size = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    counted = sample.select("label", "text").mapInArrow(count, "b long, c0 long, c1 long").groupBy("b").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where("c0 + c1 >= 3").toArrow()
    best, common = screen(*(counted.column(c).to_numpy().copy() for c in ("b", "c0", "c1")), size.get(0, 0), size.get(1, 0))
    asked = np.union1d(best, common).astype(np.int64)

    def held(t: pa.Array) -> pa.Array:
        slot = np.full(BUCKETS, -1, dtype=np.int32)
        slot[asked] = np.arange(len(asked))
        return pa.array([x.astype(np.int16) for x in terms(T.texts_of(t), slot)], pa.list_(pa.int16()))

    got = sample.select("id", "label", F.arrow_udf(held, "array<smallint>")("text").alias("t")).orderBy(F.xxhash64("id"), "id", "label").toArrow()
    flat = got.column("t").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    offs, vals = flat.offsets.to_numpy(), asked[flat.values.to_numpy().astype(np.int64)]
    docs, toxic = [vals[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)], got.column("label").to_numpy() == 1
    return fit(docs, toxic, np.union1d(best, paired(docs, toxic, common)))


def fm_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS, keep: list[str] | None = None) -> DataFrame:
    """docs, and labels (id, label: 1 toxic, 0 not, other or null ignored) -> the columns `keep` (id_col if none
    are named) of every row, `score` (0 to 1) and `predicted` (1 if score >= threshold).

    Null texts count as empty. Without labels of both classes every score is that of the constant term. Repeated rows are scored alike; where
    labelled ids repeat, one text counts. Very long texts are scored whole, by their distinct terms. An empty table gives no
    row. Extra columns are ignored; `keep` must not hold `score` or `predicted`.
    """
    keep = [id_col] if keep is None else keep
    some = bounded_labels(labels.where("label in (0, 1) and id is not null").select("id", "label"), per_class)
    sample = save(sampled_texts(docs, some, id_col, text_col), "sample")
    model = learn(sample)
    release(sample)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:
            yield pa.array(model.scores(T.texts_of(t)), pa.float64())

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = docs.select(*map(quoted, keep), F.arrow_udf(score, "double")(F.col(quoted(text_col))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
