"""Language identification of mixed text.

Letters' script ranges narrow the candidates of each word to the languages that use the script
in the training texts. A word's score for a language is the log-likelihood of its byte trigrams.
Viterbi decoding over the words, with a penalty for every switch, labels spans; a text's
language is the one whose spans hold most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _text as T
from quillon.llm._tables import fresh, quoted

#: Training rows: at most so many texts of each language, dealt by hash of the id.
SAMPLE_PER_LANG = 2000
#: All languages are learned. Beyond so many each has fewer texts, so that ids of the sample stay below 512 * 2000.
MAX_LANGS = 512
BUCKETS = 1 << 16
#: Bytes of texts decoded together: long texts set the number of steps, so many share them.
DECODED_BYTES = 1 << 23
#: Log-odds that a switch of language costs.
PENALTY = 12.0
#: A language is a candidate for a script if so large a share of its training words is written in it.
LEAST_SHARE = 0.001
#: First code points of the ranges of scripts; a word belongs to the range of its first letter that is not ASCII, else to Latin.
SCRIPTS = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0780, "other"),
    (0x0900, "devanagari"),
    (0x0980, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "latin"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD800, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x20000, "han"),
    (0x30000, "other"),
]
_NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT_AT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_LATIN = _NAMES.index("latin")


def scripts(w: T.Words) -> np.ndarray:
    """Script number of each word."""
    out = np.full(len(w.start), _LATIN)
    lead = np.flatnonzero(w.buf >= 0xC0)
    if len(lead) and len(out):
        b = w.buf[np.minimum(lead[:, None] + np.arange(4), len(w.buf) - 1)].astype(np.int64)
        code = np.select([b[:, 0] < 0xE0, b[:, 0] < 0xF0], [(b[:, 0] & 31) << 6 | (b[:, 1] & 63), (b[:, 0] & 15) << 12 | (b[:, 1] & 63) << 6 | (b[:, 2] & 63)], (b[:, 0] & 7) << 18 | (b[:, 1] & 63) << 12 | (b[:, 2] & 63) << 6 | (b[:, 3] & 63))
        word = np.searchsorted(w.start, lead, side="right") - 1
        inside = (word >= 0) & (lead < w.end[word])
        word, first = np.unique(word[inside], return_index=True)
        out[word] = _SCRIPT_AT[np.searchsorted(_STARTS, code[inside][first], side="right") - 1]
    return out


def trigrams(w: T.Words) -> np.ndarray:
    """Bucket of the byte trigram around each byte; beyond a word's ends stands a blank."""
    b = np.where(T.ALNUM[w.buf] | ((w.buf >= 65) & (w.buf <= 90)), w.buf, 32).astype(np.uint32)
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    code = b * np.uint32(65599)
    code[1:] += b[:-1] * np.uint32(8219009)
    code[:-1] += b[1:] * np.uint32(2654435761)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    code ^= code >> np.uint32(13)
    return (code & np.uint32(BUCKETS - 1)).astype(np.int32)


_WORD = T.ALNUM.copy()
_WORD[65:91] = True
_WORD[48:58] = False


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # BUCKETS x langs
    candidates: np.ndarray  # scripts x langs, bool

    def word_scores(self, w: T.Words) -> np.ndarray:
        s, grams = np.zeros((len(w.start), len(self.langs)), dtype=np.float32), trigrams(w)
        for k in range(len(self.langs)):  # one language at a time: a sum for each byte is held
            sums = np.cumsum(self.logs[:, k][grams], dtype=np.float64)
            s[:, k] = sums[w.end - 1] - np.where(w.start > 0, sums[w.start - 1], 0)
        s -= s.max(1, keepdims=True) if len(s) else 0
        allowed = self.candidates[scripts(w)]
        return np.where(allowed, s, np.float32(-1e6))

    def label(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per text: the language number of each word, and the words' letters (code points). Words are scored in small pieces and decoded together."""
        scores, sizes, first = [np.zeros((0, len(self.langs)), np.float32)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for lo, hi in T.chunks(texts):
            w = T.Words(texts[lo:hi], _WORD)
            scores.append(self.word_scores(w))
            points = np.cumsum((w.buf & 0xC0) != 0x80)
            sizes.append(points[w.end - 1] - points[w.start] + 1)
            first.append(first[-1][-1] + w.first[1:])
        size, first = np.concatenate(sizes), np.concatenate(first)
        path = viterbi(np.concatenate(scores), first, PENALTY)
        return [path[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], [size[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        for lo, hi in T.chunks(texts, DECODED_BYTES * MAX_LANGS // max(MAX_LANGS, len(self.langs))) if self.langs else ():
            for i, (p, size) in enumerate(zip(*self.label(texts[lo:hi]), strict=True)):
                t = texts[lo + i]
                if t and len(p) and any(map(str.isalpha, t.decode())):
                    share = np.bincount(p, weights=size, minlength=len(self.langs))
                    lang[lo + i], score[lo + i] = self.langs[int(share.argmax())], share.max() / share.sum()
        return lang, score


def viterbi(s: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best path of each sequence s[first[i]:first[i+1]]; all sequences go forward together, the longest first."""
    n = np.diff(first)
    path = np.zeros(len(s), dtype=np.int8 if s.shape[1] < 128 else np.int16)
    if not len(s) or s.shape[1] == 1:
        return path
    order = np.argsort(-n, kind="stable")
    base, n = first[:-1][order], n[order]
    alive = len(n) - np.searchsorted(n[::-1], np.arange(n[0] + 1), side="right")
    back = np.zeros(s.shape, dtype=path.dtype)
    own = np.arange(s.shape[1], dtype=path.dtype)
    v = s[base[: alive[0]]]
    for t in range(1, n[0]):
        k = alive[t]
        v = v[:k]
        best = v.argmax(1)
        top = v[np.arange(k), best][:, None] - penalty
        stay = v >= top
        at = base[:k] + t
        back[at] = np.where(stay, own, best[:, None])
        # what is far from the best stays far: numbers stay small
        v = np.where(stay, v, top) - top + s[at]
        if k and t + 1 <= n[0]:
            ends = alive[t + 1] if t + 1 < len(alive) else 0
            if ends < k:
                path[base[ends:k] + t] = v[ends:k].argmax(1)
    one = np.flatnonzero(n == 1)
    path[base[one]] = s[base[one]].argmax(1)
    for t in range(int(n[0]) - 1, 0, -1):
        at = base[: alive[t]] + t
        path[at - 1] = back[at, path[at]]
    return path


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """docs (id, text, lang): counts trigrams of a bounded sample on the executors; a fixed-size table per language and task reaches the driver."""
    known = docs.where("lang is not null and id is not null")
    n_langs = known.select("lang").distinct().count()
    slot = F.pmod(F.xxhash64("id"), F.lit(max(1, per_lang * MAX_LANGS // max(MAX_LANGS, n_langs))))
    ids = known.groupBy("lang", slot.alias("slot")).agg(F.min("id").alias("id")).select("id", F.col("lang").alias("of"))
    some = docs.join(F.broadcast(ids), "id").where("lang = of").select("lang", "text")
    # The sample's texts only; the scan keeps its tasks. A task holds a table for each of its languages.
    some = some.repartition(16) if n_langs <= MAX_LANGS else some.repartition(n_langs // 32 + 1, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        written: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = T.texts_of(batch.column(1)), batch.column(0).to_pylist()
            for lo, hi in T.chunks(texts):
                w = T.Words(texts[lo:hi], _WORD)
                code, script = trigrams(w), scripts(w)
                inside = np.zeros(len(w.buf) + 1, dtype=np.int8)
                inside[w.start] += 1
                inside[w.end] -= 1
                inside = np.cumsum(inside[:-1]) > 0
                for i in range(hi - lo):
                    a, b = w.offsets[i], w.offsets[i + 1]
                    grams.setdefault(langs[lo + i], np.zeros(BUCKETS, dtype=np.int64))
                    written.setdefault(langs[lo + i], np.zeros(len(_NAMES), dtype=np.int64))
                    grams[langs[lo + i]] += np.bincount(code[a:b][inside[a:b]], minlength=BUCKETS)
                    written[langs[lo + i]] += np.bincount(script[w.first[i] : w.first[i + 1]], minlength=len(_NAMES))
        for lang in grams:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([grams[lang]]), pa.array([written[lang]])], ["lang", "grams", "written"])

    got = some.mapInArrow(run, "lang string, grams array<long>, written array<long>").toLocalIterator()
    grams, written = {}, {}
    for r in got:
        grams[r.lang] = grams.get(r.lang, 0) + np.array(r.grams)
        written[r.lang] = written.get(r.lang, 0) + np.array(r.written)
    langs = sorted(x for x in grams if written[x].sum())
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    logs = np.empty((BUCKETS, len(langs)), dtype=np.float32)
    for k, x in enumerate(langs):
        g = grams.pop(x) + 0.5
        logs[:, k] = np.log(g / g.sum())
    s = np.stack([written[x] for x in langs], axis=1)
    candidates = s >= LEAST_SHARE * s.sum(0)
    candidates[~candidates.any(1)] = True
    return Model(langs, logs, candidates)


def language_id(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs, and training rows (id, text, lang) -> the columns `keep` (id_col if none are named) of every row, `lang_pred` and
    `score` (share of the letters in spans of that language).

    Null texts, texts without a letter and, without training rows, all texts have `und` and 0. Ties go to the language first by
    code point. Repeated rows have equal results. Very long texts are decoded whole: a number for each word and language is held.
    An empty table gives no row. Extra columns are ignored; `keep` must not hold the new names.
    """
    keep = [id_col] if keep is None else keep
    model = docs.sparkSession.sparkContext.broadcast(train(training))  # 256 KB a language

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:
            lang, score = model.value.predict(T.texts_of(t))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    got = F.arrow_udf(run, "lang_pred string, score double")(F.col(quoted(text_col))).alias(found := fresh(keep, "_lid"))
    return docs.select(*map(quoted, keep), got).select(*map(quoted, keep), f"{found}.lang_pred", f"{found}.score")
