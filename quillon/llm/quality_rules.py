"""Quality rules with cross-document line frequency.

One pass over the texts gives the per-document figures and, for each line with a word, two hashes (128 bits) of its
normalised form (A-Z lower-cased, digit runs as one 0, blanks as one) and its number of words. Lines are
then counted per host over distinct documents (equal texts count once, so a document and its
copies don't make each other's lines frequent). Lines above the limit are removed, and
a document that keeps too small a share of its words is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _text as T
from quillon.llm._tables import fresh, quoted, save

SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS = bytes(range(65, 91)), re.compile(rb"[0-9]+")
_FOLD = bytes.maketrans(_UPPER, bytes(range(97, 123)))


def line_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the normalised forms of lines that have a word."""
    if not lines:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    flat = [b"_".join(_DIGITS.sub(b"0", x.translate(_FOLD)).split()) for x in lines]
    w = T.Words(flat, T.NON_BLANK, pair=True)
    return w.h.view(np.int64), w.h2.view(np.int64)


def repeated_words(five: np.ndarray, other: np.ndarray) -> int:
    """Words inside 5-word windows found twice or more in the text, the first ones included. Windows are equal if both hashes are."""
    if len(five) < 2:
        return 0
    order = np.argsort(five, kind="stable")
    same = (five[order][1:] == five[order][:-1]) & (other[order][1:] == other[order][:-1])
    if not same.any():
        return 0
    again = np.zeros(len(five), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.convolve(again, np.ones(5, dtype=np.int64))
    return int(np.count_nonzero(cover))


_FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    out = np.zeros((len(texts), len(_FIGURES)), dtype=np.int64)
    hashes, checks, sizes = [], [], []
    for lo, hi in T.chunks(texts):
        part = texts[lo:hi]
        w = T.Words(part, T.NON_BLANK, pair=True)
        five, other = T.runs(w.h, 5), T.runs(w.h2, 5)
        lines = [t.split(b"\n") for t in part]
        kept = [[x for x in ls if x and not x.isspace()] for ls in lines]
        flat, check = line_hashes([x for ls in kept for x in ls])
        at = 0
        for i, t in enumerate(part):
            a, b = w.first[i], w.first[i + 1]
            blanks = len(t) - len(t.translate(None, T.BLANKS.encode()))
            stop = max(a, b - 4)
            out[lo + i] = (
                b - a,
                len(t.decode()) - blanks,
                len(t) - len(t.translate(None, SYMBOLS)),
                len(kept[i]) - len(set(kept[i])),
                repeated_words(five[a:stop], other[a:stop]),
            )
            hashes.append(flat[at : at + len(kept[i])])
            checks.append(check[at : at + len(kept[i])])
            sizes.append(np.array([len(x.split()) for x in kept[i]], dtype=np.int64))
            at += len(kept[i])
    return out, hashes, checks, sizes


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)))


def measure(column):
    """Arrow UDF column: the figures of each text, its line hashes, and words per line."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:
            x, *lists = _measure(T.texts_of(t))
            yield pa.StructArray.from_arrays([*(pa.array(x[:, i]) for i in range(len(_FIGURES))), *map(_lists, lists)], [*_FIGURES, "h", "g", "n"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ", ".join(f"{x} long" for x in _FIGURES) + ", h array<long>, g array<long>, n array<long>")(column)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = 10, ratio: float = 0.0, least_left: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs -> the columns `keep` (id_col if none are named) of every row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_left (words outside removed lines) and kept.

    A line is removed if more than `limit` distinct texts of its host hold it, however large the host is; with `ratio`, only if
    more than that share of the host's distinct texts do, too.
    kept is false if base_failed, or if n_left < least_left * n_words. Null and empty texts have no words and fail the base rules.
    Null hosts are one host. Repeated rows are judged alike, and their lines count once; a line exactly at a limit stays. Very long texts
    are measured whole. An empty table gives no row. Extra columns are ignored; `keep` must not hold the new names.
    """
    keep = [id_col] if keep is None else keep
    host, key, check, m = (fresh(keep, x) for x in ("_host", "_text_key", "_text_check", "_m"))
    text = F.col(quoted(text_col))
    got = docs.select(*map(quoted, keep), F.coalesce(F.concat(F.lit("h"), F.col(quoted(host_col)).cast("string")), F.lit("n")).alias(host), F.xxhash64(text).alias(key), F.xxhash64(text, F.lit(7)).alias(check), measure(text).alias(m))
    base = save(got, "figures")
    content = [host, key, check]
    each_line = lambda *more: base.select(*content, F.posexplode(F.arrays_zip(f"{m}.h", f"{m}.g", f"{m}.n")).alias("p", "x")).select(*content, "x.h", "x.g", *more)
    total = base.select(*content).distinct().groupBy(host).agg(F.count(F.lit(1)).alias("texts"))
    often = each_line().distinct().groupBy(host, "h", "g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > limit)
    common = often.join(total, host).where(F.col("c") > ratio * F.col("texts")).select(host, "h", "g") if ratio > 0 else often.select(host, "h", "g")
    # At most one for limit + 1 lines of distinct texts; the other side is salted, so no line is one task's.
    salts = 32
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    each = each_line("x.n", "p").withColumn("salt", F.pmod(F.col(key), F.lit(salts)).cast("int"))
    lost = save(each.join(salted.hint("merge"), [host, "h", "g", "salt"]).groupBy(*content, "p").agg(F.first("n").alias("n")).groupBy(*content).agg(F.sum("n").alias("lost")), "lost")
    out = base.join(lost, content, "left")
    n, rep = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    failed = (n < 10) | (rep * 100 > n * 20)
    left = n - F.coalesce("lost", F.lit(0))
    return out.select(*map(quoted, keep), *(F.col(f"{m}.{x}").alias(x) for x in _FIGURES), failed.alias("base_failed"), left.alias("n_left"), (~failed & (left >= least_left * n)).alias("kept"))
