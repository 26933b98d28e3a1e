"""Token counts by a two-tier lookup on the map side.

A pre-token is a run of blanks (U+0020, which the model writes as U+2581) with the other
characters that follow, up to a line end. No piece of the vocabulary has a blank after another
character or a line end beside others, so the pieces of a text are those of its pre-tokens, one by one, and a
piece for each line end; `splits_at_blanks` checks this of a model, and texts of a model that fails are
encoded whole. The first tier is a hash table of the lengths of frequent pre-tokens, of fixed size, broadcast once. Misses go to a cache in the worker,
and what is new there to the tokenizer, each distinct pre-token once. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _text as T
from quillon.llm._tables import quoted

#: Slots of the broadcast table: 20 bytes each, so 5 MB whatever the input.
SLOTS = 1 << 18
#: The table is filled from at most so many documents (the first by hash of the id); what it lacks, the caches have.
SAMPLE = 3000
#: A worker's cache is emptied beyond this many pre-tokens; it refills.
CACHE = 500_000

_MARK = "\u2581"
_NOT_BLANK = T.byte_table(" \n")


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_blanks(path: str) -> bool:
    """Whether counts by pre-token are exact for this model: the pieces allow it, a blank is put in front, and characters stay as they are."""
    sp = _processor(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces):
        return False
    return all(sp.decode(sp.encode(t)) == t and "".join(sp.encode(t, out_type=str))[:1] == _MARK for t in ("a  b", " a", "\ufb01 \u00bd", "end "))


class Counter:
    """Counts the tokens of texts; holds the table and the cache of one worker. Both know a pre-token by two hashes, 128 bits."""

    def __init__(self, path: str, table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, whole: bool = False):
        self.sp, self.table, self.whole = _processor(path), table, whole
        self.cache: dict[int, tuple[int, int]] = {}

    def encode(self, words: list[bytes]) -> list[int]:
        return [len(x) for x in self.sp.encode([w.decode() for w in words], num_threads=1)]

    def units(self, texts: list[bytes]) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray]:
        """The words of texts, the number of blanks before each, and two hashes of both."""
        w = T.Words(texts, _NOT_BLANK, pair=True)
        line = np.maximum.accumulate(np.where(w.buf == 10, np.arange(len(w.buf)), -1))
        stop = np.concatenate(([-1], w.end[:-1] - 1))[: len(w.start)]
        before = np.where(w.start > 0, line[w.start - 1], -1) if len(w.start) else stop
        blanks = w.start - 1 - np.maximum(before, stop)
        blanks[w.first[:-1][np.diff(w.first) > 0]] += 1  # the blank in front of a text
        n = blanks.astype(np.uint64)
        return w, blanks, T.mix64(w.h + n), T.mix64(w.h2 ^ T.mix64(n + np.uint64(1)))

    def resolve(self, w: T.Words, blanks: np.ndarray, h: np.ndarray, g: np.ndarray, miss: np.ndarray) -> np.ndarray:
        """Token counts of the units at `miss`: from the cache, or encoded once."""
        u, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
        check = g[miss[first]]
        cached = [self.cache.get(x, (0, -1)) for x in u.tolist()]
        got = np.array([n if c == x else -1 for (c, n), x in zip(cached, check.tolist(), strict=True)], dtype=np.int64)
        new = np.flatnonzero(got < 0)
        if len(new):
            got[new] = self.lengths(w, blanks, miss[first[new]])
            if len(self.cache) > CACHE:
                self.cache.clear()
            self.cache.update(zip(u[new].tolist(), zip(check[new].tolist(), got[new].tolist(), strict=True), strict=True))
        out = got[back]
        odd = np.flatnonzero(g[miss] != check[back])  # one hash alike, the other not
        if len(odd):
            out[odd] = self.lengths(w, blanks, miss[odd])
        return out

    def lengths(self, w: T.Words, blanks: np.ndarray, at: np.ndarray) -> np.ndarray:
        # Behind a line end no blank stands: then the word follows a line end here too, which with the blank in front is two tokens.
        bare = blanks[at] == 0
        return np.array(self.encode([b"\n" + w.word(i) if b else b" " * int(blanks[i] - 1) + w.word(i) for i, b in zip(at, bare, strict=True)]), dtype=np.int64) - 2 * bare

    def count(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        mark = _MARK.encode()
        for lo, hi in T.chunks(texts):
            part = texts[lo:hi]
            # Blanks before a line end or at the end, a line end in front, and the mark itself: these texts are encoded whole.
            whole = [self.whole or t[:1] == b"\n" or t[-1:] == b" " or b" \n" in t or mark in t for t in part]
            w, blanks, h, g = self.units([b"" if x else t for t, x in zip(part, whole, strict=True)])
            n = np.zeros(len(h), dtype=np.int64)
            miss = np.arange(len(h))
            if self.table is not None and len(h):
                at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
                hit = (self.table[0][at] == h) & (self.table[1][at] == g)
                n[hit] = self.table[2][at[hit]]
                miss = np.flatnonzero(~hit)
            if len(miss):
                n[miss] = self.resolve(w, blanks, h, g, miss)
            sums = np.concatenate(([0], np.cumsum(n)))
            lines = np.concatenate(([0], np.cumsum(w.buf == 10)))
            out[lo:hi] = sums[w.first[1:]] - sums[w.first[:-1]] + lines[w.offsets[1:] - 1] - lines[w.offsets[:-1]]
            at = [i for i, x in enumerate(whole) if x and part[i]]
            if at:
                out[lo + np.array(at)] = self.encode([part[i] for i in at])
        return out


def frequent(docs: DataFrame, path: str, id_col: str, text_col: str, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The broadcast table: hashes and token counts of the most frequent pre-tokens of a bounded sample. Rows that share an id count once."""
    ids = docs.where(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample)
    some = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(ids.distinct()), "id").groupBy("id").agg(F.min("text").alias("text")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            for lo, hi in T.chunks(texts := T.texts_of(batch.column(0))):
                w, blanks, h, g = counter.units(texts[lo:hi])
                u, first, count = np.unique(h, return_index=True, return_counts=True)
                keep = count > 1
                n = counter.resolve(w, blanks, h, g, first[keep]) if keep.any() else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(g[first[keep]].view(np.int64)), pa.array(n), pa.array(count[keep])], ["h", "g", "n", "c"])

    # What leaves Spark is bounded by the table, not by the sample.
    most = some.mapInArrow(run, "h long, g long, n long, c long").groupBy("h", "g", "n").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h", "g").limit(SLOTS // 2)
    got = most.toArrow()
    keys, check, values = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.int32)
    if got.num_rows:
        h, g, n = (got.column(x).to_numpy() for x in ("h", "g", "n"))
        h, g = h.view(np.uint64), g.view(np.uint64)
        slot, at = np.unique((h & np.uint64(SLOTS - 1)).astype(np.int64), return_index=True)  # the more frequent one of a slot
        keys[slot], check[slot], values[slot] = h[at], g[at], n[at]
    return keys, check, values


def token_count(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """docs -> the columns `keep` (id_col if none are named) of every row, `n_bytes` (UTF-8), `n_tokens` (as the model's own library
    gives them, without begin or end) and `over_limit` (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted one by one, so none is a tie. A very long text is counted
    whole, by its pre-tokens. An empty table gives no row. Extra columns are ignored; `keep` must not hold the three names.
    """
    keep = [id_col] if keep is None else keep
    exact = splits_at_blanks(model_path)
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, model_path, id_col, text_col) if exact else None)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(model_path, table.value, whole=not exact)
        for t in batches:
            yield pa.array(counter.count(T.texts_of(t)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    text = F.col(quoted(text_col))
    out = docs.select(*map(quoted, keep), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.arrow_udf(run, "long")(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
