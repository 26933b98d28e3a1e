"""Benchmark decontamination by a prefix-filtered set join.

Item windows (8 words in a row; a shorter item is one window) are sets of word shingles.
Shingles are ordered by rarity in the documents. A window is contained in a text only if each of its
shingles is, so one shingle is the necessary prefix (containment 1 leaves |x| - |x| + 1): its
rarest. Texts are joined on that shingle with its offset in the window; the window must then
start and end within the text (positional and length bounds), and all its words are compared.

Benchmarks are joined in blocks: each holds at most BLOCK windows, which bounds what is broadcast. With more,
further blocks follow in the same pass over the partition. Document frequencies are counted over all
documents. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _text as T
from quillon.llm._tables import fresh, quoted

#: Windows of a block: about 200 bytes each are broadcast.
BLOCK = 1 << 20
#: Bits of a block's first sieve.
SIEVE = 1 << 22


class Block:
    """Windows of some items: word hashes (two of 64 bits), items, and shingles; after `order`, the index by prefix shingle."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        w = T.Words([t for _, t in items], T.ALNUM, lower=True, pair=True)
        seen: dict[tuple[tuple[int, int], ...], set[int]] = {}
        for i in range(len(items)):
            here = slice(w.first[i], w.first[i + 1])
            h = list(zip(w.h[here].tolist(), w.h2[here].tolist(), strict=True))
            for a in range(max(1, len(h) - window + 1) if h else 0):
                seen.setdefault(tuple(h[a : a + window]), set()).add(i)
        self.ids = [x for x, _ in items]
        self.groups = []  # by length: words (n x length), and the items of each
        for length in sorted({len(k) for k in seen}):
            keys = [k for k in seen if len(k) == length]
            at = np.cumsum([0, *(len(seen[k]) for k in keys)])
            both = np.array(keys, dtype=np.uint64)
            words = np.ascontiguousarray(both[:, :, 0])
            k = min(shingle, length)
            parts = np.stack([T.runs(words[:, o : o + k].ravel(), k)[:: k] for o in range(length - k + 1)], axis=1)
            self.groups.append({"length": length, "k": k, "words": words, "checks": np.ascontiguousarray(both[:, :, 1]), "items": np.concatenate([sorted(seen[x]) for x in keys]), "at": at, "parts": parts})
        self.shingles = {k: np.unique(np.concatenate([g["parts"].ravel() for g in self.groups if g["k"] == k])) for k in {g["k"] for g in self.groups}}

    def order(self, frequency: dict[int, np.ndarray]) -> None:
        for g in self.groups:
            df = frequency[g["k"]][np.searchsorted(self.shingles[g["k"]], g["parts"])]
            offset = np.lexsort((np.broadcast_to(np.arange(df.shape[1]), df.shape), df), axis=1)[:, 0] if df.shape[1] > 1 else np.zeros(len(df), dtype=np.int64)
            prefix = g["parts"][np.arange(len(df)), offset]
            by = np.argsort(prefix, kind="stable")
            g["prefix"], first, g["count"] = np.unique(prefix[by], return_index=True, return_counts=True)
            g["first"], g["window"], g["offset"] = first, by, offset[by]
            g["sieve"] = sieve(g["prefix"])
            del g["parts"]

    def spans(self, w: T.Words, runs: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Verified windows: (word position, length, group number and window number)."""
        out = [], [], [], []
        text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        for number, g in enumerate(self.groups):
            s = runs[g["k"]]
            at = np.flatnonzero(g["sieve"][(s & np.uint64(SIEVE - 1)).astype(np.int64)])
            slot = np.searchsorted(g["prefix"], s[at])
            ok = (slot < len(g["prefix"])) & (g["prefix"][np.minimum(slot, len(g["prefix"]) - 1)] == s[at])
            at, slot = at[ok], slot[ok]
            count = g["count"][slot]
            which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(g["first"][slot], count)
            start = np.repeat(at, count) - g["offset"][which]
            window = g["window"][which]
            ok = (start >= 0) & (start + g["length"] <= len(w.h))  # bounds: the window lies within the words of one text
            start, window, near = start[ok], window[ok], np.repeat(at, count)[ok]
            ok = (text[start] == text[near]) & (text[start + g["length"] - 1] == text[near]) if len(start) else ok[:0]
            start, window = start[ok], window[ok]
            ok = np.ones(len(start), dtype=bool)
            for j in range(g["length"]):
                ok &= w.h[start + j] == g["words"][window, j]
            start, window = start[ok], window[ok]
            ok = np.ones(len(start), dtype=bool)
            for j in range(g["length"]):
                # 128 bits stand for a word; the second half is made for these words only
                ok &= T.hash_spans(w.plain, w.start[start + j], w.end[start + j])[1] == g["checks"][window, j]
            for x, y in zip(out, (start[ok], np.full(ok.sum(), g["length"]), np.full(ok.sum(), number), window[ok]), strict=True):
                x.append(y)
        return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out)


def sieve(values: np.ndarray) -> np.ndarray:
    out = np.zeros(SIEVE, dtype=bool)
    out[(values & np.uint64(SIEVE - 1)).astype(np.int64)] = True
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, shingle: int, size: int) -> Iterator[Block]:
    """Blocks in order of the items; rows come to the driver one partition at a time, and at most one block is held."""
    items, n = [], 0
    for r in benchmark.where(F.col(quoted(text_col)).isNotNull()).select(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("i"), F.col(quoted(text_col)).alias("t")).toLocalIterator():
        t = r.t.encode()
        if n and n + len(t) // 2 > size:
            yield Block(items, window, shingle)
            items, n = [], 0
        items.append((r.i, t))
        n += len(t) // 2 if len(t) > 1 << 16 else len(t.split())
    if items:
        yield Block(items, window, shingle)


def _frequency(docs: DataFrame, text_col: str, block) -> dict[int, np.ndarray]:
    """In how many documents each shingle of the block occurs; one row a shingle and task leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value.shingles
        sieves = {k: sieve(v) for k, v in known.items()}
        total = {k: np.zeros(len(v), dtype=np.int64) for k, v in known.items()}
        for batch in batches:
            texts = T.texts_of(batch.column(0))
            for lo, hi in T.chunks(texts):
                w = T.Words(texts[lo:hi], T.ALNUM, lower=True)
                text = np.repeat(np.arange(hi - lo), np.diff(w.first))
                for k, v in known.items():
                    s = T.runs(w.h, k)
                    at = np.flatnonzero(sieves[k][(s & np.uint64(SIEVE - 1)).astype(np.int64)])
                    slot = np.searchsorted(v, s[at])
                    ok = (slot < len(v)) & (v[np.minimum(slot, len(v) - 1)] == s[at])
                    pair = np.unique(text[at[ok]] * np.int64(len(v)) + slot[ok])
                    total[k] += np.bincount(pair % len(v), minlength=len(v))
            T.give_back()
        for k, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(c[at])], ["k", "s", "c"])

    got = docs.select(quoted(text_col)).mapInArrow(run, "k long, s long, c long").groupBy("k", "s").agg(F.sum("c").alias("c")).toArrow()
    out = {k: np.zeros(len(v), dtype=np.int64) for k, v in block.value.shingles.items()}
    k, s, c = (got.column(x).to_numpy() for x in "ksc")
    for x in out:
        out[x][s[k == x]] = c[k == x]
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 8, shingle: int = 3, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs -> the columns `keep` (id_col if none are named) of every row, `n_words`, `n_hit` (words inside any occurrence of an item
    window), `n_items`, `items` (ids of items with a window that occurs, as sorted strings) and `spans` (hit
    stretches of the text: start and end in bytes of its UTF-8 form).

    Words are runs of letters a-z (after lower-casing A-Z), digits and non-ASCII characters. Null texts have no words and no hits,
    as have all with an empty benchmark. Null or wordless items have no window; a null item id counts as ''.
    Items with equal texts all count, items with equal ids once. Extra columns are ignored.
    """
    keep = [id_col] if keep is None else keep
    spark, loaded = docs.sparkSession, []
    for b in blocks_of(benchmark, item_id, item_text, window, shingle, block):
        if b.groups:
            plain = spark.sparkContext.broadcast(b)
            df = _frequency(docs, text_col, plain)
            plain.unpersist()
            b.order(df)
            loaded.append(spark.sparkContext.broadcast(b))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:
            rows = []
            texts = T.texts_of(t)
            for lo, hi in T.chunks(texts):
                w = T.Words(texts[lo:hi], T.ALNUM, lower=True)
                cover = np.zeros(len(w.h) + 1, dtype=np.int32)
                runs: dict[int, np.ndarray] = {}
                items: dict[int, set[str]] = {}
                for b in (x.value for x in loaded):
                    for k in b.shingles:
                        if k not in runs:
                            runs[k] = T.runs(w.h, k)
                    start, length, group, number = b.spans(w, runs)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + length, -1)
                    where = np.searchsorted(w.first, start, side="right") - 1
                    for i, g, x in np.unique(np.stack([where, group, number], axis=1), axis=0).tolist() if len(start) else ():
                        found = b.groups[g]
                        items.setdefault(i, set()).update(b.ids[y] for y in found["items"][found["at"][x] : found["at"][x + 1]])
                hit = np.cumsum(cover[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(hit)))
                for i in range(hi - lo):
                    a, z = int(w.first[i]), int(w.first[i + 1])
                    ids = sorted(items.get(i, ()))
                    spans = []
                    if ids:
                        at = a
                        for is_hit, words in groupby(hit[a:z].tolist()):
                            n = len(list(words))
                            if is_hit:
                                spans.append({"start": int(w.start[at] - w.offsets[i]), "stop": int(w.end[at + n - 1] - w.offsets[i])})
                            at += n
                    rows.append({"n_words": z - a, "n_hit": int(total[z] - total[a]), "items": ids, "spans": spans})
            yield pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))
            T.give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    res = fresh(keep, "_found")
    got = docs.select(*map(quoted, keep), F.arrow_udf(run, "n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>")(F.col(quoted(text_col))).alias(res))
    return got.select(*map(quoted, keep), f"{res}.n_words", f"{res}.n_hit", F.size(f"{res}.items").cast("long").alias("n_items"), f"{res}.items", f"{res}.spans")
