"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct k-word shingles. Two sets whose Jaccard
similarity is num/den or more differ in few shingles: with sizes a <= b the symmetric
difference is at most floor(a * (den - num) / num), and at most
floor((a + b) * (den - num) / (den + num)).

1. `sketch`: one Python pass makes per document a 128-bit fingerprint of its set, a
   parity sketch (each shingle flips one of m bits; the Hamming distance of two sketches
   never exceeds the symmetric difference of the sets) and its pigeonhole keys. Sizes are
   dealt into bands [2^g, 2^(g+1)). A band cuts the hash space into blocks and XORs the
   shingle hashes of each block. Of two sets that differ in D shingles, at most D blocks
   differ, so of the first D+1 non-empty blocks of either set one is equal in both. A
   document emits that many keys in its own band, and in the band below if a partner can
   be there. A document with too few non-empty blocks emits those it has and goes on to another
   cut of the hash space, until one gives enough; keys of empty blocks, which all such documents
   would share, aren't needed. Equal sets are collapsed first (once in each task, then
   by fingerprint), so a group of copies costs one document.
2. `_meet`: rows are dealt and sorted by key; buckets of up to SMALL sets give all their pairs, larger
   ones their members in parts of at most CELL: rows stay linear in the bucket, and none is held in full.
3. Within a part, sketches are compared by Hamming distance in memory, which gives a minimal
   spanning forest of the pairs within the bound. These are verified, and one set of each part (of
   its largest component) meets those of the other parts of its bucket. What is then still in two
   components of one bucket is compared in full: cells of two parts each, every pair within the
   bound. No link is lost, and a group of near copies gives no square of rows.
4. `_verify`: exact. The texts of both sides meet, their words are cut again, and shingles of equal
   hash are compared byte by byte. Texts are sent rather than sets of hashes: they are smaller.
5. `components`: min-label propagation with pointer jumping over written tables.

Sizes and sketches take a shingle by a 64-bit hash; links are decided by the words. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _text as T
from quillon.llm._sieve import perhaps
from quillon.llm._tables import quoted, release, save, union_all

SMALL = 8
CELL = 1024
#: Bytes of texts that are sketched, or verified on one side, before rows leave a worker.
PIECE = 1 << 21
#: Cuts of the hash space that a document with few shingles tries.
CUTS = 8


def _blocks(g: int, num: int, den: int) -> int:
    most = ((2 << g) - 1) * (den - num) // num + 1
    return (most * 11 + 9) // 10 + 4


def _bits(g: int, num: int, den: int) -> int:
    """Sketch size of band g: a power of two of at least 16 times the largest difference, so that larger sketches fold onto smaller ones."""
    return max(64, 1 << (16 * ((2 << g) - 1) * (den - num) // num).bit_length())


def keys_of(u: np.ndarray, g: int, most: int, num: int, den: int) -> np.ndarray:
    """Pigeonhole keys in band g of a set with sorted hashes u that must meet partners differing in up to `most` shingles."""
    n_blocks, out = _blocks(g, num, den), []
    for cut in range(CUTS):
        v = np.sort(T.mix64(u + np.uint64(cut * 0x9E3779B9))) if cut else u
        block = ((v >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        salt = np.uint64((g + 1) << 40 | cut << 32)
        full = at[: most + 1]
        stop = at[most + 1] if len(at) > most + 1 else len(v)
        out.append(T.mix64(np.bitwise_xor.reduceat(v[:stop], full) ^ T.mix64(block[full] + salt)))
        if len(at) > most:
            return np.concatenate(out)
    # No cut has enough non-empty blocks (only for similarities below 2/3, or by a chance below 10^-15): all blocks of one more cut.
    v = np.sort(T.mix64(u + np.uint64(CUTS * 0x9E3779B9)))
    block = (((v >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)).astype(np.int64)
    values = np.zeros(n_blocks, dtype=np.uint64)
    np.bitwise_xor.at(values, block, v)
    out.append(T.mix64(values ^ T.mix64(np.arange(n_blocks, dtype=np.uint64) + np.uint64((g + 1) << 40 | CUTS << 32))))
    return np.concatenate(out)


def sketch_of(u: np.ndarray, bits: int) -> np.ndarray:
    """Parity sketch: bit (hash mod bits) is the parity of the number of shingles there."""
    odd = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """XOR of the parts of n words of a sketch: the sketch with 64 n bits."""
    return words if len(words) == n else np.bitwise_xor.reduce(words.reshape(-1, n), axis=0)


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    for lo, hi in T.chunks(texts):
        w = T.Words(texts[lo:hi], T.NON_BLANK, lower=True)
        grams, first = T.runs(w.h, k), w.first
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield T.shingles(w.h[a:b], grams[a : max(a, b - k + 1)], k)


def _fingerprint(u: np.ndarray) -> tuple[int, int]:
    if not len(u):
        return 0, 0
    return int(T.mix64(u + np.uint64(7)).sum().view(np.int64)), int(np.bitwise_xor.reduce(T.mix64(u ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64))


def _list_array(parts: list[np.ndarray | None]) -> pa.Array:
    sizes = np.fromiter((0 if p is None else len(p) for p in parts), dtype=np.int32, count=len(parts))
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.concatenate([p for p in parts if p is not None and len(p)] or [np.zeros(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def sketch(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """rows (rk, rk2, id, text) -> (rk, rk2, id, n, fp, fp2, keys, sk); keys and sk only for the first of equal sets in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            texts = T.texts_of(batch.column(3))
            for lo, hi in T.chunks(texts, PIECE):
                n, fp, fp2, keys, sk = [], [], [], [], []
                for u in _sets(texts[lo:hi], k):
                    size, f = len(u), _fingerprint(u)
                    n.append(size)
                    fp.append(f[0])
                    fp2.append(f[1])
                    if not size or f in seen:
                        keys.append(None)
                        sk.append(None)
                        continue
                    seen.add(f)
                    g, own = size.bit_length() - 1, []
                    if (most := size * (den - num) // num) > 0:
                        own.append(keys_of(u, g, most, num, den))
                    least = (size * num + den - 1) // den
                    if g and least < (1 << g) and (most := ((1 << g) - 1) * (den - num) // num) > 0:
                        own.append(keys_of(u, g - 1, most, num, den))
                    keys.append(np.concatenate(own) if own else None)
                    sk.append(sketch_of(u, _bits(g, num, den)))
                figures = [pa.array(np.array(x, dtype=np.int64)) for x in (n, fp, fp2)]
                ids = [batch.column(i).slice(lo, hi - lo) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*ids, *figures, _list_array(keys), _list_array(sk)], ["rk", "rk2", "id", "n", "fp", "fp2", "keys", "sk"])
            T.give_back()

    return rows.select("rk", "rk2", "id", "text").mapInArrow(run, f"rk long, rk2 long, id {rows.schema['id'].dataType.simpleString()}, n long, fp long, fp2 long, keys array<long>, sk array<long>")


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a group ends: what is held is a batch and one group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        first = tuple(c[0] for c in cols)
        cut = change[-1] if len(change) else 0
        if held and first != last:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _parts(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    x = lists.combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    return x.offsets.to_numpy(), x.values.to_numpy()


def _meet(rows: DataFrame) -> DataFrame:
    """(key, fp) -> pairs of small buckets (part -1; a < b), and members of large ones (key, part, a). Rows come sorted; of a bucket
    only its first sets are held."""
    names = ["key", "part", "a", "b"]

    def members(key: np.ndarray, fp: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(rank // CELL), pa.array(fp), pa.nulls(len(key), pa.int64())], names)

    def small(fp: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(2, SMALL + 1):
            at = start[size == s]
            for i in range(s):
                for j in range(i + 1, s):
                    a.append(fp[at + i])
                    b.append(fp[at + j])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        n = pairs.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.full(n, -1)), pa.array(pairs[0]), pa.array(pairs[1])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # the bucket in work: sets held, and how many have left
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate((key, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy()))
            first = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])))
            key, fp = key[first], fp[first]
            yield from out(key, fp, done, last := int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1]))
            done = 0 if last else done
            key, fp = key[last:], fp[last:]
            if done + len(key) > SMALL and len(key) > 1:  # a large bucket: all but one leave (the last may come again)
                yield members(key[:-1], fp[:-1], done + np.arange(len(key) - 1))
                done += len(key) - 1
                key, fp = key[-1:], fp[-1:]
        if len(key):
            yield from out(key, fp, done, len(key))

    def out(key: np.ndarray, fp: np.ndarray, done: int, stop: int) -> Iterator[pa.RecordBatch]:
        """The buckets before `stop`; of the first one `done` sets have left."""
        key, fp = key[:stop], fp[:stop]
        if not stop:
            return
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, stop))
        before = np.where(np.arange(len(start)) == 0, done, 0)
        large = size + before > SMALL
        yield from small(fp, start[~large], size[~large])
        at = np.flatnonzero(np.repeat(large, size))
        if len(at):
            yield members(key[at], fp[at], (np.arange(stop) - np.repeat(start, size) + np.repeat(before, size))[at])

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "key long, part long, a long, b long")


def _bound(na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    return (na + nb) * (den - num) // (den + num)


def _close(sk: list[np.ndarray], n: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (left before right) whose sketches are within the bound and whose `open_` differ, with the distance."""
    out = [], [], []
    sizes = np.array([len(s) for s in sk])
    for wide in np.unique(sizes):
        # the larger sketches of the neighbouring band fold onto this size
        li, ri = left[sizes[left] >= wide], right[sizes[right] >= wide]
        use = np.unique(np.concatenate((li, ri)))
        use = use[sizes[use] <= 4 * wide]
        if not (sizes[use] == wide).any():
            continue
        at = np.full(len(sk), -1)
        at[use] = np.arange(len(use))
        x = np.stack([fold(sk[i], wide) for i in use])
        li, ri = li[at[li] >= 0], ri[at[ri] >= 0]
        step = max(1, 500_000 // max(1, len(ri)))
        for lo in range(0, len(li), step):
            part = li[lo : lo + step]
            dist = np.zeros((len(part), len(ri)), dtype=np.int32)
            for w in range(int(wide)):
                dist += np.bitwise_count(x[at[part], w][:, None] ^ x[at[ri], w][None, :])
            na, nb = n[part][:, None], n[ri][None, :]
            ok = (dist <= _bound(na, nb, num, den)) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (np.minimum(sizes[part][:, None], sizes[ri][None, :]) == wide)
            ok &= (open_[part][:, None] != open_[ri][None, :]) & ((part[:, None] < ri[None, :]) if left is right else True)
            i, j = np.nonzero(ok)
            out[0].append(part[i])
            out[1].append(ri[j])
            out[2].append(dist[i, j])
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out)


def _forest(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Positions of the edges of a minimal spanning forest, closest first. Ties by a hash: no set becomes a hub."""
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    kept = []
    for e in np.lexsort((T.mix64((i * n + j).astype(np.uint64)), d)).tolist():
        a, b = find(int(i[e])), find(int(j[e]))
        if a != b:
            root[a] = b
            kept.append(e)
            if len(kept) == n - 1:
                break
    return np.array(kept, dtype=np.int64)


def _cell_pairs(members: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """(key, i, j, side, a, n, sk) -> candidate pairs (a, b) of each cell (key, i, j): a spanning forest. Without forest, with comp too: all
    pairs of different comp. Side 0 is compared with side 1, side 2 with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ["key", "i", "j"]):
            yield from cells(t)
            T.give_back()

    def cells(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ci, cj, side, fp, n = (t.column(c).to_numpy() for c in ("key", "i", "j", "side", "a", "n"))
        offs, flat = _parts(t.column("sk"))
        flat = flat.view(np.uint64)
        comp = np.asarray(t.column("comp").combine_chunks().dictionary_encode().indices) if not forest else None
        new = (key[1:] != key[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])
        cuts = np.flatnonzero(np.concatenate(([True], new)))
        got_a, got_b, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            a, b = np.concatenate(got_a), np.concatenate(got_b)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            for lo in range(0, pairs.shape[1], 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0, lo : lo + 100_000]), pa.array(pairs[1, lo : lo + 100_000])], ["a", "b"])

        for lo, hi in zip(cuts, [*cuts[1:], len(key)], strict=True):
            rows = np.arange(lo, hi)
            rows = rows[np.lexsort((fp[rows], side[rows]))]
            here = np.arange(len(rows))
            left = here[side[rows] != 1]
            right = here[side[rows] == 1] if (side[rows] == 1).any() else left
            i, j, d = _close([flat[offs[r] : offs[r + 1]] for r in rows], n[rows], left, right, num, den, here if forest else comp[rows])
            keep = _forest(i, j, d, len(rows)) if forest else np.arange(len(i))
            got_a.append(fp[rows[i[keep]]])
            got_b.append(fp[rows[j[keep]]])
            held += len(keep)
            if held > 1_000_000:
                yield from out()
                got_a, got_b, held = [], [], 0
        if got_a:
            yield from out()

    return members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _cells(members: DataFrame) -> DataFrame:
    """(key, part, parts, a, comp) -> (key, i, j, side, a, comp): each member in the cells of its part with every part of the bucket."""
    every = members.select("key", "part", "a", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q"))
    side = F.when(F.col("q") == F.col("part"), 2).when(F.col("part") < F.col("q"), 0).otherwise(1)
    return every.select("key", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), side.alias("side"), "a", "comp")


def _near(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs within the Hamming bound (JVM only): the longer sketch is folded onto the shorter."""
    s = lambda side: sketches.select(F.col("fp").alias(side), F.col("n").alias(f"n{side}"), F.col("sk").alias(f"s{side}"))
    both = pairs.join(s("a").hint("merge"), "a").join(s("b").hint("merge"), "b")
    least = F.least(F.size("sa"), F.size("sb"))

    def folded(c: str):
        return F.when(F.size(c) == least, F.col(c)).otherwise(F.transform(F.sequence(F.lit(1), least), lambda i: F.aggregate(F.sequence(F.lit(0), (F.size(c) / least).cast("int") - 1), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseXOR(F.element_at(F.col(c), i + p * least)))))

    dist = F.aggregate(F.zip_with(folded("sa"), folded("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return both.where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (dist <= F.floor((F.col("na") + F.col("nb")) * (den - num) / (den + num)))).select("a", "b")


def _vertex(fp, fp2):
    return F.concat(F.hex(fp), F.lit("."), F.hex(fp2))


def shared(w: T.Words, grams: list[tuple[np.ndarray, np.ndarray]], x: int, y: int, k: int) -> int:
    """Number of shingles that texts x and y of w share: equal hashes, then equal bytes. grams: per text, distinct hashes and a word where each begins."""
    _, i, j = np.intersect1d(grams[x][0], grams[y][0], assume_unique=True, return_indices=True)
    i, j = grams[x][1][i], grams[y][1][j]
    ok = np.ones(len(i), dtype=bool)
    for o in range(k):
        ok &= w.same(i + o, w, j + o)
    return int(ok.sum())


def _linked(a: list[bytes], b: list[bytes], prints: np.ndarray, k: int, num: int, den: int) -> np.ndarray:
    """Whether texts a[i] and b[i] have the fingerprints they are named by (prints: fp, fp2 of either) and link."""
    out = np.zeros(len(a), dtype=bool)
    limit = T.CHUNK_BYTES // 2
    for lo, hi in T.chunks([x + y for x, y in zip(a, b, strict=True)], limit):
        texts = [t for pair in zip(a[lo:hi], b[lo:hi], strict=True) for t in pair]
        names = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        w = T.Words(list(names), T.NON_BLANK, lower=True)
        runs, grams, count = T.runs(w.h, k), [], np.diff(w.first)
        for first, last in zip(w.first[:-1], w.first[1:], strict=True):
            if last - first >= k:
                u, at = np.unique(runs[first : last - k + 1], return_index=True)
                grams.append((u, at + first))
            else:
                grams.append((T.shingles(w.h[first:last], runs[:0], k), np.arange(first, first + (last > first))))
        for i in range(lo, hi):
            x, y = names[a[i]], names[b[i]]
            if (*_fingerprint(grams[x][0]), *_fingerprint(grams[y][0])) != tuple(prints[i].tolist()):
                continue
            nx, ny = len(grams[x][0]), len(grams[y][0])
            size = k if min(count[x], count[y]) >= k else int(count[x]) if count[x] == count[y] else 0
            both = shared(w, grams, x, y, size) if size else 0
            out[i] = both * den >= (nx + ny - both) * num and both > 0
    return out


def _verify(pairs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) of fingerprints -> links (a, b, u, v), u and v being vertices whose exact similarity is num/den or more. One pass over the
    texts; only those of the classes in question are shuffled."""
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    who = save(classes.join(ends, "fp", "left_semi").select("fp", "fp2", "rk", "rk2"), "ends")
    # One row of each repeated row; a row's key is 128 bits.
    texts = rows.where(perhaps(who, "rk")).groupBy("rk", "rk2").agg(F.first("text").alias("text"))
    name = lambda side: who.select(*(F.col(c).alias(c + side) for c in ("fp", "fp2", "rk", "rk2")))
    text = lambda side: texts.select(*(F.col(c).alias(c + side) for c in ("rk", "rk2", "text"))).hint("merge")
    named = pairs.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(name("_a").hint("merge"), "fp_a").join(name("_b").hint("merge"), "fp_b")
    both = named.join(text("_a"), ["rk_a", "rk2_a"]).join(text("_b"), ["rk_b", "rk2_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            a, b = T.texts_of(batch.column(4)), T.texts_of(batch.column(5))
            for lo, hi in T.chunks(a, PIECE):
                ok = np.flatnonzero(_linked(a[lo:hi], b[lo:hi], prints[lo:hi], k, num, den)) + lo
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(ok)) for i in range(4)], ["fp_a", "fp2_a", "fp_b", "fp2_b"])
            T.give_back()

    met = both.select("fp_a", "fp2_a", "fp_b", "fp2_b", "text_a", "text_b").mapInArrow(run, "fp_a long, fp2_a long, fp_b long, fp2_b long")
    links = save(met.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"), _vertex("fp_a", "fp2_a").alias("u"), _vertex("fp_b", "fp2_b").alias("v")), "links")
    release(who)
    return links


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> (u, root), root being the smallest vertex reachable. Each step is a written table."""
    edges = save(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = save(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "labels")
    while True:
        of_v = labels.select(F.col("u").alias("v"), F.col("root").alias("m"))
        least = edges.join(of_v, "v").groupBy("u").agg(F.min("m").alias("m"))
        step = labels.join(least, "u").select("u", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        jump = labels.where("u <> root").select(F.col("u").alias("root"), F.col("root").alias("far"))
        after = save(step.join(jump, "root", "left").select("u", "was", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        moved = after.where("was <> root").limit(1).count()
        release(labels)
        labels = after.select("u", "root")
        labels.stored_path = after.stored_path
        if not moved:
            release(edges)
            return labels


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of docs: (id_col, n_shingles, component_id): the size of its set of distinct k-word
    shingles, and the smallest id reachable by links of Jaccard similarity num/den or more.

    Words are runs of non-blanks, A-Z lower-cased. Fewer than k words: the whole sequence is one
    shingle. Null and blank texts have the empty set and link with nothing, so their component is
    their own id. Equal sets always link. Repeated rows give repeated results. A null id takes part
    in links but is never the smallest; alone, its component is null. Very long texts are taken whole (a text
    has to fit in a worker several times). An empty table gives no row. Extra columns are ignored.
    """
    return _components_of(docs, id_col, text_col, k, num, den)[0].select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rk, rk2, id, text): two hashes of id and text name a row's content."""
    i, t = F.col(quoted(id_col)), F.col(quoted(text_col))
    return docs.select(F.xxhash64(i, t).alias("rk"), F.xxhash64(t, F.lit(7), i).alias("rk2"), i.alias("id"), t.alias("text"))


def _components_of(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rk, rk2, id, n, component_id) per row, and the tables it reads."""
    rows = _keyed(docs, id_col, text_col)
    heavy = save(sketch(rows, k, num, den), "sketches")
    made = save(heavy.select("rk", "rk2", "id", "n", "fp", "fp2"), "sets")
    one = F.min(F.struct("rk", "rk2"))
    classes = made.where("n > 0").groupBy("fp", "fp2").agg(F.min("id").alias("least"), one.alias("row"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select("fp", "fp2", "least", "copies", "row.rk", "row.rk2")
    met = save(_meet(heavy.select(F.explode("keys").alias("key"), "fp")), "met")
    sketches = heavy.where(F.size("sk") > 0).select("fp", "n", "sk")

    small, members = met.where("part < 0").select("a", "b").distinct(), met.where("part >= 0").select("key", "part", "a")
    of = lambda fps: sketches.join(fps.distinct(), "fp", "left_semi").groupBy("fp").agg(F.first("n").alias("n"), F.first("sk").alias("sk"))
    info = save(of(members.select(F.col("a").alias("fp"))), "members")
    with_sketch = lambda cells: cells.join(info.withColumnRenamed("fp", "a").hint("merge"), "a")

    # First round: pairs of small buckets within the bound, and a forest of each part of a large one.
    light = of(small.select(F.col("a").alias("fp")).union(small.select("b")))
    own = members.select("key", F.col("part").alias("i"), F.col("part").alias("j"), F.lit(2).alias("side"), "a")
    tried = save(_near(small, light, num, den).union(_cell_pairs(with_sketch(own), num, den, forest=True)).distinct(), "tried")
    links = [_verify(tried, rows, classes, k, num, den)]
    comp = components(links[0])
    tables = [heavy, met, info, tried]

    def apart() -> DataFrame:
        """Members of buckets that hold more than one component, with it."""
        met_links = union_all(links)
        by_fp = met_links.select("a", "u").union(met_links.select("b", "v")).distinct().join(comp, "u").groupBy("a").agg(F.min("root").alias("comp"))
        placed = members.join(by_fp.hint("merge"), "a", "left").withColumn("comp", F.coalesce("comp", F.col("a").cast("string")))
        several = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), (F.max("part") + 1).alias("parts")).where("x <> y").select("key", "parts")
        tables.append(save(placed.join(several.hint("merge"), "key"), "apart"))
        return tables[-1]

    def add(pairs: DataFrame) -> None:
        nonlocal comp
        tables.append(save(pairs.join(tried, ["a", "b"], "left_anti").distinct(), "tried"))
        if not tables[-1].isEmpty():
            links.append(_verify(tables[-1], rows, classes, k, num, den))
            if not links[-1].isEmpty():
                release(comp)
                comp = components(union_all(links))

    # Second round: one set of each part, of its largest component, meets those of the bucket's other parts.
    split = apart()
    if not split.where("parts > 1").isEmpty():
        sizes = split.where("parts > 1").groupBy("key", "part", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("a").alias("a"))
        chosen = sizes.groupBy("key", "part").agg(F.max(F.struct("c", "comp", "a")).alias("x"))
        cell = F.floor(F.col("part") / CELL)
        add(_cell_pairs(with_sketch(chosen.select("key", cell.alias("i"), cell.alias("j"), F.lit(2).alias("side"), F.col("x.a").alias("a"))), num, den, forest=True))
        split = apart()
    # Third round: whatever is within the bound and still apart.
    if not split.isEmpty():
        add(_cell_pairs(with_sketch(_cells(split)), num, den, forest=False))

    of = classes.select("fp", "fp2", "least", "copies", _vertex("fp", "fp2").alias("u")).join(comp, "u", "left")
    small_root = of.where("root is not null").groupBy("root").agg(F.min("least").alias("least_of"))
    moved = save(of.where("root is not null or copies > 1").join(small_root, "root", "left").select("fp", "fp2", F.coalesce("least_of", "least").alias("component_id")), "moved")
    release(comp, *tables, *links)
    out = made.join(moved, ["fp", "fp2"], "left").select("rk", "rk2", "id", "n", F.coalesce("component_id", "id").alias("component_id"))
    return out, [made, moved]


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of near copies: the one with the group's smallest id. Columns stay.

    Rows that are alone stay as they are, also with null ids or empty texts; an empty table stays empty. Of repeated rows (equal id and
    text) one stays. Of rows with one id and different texts of a group all stay. Of a group without any id all different texts stay.
    Very long texts are compared whole. Extra columns may have any names.

    Only rows that may have to go are shuffled: a bit table over their keys (`_sieve`) lets the others pass.
    A row is named by 128 bits of its id and text.
    """
    names = docs.columns
    lazy, parts = _components_of(docs, id_col, text_col, k, num, den)
    found = save(lazy, "components")
    gone = save(found.where(F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("id"))).select("rk", "rk2").distinct(), "gone")
    twice = found.groupBy("rk", "rk2").count().where("count > 1").select("rk", "rk2")
    hit = perhaps(gone.union(twice), "rk")
    release(found, *parts)
    i, t = F.col(quoted(id_col)), F.col(quoted(text_col))
    boxed = docs.select(F.struct(*(F.col(quoted(c)) for c in names)).alias("box"), F.xxhash64(i, t).alias("rk"), F.xxhash64(t, F.lit(7), i).alias("rk2"))
    checked = boxed.where(hit).join(gone.hint("merge"), ["rk", "rk2"], "left_anti").dropDuplicates(["rk", "rk2"])
    return boxed.where(~hit).select("box.*").unionByName(checked.select("box.*"))
