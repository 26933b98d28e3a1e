"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same expected number of copies, target / source_size. In a
fixed order within its source, documents get the prefix sums of these numbers plus one offset per source;
a document is emitted once for each integer that its step crosses. Documents of a source stand in order of
size class, so each class is sampled evenly and the words taken come near the target.

Prefix sums are taken in two levels, so that no source is one task's work: documents are counted in cells of
(source, size class, one of SUBCELLS by hash), the cells' counts are summed in order, and documents
are numbered within their cells. Cells of a source are at most 8 * 64 * SUBCELLS, whatever its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._tables import fresh, quoted

SUBCELLS = 64
WORD = r"[^\x20\x09-\x0D]++"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """8 classes for each doubling of size."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.call_function("shiftright", size * 8, bits - 1) % 8).cast("int")


def _u(x: Column) -> Column:
    """A number in [0, 1) from 32 bits of the MD5 of x."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """sizes (source, size) -> (source, size, target). One row per source.

    Weights repeat along the sources in code point order, null last. The budget (that share of all sizes) is dealt by weight; a
    source stops at `most` times its size and its excess is dealt again by weight. The fixed point is found at once: with sources
    ordered by size / weight, those before the first that can take its share at the level left stop.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long")
    ranked = sizes.withColumn("w", w)
    order = Window.orderBy((F.col("size") / F.col("w")), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = (F.sum("size").over(everything) * budget) - most * F.coalesce(F.sum("size").over(before), F.lit(0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    found = ranked.withColumn("level", level).withColumn("fits", F.col("size") * most >= F.col("level") * F.col("w"))
    final = F.min(F.when(F.col("fits"), F.struct((F.col("size") / F.col("w")).alias("r"), F.col("source").isNull().alias("n"), "source", "level"))).over(everything)["level"]
    cap = (F.col("size") * most).cast("double")
    return found.select("source", "size", F.when(final.isNull(), cap).otherwise(F.least(cap, final * F.col("w"))).alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """docs -> the columns `keep` (id_col if none are named) of every row, `size` (words), `source_size`, `target` (its source's),
    `copies` and `taken` (copies * size).

    copies is at most `most` (its expectation is target / source_size, and never above). Null texts have size 0 and
    may be "taken" with no words. Null sources are one source. Repeated rows are documents of their own. Reruns agree: the
    order within a cell is by size, then hash of id, then rows that tie in any order (they take alike). A source without a word has
    target 0. Very long texts are counted whole. An empty table gives no row. Extra columns are ignored;
    `keep` must not hold the new names.
    """
    keep = [id_col] if keep is None else keep
    src, cls, sub, rank, cell_n = (fresh(keep, x) for x in ("_source", "_class", "_sub", "_rank", "_n"))
    tie = fresh(keep, "_tie")
    got = docs.select(*map(quoted, keep), F.col(quoted(source_col)).cast("string").alias("source_"), F.md5(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))).alias(tie), n_words(F.col(quoted(text_col))).alias("size"))
    got = got.select(*map(quoted, keep), "size", tie, F.coalesce(F.concat(F.lit("s"), "source_"), F.lit("n")).alias(src), size_class(F.col("size")).alias(cls), (F.conv(F.substring(tie, 1, 4), 16, 10).cast("int") % SUBCELLS).alias(sub))
    cells = got.groupBy(src, cls, sub).agg(F.count(F.lit(1)).alias(cell_n), F.sum("size").alias("cell_size"))
    per_source = targets(cells.groupBy(F.expr(f"CASE WHEN `{src}` = 'n' THEN NULL ELSE substr(`{src}`, 2) END").alias("source")).agg(F.sum("cell_size").alias("size")), weights=weights, budget=budget, most=most)
    per_source = per_source.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias(src), F.col("size").alias("source_size"), "target")
    along = Window.partitionBy(src).orderBy(cls, sub).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum(cell_n).over(along), F.lit(0))).join(per_source, src).select(src, cls, sub, "start", "source_size", "target")
    numbered = got.withColumn(rank, F.row_number().over(Window.partitionBy(src, cls, sub).orderBy("size", tie)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    done = F.col("start") + F.col(rank)
    offset = _u(F.concat(F.lit(seed + ":"), F.col(src)))
    copies = (F.floor(ratio * done + offset) - F.floor(ratio * (done - 1) + offset)).cast("long")
    out = numbered.join(starts, [src, cls, sub]).withColumn("copies", copies)
    return out.select(*map(quoted, keep), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy taken."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
