"""Line dedup by site-relative frequency.

For every host, the share of its pages that contain a line (compared without blanks at its ends). Lines whose
share exceeds a ratio are boilerplate and leave every page of the host. Pages with equal texts count
as one, so that a page with many copies isn't taken for boilerplate. Counting and joining run in the JVM; only texts
that lose lines pass through Python.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _text as T
from quillon.llm._sieve import perhaps
from quillon.llm._tables import fresh, quoted, release, save

SALTS = 32
_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _without(text: F.Column, drop: F.Column) -> F.Column:
    """text without the lines of these numbers."""

    def run(t: pa.Array, d: pa.Array) -> pa.Array:
        out = []
        for x, gone in zip(t, d, strict=True):
            x, gone = x.as_py(), set(gone.as_py())
            out.append("\n".join(y for i, y in enumerate(x.split("\n")) if i not in gone) if gone else x)
        made = pa.array(out, pa.string())
        del out
        T.give_back()
        return made

    return F.arrow_udf(run, "string")(text, drop)


def line_dedup(docs: DataFrame, *, host: F.Column, text_col: str = "text", ratio: float = 0.05, least_pages: int = 5) -> DataFrame:
    """docs with boilerplate lines taken out of text_col, and a last column `lines_dropped`.

    A line goes if more than `ratio` of the distinct texts of its host hold it, and `least_pages` or more do.
    Lines without a word stay as they are, as do null texts and rows whose host is null (no site to compare with). A text
    that loses all its lines becomes empty; the row stays. Repeated rows lose the same lines. Columns keep
    names and order; `lines_dropped` gets underscores if it is taken. A line exactly at the ratio stays. Very long texts are
    taken whole. An empty table gives no row.
    """
    names = docs.columns
    h, k1, k2, drop = (fresh(names, x) for x in ("_host", "_k1", "_k2", "_drop"))
    text = F.col(quoted(text_col))
    # Two hashes of host and text: what stands for a row's content, so that no id is needed. Lines have two hashes, too.
    rows = docs.withColumn(h, host.cast("string")).withColumn(k1, F.xxhash64(h, text)).withColumn(k2, F.xxhash64(text, F.lit(7), h))
    name = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(7)).alias("b"))
    hashed = F.transform(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, _TRIM, "")), name)
    flat = save(rows.where(F.col(h).isNotNull() & (F.length(text) > 0)).select(F.col(h).alias("h"), F.col(k1).alias("k1"), F.col(k2).alias("k2"), hashed.alias("lines")).dropDuplicates(["h", "k1", "k2"]), "lines")
    pages = flat.groupBy("h").agg(F.count(F.lit(1)).alias("pages"))
    often = flat.select("h", F.explode(F.array_distinct("lines")).alias("line")).where(F.col("line") != name(F.lit(""))).groupBy("h", "line.a", "line.b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_pages)
    common = often.join(pages, "h").where(F.col("c") > ratio * F.col("pages")).select("h", "a", "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = flat.select("h", "k1", "k2", F.posexplode("lines").alias("p", "line"), F.pmod("k1", F.lit(SALTS)).cast("int").alias("salt")).select("h", "k1", "k2", "p", "line.a", "line.b", "salt")
    gone = save(each.join(common, ["h", "a", "b", "salt"]).groupBy("k1", "k2").agg(F.collect_set("p").alias(drop)).withColumnsRenamed({"k1": k1, "k2": k2}), "gone")
    release(flat)
    # Only rows that may lose a line are shuffled; the others pass by a bit table.
    hit = perhaps(gone, k1)
    lost = fresh(names, "lines_dropped")
    whole = rows.where(~hit).select(*map(F.col, map(quoted, names)), F.lit(0).cast("long").alias(lost))
    some = rows.where(hit).join(gone.hint("merge"), [k1, k2], "left")
    new = F.when(F.col(drop).isNull(), text).otherwise(_without(text, F.coalesce(drop, F.array().cast("array<int>"))))
    some = some.select(*(new.alias(c) if c == text_col else F.col(quoted(c)) for c in names), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(lost))
    return whole.unionByName(some)
