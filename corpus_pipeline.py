"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._tables import crc_mod, fresh, quoted, release, save, table
from quillon.llm.bt_quality import bt_quality
from quillon.llm.decontaminate import decontaminate
from quillon.llm.line_dedup import line_dedup
from quillon.llm.mixing import mix_sources
from quillon.llm.ngram_join import keep_one

WINDOW = 8


def _boxed(docs: DataFrame) -> DataFrame:
    """All columns in one, beside those an operator reads, so that no name can clash."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("box"), "doc_id", "text", "source")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return bt_quality(_boxed(docs), labels, keep=["box"]).where("predicted = 1").select("box.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many pages of a source hold go; every document stays."""
    return line_dedup(docs, host=F.col("source")).select(*map(quoted, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, similarity 0.8 or more."""
    return keep_one(docs, k=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of an item go: WINDOW words in a row, or all words of a shorter item. Their length doesn't matter."""
    found = decontaminate(_boxed(docs), table(spark, sf_dir, "benchmark"), window=WINDOW, keep=["box"])
    return found.where(F.col("n_items") == 0).select("box.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with two new columns: the number of copies and the words taken."""
    copies, words = (fresh(docs.columns, x) for x in ("mix_copies", "mix_words"))
    return mix_sources(_boxed(docs), keep=["box"]).where("copies > 0").select("box.*", F.col("copies").alias(copies), F.col("taken").alias(words))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mixture),
]

#: Stages 1, 3 and 4 learn a model or compare sets of all documents: not for SQL. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
