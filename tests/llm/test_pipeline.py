"""The pipeline stage by stage against brute force, each stage on what the one before kept."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from quillon.llm._tables import save, table
from quillon.llm.oracles import OP3

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append(docs)
    return out


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("doc_id").collect()]


def test_columns(steps):
    for s in steps[:-1]:
        assert s.columns == steps[0].columns


def test_quality_keeps_good(spark, steps):
    labels = table(spark, SF, "labels")
    kept = steps[1].join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r.quality: r["count"] for r in kept}.get(0, 0) <= 3
    assert steps[1].join(labels.where("quality = 1"), "doc_id").count() >= 0.99 * labels.where("quality = 1").join(steps[0], "doc_id").count()


def test_lines(steps):
    before, after = rows(steps[1], "doc_id", "source", "text"), rows(steps[2], "doc_id", "text")
    want = brute.boilerplate([(s, t) for _, s, t in before], 0.05, 5)
    assert after == [(d, t) for (d, _, _), t in zip(before, want, strict=True)]


def test_near_copies(steps):
    kept = {d for d, _, least in brute.near(rows(steps[2], "doc_id", "text"), 5, 80, 100) if d == least}
    assert {d for (d,) in rows(steps[3], "doc_id")} == kept


def test_benchmark(spark, steps):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    kept = {d for d, _, _, ids in brute.windows(rows(steps[3], "doc_id", "text"), items) if not ids}
    assert {d for (d,) in rows(steps[4], "doc_id")} == kept


def test_benchmark_short_items(spark, tmp_path):
    """An item of fewer than 8 words counts whole, once or more; parts of items don't add up."""
    spark.createDataFrame([(1, "alpha beta gamma"), (2, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = ["x alpha beta gamma y", "alpha beta gamma x alpha beta gamma y alpha beta gamma", "alpha beta x beta gamma y " * 9, "one two three four five six seven x two three four five six seven eight", "x two three four five six seven eight nine y", "", None]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id for r in corpus_pipeline.benchmark(spark, docs, str(tmp_path)).collect()} == {2, 3, 5, 6}


def test_mixture(steps, tmp_path):
    steps[4].coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[4] for r in c.sql(OP3).fetchall()}
    got = dict(rows(steps[5], "doc_id", "mix_words"))
    assert {d: n for d, n in want.items() if n} == {d: n for d, n in got.items() if n}


def test_extra_columns_and_empty(spark, steps):
    docs = steps[0].withColumn("score", F.lit("x")).withColumn("predicted", F.lit(1)).withColumn("lines_dropped", F.lit(2)).withColumn("n_hit", F.lit(99)).withColumn("size", F.lit(3)).withColumn("box", F.lit(4))
    docs = docs.withColumns({c: F.lit(5) for c in ("a.b", "x y", "rk", "rk2", "mix_copies", "_raw")}).limit(200)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert len(out.columns) == len(docs.columns) + (2 if name.startswith("mixing") else 0)
        assert out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
