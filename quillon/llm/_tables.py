"""Tables in the folder that driver and executors share, and small frame helpers."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a folder of its own only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Bytes of an Arrow batch while a table is written: a task holds a few batches in the JVM and in its worker.
BATCH_BYTES = 1 << 21
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again. The files carry `stored_path`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables made by `save` which no later result reads. The driver is asked to collect garbage, so that Spark drops the
    shuffle files of finished steps, too."""
    paths = [(t.sparkSession, t.stored_path) for t in tables if getattr(t, "stored_path", None)]
    for spark, path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if paths:
        paths[0][0]._jvm.java.lang.System.gc()


def quoted(name: str) -> str:
    """A column's name as an expression reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def fresh(columns: list[str], name: str) -> str:
    """`name`, with underscores added until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled_texts(docs: DataFrame, some: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label, text) of the bounded rows `some` (id, label): one text for each, the least where rows of docs share an id, so that
    repeated ids can't make the sample grow."""
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return texts.join(F.broadcast(some), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def crc_mod(doc_id, mod: int):
    """crc32(doc_id as text) mod `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod
