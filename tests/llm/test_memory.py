"""What a worker holds: batches of a written table are small, and what a batch needed doesn't stay in a worker that is used again."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm._tables import save

LEFT = """
import ctypes
import random
import pyarrow as pa
from quillon.llm import ngram_join
from types import SimpleNamespace as Box

class Frame:
    schema = {"id": Box(dataType=Box(simpleString=lambda: "long"))}
    def select(self, *names):
        return self
    def mapInArrow(self, run, kind):
        return run

words = [f"w{i}" for i in range(5000)]
def batches():
    rng = random.Random(1)
    for _ in range(14):
        ids = pa.array(range(700))
        yield pa.RecordBatch.from_arrays([ids, ids, ids, pa.array([" ".join(rng.choices(words, k=600)) for _ in range(700)])], ["rk", "rk2", "id", "text"])

held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4 // 1024
run = ngram_join.sketch(Frame(), 5, 80, 100)
for _ in run(b.slice(0, 9) for b in batches()):  # loads what stays anyway
    pass
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
before = held()
rows = sum(b.num_rows for b in run(batches()))
print(rows, held() - before)
"""


def test_worker_gives_back():
    """9800 texts of 3 KB in batches of 2 MB: what stays is less than 20 MB."""
    got = subprocess.run([sys.executable, "-c", LEFT], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=120, check=True)
    rows, left = map(int, got.stdout.split())
    assert rows == 9800
    assert left < 20


def test_small_batches(spark):
    """A batch of a table that `save` writes has little over 2 MB."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    docs = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 600).alias("text"))
    got = save(docs.mapInArrow(run, "n long, size long"), "sizes").agg(F.sum("n").alias("n"), F.max("size").alias("size")).first()
    assert got.n == 4000
    assert got["size"] < 2.2 * (1 << 20)
