"""Two-way references over tables: derived inverses, integrity, and search along references."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import ValueError_
from quillon.operators.collection import Coll


def inverse(child: Coll, fk: str) -> DataFrame:
    """(fk, n, ids): the other side of a reference, a set of the things that point here. Partial results are made in every task."""
    return child.rows.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(child.key)).alias("ids"))


def inverse_counts(child: Coll, fk: str) -> DataFrame:
    """(fk, n, first, last) without the list, for sides of any size."""
    return child.rows.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n"), F.min(child.key).alias("first"), F.max(child.key).alias("last"))


def broken(child: Coll, fk: str, parent: Coll) -> DataFrame:
    """Things whose reference points at nothing."""
    return child.df().where(F.col(fk).isNotNull()).join(parent.df().select(F.col(parent.key).alias("_k")), F.col(fk) == F.col("_k"), "left_anti")


def search(edges: DataFrame, start: int, needle: int, deep: int = 1, limit: int = 1) -> DataFrame:
    """edges (parent, key, child): the places up to `deep` references below start that hold needle, nearest first.

    A recursive common table expression walks breadth first; each level keeps distinct things only.
    """
    if not 0 <= deep <= 127 or not 0 <= limit <= 255:
        raise ValueError_("deep must be 0 to 127, limit 0 to 255")
    spark = edges.sparkSession
    view = f"_quillon_edges_{uuid.uuid4().hex}"  # a name of its own: an earlier result may still read its edges
    edges.createOrReplaceTempView(view)
    return spark.sql(
        f"""
        WITH RECURSIVE reach (id, d) AS (
          SELECT CAST({int(start)} AS BIGINT), 0
          UNION ALL
          SELECT DISTINCT e.child, r.d + 1 FROM reach r JOIN {view} e ON e.parent = r.id WHERE r.d < {int(deep)}
        ), near AS (SELECT id, min(d) AS d FROM reach GROUP BY id)
        SELECT e.parent, e.key, n.d AS depth FROM near n JOIN {view} e ON e.parent = n.id
        WHERE e.child = {int(needle)} ORDER BY n.d, e.parent, e.key LIMIT {int(limit)}
        """
    )
