"""Joins on grid cells whose work a key is bounded, however many points lie in one place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable

#: Pairs that one key may make. Bytes say nothing of it: a few MB of points in one cell make billions of pairs.
PAIRS_A_KEY = 4_000_000


def slices(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """(_cell, _sa, _sb) of cells that would make more than `most` pairs: into how many slices each side is dealt.

    A row with a column _w counts as so many. A side up to the square root of most stays whole; where
    both are larger, both are dealt, as a whole side would be copied to every slice of the other.
    """
    size = lambda x: F.sum("_w") if "_w" in x.columns else F.count("*")
    counts = a.groupBy("_cell").agg(size(a).alias("na")).join(b.groupBy("_cell").agg(size(b).alias("nb")), "_cell")
    edge = F.lit(math.sqrt(most))
    dealt = lambda own, other: F.when(F.col(own) <= edge, 1).otherwise(F.ceil(F.col(own) * F.least(F.col(other), edge) / F.lit(most))).cast("int")
    return counts.where(F.col("na") * F.col("nb") > most).select("_cell", dealt("na", "nb").alias("_sa"), dealt("nb", "na").alias("_sb"))


def join_cells(a: DataFrame, b: DataFrame, most: int | None = None) -> DataFrame:
    """a and b joined on the column _cell, crowded cells slice by slice.

    Both sides are written once: they are counted before they are joined, and rows
    are dealt to slices in turn, so copies of one point are spread too. Each pair
    meets in one slice. Both are dealt by key to the session's number of shuffle
    partitions, as Spark would join small partitions by bytes to few tasks.
    """
    most = most or PAIRS_A_KEY
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (durable(x.withColumn("_n", F.monotonically_increasing_id())) for x in (a, b))
    crowded = durable(slices(a, b, most))
    if crowded.isEmpty():
        return a.drop("_n", "_w").repartition(n, "_cell").join(b.drop("_n", "_w").repartition(n, "_cell"), "_cell")
    own = lambda n: F.pmod(F.col("_n"), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    a = a.join(crowded, "_cell", "left").withColumns({"_i": own(F.col("_sa"))}).withColumn("_j", every(F.col("_sb")))
    b = b.join(crowded, "_cell", "left").withColumns({"_j": own(F.col("_sb"))}).withColumn("_i", every(F.col("_sa")))
    extra = ("_n", "_w", "_sa", "_sb")
    key = ["_cell", "_i", "_j"]
    return a.drop(*extra).repartition(n, *key).join(b.drop(*extra).repartition(n, *key), key).drop("_i", "_j")
