"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each round hangs the larger neighbours of every vertex on its least neighbour, then the smaller ones; after a number of
rounds that grows with the logarithm of the longest chain every component is a star around its least vertex. A round is
two least values by vertex, without a join; nothing of a neighbourhood is ever gathered into one row, and a round
is written to the shared folder, so that lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecue.llm.common import materialize

def _least() -> Column:
    return F.min("v").over(Window.partitionBy("u"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = both.withColumn("m", F.least("u", _least())).filter("v > u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).withColumn("m", _least())
    return down.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


@contextmanager
def _planned_once(spark: SparkSession) -> Iterator[None]:
    """Rounds are many short queries: an adaptive plan would hold a thread of the driver for each shuffle of the last minute."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` (numbers, u <> v, each link at least once in any direction) -> ``u, root`` for every vertex but the roots."""
    edges = materialize(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    with _planned_once(edges.sparkSession):
        state = _state(edges)
        while state[0]:
            edges = materialize(_small(_large(edges)), "stars")
            before, state = state, _state(edges)
            if state == before:
                break
    return edges.select("u", F.col("v").alias("root"))
