"""Connected components of an edge table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atollkit.llm.common import pinned, skew_join


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def nearer(edges: DataFrame) -> DataFrame:
    """(id, comp) for every vertex of edges (a, b): comp is a smaller id that it reaches within two steps and a step from there, or
    itself. Not the smallest one of the component: a cheap first merge, whose result needs no rounds."""
    both = both_ways(edges)
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp")).select("id", F.least("id", "comp").alias("comp"))
    near = skew_join(both.select(F.col("b").alias("id"), F.col("a").alias("to")), labels, "id", "inner").groupBy(F.col("to").alias("id")).agg(F.min("comp").alias("comp"))
    jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
    return skew_join(near.select("id", F.least("id", "comp").alias("comp")), jump, "comp").select("id", F.least("comp", F.coalesce("further", "comp")).alias("comp"))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, comp) for every vertex of edges (a, b): comp is the smallest id reachable.

    Each round every vertex takes the smallest label among its own, its neighbours' and its label's label, so paths shrink
    by halves. Labels are pinned in the shared folder each round; edges are read again, so pin them before. An empty edge table gives
    no rows."""
    both = both_ways(edges)
    labels = pinned(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")))
    for _ in range(rounds):
        near = skew_join(both.select(F.col("b").alias("id"), F.col("a").alias("to")), labels, "id", "inner").select(F.col("to").alias("id"), "comp", F.lit(None).cast("string").alias("old"))
        least = near.unionByName(labels.withColumn("old", F.col("comp"))).groupBy("id").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        new = pinned(skew_join(least, jump, "comp").select("id", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "old"))
        labels = new.select("id", "comp")
        if new.where("comp != old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
