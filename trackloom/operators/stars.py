"""Greedy stars over a graph of any shape: the lexicographically first independent set, by rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.shared import materialise

JUMPS = 4


def first_independent(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``edges`` (a, b; a < b) to (node, seed): a node is a seed if none of its smaller neighbours is one.

    What is open is a table of conditions: ``node`` is no seed if ``flip`` turned with whether ``other`` is a seed is
    true. A round fills in what the round before has settled. A node with one open condition is the same as its other
    node or its opposite; those names are followed ``JUMPS`` times, doubling each time, so that a chain of any length
    takes a number of rounds that grows with its logarithm. Others wait for all smaller neighbours. Tables of rounds
    are written; a round's counts reach the driver, no component stands in one task.
    """
    edges = edges.select("a", "b")
    open_ = materialise(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), F.lit(False).alias("flip")).distinct(), "conditions")
    total = open_.count()
    heads = edges.select(F.col("a").alias("node")).join(edges.select(F.col("b").alias("node")), "node", "left_anti").distinct()
    known = materialise(heads.withColumn("seed", F.lit(True)), "settled", total)
    settled = [known]
    for _ in range(max_rounds):
        told = known.select(F.col("node").alias("other"), "seed")
        filled = open_.join(told, "other", "left").withColumn("taken", F.col("seed") != F.col("flip"))
        # of two conditions on one node, one the opposite of the other, one is true
        state = filled.groupBy("node").agg(
            F.coalesce(F.bool_or("taken"), F.lit(False)).alias("taken"),
            F.count_if(F.col("taken").isNull()).alias("n"),
            F.count_distinct(F.when(F.col("taken").isNull(), F.col("other"))).alias("others"),
            F.min(F.when(F.col("taken").isNull(), F.struct("other", "flip"))).alias("one"),
        )
        state = materialise(state.withColumn("taken", F.col("taken") | (F.col("n") > F.col("others"))), "state", total)
        known = state.where("taken or n = 0").select("node", (~F.col("taken")).alias("seed"))
        settled.append(known)
        rest = state.where("not taken and n > 0")
        names = rest.where("n = 1").select("node", F.col("one.other").alias("name"), (~F.col("one.flip")).alias("turn"))
        for _ in range(JUMPS):
            far = names.select(F.col("node").alias("name"), F.col("name").alias("far"), F.col("turn").alias("again"))
            names = names.join(far, "name", "left").select("node", F.coalesce("far", "name").alias("name"), (F.col("turn") != F.coalesce("again", F.lit(False))).alias("turn"))
        names = materialise(names, "names", total)
        going = filled.where("taken is null").join(rest.select("node"), "node", "left_semi").select("node", "other", "flip")
        going = going.join(names.select(F.col("node").alias("other"), "name", "turn"), "other", "left")
        open_ = going.select("node", F.coalesce("name", "other").alias("other"), (F.col("flip") != F.coalesce("turn", F.lit(False))).alias("flip")).distinct()
        open_ = materialise(open_, "conditions", total)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)
    raise RuntimeError(f"seeds did not settle in {max_rounds} rounds")


def first_stars(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b, further columns; a < b) to (seed, node, further columns): the smallest seed next to each node.

    Seeds stand with themselves and null further columns.
    """
    nodes = materialise(first_independent(edges), "seeds")
    more = [c for c in edges.columns if c not in ("a", "b")]
    near = edges.join(nodes.where("seed").select(F.col("node").alias("a")), "a", "left_semi")
    near = near.join(nodes.where("not seed").select(F.col("node").alias("b")), "b", "left_semi")
    least = near.groupBy("b").agg(F.min(F.struct("a", *more)).alias("least"))
    taken = least.select(F.col("least.a").alias("seed"), F.col("b").alias("node"), *[F.col(f"least.{c}").alias(c) for c in more])
    kinds = dict(edges.dtypes)
    return taken.unionByName(nodes.where("seed").select(F.col("node").alias("seed"), "node", *[F.lit(None).cast(kinds[c]).alias(c) for c in more]))
