"""Connected components by contraction: every round hooks nodes to a neighbour and merges what hangs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.shared import materialise

JUMPS = 3


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) to (node, component): the smallest node that each node is connected with.

    In a round every node takes the first of itself and its neighbours in a random order of that round (aggregated
    before the shuffle, so a hub is one row per task), then what that one has taken, and so on ``JUMPS`` times; edges
    are renamed to what their ends have taken, and those inside one name go. A star is gone after a round, a path of
    any order loses a fixed share of its edges. Tables of rounds are written to the shared folder; nothing but a count
    reaches the driver. Nulls and loops connect nothing.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    both = materialise(edges.union(edges.select("b", "a")).distinct(), "edges")
    total, steps = both.count(), []
    for turn in range(max_rounds):
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        taken = both.groupBy("a").agg(F.least(F.min(place("b")), F.min(place("a"))).alias("near")).select(F.col("a").alias("node"), F.col("near.x").alias("label"))
        step = taken
        for _ in range(JUMPS):
            step = step.join(taken.select(F.col("node").alias("at"), F.col("label").alias("far")), F.col("label") == F.col("at")).select("node", F.col("far").alias("label"))
        steps.append(materialise(step, "step", total))
        head = both.join(steps[-1], both.a == F.col("node")).select(F.col("label").alias("head"), "b")
        ends = head.join(steps[-1], head.b == F.col("node")).select(F.col("head").alias("a"), F.col("label").alias("b"))
        both = materialise(ends.where("a <> b").distinct(), "edges", total)
        if both.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = steps[0]
    for step in steps[1:]:
        renamed = step.select(F.col("node").alias("was"), F.col("label").alias("now"))
        labels = labels.join(renamed, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
    labels = materialise(labels, "labels", total)
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
