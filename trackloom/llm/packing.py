"""Best-fit packing by minimum bin slack over the histogram of lengths.

A bin is seeded with the longest remaining piece; a subset-sum dynamic program over the available lengths, one bitset
of ``capacity`` bits, finds the fullest feasible combination for the rest, which is then removed. Short pieces are taken
only while more than a tolerated slack is left, which keeps them for later bins; several tolerances are tried, and the
plan with the fewest bins counts. Lengths are whole numbers up to ``capacity``, so the remaining pieces are at most ``capacity`` counts, whatever the input: the program
runs on that histogram and takes a combination as often as its counts allow, at most a few thousand times in all.
Spark makes the pieces, counts lengths, numbers the pieces of each length in buckets of bounded size, and joins them
with the ranges of numbers that each combination takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.shared import materialise, with_prefix

CELLS = 64
#: Slacks, for bins of about a thousand, below which short pieces stay out of a combination.
TOLERATED = (1, 0, 2, 4, 8, 12, 16, 24, 32, 64)


def fullest(counts: dict[int, int], order: list[int], room: int, tolerated: int = 0) -> dict[int, int]:
    """The multiset of lengths within ``counts`` with the largest sum of at most ``room``; longer lengths first.

    Shorter lengths stay out of it once some sum leaves at most ``tolerated``.
    """
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in order:
        left = min(counts[length], room // length) if length <= room else 0
        k = 1
        while left > 0:
            k = min(k, left)
            grown = (bits | (bits << (length * k))) & mask
            if grown != bits:
                steps.append((length, k, bits))
                bits = grown
            left -= k
            k *= 2
        if bits >> max(0, room - tolerated):
            break
    target, chosen = bits.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + k
            target -= length * k
    return chosen


def slack_plan(histogram: dict[int, int], capacity: int, tolerated: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, {length: pieces in each}) that use up the histogram, with one tolerated slack."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    plan = []
    while counts:
        order = sorted(counts, reverse=True)
        seed = order[0]
        counts[seed] -= 1
        bin_ = fullest(counts, order, capacity - seed, tolerated)
        counts[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in bin_.items())
        for k, n in bin_.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        plan.append((times, bin_))
    return plan


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """The plan with the fewest bins over the tolerated slacks; one that meets the sum's lower bound ends the search."""
    bins = lambda plan: sum(times for times, _ in plan)
    least, best = -(-sum(k * n for k, n in histogram.items()) // capacity), None
    for tolerated in TOLERATED:
        plan = slack_plan(histogram, capacity, tolerated)
        best = plan if best is None or bins(plan) < bins(best) else best
        if bins(best) <= least:
            break
    return best


def ranges(plan: list[tuple[int, dict[int, int]]], histogram: dict[int, int]) -> list[tuple]:
    """(length, cell, low, high, first bin, pieces in a bin, offset): which numbers of a length go where."""
    out, used, first = [], dict.fromkeys(histogram, 0), 0
    for times, bin_ in plan:
        offset = 0
        for length in sorted(bin_, reverse=True):
            n, low = bin_[length], used[length]
            high, cell = low + n * times, -(-histogram[length] // CELLS)
            out += [(length, c, low, high, first, n, offset) for c in range(low // cell, (high - 1) // cell + 1)]
            used[length], offset = high, offset + n * length
        first += times
    return out


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """All rows and columns of ``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``.

    Lengths must be 1 to ``capacity``. Offsets in a sequence are gapless from 0. Rows that are equal in every column
    that orders them (length, doc_id, piece) are interchangeable. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces.drop("sequence_id", "offset"), "pieces")
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    if any(not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"a length is not within 1 and {capacity}")
    table = ranges(minimum_bin_slack(histogram, capacity), histogram)
    schema = "__length long, __cell long, __low long, __high long, __first long, __n long, __offset long"
    # at most CELLS + 1 rows for each length, and those of the combinations: bounded by the capacity alone
    table = F.broadcast(spark.createDataFrame(table, schema))
    cells = F.broadcast(spark.createDataFrame([(k, -(-n // CELLS)) for k, n in histogram.items()], "__len long, __per long"))
    numbered = with_prefix(pieces, ["length"], [F.col("doc_id"), F.col("piece")], F.struct("doc_id", "piece"), rank="__rank")
    placed = numbered.join(cells, F.col("length") == F.col("__len")).withColumn("__at", F.floor(F.col("__rank") / F.col("__per")))
    placed = placed.join(table, (F.col("length") == F.col("__length")) & (F.col("__at") == F.col("__cell")) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high")))
    step = F.col("__rank") - F.col("__low")
    bin_ = F.floor(step / F.col("__n"))
    return placed.select(*pieces.columns, (F.col("__first") + bin_).alias("sequence_id"), (F.col("__offset") + (step - bin_ * F.col("__n")) * F.col("length")).alias("offset"))
