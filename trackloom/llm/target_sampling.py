"""Importance resampling towards a target: array-scored weights, Gumbel noise by hash, exact selection of the top share.

Words and their runs fall into hashed buckets; the documents' and the target's counts of each bucket give it a gain, and
a document's weight is the mean gain of its features. Noise drawn from the row's id is added, so that the highest scores
are a sample without replacement. The cutoff is found by weighted median of medians: every partition offers the median
of the keys that it still holds, the median of those by weight is the next pivot, and the side of the pivot that the
cutoff can't be on, a quarter of the keys at least, goes. Keys that remain are rewritten when few are left, so that all
rounds together read little more than the first ones. Winners alone are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.arrow_text import byte_slices, encoded, strings
from trackloom.operators.shared import ROWS_PER_FILE, materialise

SLICE_BYTES = 8 << 20
#: Bytes as they count in words: A-Z lower-cased; digits, letters and everything past ASCII stand in words.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IN_WORDS = np.zeros(256, bool)
IN_WORDS[48:58] = IN_WORDS[97:123] = IN_WORDS[128:] = True
#: Remaining keys are written anew once they are this share of those written last.
REWRITE = 1 / 8


def features(texts: pa.Array, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every run of 1 to ``max_run`` words of all texts, and the number of words of each text."""
    data = LOWERED[np.frombuffer(b"\0".join(texts.cast(pa.binary()).to_pylist()) + b"\0", np.uint8)]
    solid = IN_WORDS[data]
    before = np.append(False, solid[:-1])
    begins, ends = np.flatnonzero(solid & ~before), np.flatnonzero(~solid & before)
    bounds = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    text_of = np.searchsorted(bounds, begins, side="right")
    keep = solid | before
    place = np.cumsum(keep) - 1
    joined, begins = np.where(solid, data, np.uint8(32))[keep], place[begins]
    ends = place[ends]
    whose, codes = [], []
    for n in range(1, max_run + 1):
        first = np.flatnonzero(text_of[: len(text_of) - n + 1] == text_of[n - 1 :])
        for r in range(n):  # runs of one turn don't overlap
            at = first[first % n == r]
            code, distinct = encoded(joined, begins[at], ends[at + n - 1])
            crc = np.fromiter((zlib.crc32(x) % buckets for x in distinct.to_pylist()), np.int64, len(distinct))
            whose.append(text_of[at])
            codes.append(crc[code] if len(at) else np.zeros(0, np.int64))
    return np.concatenate(whose), np.concatenate(codes), np.bincount(text_of, minlength=len(texts))


def bucket_counts(texts: DataFrame, max_run: int, buckets: int) -> np.ndarray:
    """How many features of all ``texts`` (text) fall into each bucket; tasks add up before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = strings(batch.column("text"))
            for a, b in byte_slices(column, SLICE_BYTES):
                total += np.bincount(features(column.slice(a, b - a), max_run, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares for each bucket, rounded down."""
    n, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((target + 1.0) * (all_s + n)) / ((corpus + 1.0) * (all_t + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(row_id: object, seed: int) -> int:
    """Gumbel noise in thousandths from the hash of seed and id; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, max_run: int = 1, seed: int = 2024) -> DataFrame:
    """Each row's id with n_words, n_features, weight (mean gain, rounded down; 0 without features) and score."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = strings(batch.column("text")), batch.column("doc_id")
            for a, b in byte_slices(column, SLICE_BYTES):
                whose, codes, words = features(column.slice(a, b - a), max_run, len(gain))
                n = np.bincount(whose, minlength=b - a)
                total = np.zeros(b - a, np.int64)
                np.add.at(total, whose, gain[codes])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                own = ids.slice(a, b - a)
                luck = np.array([noise(x, seed) for x in own.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, (words.astype(np.int64), n.astype(np.int64), weight, weight + luck))], names)

    longs = [T.StructField(c, T.LongType()) for c in names[1:]]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), *longs]))


def weighted_median(keys: list[tuple], weights: list[int]) -> tuple:
    """The first key, in order, up to which half of the weight lies."""
    half, total = sum(weights) / 2, 0
    for key, weight in sorted(zip(keys, weights, strict=True)):
        total += weight
        if total >= half:
            return key
    raise ValueError("no keys")


def compared(x: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """-1, 0 or 1 for rows of two columns below, at and above ``key``."""
    a, b = ((x[:, i] > key[i]).astype(np.int8) - (x[:, i] < key[i]) for i in (0, 1))
    return np.where(a != 0, a, b)


#: What a task tells of its keys: numbers below, at and above the pivot, and the medians of both sides.
COUNTS = ("less", "same", "more", "less_a", "less_b", "more_a", "more_b")


def cutoff(keys: DataFrame, k: int) -> tuple[int, int]:
    """The ``k``-th of ``keys`` (a, b: longs without nulls), 1 <= k <= rows, in ascending order.

    A round is one job over the keys between the bounds. A task gives the numbers of keys below, at and above the pivot
    and the medians of both sides, so that the driver gets a row for each partition and the next pivot needs no other job.
    """

    def look(low: tuple | None, high: tuple | None, pivot: tuple | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [np.zeros((0, 2), np.int64)]
            for batch in batches:
                x = np.column_stack([batch.column(c).to_numpy() for c in ("a", "b")]).astype(np.int64)
                on = np.ones(len(x), bool)
                if low:
                    on &= compared(x, low) > 0
                if high:
                    on &= compared(x, high) < 0
                parts.append(x[on])
            x = np.concatenate(parts)
            side = compared(x, pivot) if pivot else np.ones(len(x), np.int8)  # without a pivot all keys count as above it
            rows = {"less": 0, "same": int((side == 0).sum()), "more": 0}
            for name, sign in (("less", -1), ("more", 1)):
                part = x[side == sign]
                rows[name] = len(part)
                middle = part[np.lexsort((part[:, 1], part[:, 0]))[(len(part) - 1) // 2]].tolist() if len(part) else [None, None]
                rows[f"{name}_a"], rows[f"{name}_b"] = middle
            yield pa.RecordBatch.from_pylist([rows], schema=pa.schema([(c, pa.int64()) for c in COUNTS]))

        return run

    low = high = pivot = None
    held = left = None
    while True:
        near = keys
        if low:
            near = near.where(F.col("a") >= low[0])
        if high:
            near = near.where(F.col("a") <= high[0])
        seen = near.select("a", "b").mapInArrow(look(low, high, pivot), ", ".join(f"{c} long" for c in COUNTS)).collect()  # a row for each partition
        less, same, more = (sum(r[c] for r in seen) for c in ("less", "same", "more"))
        held = less + same + more if held is None else held
        if pivot and k <= less:
            high, side, left = pivot, "less", less
        elif pivot and k <= less + same:
            return pivot
        else:
            k -= less + same
            low, side, left = pivot or low, "more", more
        offers = [(r[f"{side}_a"], r[f"{side}_b"]) for r in seen if r[side]]
        pivot = weighted_median(offers, [r[side] for r in seen if r[side]])
        if left <= held * REWRITE:
            held = left
            inside = F.lit(True)
            if low:
                inside &= F.struct("a", "b") > F.struct(F.lit(low[0]).alias("a"), F.lit(low[1]).alias("b"))
            if high:
                inside &= F.struct("a", "b") < F.struct(F.lit(high[0]).alias("a"), F.lit(high[1]).alias("b"))
            keys = materialise(keys.where(inside), "keys", left)


def ranked(rows: DataFrame, order: list[Column], n_rows: int) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of all: dealt by range, numbered inside ranges that start where others end."""
    ranges = rows.repartitionByRange(n_rows // ROWS_PER_FILE + 1, *order).withColumn("__p", F.spark_partition_id())
    dealt = materialise(ranges, "ranges")
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return dealt.withColumn("__r", inside).join(F.broadcast(starts), "__p").withColumn("rank", F.col("__r") + F.col("__before")).drop("__p", "__r", "__before")


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, max_run: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Each row's doc_id, n_features, weight, score, and its rank (1, 2, ...) among the drawn, null for the others.

    ``docs``: doc_id (a long), text; ``target``: text; further columns don't matter. Of the N rows with ``least_words``
    words, floor(``percent`` * N / 100) are drawn: the highest scores, ties to the smaller doc_id, a null doc_id first.
    A null text has no words: weight 0, never drawn if ``least_words`` > 0. Repeated rows are rows of their own with
    equal scores. Empty tables give an empty result or, for the target, gains by the corpus alone.
    """
    gain = gains(bucket_counts(docs, max_run, buckets), bucket_counts(target, max_run, buckets))
    rows = materialise(scored(docs, gain, max_run, seed), "scores")
    able = rows.where(F.col("n_words") >= least_words)
    n = able.count()
    k = percent * n // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*out)
    a, b = -F.col("score"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    last = cutoff(able.select(a.alias("a"), b.alias("b")), k)
    drawn = (F.col("n_words") >= least_words) & ((a < last[0]) | ((a == last[0]) & (b <= last[1])))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    winners = ranked(rows.where(drawn), order, k).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    losers = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return winners.select(*out).unionByName(losers.select(*out))
