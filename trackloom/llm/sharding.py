"""Sharding by histogram sort: exact byte counts below probe keys, refined until splitters fit, then one exchange.

Rows are ordered by a 64-bit key: 40 bits of the text's hash, then 24 bits of the doc_id's, so that equal texts are
neighbours and a text with very many copies can still be cut. Probes are prefixes of the key. Each round counts, over
all partitions, the rows and exact bytes below each probe, and goes on only inside the ranges that hold a splitter and
are larger than the tolerance: at most ``shards`` ranges of 256 probes reach the driver in a round, whatever the input.
A row's shard follows from comparing its key with the splitters. For slots, a shard's rows are dealt into cells of
bounded size; cells are counted, start where the cells before them end, and are numbered each on its own, which is the
one exchange of whole rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.shared import materialise

LOW = (1 << 24) - 1
ROUND_BITS = 8
#: Cells by upper bits of the key: at most 2**16, and as many parts of cells that hold many copies of a text, so that the
#: tables of cells are at most some MB and can be sent to every executor.
MOST_CELL_BITS = 16


def order_key(doc_id: Column, text: Column) -> Column:
    """Equal texts share the upper 40 bits. Ranges are told by their upper bits, read as unsigned."""
    return F.xxhash64(text).bitwiseAND(F.lit(~LOW)).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit(LOW)))


def prefix(bits: int) -> Column:
    return F.shiftrightunsigned("__key", 64 - bits) if 0 < bits < 64 else F.col("__key") if bits else F.lit(0).cast("long")


def splitters(keys: DataFrame, total: int, shards: int, most: int) -> list[int]:
    """The keys, read as unsigned, at which the shards but the first begin: each next to its equal part of all bytes.

    A range that holds such a part is refined until it has at most ``most`` bytes or one row, or is a single key.
    """
    wanted = {i: total * i // shards for i in range(1, shards)}
    found: dict[int, int] = {}
    open_, bits = {0: 0}, 0  # prefix of a range: bytes before it
    while wanted and total:
        within = keys if not bits else keys.where(prefix(bits).isin(list(open_)))
        bits += ROUND_BITS
        rows = within.groupBy(prefix(bits).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("b")).collect()
        inside: dict[int, list] = {p: [] for p in open_}
        for r in rows:
            p = r.p % 2**64
            inside[p >> ROUND_BITS].append((p, r.n, r.b))
        again = {}
        for parent, below in open_.items():
            for p, n, b in sorted(inside[parent]):
                for i in [i for i, t in wanted.items() if below <= t < below + b]:
                    if b > most and n > 1 and bits < 64:
                        again[p] = below
                    else:
                        nearer_end = below + b - wanted[i] < wanted[i] - below
                        found[i] = (p + nearer_end) << (64 - bits)
                        del wanted[i]
                below += b
        open_ = again
    return [found[i] for i in sorted(found)]


def shard_of(begins: list[int]) -> Column:
    """How many of the splitters are not above the row's key."""
    if not begins:
        return F.lit(0)
    flipped = F.col("__key").bitwiseXOR(F.lit(-(2**63)))
    inner = [x - 2**63 for x in begins if x < 2**64]
    if len(inner) > 64:
        return F.size(F.filter(F.array(*map(F.lit, inner)), lambda x: x <= flipped))
    return reduce(add, [(flipped >= F.lit(x)).cast("int") for x in inner], F.lit(0))


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.005, cell_bytes: int = 32 << 20) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, ...) with ``size``, ``shard`` and ``slot``; sizes are near equal.

    ``size`` is the text's UTF-8 bytes plus 1 (a null text has none, so 1). Shards differ from an equal part of all
    bytes by ``tolerance`` of it or one row, whichever is more; slots are gapless from 0 in each shard. Equal texts
    share a shard unless a boundary has to cut through copies that are more than the tolerance. Rows with equal
    doc_id and text are alike: which of them has the lower slot is not fixed; a null doc_id is a value like others. An
    empty table gives an empty result. Columns of ``docs`` named size, shard or slot are replaced. A cell that is
    numbered by one task has about ``cell_bytes``, or a 2**16th of all bytes where that is more.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    key = order_key(F.col("doc_id"), F.col("text"))
    keys = materialise(docs.select(key.alias("__key"), size.alias("__size")), "keys")
    total = keys.agg(F.sum("__size")).first()[0] or 0
    begins = splitters(keys, total, shards, max(1, int(tolerance * total / shards)))
    cell_bytes = max(cell_bytes, total >> MOST_CELL_BITS)
    bits = min(MOST_CELL_BITS, (total // cell_bytes).bit_length())
    # cells of hot texts are cut by the part of the key that the doc_id gives; they are at most 2**16 as all bytes are
    hot = keys.groupBy(prefix(bits).alias("__hot")).agg(F.sum("__size").alias("b")).where(F.col("b") > 2 * cell_bytes)
    hot = F.broadcast(hot.select("__hot", F.ceil(F.col("b") / cell_bytes).alias("__parts")))

    def placed(df: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64(F.col("__key").bitwiseAND(F.lit(LOW))), F.coalesce("__parts", F.lit(1)))
        return df.withColumn("__cell", prefix(bits)).join(hot, F.col("__cell") == F.col("__hot"), "left").withColumns({"shard": shard_of(begins).cast("int"), "__part": part}).drop("__hot", "__parts")

    cell = ["shard", "__cell", "__part"]
    before = Window.partitionBy("shard").orderBy("__cell", "__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed(keys).groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    base = docs.drop("size", "shard", "slot").withColumns({"__key": key, "size": size})
    numbered = placed(base).withColumn("__nth", F.row_number().over(Window.partitionBy(*cell).orderBy("__key", "doc_id", "text")) - 1)
    out = numbered.join(F.broadcast(starts), cell)
    return out.select(*[c for c in base.columns if c != "__key"], "shard", (F.col("__nth") + F.col("__first")).alias("slot"))
