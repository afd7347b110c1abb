"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a hash, are one stream of words, cut into blocks of equal length. Slot i of the
mix belongs to the source in whose share of [0, 1) the golden-ratio point frac((i + 1) * phi) falls; the slot's rank
among its source's slots says which block it takes. A stream is laid down twice, so a rank past the first pass repeats
words, and never more than twice. Everything is joins and windows over buckets of bounded size; a source of any size is
numbered in many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.shared import materialise, with_prefix

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Fractional parts of phi - 1 and of 2**20 * (phi - 1): the point of slot a * 2**20 + b keeps its digits.
GOLDEN, GOLDEN_20 = 0.6180339887498949, (0.6180339887498949 * 2**20) % 1
SLOTS = 1 << 18


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): sources by code point, null last, weigh 5, 2, 1, repeating.

    ``share`` times all words is dealt by weight; a target stops at ``most`` times its source's size and the excess is
    dealt again. That ends where target = min(cap, level * weight): sorted by cap / weight, the level is the rest
    divided by the weights left, at the first source whose cap exceeds it. One row per source, so plain windows do.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(cycle, (nth % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (share * F.sum("source_size").over(everything) - earlier) / left)
    free = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def schedule(targets: DataFrame, slots: int, chunk: int = 8192) -> DataFrame:
    """(slot, source, block): the source of each slot, and which of the source's blocks it takes."""
    spark = targets.sparkSession
    upto = Window.orderBy(F.col("source").asc_nulls_last())
    whole = F.sum("target").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    high = F.sum("target").over(upto) / whole
    shares = targets.where("target > 0").withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)))
    last = F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1
    shares = shares.withColumn("high", F.when(last, F.lit(2.0)).otherwise(F.col("high")))
    cells = 1024
    cut = shares.select("source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.least("high", F.lit(0.9999999)) * cells))).alias("cell"))
    i = F.col("id") + 1
    turned = F.shiftright(i, 20) * F.lit(GOLDEN_20) + i.bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(GOLDEN)
    points = spark.range(slots).select("id", (turned - F.floor(turned)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells)).withColumn("chunk", F.floor(F.col("id") / chunk))
    dealt = points.join(cut, (points.cell == cut.cell) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("id", "chunk", "source")
    counted = dealt.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("source", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("id")) - 1).alias("l")
    same = F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.chunk") == F.col("r.chunk"))
    return inside.join(starts.alias("r"), same).select(F.col("l.id").alias("slot"), "l.source", (F.col("nth") + F.col("start")).alias("block"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words (a null text has none), and __tie that tells rows with one doc_id apart."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("__tie"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, targets, pieces): which words of which document each slot of the mix takes.

    ``docs``: doc_id, text, source. ``pieces``: slot, position (of the piece in its slot, in words), doc_id, source,
    __tie, start and length in words of the document. Null text: no words, so no piece. Null source: a source of its
    own, last. Words of a block past ``most`` passes over its stream are not taken. The result depends on the rows
    alone; rows that are equal in doc_id and text are alike. An empty table gives no pieces.
    """
    sizes = materialise(sized(docs), "sizes")
    targets = materialise(source_targets(sizes, share=share, most=most), "targets")
    totals = targets.agg(F.sum("source_size"), F.sum("target")).first()
    block = min(4096, max(1, (totals[0] or 0) // SLOTS))
    slots = materialise(schedule(targets, -(-int(round(totals[1] or 0)) // block)), "schedule")
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id"), F.col("__tie"), F.col("size")]
    laid = with_prefix(sizes.where("size > 0"), ["source"], order, F.struct(F.lit(seed), "doc_id"), F.col("size"), before="at")
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    laid = laid.alias("l").join(targets.alias("r"), same).select("l.doc_id", "l.source", "l.size", "l.__tie", "l.at", "r.source_size")
    passes = F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1))).alias("turn")
    turns = laid.select("*", passes).withColumn("from", F.col("at") + F.col("turn") * F.col("source_size"))
    spans = F.sequence(F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("size") - 1) / block))
    cut = turns.select("*", F.explode(spans).alias("block"))
    begin = F.greatest(F.col("from"), F.col("block") * block)
    end = F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * block)
    cut = cut.select("doc_id", "source", "__tie", "block", (begin - F.col("from")).alias("start"), (end - begin).alias("length"), (begin - F.col("block") * block).alias("position"))
    same = F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.block") == F.col("c.block"))
    pieces = slots.alias("s").join(cut.alias("c"), same).select("s.slot", "c.position", "c.doc_id", "c.source", "c.__tie", "c.start", "c.length")
    return sizes, targets, pieces


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target and taken, the words that the mix takes of it."""
    sizes, targets, pieces = mix(docs)
    keys = ["doc_id", "source", "__tie"]
    copies = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    # rows that are alike stand next to each other in the stream and share what was taken of them
    taken = pieces.groupBy(*keys).agg(F.sum("length").alias("words"))
    same = lambda l, r: [F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}")) for k in keys]
    known = copies.alias("c").join(taken.alias("t"), same("c", "t"), "left").select("c.*", F.coalesce("t.words", F.lit(0)).alias("words"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("size"))
    out = sizes.withColumn("nth", nth).alias("s").join(known.alias("k"), same("s", "k")).join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    even = F.floor(F.col("k.words") / F.col("k.rows"))
    more = (F.col("s.nth") <= F.col("k.words") - even * F.col("k.rows")).cast("long")
    return out.select("s.doc_id", "s.size", "s.source", "t.source_size", "t.target", (even + more).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often (0 to 2 times) as the mix takes its first word; rows without words once."""
    _, _, pieces = mix(docs)
    begun = pieces.where("start = 0").groupBy("doc_id", "source", "__tie").agg(F.count(F.lit(1)).alias("__n"))
    keyed = docs.withColumn("__t", F.xxhash64("text")).withColumn("__w", F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False)))
    same = [F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("d.source").eqNullSafe(F.col("b.source")), F.col("d.__t") == F.col("b.__tie")]
    alike = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "source", "__t"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "__t").orderBy(F.lit(0)))
    rows = keyed.withColumns({"__alike": alike, "__nth": nth}).alias("d").join(begun.alias("b"), same, "left")
    n = F.coalesce("b.__n", F.lit(0))
    times = F.when(~F.col("d.__w"), F.lit(1)).otherwise(F.floor((n + F.col("d.__alike") - F.col("d.__nth")) / F.col("d.__alike")))
    return rows.withColumn("__times", times.cast("int")).where("__times > 0").select(*[f"d.{c}" for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).drop("__copy")
