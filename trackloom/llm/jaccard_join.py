"""N-gram Jaccard join by chosen paths: recursive splitting of sets on sampled shared tokens.

Texts are sets of five-word shingles, embedded as ``TOKENS`` min-hashes; a token is a position and its value. In every
run a set goes to the bucket of each of its tokens that the run's hash samples, 1 / similarity of them on average;
buckets of more than ``small`` sets are split again by further tokens, chosen along the path. Small buckets are compared
in full; so is, in blocks of bounded size, a bucket that stays large to the last level, but for sets that are already
connected. Runs repeat until two sets at the threshold meet with the target probability at the deepest level. What meets
and agrees in its min-hashes is a candidate edge; connected candidates are then compared exactly, shingle by shingle, all
pairs of a component in blocks of bounded size. Equal sets are one node from the start, so copies cost nothing, and only
counts and one edge for each set leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackloom.llm.arrow_text import PRIME, byte_slices, frugal, give_back, mixed, strings, word_hashes
from trackloom.operators.components import connected_components
from trackloom.operators.shared import materialise, with_prefix

TOKENS = 64
SLICE_BYTES = 1 << 20
#: Most documents whose ids are sent to every executor to fetch their texts; beyond, texts are shuffled.
BROADCAST_ROWS = 200_000
#: Shingles (8 bytes each) of a block of sets that are compared with those of another block.
BLOCK_SHINGLES = 1 << 20
_seeds = np.random.default_rng(20)
MULTIPLY = _seeds.integers(1, 2**63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _seeds.integers(0, 2**63, TOKENS, np.uint64)


def shingles(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, end to end, and where each text's begin. A shorter text is one run."""
    word, first = word_hashes(texts)
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    length = np.repeat(np.minimum(size, n), count)
    word = np.append(word, np.zeros(n, np.uint64))
    h = length.astype(np.uint64)
    for k in range(n):
        h = np.where(k < length, h * PRIME + word[start + k], h)
    return mixed(h), at


def sets(texts: pa.Array) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """For each text the 128-bit key of its shingle set (None without words) and the sorted set."""
    flat, at = shingles(texts)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = np.unique(flat[a:b])
        yield (np.array([own.sum(), mixed(own + PRIME).sum()], "<u8").tobytes() if b > a else None), own


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key, n (shingles) and sig (min-hashes) for every row; key and sig are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = strings(batch.column("text")), batch.column("doc_id")
            for a, b in byte_slices(texts, SLICE_BYTES):
                flat, at = shingles(texts.slice(a, b - a))
                full = np.flatnonzero(np.diff(at))
                sig = np.zeros((len(full), TOKENS), "<u4")
                if len(full):
                    for k in range(TOKENS):
                        sig[:, k] = np.minimum.reduceat((flat * MULTIPLY[k] + ADD[k]) >> np.uint64(32), at[:-1][full])
                keys, sizes, sigs = [None] * (b - a), np.zeros(b - a, np.int64), [None] * (b - a)
                for row, i in enumerate(full.tolist()):
                    own = np.unique(flat[at[i] : at[i + 1]])
                    keys[i], sizes[i], sigs[i] = np.array([own.sum(), mixed(own + PRIME).sum()], "<u8").tobytes(), len(own), sig[row].tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(keys, pa.binary()), pa.array(sizes), pa.array(sigs, pa.binary())], ["doc_id", "key", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, key binary, n long, sig binary")


def fixed(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def split(rows: DataFrame, runs: int | None, threshold: float) -> DataFrame:
    """(bucket, key) one level deeper: each set in the bucket of each token chosen on its path.

    ``rows``: key, sig, and bucket but for the first level, where each run is a path of its own. Below the first level
    the result carries sig too: the sets of large buckets meet their min-hashes once and take them along.
    """
    below = np.uint64(2**64 / (threshold * TOKENS))
    position = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
    kept = ["key"] if runs else ["key", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            token = mixed((fixed(batch.column("sig"), "<u4", TOKENS).astype(np.uint64) | position) + PRIME)
            if runs:
                # runs take parts of the range of one hash: no token is chosen twice before all are
                point = mixed(token)
                chosen = ((np.uint64((r + 1) * int(PRIME) % 2**64), point - np.uint64(r * int(below) % 2**64)) for r in range(runs))
            else:
                path = batch.column("bucket").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[:, None]
                chosen = [(path, mixed(token + path * np.uint64(0xD1342543DE82EF95)))]
            for path, h in chosen:
                row, col = np.nonzero(h < below)
                if len(row):
                    bucket = mixed(token[row, col] + np.uint64(1) ^ np.broadcast_to(path, h.shape)[row, col]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), *[batch.column(c).take(pa.array(row)) for c in kept]], ["bucket", *kept])

    return rows.mapInArrow(frugal(run), "bucket long, " + ", ".join(f"{c} binary" for c in kept))


def agreeing(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b) of ``pairs`` (a, b, sig_a, sig_b) whose min-hashes agree in at least the share ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (fixed(batch.column("sig_a"), "<u4", TOKENS) == fixed(batch.column("sig_b"), "<u4", TOKENS)).mean(1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    return pairs.mapInArrow(frugal(run), "a binary, b binary")


def runs_for(recall: float, depth: int) -> int:
    """Runs after which two sets at the threshold have met in a bucket of the last level with probability ``recall``.

    A shared token is chosen for both or for neither; the number chosen is about Poisson with mean 1, so the path dies
    out by level d with probability q(d) = exp(q(d - 1) - 1), q(0) = 0.
    """
    q = 0.0
    for _ in range(depth):
        q = math.exp(q - 1)
    return math.ceil(math.log(1 - recall) / math.log(q))


def crowd_edges(large: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b): edges that connect all sets of one bucket of ``large`` which agree in their min-hashes.

    ``large``: bucket, key, sig and component, what a set is already connected with. A bucket's sets are numbered by
    component and dealt into blocks; a unit is two blocks, compared in full. Units within one component have nothing left
    to connect and are not made. A unit leaves one edge at most for each of its sets.
    """
    members = materialise(with_prefix(large, ["bucket"], [F.col("component"), F.col("key")], F.col("key"), rank="nth").withColumn("own", F.floor(F.col("nth") / block)).drop("nth"), "crowds")
    blocks = members.groupBy("bucket", "own").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    other = blocks.select("bucket", F.col("own").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    units = blocks.withColumnRenamed("own", "i").join(other, "bucket").where("i <= j and not (low = high and low_j = high_j and low = low_j)").select("bucket", "i", "j")
    units = materialise(units, "units")
    dealt = units.withColumn("own", F.explode(F.array_distinct(F.array("i", "j")))).join(members.select("bucket", "own", "key", "sig"), ["bucket", "own"])
    shards = max(1, units.count() // 4)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(shards)))

    def compare(shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), unit in shard.groupby(["bucket", "i", "j"], sort=False):
            key, own = unit["key"].to_numpy(), unit["own"].to_numpy()
            sig = np.frombuffer(b"".join(unit["sig"]), "<u4").reshape(-1, TOKENS)
            x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
            same = np.zeros((len(x), len(y)), np.uint8)
            for k in range(TOKENS):
                same += sig[x, k][:, None] == sig[y, k]
            linked = same >= least * TOKENS
            first = np.arange(len(key), dtype=np.int32)
            while True:
                before = first.copy()
                first[y] = np.minimum(first[y], np.where(linked, first[x][:, None], np.int32(len(key))).min(0))
                first[x] = np.minimum(first[x], np.where(linked, first[y], np.int32(len(key))).min(1))
                if (first == before).all():
                    break
            new = np.flatnonzero(first != np.arange(len(key)))
            out.append(pd.DataFrame({"a": key[first[new]], "b": key[new]}))
        return pd.concat(out)

    return dealt.groupBy("shard").applyInPandas(compare, "a binary, b binary")


def candidate_edges(nodes: DataFrame, threshold: float, recall: float, small: int, depth: int, slack: float, block: int = 2048) -> DataFrame:
    """(a, b): edges that connect all sets which met on a path and agree in their min-hashes.

    On the first level the sets of a large bucket are compared with a hub of it, the same for all buckets where it can
    be; a bucket that is one component by then is done. What is still large at the last level and in several components
    is compared in blocks.
    """
    least = threshold - slack
    sigs = nodes.select("key", "sig")
    rows, found, linked = split(sigs, runs_for(recall, depth), threshold), [], []
    for level in range(1, depth + 1):
        rows = materialise(rows, "paths")
        sizes = rows.groupBy("bucket").count().where("count > 1")
        met = materialise(rows.join(sizes, "bucket"), "buckets", rows.count())
        lists = met.where(F.col("count") <= small).groupBy("bucket").agg(F.sort_array(F.collect_list("key")).alias("keys")).select("keys").distinct()
        at = lists.select("keys", F.explode(F.sequence(F.lit(1), F.size("keys") - 1)).alias("i"))
        found.append(at.select(F.element_at("keys", F.col("i")).alias("a"), F.explode(F.expr("slice(keys, i + 1, size(keys))")).alias("b")))
        large = met.where(F.col("count") > small)
        if large.isEmpty():
            break
        large = (large.join(sigs, "key") if level == 1 else large).select("bucket", "key", "sig")
        if level == 1:
            large = materialise(large, "large")
            hubs = large.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("key").alias("h"), "key", "sig")).alias("x")).select("bucket", F.col("x.key").alias("a"), F.col("x.sig").alias("sig_a"))
            beside = large.select("bucket", F.col("key").alias("b"), F.col("sig").alias("sig_b")).join(hubs, "bucket").where("a <> b")
            linked.append(materialise(agreeing(beside.select("a", "b", "sig_a", "sig_b"), least).distinct(), "linked"))
            groups = connected_components(linked[0]).withColumnRenamed("node", "key")
        if level in (1, depth):
            large = large.join(groups, "key", "left").withColumn("component", F.coalesce("component", "key"))
            several = large.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
            large = large.join(several, "bucket")
        if level < depth:
            rows = split(large, None, threshold)
        else:
            linked.append(crowd_edges(materialise(large, "open"), least, block))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = pairs.distinct()
    pairs = pairs.join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("sig_b")), "b")
    edges = agreeing(pairs.select("a", "b", "sig_a", "sig_b"), least)
    for more in linked:
        edges = edges.union(more)
    return edges


def overlaps(own: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of one unit, beside the diagonal."""
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    flat = np.concatenate(own)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    edge = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    held = np.diff(np.append(edge, len(flat)))
    # what stands in one set alone is in no intersection
    shared = np.repeat(held > 1, held)
    row, held = row[shared], held[held > 1]
    col = np.repeat(np.arange(len(held)), held)
    out = np.zeros((len(own), len(own)), np.float32)
    step = max(1, (8 << 20) // len(own))
    edges = np.searchsorted(col, np.arange(0, len(held) + step, step))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        hot = np.zeros((len(own), min(step, len(held) - k * step)), np.float32)
        hot[row[a:b], col[a:b] - k * step] = 1
        out += hot @ hot.T
    return out.astype(np.int64)


def compared(unit: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set of a unit the weight of those linked with it, and the row of the first set connected with it.

    In a unit of two blocks only pairs across the blocks count; ``side`` tells them apart.
    """
    own = [np.frombuffer(x, "<u8") for x in unit["own"]]
    n = np.array([len(x) for x in own])
    both = overlaps(own)
    linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
    side = unit["side"].to_numpy()
    linked &= (side[:, None] != side[None, :]) if side.max() != side.min() else ~np.eye(len(own), dtype=bool)
    first = np.arange(len(own))
    while True:
        near = np.minimum(first, np.where(linked, first[None, :], len(own)).min(1))
        near = near[near]
        if (near == first).all():
            return linked @ unit["copies"].to_numpy(), first
        first = near


def classed(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, small: int = 32, depth: int = 4, slack: float = 0.18, block: int = 256) -> DataFrame:
    """doc_id, key, copies, links and class (a key) for every row of ``docs``; all but doc_id null for a text without words."""
    marked = materialise(signatures(docs), "signatures")
    nodes = marked.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("x"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    nodes = materialise(nodes.select("key", F.col("x.doc_id").alias("doc_id"), "copies", "n", "sig"), "nodes")
    edges = materialise(candidate_edges(nodes, threshold, recall, small, depth, slack), "candidates")
    groups = connected_components(edges).withColumnRenamed("node", "key")

    members = groups.join(nodes.select("key", "doc_id", "copies", "n"), "key")
    # blocks of at most ``block`` sets and about ``BLOCK_SHINGLES`` shingles
    weight = F.greatest(F.col("n"), F.lit(BLOCK_SHINGLES // block))
    members = with_prefix(members, ["component"], [F.col("key")], F.col("key"), weight, rank="nth", before="ahead")
    members = materialise(members.withColumn("own_block", F.floor(F.col("ahead") / BLOCK_SHINGLES)).drop("nth", "ahead", "n"), "members", groups.count())
    sizes = members.groupBy("component").agg((F.max("own_block") + 1).alias("blocks"))
    # a set goes to the units of its block and each block of its component: (i, j) with i <= j
    units = members.join(sizes, "component").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("key", "doc_id", "copies", "component", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j"), F.col("own_block").alias("side"))
    total = units.count()
    wanted = members.select("doc_id", "key")
    wanted = F.broadcast(wanted) if total <= BROADCAST_ROWS else wanted
    texts = docs.select("doc_id", "text").alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("w.key", "d.text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, keys = strings(batch.column("text")), batch.column("key").to_pylist()
            for a, b in byte_slices(part, SLICE_BYTES):
                # the id may also stand at a row with another text
                found = [(k, own.astype("<u8").tobytes()) for k, (key, own) in zip(keys[a:b], sets(part.slice(a, b - a)), strict=True) if k == key]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["key", "own"])

    sets_ = texts.mapInArrow(frugal(shingled), "key binary, own binary").dropDuplicates(["key"])
    shards = max(1, total // 1000)
    dealt = units.join(sets_, "key").withColumn("shard", F.pmod(F.xxhash64("component", "i", "j"), F.lit(shards)))

    def verify(shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in shard.groupby(["component", "i", "j"], sort=False):
            unit = unit.sort_values("key", ignore_index=True)
            links, first = compared(unit, threshold)
            out.append(pd.DataFrame({"a": unit["key"], "b": unit["key"].to_numpy()[first], "links": links}))
        give_back()
        return pd.concat(out)

    checked = materialise(dealt.groupBy("shard").applyInPandas(verify, "a binary, b binary, links long"), "checked")
    links = checked.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    classes = connected_components(checked.where("a <> b").select("a", "b")).withColumnRenamed("node", "key")
    rows = marked.select("doc_id", "key").join(nodes.select("key", "copies"), "key", "left").join(links, "key", "left").join(classes, "key", "left")
    return rows.withColumn("class", F.coalesce("component", "key"))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, small: int = 32, depth: int = 4, slack: float = 0.18, block: int = 256) -> DataFrame:
    """doc_id, class_id and n_links for every row of ``docs`` (doc_id, text).

    Two rows are linked if their sets of five-word shingles (words are runs without white space, unchanged; a shorter
    text is one shingle) have a Jaccard similarity of at least ``threshold``; equal sets are linked. ``class_id`` is the
    smallest doc_id connected by links, ``n_links`` the number of other rows linked with the row, copies counted each.
    A null or empty text, or one of white space alone, has no words: it is a class of its own without links. Repeated
    rows are linked with each other. An empty table gives an empty result; other columns are ignored. ``recall`` is the
    chance that two sets at the threshold become candidates; all links inside a candidate component are exact.
    """
    rows = classed(docs, threshold, recall, small, depth, slack, block)
    least = rows.where("key is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    n = F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    return rows.join(least, "class", "left").select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), n.alias("n_links"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of each text's shingle set as ``__key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("text"))
            for a, b in byte_slices(texts, SLICE_BYTES):
                keys = pa.array([key for key, _ in sets(texts.slice(a, b - a))], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, keys], [*batch.schema.names, "__key"])

    return docs.mapInArrow(frugal(run), StructType([*docs.schema.fields]).add("__key", "binary"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, one for each class of :func:`jaccard_join`: the one with the smallest doc_id.

    A null doc_id comes last. Texts without words are classes of their own and stay. Rows with one doc_id and equal
    shingles leave one; rows with one doc_id and different texts are judged each by its own class.
    """
    from pyspark.sql import Window

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = classed(docs).where("key is not null").groupBy("class").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.key").alias("__first"))
    kept = keyed(docs).join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__first")), "left")
    kept = kept.where("__key is null or __first is not null").drop("__id", "__first")
    nth = F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy("text"))
    return kept.withColumn("__nth", nth).where("__nth = 1 or doc_id is null and __key is null").drop("__nth", "__key")
