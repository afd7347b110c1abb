"""Substring deduplication: repeated windows of words by compressed FM-indexes, one for each shard.

Two equal windows of ``WINDOW`` words choose the same anchor: the smallest hash among their runs of ``ANCHOR`` words.
The windows of a text that share an anchor are a snippet, and all windows equal to one of them lie in snippets with that
anchor's hash. Snippets are counted by content before anything else moves, so copies are one row with a weight; those
whose anchor occurs once are done. Windows of anchors with more snippets than a shard should hold are counted by the hash
of their words, without an index. The rest go to shards by anchor. A shard's distinct snippets are one text, indexed by
its Burrows-Wheeler transform in a wavelet tree; the snippets then stream through backward search, whose matching
statistics (how far back from a word the text occurs with a weight of two or more) give the intervals to report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.arrow_text import PRIME, byte_slices, encoded, hashes, mixed, raw, strings, words
from trackloom.operators.shared import materialise

WINDOW, ANCHOR = 35, 6
SLICE_BYTES = 2 << 20
PLACE = np.uint64((1 << 26) - 1)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Most snippets (20 bytes each) that are sent to every executor; beyond, they are joined with the texts by row.
BROADCAST_SNIPPETS = 3_000_000


class Snippets:
    """The words of a slice, and its snippets: anchor, hash of content, first word and number of windows."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = raw(texts)
        self.begins, self.stops, self.first = words(self.data, offsets)
        codes, distinct = encoded(self.data, self.begins, self.stops)
        self.word = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        n, w = len(self.word), self.word
        if n < WINDOW:
            self.anchor = self.content = np.zeros(0, np.uint64)
            self.start = self.windows = self.text = np.zeros(0, np.int64)
            return
        h = np.zeros(n, np.uint64)
        for k in range(ANCHOR):
            h[: n - k] = h[: n - k] * PRIME + w[k:]
        gram = mixed(h)
        index = np.arange(n)
        key = (gram & ~PLACE) | (index.astype(np.uint64) & PLACE)
        span = WINDOW - ANCHOR + 1
        low, width = key, 1
        while width * 2 <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        low = np.minimum(low[: n - WINDOW + 1], low[span - width : span - width + n - WINDOW + 1])
        text = np.searchsorted(self.first, index[: n - WINDOW + 1], side="right") - 1
        valid = index[: n - WINDOW + 1] + WINDOW <= self.first[text + 1]
        chosen = low & PLACE
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (chosen[1:] != chosen[:-1])
        self.start = np.flatnonzero(new)
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (chosen[1:] != chosen[:-1])
        self.windows = np.flatnonzero(last) - self.start + 1
        self.text = text[self.start]
        at = self.start + ((chosen[self.start] - self.start.astype(np.uint64)) & PLACE).astype(np.int64)
        self.anchor = gram[at]
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, PRIME)))
        sums = np.append(np.uint64(0), np.add.accumulate(w * power[:n]))
        back = np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, INVERSE)))
        length = self.windows + WINDOW - 1
        self.content = mixed((sums[self.start + length] - sums[self.start]) * back[self.start] + length.astype(np.uint64))


class FMIndex:
    """Burrows-Wheeler transform of a text of integers in a wavelet matrix, with weighted occurrences.

    ``text`` holds symbols from 1 and separators 0; ``weight`` is the weight of each position. Suffixes are sorted by
    their first 48 symbols, which is exact for patterns shorter than that in whole and longer ones up to ties: a pattern
    never spans a separator, and no snippet is longer than ``2 * WINDOW - ANCHOR`` symbols, so ranks double once more.
    """

    def __init__(self, text: np.ndarray, weight: np.ndarray):
        n = len(text)
        size = int(text.max()) + 1
        self.levels = max(1, int(size - 1).bit_length())
        order = self.suffixes(text, n)
        self.before = np.concatenate([[0], np.cumsum(weight[order])])
        sequence = text[order - 1]
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(128 - n % 64, bool)), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1])
            self.zeros.append(n - int(bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        counts = np.bincount(text, minlength=size)
        symbols = np.arange(size)
        self.base = np.concatenate([[0], np.cumsum(counts)[:-1]]) - self.descend(symbols, np.zeros(size, np.int64))

    @staticmethod
    def suffixes(text: np.ndarray, n: int) -> np.ndarray:
        def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            sorted_ = key[order]
            rank[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1]))
            return order, rank

        t = text.astype(np.int64)
        later = lambda x, k: np.append(x[k:], np.zeros(min(k, n), np.int64))
        wide = int(t.max()) + 1
        # two symbols, as three can overflow above 2**21 distinct words
        order, rank = ranked(t * wide + later(t, 1))
        length = 2
        while length < 2 * WINDOW and rank[order[-1]] < n - 1:
            order, rank = ranked(rank * (n + 1) + np.append(rank[length:] + 1, np.zeros(min(length, n), np.int64)))
            length *= 2
        return order

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the transform comes to lie, seen from ``symbol``, on the last level."""
        for k in range(self.levels):
            word = at >> 6
            ones = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.levels - 1 - k) & 1, ones + self.zeros[k], at - ones)
        return at

    def back(self, text: np.ndarray, end: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The matching statistic of each ``end``: the least i >= stop such that text[i:end] has a weight of 2 or more."""
        out = end.copy()
        live = np.flatnonzero(end > stop)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.before) - 1, np.int64)
        while len(live):
            symbol = text[out[live] - 1]
            both = self.base[np.concatenate([symbol, symbol])] + self.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = both[: len(live)], both[len(live) :]
            good = self.before[high] - self.before[low] >= 2
            out[live[good]] -= 1
            good &= out[live] > stop[live]
            live, low, high = live[good], low[good], high[good]
        return out


def repeated_windows(text: np.ndarray, weight: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each snippet, which of its windows occur with a weight of two or more in all snippets of the shard.

    Backward search from the end of a snippet runs until a word that no repeat extends over; the next search starts
    before that word. Every interval of WINDOW words or more that it reports covers repeated windows. Windows between,
    which hold such a word, are tried by themselves: a search that fails at i rules out all windows that begin before i.
    """
    index = FMIndex(text, weight)
    flags = np.zeros((len(starts), WINDOW - ANCHOR + 1), bool)
    column = np.arange(flags.shape[1])
    end = starts + windows + WINDOW - 1
    live = np.arange(len(starts))
    while len(live):
        i = index.back(text, end[live], starts[live])
        first, last = i - starts[live], end[live] - WINDOW - starts[live]
        flags[live] |= (column >= first[:, None]) & (column <= last[:, None])
        end[live] = i - 1
        live = live[end[live] - starts[live] >= WINDOW]
    at = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    while True:
        open_ = ~flags[live] & (column >= at[live][:, None]) & (column < windows[live][:, None])
        some = open_.any(1)
        live = live[some]
        if not len(live):
            return flags
        at[live] = open_[some].argmax(1)
        s = starts[live] + at[live]
        i = index.back(text, s + WINDOW, s)
        flags[live[i == s], at[live[i == s]]] = True
        at[live] = np.where(i == s, at[live] + 1, i - starts[live])


def row_key() -> F.Column:
    return F.xxhash64("doc_id", "text").alias("row")


def snippet_counts(docs: DataFrame) -> DataFrame:
    """(anchor, content, n, row): every distinct snippet, how often it occurs, and the row of one occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = strings(batch.column("text")), batch.column("row").to_numpy(zero_copy_only=False)
            for a, b in byte_slices(texts, SLICE_BYTES):
                s = Snippets(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(s.anchor.view(np.int64)), pa.array(s.content.view(np.int64)), pa.array(rows[a:b][s.text])], ["anchor", "content", "row"])

    found = docs.select(row_key(), "text").mapInArrow(run, "anchor long, content long, row long")
    return found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))


def shared_snippets(docs: DataFrame, most: int = 4000) -> DataFrame:
    """Those of :func:`snippet_counts` whose anchor occurs at least twice, and ``hot``: it has over ``most`` of them."""
    counted = materialise(snippet_counts(docs), "counted")
    anchors = counted.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")).where("total > 1")
    return counted.join(anchors.select("anchor", (F.col("distinct") > most).alias("hot")), "anchor")


class Lookup:
    """Numbers kept by content: one table for all texts, or those that came with the rows of a batch."""

    def __init__(self, shared):
        self.shared = shared

    def at(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.shared is not None:
            return self.shared.value
        content, value = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("contents", "numbers"))
        counts = np.diff(batch.column("contents").offsets.to_numpy())
        row = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), counts) if len(content) else np.zeros(0, np.int64)
        content, first = np.unique(content.astype(np.int64), return_index=True)
        return content, value[first].astype(np.int64), row[first]


def located(table: tuple[np.ndarray, ...], content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of ``content`` the table has, and where."""
    if not len(table[0]):
        return np.zeros(len(content), bool), np.zeros(len(content), np.int64)
    at = np.minimum(np.searchsorted(table[0], content), len(table[0]) - 1)
    return table[0][at] == content, at


def attached(docs: DataFrame, numbers: DataFrame, most: int) -> tuple[DataFrame, Lookup]:
    """``docs`` with what ``numbers`` (row, content, number) says of their snippets: broadcast if small, else joined."""
    spark = docs.sparkSession
    keyed = docs.withColumn("row", row_key())
    if numbers.limit(most + 1).count() <= most:
        table = numbers.select("content", "number", "row").toArrow()
        content, number, row = (table.column(c).to_numpy() for c in ("content", "number", "row"))
        order = np.argsort(content, kind="stable")
        return keyed, Lookup(spark.sparkContext.broadcast((content[order], number[order], row[order])))
    lists = numbers.groupBy("row").agg(F.collect_list(F.struct("content", "number")).alias("x"))
    lists = lists.select("row", F.col("x.content").alias("contents"), F.col("x.number").alias("numbers"))
    none = F.array().cast("array<bigint>")
    joined = keyed.join(lists, "row", "left").withColumns({"contents": F.coalesce("contents", none), "numbers": F.coalesce("numbers", none)})
    return joined, Lookup(None)


def snippet_words(docs: DataFrame, wanted: DataFrame, shards: int, most: int) -> DataFrame:
    """(shard, content, n, windows, low, high): the words of each wanted snippet, 40 bits of hash for each.

    The shard of snippets with a hot anchor is -1.
    """
    # a negative number tells that the anchor is hot
    number = F.when(F.col("hot"), -F.col("n")).otherwise(F.col("n"))
    docs, lookup = attached(docs.select("doc_id", "text"), wanted.select("row", "content", number.alias("number")), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = lookup.at(batch)
            texts, rows = strings(batch.column("text")), batch.column("row").to_numpy(zero_copy_only=False)
            keep = np.isin(rows, table[2])
            texts, rows = texts.filter(pa.array(keep)), rows[keep]
            for a, b in byte_slices(texts, SLICE_BYTES):
                s = Snippets(texts.slice(a, b - a))
                content = s.content.view(np.int64)
                found, at = located(table, content)
                found &= table[2][at] == rows[a:b][s.text] if len(at) and len(table[2]) else False
                _, one = np.unique(content[found], return_index=True)
                pick = np.flatnonzero(found)[one]
                length = s.windows[pick] + WINDOW - 1
                offsets = np.concatenate([[0], np.cumsum(length)])
                word = s.word[np.repeat(s.start[pick] - offsets[:-1], length) + np.arange(offsets[-1])]
                blob = lambda x, width: pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(x)])
                low, high = (word & np.uint64(0xFFFFFFFF)).astype("<u4"), (word >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8)
                n = table[1][at[pick]].astype(np.int64)
                shard = np.where(n < 0, -1, (s.anchor[pick] % np.uint64(shards)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(content[pick]), pa.array(np.abs(n)), pa.array(s.windows[pick].astype(np.int32)), blob(low, 4), blob(high, 1)], ["shard", "content", "n", "windows", "low", "high"]
                )

    return docs.mapInArrow(run, "shard long, content long, n long, windows int, low binary, high binary")


def repeats(snippets: DataFrame) -> DataFrame:
    """(content, number): the repeated windows of each snippet as bits, from the index of its shard."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("content")
        low = np.frombuffer(b"".join(rows["low"]), "<u4").astype(np.uint64)
        word = low | np.frombuffer(b"".join(rows["high"]), np.uint8).astype(np.uint64) << np.uint64(32)
        windows = rows["windows"].to_numpy(np.int64)
        length = windows + WINDOW - 1
        starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        place = np.arange(len(word)) + np.repeat(np.arange(len(rows)), length)
        text = np.zeros(len(word) + len(rows), np.int64)
        text[place] = np.unique(word, return_inverse=True)[1] + 1
        weight = np.repeat(rows["n"].to_numpy(np.int64), length + 1)
        flags = repeated_windows(text, weight, starts, windows)
        number = flags @ (1 << np.arange(flags.shape[1], dtype=np.int64))
        return pd.DataFrame({"content": rows["content"].to_numpy()[number > 0], "number": number[number > 0]})

    return snippets.groupBy("shard").applyInPandas(search, "content long, number long")


def hot_repeats(snippets: DataFrame) -> DataFrame:
    """As :func:`repeats`, for snippets whose anchor has too many for one index: windows are counted by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            low = np.frombuffer(b"".join(batch.column("low").to_pylist()), "<u4").astype(np.uint64)
            word = low | np.frombuffer(b"".join(batch.column("high").to_pylist()), np.uint8).astype(np.uint64) << np.uint64(32)
            windows = batch.column("windows").to_numpy().astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(windows + WINDOW - 1)[:-1]])
            own = np.repeat(np.arange(len(windows)), windows)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
            h = np.zeros(len(own), np.uint64)
            for k in range(WINDOW):
                h = mixed(h * PRIME + word[starts[own] + nth + k])
            yield pa.RecordBatch.from_arrays([batch.column("content").take(pa.array(own)), batch.column("n").take(pa.array(own)), pa.array(nth.astype(np.int32)), pa.array(h.view(np.int64))], ["content", "n", "nth", "hash"])

    each = materialise(snippets.dropDuplicates(["content"]).select("content", "n", "windows", "low", "high").mapInArrow(run, "content long, n long, nth int, hash long"), "windows")
    repeated = each.groupBy("hash").agg(F.sum("n").alias("total")).where("total > 1").select("hash")
    return each.join(repeated, "hash").groupBy("content").agg(F.expr("bit_or(shiftleft(1L, nth))").alias("number"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(row, content) of every snippet of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = strings(batch.column("text")), batch.column("row").to_numpy(zero_copy_only=False)
            for a, b in byte_slices(texts, SLICE_BYTES):
                s = Snippets(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(rows[a:b][s.text]), pa.array(s.content.view(np.int64))], ["row", "content"])

    return docs.select(row_key(), "text").mapInArrow(run, "row long, content long").distinct()


def substring_dedup(docs: DataFrame, snippets_per_shard: int = 4000, broadcast: int = BROADCAST_SNIPPETS) -> DataFrame:
    """doc_id, n_words, n_removed, spans and kept_text for every row of ``docs`` (doc_id, text).

    Words are runs without white space, unchanged; a window is WINDOW consecutive words of one text. Each word is removed
    that a window covers whose words also start anywhere else, the same text included; windows are judged on the input.
    ``spans`` are the removed words as (first, last + 1), ``kept_text`` the other words joined by one space. A null,
    empty or blank text has no words and an empty ``kept_text``; repeated rows repeat each other; an empty table gives an
    empty result; other columns are ignored. Words are compared by 64-bit hashes, inside shards by 40 bits of them.
    """
    wanted = materialise(shared_snippets(docs, snippets_per_shard), "snippets")
    shards = max(1, wanted.count() // snippets_per_shard)
    snippets = snippet_words(docs, wanted, shards, broadcast)
    if wanted.where("hot").isEmpty():
        found = repeats(snippets)
    else:
        snippets = materialise(snippets, "words")
        found = repeats(snippets.where("shard >= 0")).union(hot_repeats(snippets.where("shard < 0")))
    found = materialise(found, "repeats")
    if found.limit(broadcast + 1).count() <= broadcast:
        numbers = found.withColumn("row", F.lit(0).cast("long"))
    else:
        numbers = occurrences(docs).join(found, "content")
    docs, lookup = attached(docs.select("doc_id", "text"), numbers, broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = lookup.at(batch)
            texts, ids = strings(batch.column("text")), batch.column("doc_id")
            for a, b in byte_slices(texts, SLICE_BYTES):
                s = Snippets(texts.slice(a, b - a))
                n = len(s.begins)
                hit, at = located(table, s.content.view(np.int64))
                bits = np.where(hit, table[1][at], 0) if len(at) and len(table[1]) else np.zeros(len(s.start), np.int64)
                own, nth = np.nonzero(bits[:, None] >> np.arange(WINDOW - ANCHOR + 1) & 1)
                opened = s.start[own] + nth
                gone = np.cumsum(np.bincount(opened, minlength=n + WINDOW) - np.bincount(opened + WINDOW, minlength=n + WINDOW))[:n] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[s.first[1:]] - total[s.first[:-1]]
                text = np.repeat(np.arange(b - a), np.diff(s.first))
                edge = np.append(True, text[1:] != text[:-1]) if n else np.zeros(0, bool)
                enter = np.flatnonzero(gone & (edge | ~np.append(False, gone[:-1])[:n]))
                leave = np.flatnonzero(gone & (np.append(edge[1:], True)[:n] | ~np.append(gone[1:], False)[:n])) + 1
                base = s.first[text[enter]]
                spans = pa.StructArray.from_arrays([pa.array(enter - base), pa.array(leave - base)], ["first", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(enter, s.first).astype(np.int32)), spans)
                kept = np.flatnonzero(~gone)
                size = s.stops[kept] - s.begins[kept]
                # each kept word and a space, but for the last of a text
                last = np.append(text[kept][1:] != text[kept][:-1], True)[: len(kept)]
                wide = size + ~last
                upto = np.concatenate([[0], np.cumsum(wide)])
                body = np.full(upto[-1], 32, np.uint8)
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                body[np.repeat(upto[:-1], size) + inside] = s.data[np.repeat(s.begins[kept], size) + inside]
                cuts = upto[np.searchsorted(kept, s.first)]
                out = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(s.first)), pa.array(removed), spans, out], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<first: long, end: long>>, kept_text string")
