"""Language-model scores by online logistic context mixing over the bits of tokens.

A token is a path of bits: the Huffman code, over training counts, of a bounded vocabulary of frequent words, an end and
an escape; behind the escape a word has its smoothed share of the rare words. Each bit is predicted from several hashed
contexts (the code's node alone; with the word before; with the two words before; with the word before the last).
Their logits are combined by weights that a gate, the counts behind the first two word contexts, selects; the weights are
learned online over all training texts, and an adaptive table refines the result.

Spark counts words over all training texts in hash buckets, codes every text once as symbols of two bytes, and counts
contexts over all training texts of either half; each half teaches the weights with the counts of the other half, so
that no text is predicted from itself. Learning follows blocks of texts in the order of a hash: blocks are cut by the
number of training tokens, so the result does not depend on partitions. What is broadcast (codes, quantised context
tables, weights) has a size fixed by parameters; counts of rare words, which grow with the corpus, stay in their buckets,
and what each text needs of them is looked up bucket by bucket. Tasks expand a few thousand tokens at a time to bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.arrow_text import SPACES, byte_slices, encoded, hashes, raw, strings, words
from trackloom.llm.language_id import remainder
from trackloom.operators.shared import materialise

#: Frequent words with a code of their own; symbols 0 and 1 are the end of a text and the escape.
VOCABULARY = 1 << 14
CONTEXTS = 3
#: Slots of a context table: about four for each training token, between these powers of two.
LEAST_SLOT_BITS, MOST_SLOT_BITS = 16, 22
#: Levels of a code whose slots stand side by side.
LINE_LEVELS = 2
CHUNK_BITS = 16
GATES = 64
INPUTS = CONTEXTS + 2
CURVE = 33
SLICE_BYTES = 2 << 20
#: Tokens that are expanded to bits at a time.
STRIDE = 12_000
#: Training tokens of a block that is learned in order, and of a task that counts contexts.
BLOCK_TOKENS, TASK_TOKENS = 1_000_000, 6_000_000
#: Text of a hash bucket of words, text whose rare words are looked up together, and tables merged by a task.
BUCKET_BYTES, UNIT_BYTES, MERGED = 16 << 20, 16 << 20, 32
SMOOTH = 0.1
CONFIDENCE = np.searchsorted([1, 2, 3, 6, 16, 64, 256], np.arange(257), side="right").astype(np.uint16)
#: A state is 3 bits of confidence and 10 of the logit.
LEVELS, REACH = 1024, 10.0
EMPTY = np.uint16(LEVELS // 2)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def stretches(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Row ranges of about ``most`` bytes with their bytes and offsets; a longer text comes alone, cut at white space."""
    for a, b in byte_slices(texts, most):
        data, offsets = raw(texts.slice(a, b - a))
        if b - a > 1 or len(data) <= most:
            yield a, b, [(data, offsets)]
            continue
        parts, at = [], 0
        while at < len(data):
            stop = min(at + most, len(data))
            while stop < len(data) and not (gap := np.flatnonzero(SPACES[data[stop : stop + 4096]])).size:
                stop = min(stop + 4096, len(data))
            stop += int(gap[0]) if stop < len(data) else 0
            parts.append((data[at:stop], np.array([0, stop - at])))
            at = stop
        yield a, b, parts


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of every word, the hash of each code, and each text's first word."""
    data = lowered(data)
    begins, stops, first = words(data, offsets)
    codes, distinct = encoded(data, begins, stops)
    return codes, hashes(distinct), first


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the sums of their counts."""
    h, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def word_counts(train: DataFrame, buckets: int, vocabulary: int = VOCABULARY) -> DataFrame:
    """One row for each bucket of word hashes: sorted hashes and counts, totals, and the bucket's most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            h, c = summed(held)
            at = np.searchsorted(h, edges(buckets))
            cuts = [(k, a, b) for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in cuts], pa.int32()), pa.array([h[a:b].tobytes() for _, a, b in cuts], pa.binary()), pa.array([c[a:b].tobytes() for _, a, b in cuts], pa.binary())], ["bucket", "hash", "n"])

        size = 0
        for batch in batches:
            for _, _, parts in stretches(strings(batch.column("text"))):
                for data, offsets in parts:
                    codes, h, _ = coded(data, offsets)
                    held.append((h, np.bincount(codes, minlength=len(h))))
                    size += len(h)
                if size > 2_000_000:
                    held[:] = [summed(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield rows()
                        held.clear()
                        size = 0
        if held:
            yield rows()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        h, c = summed([(np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64)) for x, y in zip(rows["hash"], rows["n"], strict=True)])
        top = np.sort(np.lexsort((h.view(np.int64), -c))[:vocabulary])
        return pd.DataFrame([(int(rows["bucket"].iloc[0]), h.tobytes(), c.tobytes(), int(c.sum()), len(c), h[top].tobytes(), c[top].tobytes())])

    found = train.select("text").mapInArrow(run, "bucket int, hash binary, n binary")
    return found.groupBy("bucket").applyInPandas(merge, "bucket int, hash binary, n binary, tokens long, types long, top_hash binary, top_n binary")


def most_frequent(counts: DataFrame, vocabulary: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words of all buckets, however many buckets there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("top_hash").to_pylist(), batch.column("top_n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["hash", "n"])

    top = counts.select("top_hash", "top_n").mapInArrow(run, "hash long, n long").orderBy(F.desc("n"), "hash").limit(vocabulary).toArrow()
    return top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy()


def edges(buckets: int) -> np.ndarray:
    """Where the hash range of each bucket begins."""
    return np.array([(k << 64) // buckets for k in range(buckets)] + [2**64 - 1], np.uint64)


class Codes:
    """Huffman codes: symbol 0 is the end of a text, 1 the escape, then the vocabulary in order of its hashes."""

    def __init__(self, top_hash: np.ndarray, top_n: np.ndarray, ends: int, rare: int, slot_bits: int):
        order = np.argsort(top_hash)
        self.top, self.slot_bits = top_hash[order], slot_bits
        self.counts = np.concatenate([[ends, rare], top_n[order]]).astype(np.float64)
        heap = [(max(float(n), 0.5), i) for i, n in enumerate(self.counts)]
        heapq.heapify(heap)
        m = len(heap)
        parent, bit, weight = np.zeros(2 * m, np.int64), np.zeros(2 * m, bool), np.zeros((2 * m, 2))
        nxt = m
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i], parent[j], bit[j] = nxt, nxt, True
            weight[nxt] = a, b
            heapq.heappush(heap, (a + b, nxt))
            nxt += 1
        nodes, roots, marks, lens = [], [], [], []
        for i in range(m):
            path = []
            while i != nxt - 1:
                path.append((parent[i] - m, int(bit[i])))
                i = parent[i]
            lens.append(len(path))
            # LINE_LEVELS levels share the hash of their root and differ in the place below it: neighbours in a table
            root, place = 0, 1
            for t, (n, b) in enumerate(reversed(path)):
                if t % LINE_LEVELS == 0:
                    root, place = n, 1
                nodes.append(n)
                roots.append(root)
                marks.append(place << 1 | b)
                place = place << 1 | b
        self.lens = np.array(lens, np.int64)
        self.at = np.cumsum(self.lens) - self.lens
        inner = weight[m:nxt]
        draw = np.random.default_rng(11)
        # an entry of a path: the node's logit, whose lowest bits are replaced by the place and the path's bit, and the
        # hash of the root
        self.paths = np.empty((len(nodes), 2), np.uint32)
        logit = (np.log(inner[:, 1]) - np.log(inner[:, 0])).astype(np.float32)[nodes].view(np.uint32)
        self.paths[:, 0] = logit & ~np.uint32((2 << LINE_LEVELS) - 1) | np.array(marks, np.uint32)
        self.paths[:, 1] = draw.integers(0, 1 << 32, max(1, len(inner)), np.uint32)[roots]
        self.paths = self.paths.view(np.uint64)[:, 0]
        #: for each symbol its part in the three contexts
        self.seeds = draw.integers(0, 1 << 32, (4, m), np.uint32)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The symbol of each word hash; 1 where it has none of its own."""
        if not len(self.top):
            return np.ones(len(h), np.uint16)
        place = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
        return np.where(self.top[place] == h, place + 2, 1).astype(np.uint16)


ENCODED = "unit long, bucket int, ord int, doc_id long, fold long, n_bytes long, sym binary, hash binary"


def symbol_texts(docs: DataFrame, shared, buckets: int) -> DataFrame:
    """Rows of two kinds: one for each text with its symbols (bucket -1), and each unit's rare words by bucket.

    ``docs``: doc_id, text, fold. In the second kind ``sym`` holds the number (ord) of the text in the unit that each
    hash stands in, once for each time.
    """
    names = [x.split()[0] for x in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        context = TaskContext.get()
        unit = (context.partitionId() if context else 0) << 24
        rare, held, count = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, o = np.concatenate([x for x, _ in rare]), np.concatenate([x for _, x in rare])
            order = np.argsort(h, kind="stable")
            h, o = h[order], o[order]
            at = np.searchsorted(h, edges(buckets)).tolist()
            for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if b > a:
                    values = [unit, k, None, None, None, None, o[a:b].tobytes(), h[a:b].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            texts = strings(batch.column("text"))
            for a, b, parts in stretches(texts):
                found, size = [], b - a
                for data, offsets in parts:
                    code, h, first = coded(data, offsets)
                    own = codes.symbols(h)
                    sym = own[code]
                    low = np.flatnonzero(sym == 1)
                    rare.append((h[code[low]], (np.searchsorted(first, low, side="right") - 1 + count).astype("<i4")))
                    found.append((sym, first))
                if len(found) > 1:
                    found = [(np.concatenate([x for x, _ in found]), np.array([0, sum(len(x) for x, _ in found)]))]
                sym, first = found[0]
                # every text ends with symbol 0
                out = np.zeros(len(sym) + size, "<u2")
                out[np.arange(len(sym)) + np.repeat(np.arange(size), np.diff(first))] = sym
                at = (first + np.arange(size + 1)) * 2
                bytes_ = np.diff(raw(texts.slice(a, size))[1])
                if at[-1] >= 2**31:
                    raise ValueError("a text of more than 2**30 tokens")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, unit)),
                        pa.array(np.full(size, -1, np.int32)),
                        pa.array(np.arange(count, count + size, dtype=np.int32)),
                        batch.column("doc_id").slice(a, size),
                        batch.column("fold").slice(a, size),
                        pa.array(bytes_),
                        pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)]),
                        pa.nulls(size, pa.binary()),
                    ],
                    names,
                )
                count += size
                held += int(bytes_.sum())
                if held >= UNIT_BYTES:
                    yield from flush()
                    rare, held, count, unit = [], 0, 0, unit + 1
        if rare:
            yield from flush()

    return docs.select("doc_id", "text", "fold").mapInArrow(run, ENCODED)


def streams(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges of a column of symbols, and the symbols of each range end to end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), "<u2")
        a = b


class Bits:
    """The bits of the tokens ``i`` to ``j`` of a stream of symbols, with a slot for each hashed context."""

    def __init__(self, sym: np.ndarray, i: int, j: int, codes: Codes):
        own = sym[i:j].astype(np.int32)
        prev = np.zeros(j - i, np.int32)
        prev[1:] = own[:-1]
        prev[:1] = sym[i - 1] if i else 0
        two = np.zeros(j - i, np.int32)
        two[1:] = prev[:-1]
        two[:1] = sym[i - 2] if i > 1 else 0
        two[prev == 0] = 0  # the text before
        seeds = codes.seeds
        contexts = (seeds[0][prev], seeds[1][prev] ^ (seeds[2][two] * np.uint32(0x9E3779B1)), seeds[3][two])
        lens = codes.lens[own]
        ends = np.cumsum(lens)
        self.starts = ends - lens
        found = codes.paths[np.repeat(codes.at[own] - self.starts, lens) + np.arange(ends[-1])].view(np.uint32).reshape(-1, 2)
        head, step = found[:, 0].copy(), found[:, 1].copy()
        self.bits, self.logit = head & np.uint32(1), head.view(np.float32)
        place = (head >> np.uint32(1)) & np.uint32((1 << LINE_LEVELS) - 1)
        shift, base = np.uint32(32 - codes.slot_bits), np.uint32((1 << codes.slot_bits) - (1 << LINE_LEVELS))
        self.slots = []
        for c in contexts:
            h = np.repeat(c, lens)
            h += step
            h *= np.uint32(0x9E3779B1)
            h >>= shift
            h &= base
            h |= place
            self.slots.append(h.astype(np.intp))


def packed(counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Counts as compressed bytes of at most 255, and the places and values of larger ones."""
    large = np.flatnonzero(counts > 255)
    low = np.minimum(counts, 255).astype(np.uint8)
    return pa.compress(low.tobytes(), codec="zstd", asbytes=True), large.astype("<u4").tobytes(), counts[large].astype("<i8").tobytes()


def unpacked(low: bytes, at: bytes, n: bytes, size: int) -> np.ndarray:
    counts = np.frombuffer(pa.decompress(low, decompressed_size=size, codec="zstd", asbytes=True), np.uint8).astype(np.int64)
    counts[np.frombuffer(at, "<u4")] = np.frombuffer(n, "<i8")
    return counts


TABLE = "side int, tab int, chunk int, part long, low binary, at binary, n binary"


def context_tables(train: DataFrame, shared, slot_bits: int, tasks: int) -> list:
    """Rows (tab, chunk, first, second, every): quantised predictions of each chunk of slots, from the training texts of
    the first half, the second half, and both.

    ``train``: sym and side (0 or 1). Each of at most ``tasks`` tasks a side sums its own tables and sends the chunks it
    has touched; tables are merged ``MERGED`` at a time, so no group grows with the corpus.
    """
    size = 2 << slot_bits
    width = min(size, 1 << CHUNK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        tables, which, one = np.zeros((CONTEXTS, size), np.uint32), 0, np.uint32(1)
        for batch in batches:
            which = batch.column("side")[0].as_py() if batch.num_rows else which
            for _, _, sym in streams(batch.column("sym")):
                for i in range(0, len(sym), STRIDE):
                    e = Bits(sym, i, min(i + STRIDE, len(sym)), codes)
                    for k, slot in enumerate(e.slots):
                        np.add.at(tables[k], 2 * slot + e.bits, one)
        for k in range(CONTEXTS):
            for chunk in range(size // width):
                cut = tables[k, chunk * width : (chunk + 1) * width]
                if cut.any():
                    values = [which, k, chunk, part, *packed(cut)]
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [x.split()[0] for x in TABLE.split(", ")])

    def total(rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros(width, np.int64)
        for low, at, n in zip(rows["low"], rows["at"], rows["n"], strict=True):
            out += unpacked(low, at, n, width)
        return out

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        return pd.DataFrame([(int(r["side"]), int(r["tab"]), int(r["chunk"]), int(r["part"]) // MERGED, *packed(total(rows)))])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        both = [total(rows[rows["side"] == s]) for s in (0, 1)]
        return pd.DataFrame([(int(rows["tab"].iloc[0]), int(rows["chunk"].iloc[0]), *[quantised(x) for x in (*both, both[0] + both[1])])])

    # a task counts texts of one side alone
    halves = [train.where(F.col("side") == k).coalesce(tasks) for k in (0, 1)]
    found, parts = halves[0].union(halves[1]).mapInArrow(run, TABLE), 2 * tasks
    while parts > MERGED:
        found = found.groupBy("side", "tab", "chunk", F.floor(F.col("part") / MERGED)).applyInPandas(merge, TABLE)
        parts = -(-parts // MERGED)
    return found.groupBy("tab", "chunk").applyInPandas(finish, "tab int, chunk int, first binary, second binary, every binary").collect()


def quantised(counts: np.ndarray) -> bytes:
    """For each slot its state: the logit of its smoothed counts and the level of its confidence."""
    zero, one = counts[0::2], counts[1::2]
    logit = np.log((one + 0.4) / (zero + 0.4))
    level = np.rint((np.clip(logit, -REACH, REACH) + REACH) * ((LEVELS - 1) / (2 * REACH))).astype(np.uint16)
    level[zero + one == 0] = EMPTY
    return (level | (CONFIDENCE[np.minimum(zero + one, 256)] << np.uint16(10))).astype("<u2").tobytes()


def joined(rows: list, field: str, slot_bits: int) -> list[np.ndarray]:
    """The states of each context table."""
    out = [np.full(1 << slot_bits, EMPTY, np.uint16) for _ in range(CONTEXTS)]
    half = min(1 << slot_bits, 1 << (CHUNK_BITS - 1))
    for r in rows:
        out[r.tab][r.chunk * half : (r.chunk + 1) * half] = np.frombuffer(r[field], "<u2")
    return out


def inputs(e: Bits, tables: list[np.ndarray]) -> tuple[list, np.ndarray]:
    """The logits that are mixed for each bit (the second is constant), and the gate of each bit."""
    states = [t[s] for t, s in zip(tables, e.slots, strict=True)]
    gate = (states[0] >> np.uint16(10)) * np.uint16(8) + (states[1] >> np.uint16(10))
    scale = np.float32(2 * REACH / (LEVELS - 1))
    logits = [(s & np.uint16(LEVELS - 1)).astype(np.float32) * scale - np.float32(REACH) for s in states]
    return [e.logit, np.float32(0.3), *logits], gate.astype(np.intp)


START = np.repeat(np.array([[0.3], [0.0], [0.5], [0.2], [0.1]], np.float64), GATES, 1)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


def dotted(x: list, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = x[0] * weights[0][gate]
    for k in range(1, INPUTS):
        out += x[k] * weights[k][gate]
    return out


def curve_cell(gate: np.ndarray, dot: np.ndarray) -> np.ndarray:
    return (gate >> 3) * CURVE + ((np.clip(dot, -8, 8) + 8) * np.float32((CURVE - 1) / 16) + np.float32(0.5)).astype(np.intp)


def learned(train: DataFrame, shared, blocks: int, rate: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Weights for each gate, and the counts of the refining curve (zeros and ones), over all training texts.

    ``train``: doc_id, side, sym. Every block starts from the same weights and follows its own texts in the order of a
    hash, with the counts of the other side; blocks are averaged by their bits.
    """

    def learn(table: pa.Table) -> pa.Table:
        codes, halves = shared.value
        tables = halves[1 - table.column("side")[0].as_py()]
        w, squares, curve, bits = START.copy(), np.full(START.shape, 1e-3), np.zeros((2, 8 * CURVE)), 0
        for _, _, sym in streams(table.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("sym", "ascending")]).column("sym")):
            for i in range(0, len(sym), STRIDE // 4):
                e = Bits(sym, i, min(i + STRIDE // 4, len(sym)), codes)
                x, gate = inputs(e, tables)
                dot = dotted(x, gate, w.astype(np.float32))
                cell = curve_cell(gate, dot)
                seen, ones = np.bincount(cell, minlength=8 * CURVE), np.bincount(cell, e.bits, 8 * CURVE)
                curve += seen - ones, ones
                off = e.bits.astype(np.float32) - squash(dot)
                up = np.stack([np.bincount(gate, off * v, GATES) for v in x]) / np.sqrt(np.bincount(gate, minlength=GATES) + 1)
                squares += up * up
                w += rate * up / np.sqrt(squares) * 2
                bits += len(gate)
        return pa.table({"bits": [bits], "weights": pa.array([w.tobytes()], pa.binary()), "curve": pa.array([curve.tobytes()], pa.binary())})

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["bits"].to_numpy(np.float64)
        w = sum(k * np.frombuffer(x) for k, x in zip(n, rows["weights"], strict=True))
        curve = sum(np.frombuffer(x) for x in rows["curve"])
        return pd.DataFrame([(int(n.sum()), (w / max(n.sum(), 1.0)).tobytes(), curve.tobytes())])

    schema = "bits long, weights binary, curve binary"
    place = F.xxhash64("doc_id", "sym")
    dealt = train.select("doc_id", "side", "sym", place.alias("place"), F.pmod(F.shiftrightunsigned(place, 20), F.lit(blocks)).alias("block"))
    found = dealt.groupBy("side", "block").applyInArrow(learn, schema)
    some = found.groupBy(F.pmod(F.xxhash64("curve"), F.lit(max(1, blocks // 32))).alias("salt")).applyInPandas(average, schema)
    rows = some.groupBy(F.lit(0).alias("all")).applyInPandas(average, schema).collect()
    if not rows or not rows[0].bits:
        return START.copy(), np.zeros((2, 8 * CURVE))
    return np.frombuffer(rows[0].weights).reshape(START.shape), np.frombuffer(rows[0].curve).reshape(2, -1)


def refined(curve: np.ndarray) -> np.ndarray:
    """The refining curve as probabilities, smoothed to the identity where little was seen."""
    own = squash(np.tile(np.linspace(-8, 8, CURVE), 8))
    return (curve[1] + 20 * own) / (curve.sum(0) + 20)


def token_logs(sym: np.ndarray, codes: Codes, tables: list, weights: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """log10 of the probability that the model gives each symbol of a stream."""
    out = np.zeros(len(sym))
    if len(codes.counts) < 2:
        return out
    for i in range(0, len(sym), STRIDE):
        j = min(i + STRIDE, len(sym))
        e = Bits(sym, i, j, codes)
        x, gate = inputs(e, tables)
        dot = dotted(x, gate, weights)
        p = np.float32(0.5) * (squash(dot) + curve[curve_cell(gate, dot)])
        out[i:j] = np.add.reduceat(np.log10(np.where(e.bits == 1, p, 1 - p)), e.starts)
    return out


def scored(texts: DataFrame, shared) -> DataFrame:
    """unit, ord, doc_id, fold, n_bytes, n_tokens, and n_top, base, mix of the symbols, and the number of rare words."""
    schema = "unit long, ord int, doc_id long, fold long, n_bytes long, n_tokens long, n_top long, base double, mix double, n_rare long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tables, weights, curve, price = shared.value
        weights, curve = weights.astype(np.float32), curve.astype(np.float32)
        top = (codes.counts > 0) & (np.arange(len(codes.counts)) != 1)
        price = np.where(np.arange(len(price)) == 1, 0.0, price)
        for batch in batches:
            for a, b, sym in streams(batch.column("sym")):
                begin = np.append(0, np.flatnonzero(sym == 0)[:-1] + 1)
                each = lambda v: np.add.reduceat(v, begin)  # noqa: B023, E731
                found = [np.diff(np.append(begin, len(sym))), each(top[sym].astype(np.int64)), each(price[sym]), each(token_logs(sym, codes, tables, weights, curve)), each((sym == 1).astype(np.int64))]
                own = [batch.column(c).slice(a, b - a) for c in ("unit", "ord", "doc_id", "fold", "n_bytes")]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, found)], names)

    return texts.select("unit", "ord", "doc_id", "fold", "n_bytes", "sym").mapInArrow(run, schema)


def rare_sums(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """unit, ord, and over the text's rare words the sum of log10(count + SMOOTH) and how many are known."""

    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(right["hash"].iloc[0], np.uint64) if len(right) else np.zeros(0, np.uint64)
        c = np.frombuffer(right["n"].iloc[0], np.int64) if len(right) else np.zeros(0, np.int64)
        out = []
        for unit, own, ord_ in zip(left["unit"], left["hash"], left["sym"], strict=True):
            own, ord_ = np.frombuffer(own, np.uint64), np.frombuffer(ord_, "<i4")
            at = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
            found = np.where(h[at] == own, c[at], 0) if len(h) else np.zeros(len(own), np.int64)
            ids, where = np.unique(ord_, return_inverse=True)
            logs = np.bincount(where, np.log10(found + SMOOTH), len(ids))
            out.append((unit, ids.astype("<i4").tobytes(), logs.tobytes(), np.bincount(where, found > 0, len(ids)).astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["unit", "ord", "logs", "known"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        o = np.concatenate([np.frombuffer(x, "<i4") for x in rows["ord"]])
        ids, where = np.unique(o, return_inverse=True)
        total = [np.bincount(where, np.concatenate([np.frombuffer(x, t) for x in rows[c]]), len(ids)) for c, t in (("logs", np.float64), ("known", np.int64))]
        return pd.DataFrame({"unit": rows["unit"].iloc[0], "ord": ids, "logs": total[0], "known": total[1].astype(np.int64)})

    # a bucket's words of all units may be many: units are dealt, and each part meets the bucket's counts
    part = F.pmod(F.shiftrightunsigned("unit", 24) + F.col("unit").bitwiseAND(F.lit((1 << 24) - 1)), F.col("parts"))
    wanted = texts.where("bucket >= 0").select("unit", "bucket", "hash", "sym")
    parts = wanted.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("hash")) / UNIT_BYTES).alias("parts"))
    left = wanted.join(parts, "bucket").withColumn("part", part).select("bucket", "part", "unit", "hash", "sym")
    right = counts.select("bucket", "hash", "n").join(parts, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    found = left.groupBy("bucket", "part").cogroup(right.groupBy("bucket", "part")).applyInPandas(look_up, "unit long, ord binary, logs binary, known binary")
    return found.groupBy("unit").applyInPandas(merge, "unit long, ord int, logs double, known long")


def lm_scores(docs: DataFrame, folds: int = 10, buckets: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of ``docs``.

    Texts are lower-cased in A-Z; tokens are runs without white space and one end for each text; a null text counts as
    empty and is its end alone. The model learns from rows whose crc32(doc_id as text) is not 0 modulo ``folds``; it
    gives each training token and one unknown token a probability, as the base does, in which N is all training tokens
    and V the distinct ones. Repeated rows are scored each and teach each; a null doc_id counts as the empty text in
    the fold. Without training rows every token is unknown. ``bits_per_byte`` is the score in bits for each UTF-8 byte
    (null for an empty text). An empty table gives an empty result; other columns are ignored. Scores do not depend on
    partitions or on ``buckets``.
    """
    sc = docs.sparkSession.sparkContext
    own = docs.select("doc_id", "text", remainder(F.col("doc_id"), folds).alias("fold"))
    train = own.where("fold <> 0")
    ends, size = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = buckets or max(8, size // BUCKET_BYTES)
    counts = materialise(word_counts(train, buckets), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    top_hash, top_n = most_frequent(counts)
    n, v = totals[0] + ends, totals[1] + (ends > 0)
    rare, rare_types = totals[0] - int(top_n.sum()), totals[1] - len(top_n)
    slot_bits = min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, int(n).bit_length() + 2))
    codes = Codes(top_hash, top_n, ends, rare, slot_bits)
    to_codes = sc.broadcast(codes)
    texts = materialise(symbol_texts(own, to_codes, buckets), "symbols")
    # halves by the checksum that makes the folds, but for its remainder
    side = ((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) / folds).cast("long") % 2).cast("int")
    learn = texts.where("bucket < 0 and fold <> 0").select("doc_id", "sym", side.alias("side"))
    tables = context_tables(learn, to_codes, slot_bits, max(1, round(n / 2 / TASK_TOKENS)))
    to_halves = sc.broadcast((codes, [joined(tables, "first", slot_bits), joined(tables, "second", slot_bits)]))
    weights, curve = learned(learn, to_halves, max(1, round(n / 2 / block_tokens)))
    # all that read these is written or here
    to_halves.destroy()
    to_codes.destroy()
    whole, rest = float(np.log10(n + SMOOTH * (v + 1))), float(np.log10(rare + SMOOTH * (rare_types + 1)))
    price = np.log10(codes.counts + SMOOTH) - whole
    to_all = sc.broadcast((codes, joined(tables, "every", slot_bits), weights, refined(curve), price))
    rows = scored(texts.where("bucket < 0"), to_all).join(rare_sums(texts, counts), ["unit", "ord"], "left")
    logs = F.coalesce("logs", F.lit(0.0))
    score = F.col("mix") + logs - F.col("n_rare") * rest
    return rows.select(
        "doc_id",
        (F.col("fold") == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_top") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_rare") * whole).alias("base_score"),
        score.alias("score"),
        F.when(F.col("n_bytes") > 0, -score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
