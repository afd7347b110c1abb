"""Token counts and token ids: distinct safe pieces of whole texts are encoded in batches inside Arrow tasks.

Texts are cut at white space where no token can cross (see ``safe_pieces``), pieces that are equal are encoded once for
each slice, and frequent ones once for each Python worker, so that very long texts and repeated words cost little.
Slices hold about the same number of bytes whatever the number of rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trackloom.llm.arrow_text import byte_slices, encoded, give_back, raw, safe_pieces, strings

SLICE_BYTES = 2 << 20
#: Pieces that a worker remembers (about 15 MB); others are encoded anew in each slice.
REMEMBERED = 300_000
#: Longer pieces are never remembered.
SHORT = 64
#: Pieces that are encoded as one text where they can be.
JOINED = 256


class Encoder:
    """Token ids of pieces by the library of the file's kind: .json (tokenizers) or .model (sentencepiece).

    Sentencepiece is given whole texts: its white-space marks depend on the neighbours, so nothing is cut. Ids of pieces
    that are remembered (``known``) stand end to end in ``pool``, from ``pool_at`` on.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole, self.widths = path.endswith(".model"), None
        if self.whole:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.batch = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            kind = json.loads(model.to_str())
            if kind["normalizer"] is None and kind["pre_tokenizer"]["type"] == "ByteLevel":
                # every character of a token stands for one byte, so pieces can be told apart in a joined text
                widths = {i: len(t) for t, i in model.get_vocab(with_added_tokens=True).items()}
                self.widths = np.zeros(max(widths) + 1, np.int64)
                self.widths[list(widths)] = list(widths.values())
        self.known = pa.array([], pa.binary())
        self.pool, self.pool_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        ids = self.batch(texts)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n

    def joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """As :meth:`flat`, for pieces that neighbours don't change: many are encoded as one text. None: they do."""
        data, offsets = raw(pieces)
        cuts = [*range(0, len(pieces), JOINED), len(pieces)]
        found = [self.flat([data[offsets[a] : offsets[b]].tobytes().decode("utf-8") for a, b in zip(some[:-1], some[1:], strict=True)])[0] for some in (cuts[k : k + 65] for k in range(0, len(cuts) - 1, 64))]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        upto = np.cumsum(self.widths[ids])
        at = np.searchsorted(upto, offsets[1:])
        if len(pieces) and (at[-1] >= len(upto) or (upto[at] != offsets[1:]).any()):
            return None
        return ids, np.diff(at + 1, prepend=0)

    def encode(self, distinct: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids end to end, and where each distinct piece's begin and how many it has; ``often``: how many times it occurs."""
        row = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy()
        data, offsets = raw(distinct)
        size = np.diff(offsets)
        new = np.flatnonzero(row < 0)
        plain, rest, together = new[:0], new, None
        if self.widths is not None:
            # one blank, then a visible character, and no white space at the end: neighbours don't change such a piece
            head, tail = data[np.minimum(offsets[new] + 1, len(data) - 1)], data[offsets[new + 1] - 1]
            fit = (size[new] > 1) & (data[np.minimum(offsets[new], len(data) - 1)] == 32) & (head > 32) & (head < 127) & (tail > 32) & (tail < 127)
            together = self.joined(distinct.take(pa.array(new[fit])))
            if together:
                plain, rest = new[fit], new[~fit]
        flat, n = [self.pool], []
        for found in [together] if together else []:
            flat.append(found[0])
            n.append(found[1])
        for a in range(0, len(rest), 20_000):
            ids, each = self.flat([x.decode("utf-8") for x in distinct.take(pa.array(rest[a : a + 20_000])).to_pylist()])
            flat.append(ids)
            n.append(each)
        flat, n, order = np.concatenate(flat), np.concatenate([np.zeros(0, np.int64), *n]), np.concatenate([plain, rest])
        start, length = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        old = np.flatnonzero(row >= 0)
        start[old], length[old] = self.pool_at[row[old]], np.diff(self.pool_at)[row[old]]
        start[order], length[order] = np.cumsum(n) - n + len(self.pool), n
        free = REMEMBERED - len(self.known)
        if free > 0:
            kept = order[size[order] <= SHORT]
            kept = kept[np.argsort(-often[kept], kind="stable")[:free]]
            own, total = length[kept], np.cumsum(length[kept])
            where = np.repeat(start[kept] - (total - own), own) + np.arange(total[-1] if len(total) else 0)
            self.known = pa.concat_arrays([self.known, distinct.take(pa.array(kept))])
            self.pool_at = np.concatenate([self.pool_at, self.pool_at[-1] + total])
            self.pool = np.concatenate([self.pool, flat[where]])
        return flat, start, length

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A code for each piece of all texts, each text's first piece, and the ids of the codes as :meth:`encode` has them."""
        data, offsets = raw(texts)
        if self.whole:
            starts, first = offsets[:-1], np.arange(len(texts) + 1)
        else:
            starts, first = safe_pieces(data, offsets)
        codes, distinct = encoded(data, starts, np.append(starts[1:], len(data))) if len(starts) else (np.zeros(0, np.int32), pa.array([], pa.binary()))
        return codes, first, self.encode(distinct, np.bincount(codes, minlength=len(distinct)))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, with what it remembers, for all its tasks."""
    return Encoder(path)


def counts(own: Encoder, texts: pa.Array) -> np.ndarray:
    codes, first, (_, _, each) = own.pieces(texts)
    total = np.concatenate([[0], np.cumsum(each[codes])]) if len(codes) else np.zeros(1, np.int64)
    return total[first[1:]] - total[first[:-1]]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for every whole text; null counts as empty.

    The counts are those of the library on the whole text, without added special tokens, truncation or padding; special
    strings inside texts are handled as it does by default. Repeated rows are counted each; other columns are ignored;
    an empty table gives an empty result. ``tokenizer_path`` must hold on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            texts, ids = strings(batch.column("text")), batch.column("doc_id")
            for a, b in byte_slices(texts, SLICE_BYTES):
                part = texts.slice(a, b - a)
                n = counts(own, part)
                give_back()
                size = np.diff(raw(part)[1])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def cut(own: Encoder, doc_ids: pa.Array, texts: pa.Array, end_id: int | None, capacity: int) -> pa.RecordBatch:
    """The pieces of ids of some texts, as :func:`token_pieces` has them."""
    codes, first, (flat, begins, each) = own.pieces(texts)
    ends = 1 if end_id is not None else 0
    lens = each[codes]
    total = np.concatenate([[0], np.cumsum(lens)])
    where = np.repeat(begins[codes] - total[:-1], lens) + np.arange(total[-1])
    size = total[first[1:]] - total[first[:-1]]
    place = np.arange(total[-1]) + np.repeat(np.arange(len(texts)) * ends, size)
    out = np.full(total[-1] + len(texts) * ends, end_id or 0, "<u4")
    out[place] = flat[where]
    size = size + ends
    n = np.maximum(1, -(-size // capacity)) if ends else -(-size // capacity)
    head = np.where(size > 0, (size - 1) % capacity + 1, 0)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    row = np.repeat(np.arange(len(texts)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
    length = np.where(piece == 0, head[row], capacity)
    offsets = np.append(begin[row] + start, len(out)) * 4
    if len(row) and offsets[-1] >= 2**31:
        raise ValueError("a text of more than 2**29 tokens")
    body = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), body], ["doc_id", "piece", "start", "length", "ids"])


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit, as binary): texts as pieces of ids.

    A document is its ids and then ``end_id``; only one of more than ``capacity`` ids is cut, into pieces of
    ``capacity`` of which the first may be shorter. A null text counts as empty: one piece that holds ``end_id``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            texts, doc_ids = strings(batch.column("text")), batch.column("doc_id")
            for a, b in byte_slices(texts, SLICE_BYTES):
                made = cut(own, doc_ids.slice(a, b - a), texts.slice(a, b - a), end_id, capacity)
                give_back()
                yield made

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")
