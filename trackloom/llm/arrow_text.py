"""Whole texts as numpy arrays inside Arrow tasks: byte-balanced slices, words, safe pieces, hashes of distinct strings."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a string beyond which it is hashed on its own; masks of the first bytes of a little-endian word.
LONG, MASKS = 64, np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of each 64-bit number spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """What a task has freed goes back to the machine: workers live on, and their pools would keep it for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow task that gives its memory back when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def strings(column: pa.Array) -> pa.Array:
    """A plain string array; null becomes empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.string()), "")


def byte_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one entry more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def encoded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes and the distinct byte strings of ``data[start:end]``; pieces must ascend and may leave gaps."""
    if len(starts) and (starts[1:] == ends[:-1]).all() and starts[0] == 0:
        offsets, body = np.append(starts, ends[-1]), data
    else:
        mark = np.zeros(len(data) + 1, np.int8)
        mark[starts] += 1
        mark[ends] -= 1
        body = data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)] if len(starts) else data[:0]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space, none across texts, and the first word of each text."""
    solid = ~SPACES[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    begins = np.flatnonzero(solid & (~before | edge))
    stops = np.flatnonzero(before & (~solid | edge))
    if len(stops) < len(begins):
        stops = np.append(stops, len(data))
    return begins, stops, np.searchsorted(begins, offsets)


def hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct byte string: eight bytes at a time for all strings at once, long ones by xxh3."""
    data, offsets = raw(distinct)
    size = np.diff(offsets)
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    h = (size.astype(np.uint64) + np.uint64(1)) * PRIME
    for k in range(0, min(LONG, int(size.max(initial=0))), 8):
        on = slice(None) if k == 0 else np.flatnonzero(size > k)
        lane = eight[offsets[:-1][on] + k] & MASKS[np.minimum(size[on] - k, 8)]
        h[on] = mixed((h[on] ^ lane) * PRIME)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
    return h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of all texts, and the first word of each text (one entry more than texts)."""
    data, offsets = raw(texts)
    begins, stops, first = words(data, offsets)
    codes, distinct = encoded(data, begins, stops)
    return (hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)), first


def safe_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where texts can be cut so that each piece is tokenised as it is inside its text, and each text's first piece.

    A piece begins where a run of white space follows something else: the patterns of the tokenizers never match across
    that place, nor look behind it. After a byte past ASCII, which may end a white-space character that only Unicode
    knows, a cut also needs the run to be one blank with a visible ASCII character behind it.
    """
    cut = np.zeros(len(data), bool)
    if len(data):
        space = SPACES[data]
        cut[1:] = space[1:] & ~space[:-1]
        ahead = np.zeros(len(data), np.uint8)
        ahead[:-1] = data[1:]
        doubt = np.zeros(len(data), bool)
        doubt[1:] = data[:-1] >= 128
        cut &= ~doubt | ((data == 32) & (ahead > 32) & (ahead < 127))
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    pieces = np.flatnonzero(cut)
    return pieces, np.searchsorted(pieces, offsets)
