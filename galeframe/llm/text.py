"""Whole texts as flat numpy arrays: words, their 64-bit hashes, slices of bounded size."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20   # text worked on at a time
PIECE_BYTES = 1 << 18   # text hashed at a time
LONG_WORD = 1 << 16     # longer words are hashed on their own

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it

_BYTES = np.arange(256)
#: words [^\x20\x09-\x0D]+
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: words of letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (
    (_BYTES >= 0x41) & (_BYTES <= 0x5A))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = np.cumprod(np.full(LONG_WORD + 1, 0xD1342543DE82EF95, dtype=np.uint64))


@dataclass
class Words:
    """Words of a batch of texts: byte spans in data, a hash each, and the first word of every text."""

    data: np.ndarray    # lower-cased UTF-8 bytes of all texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray   # len(texts) + 1 offsets into the words
    hashes: np.ndarray  # uint64

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and len(texts) + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are not empty, ordered and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    i = 0
    while i < len(starts):
        if lengths[i] > LONG_WORD:
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, "right")))
        long = np.flatnonzero(lengths[i:j] > LONG_WORD)
        if len(long):
            j = i + int(long[0])
        n = lengths[i:j]
        begin = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(begin, n)
        values = _BYTE_VALUES[data[np.repeat(starts[i:j], n) + inside]] * _POWERS[inside]
        out[i:j] = mix(np.add.reduceat(values, begin) + n.astype(np.uint64))
        i = j
    return out


def words(texts: pa.Array, kept: np.ndarray) -> Words:
    """Lower-cases A-Z and cuts every text into its maximal runs of kept bytes. A null text has no words."""
    raw, off = flat(texts)
    data = LOWER[raw]
    inside = np.concatenate([kept[data], [False]])
    before = np.concatenate([[False], inside[:-1]])
    before[off[:-1]] = False
    after = np.concatenate([inside[1:], [False]])
    last = off[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off), spans_hash(data, starts, ends))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct texts among byte spans (told apart by their 64-bit hashes), and which one each span is."""
    _, where, which = np.unique(spans_hash(data, starts, ends), return_index=True, return_inverse=True)
    whole = data.tobytes()
    return [whole[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], which


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size numbers from each place on (len - size + 1 of them)."""
    n = len(hashes) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k:k + n]
    return mix(total)


def hand_back() -> None:
    """Free memory that Arrow and the C library keep goes back to the system, as workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about size bytes of text; a longer text stands alone."""
    hand_back()  # what an earlier stage left in this worker
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(lengths), 0
    while at < len(lengths):
        base = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + size, "right")))
        yield batch.slice(at, end - at)
        at = end
    hand_back()  # what the slices needed goes back before the next batch comes


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
