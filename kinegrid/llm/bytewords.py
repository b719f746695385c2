"""Words of whole Arrow text columns by numpy over their UTF-8 bytes.

Every separator used here is an ASCII character, so a class of code points is a class of bytes: all bytes
of other characters are 0x80 or more. A null text has no bytes. No Spark in this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(separators: bytes | range | list[int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


#: [^\x20\x09-\x0D]+
NOT_SPACE = byte_class([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased text: digits, a-z and all beyond ASCII)
ALNUM_LOWER = byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: int | str, most_bytes: int, most_rows: int = 1 << 62) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most_bytes`` of text; a longer text is a slice of its own."""
    _, offsets = raw(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        end = max(start + 1, min(end, start + most_rows, batch.num_rows))
        yield batch.slice(start, end - start)
        start = end


class Words:
    """All words of a text column. starts, ends: byte positions in data; first[i]: index of text i's first word."""

    def __init__(self, texts: pa.Array, inside: np.ndarray, lower: bool = False):
        data, offsets = raw(texts)
        self.data = LOWER[data] if lower else data
        mask = inside[self.data]
        before = np.empty(len(mask), bool)
        before[1:] = mask[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        before[edges] = False  # a word ends where its text ends
        self.starts = np.flatnonzero(mask & ~before)
        after = np.empty(len(mask), bool)
        after[:-1] = mask[1:]
        after[offsets[1:][np.diff(offsets) > 0] - 1] = False
        self.ends = np.flatnonzero(mask & ~after) + 1
        self.mask, self.offsets = mask, offsets
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def array(self) -> pa.LargeBinaryArray:
        """The words themselves, end to end in a new buffer."""
        ends = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=ends[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(self.data[self.mask])])

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A dictionary code for each word, and the distinct words."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x + MIX).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, of its bytes and length only."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64(0x100000001B3)
        lengths = words.ends - words.starts
        place = np.arange(int(lengths.max()), dtype=np.uint64)
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, len(place) - 1), base)]))
        total = int(lengths.sum())
        starts = np.zeros(len(lengths), np.int64)
        np.cumsum(lengths[:-1], out=starts[1:])
        inside = np.arange(total) - np.repeat(starts, lengths)
        terms = mixed(words.data[words.mask].astype(np.uint64)) * powers[inside]
        return mixed(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows of n words (all words of a text with fewer, but not none), and their bounds per text."""
    counts = np.diff(first)
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(many, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], many) + np.repeat(first[:-1], many)
    width = np.repeat(np.minimum(counts, n), many)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            within = width > k
            if within.all():
                out = mixed(out * np.uint64(31) + hashes[at + k])
            else:
                out[within] = mixed(out[within] * np.uint64(31) + hashes[at[within] + k])
    return out, bounds
