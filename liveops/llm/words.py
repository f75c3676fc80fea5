"""Whole texts as word codes, in Arrow and numpy, for the operators that read every word.

Texts come in bounded chunks (`chunks`); a chunk is split once (`split`), and what depends
on a word alone is computed once per distinct word of the chunk.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 6 << 20


def _table(space: str, lower: bool = True) -> np.ndarray:
    """A map of bytes: A-Z to a-z, the characters in ``space`` to a blank."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[[ord(c) for c in space]] = 32
    return table


#: Words `[^\x20\x09-\x0D]+`, A-Z lower-cased.
PLAIN = _table("")
#: The same words as they stand.
CASED = _table("", lower=False)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = PLAIN.copy()
ALNUM[[i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122)]] = 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an array of strings without nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(len(texts) + 1, np.int32), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


def release() -> None:
    """Give freed memory back to the system; reused workers would hold it beside later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in record batches of about ``limit`` bytes of text, or one row.

    What was freed since is released after each batch, and at the end.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        release()


@dataclass
class Words:
    """Words of a chunk: text d has the codes ``codes[offsets[d]:offsets[d + 1]]`` of ``words``."""

    offsets: np.ndarray
    codes: np.ndarray
    words: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def split(texts: pa.Array, table: np.ndarray = PLAIN) -> Words:
    """Words between ASCII white space after ``table`` is applied; a null text has none."""
    texts = pc.fill_null(texts, "")
    offsets, data = text_bytes(texts)
    plain = pa.StringArray.from_buffers(
        len(texts), pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(table[data])
    )
    lists = pc.ascii_split_whitespace(plain)
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)
    if len(empty):  # white space at either end leaves an empty string
        full = codes != empty[0]
        kept = np.concatenate(([0], np.cumsum(full)))
        offsets, codes = kept[offsets], codes[full]
    return Words(offsets, codes, words)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SPREAD = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPREAD = _SPREAD.reshape(64, 256)


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: random numbers per place and byte, summed and mixed."""
    offsets, data = text_bytes(words)
    sizes = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    values = _SPREAD[place & 63, data] * (2 * (place >> 6) + 1).astype(np.uint64)
    out = np.zeros(len(words), np.uint64)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return mix(out + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size`` consecutive words within a text, and the place of each first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    inside = np.arange(n) + size <= ends
    return mix(total[inside]), np.flatnonzero(inside)
