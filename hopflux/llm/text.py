"""Word splitting and hashing shared by the Python-side operators; all of it works on UTF-8 bytes.

``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at 0x20 and 0x09-0x0D only, which are exactly the rules of
the contracts, and UTF-8 bytes of other characters are never touched.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_MUL = np.uint64(0x9E3779B97F4A7C15)
_digest = xxhash.xxh3_64_intdigest

#: Lower-cases A-Z and turns every ASCII character that is neither a letter nor a digit into a space.
_ALNUM = bytes((c + 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def text_hash(text: Column) -> Column:
    """64 bits that tell the texts of one id apart; null is the empty text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def column_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes (None stays None)."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most so many rows, so that lists of their texts stay small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def give_back() -> None:
    """Return to the system what this process has freed: an idle worker otherwise keeps what its largest batch took, beside the JVM."""
    gc.collect()  # functions that came by value refer to themselves, and with them go tables of earlier tasks
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives back its memory when a task ends."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_ALNUM).split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_digest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes (63 bits, as int64) of the word shingles; fewer words than ``size``: one for the whole."""
    if not words:
        return np.empty(0, np.int64)
    w = hashes(words)
    width = min(size, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for j in range(width):
        h = mix(h * _MUL + w[j : len(w) - width + 1 + j])
    return np.unique((h >> np.uint64(1)).astype(np.int64))
