"""Words of whole texts as flat arrays.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``; ``bytes.split()`` cuts at
exactly these six.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words whose hashes one task remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Bytes of text that a kernel works on at a time; a longer text is its own block.
BLOCK_BYTES = 4 << 20


class WordHashes(dict):
    """64-bit hash of each word, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def flat(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words one after the other, and the number of words of each text."""
        words: list[bytes] = []
        counts = []
        for t in texts:
            w = t.split()
            words += w
            counts.append(len(w))
        get = self.__getitem__
        return np.fromiter(map(get, words), np.uint64, len(words)), np.array(counts, np.int64)


def text_bytes(value: str | None, lower: bool = False) -> bytes:
    """UTF-8 of a text, null as empty; ``lower`` turns A-Z, and nothing else, to lower case."""
    b = value.encode("utf-8", "surrogatepass") if value else b""
    return b.lower() if lower else b


def blocks(rows: list[bytes], limit: int = BLOCK_BYTES) -> Iterable[slice]:
    """Slices of consecutive rows of about ``limit`` bytes each."""
    start = size = 0
    for i, r in enumerate(rows):
        if size and size + len(r) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(r)
    if start < len(rows):
        yield slice(start, len(rows))


def mix(a: np.ndarray, salt: int) -> np.ndarray:
    """A well-mixed 64-bit permutation of the values, another one for each salt."""
    x = a ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words that starts at each word, and which starts lie whole in one text."""
    total = len(h)
    fits = np.zeros(total, bool)
    acc = np.zeros(total, np.uint64)
    n = total - width + 1
    if n > 0:
        roll = mix(h, 1)
        run = np.zeros(n, np.uint64)
        for i in range(width):
            run = run * np.uint64(0x9E3779B97F4A7C15 | 1) + roll[i : i + n]
        acc[:n] = mix(run, width)
    if total:
        left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
        fits = left >= width
    return acc, fits


def free_name(columns: Iterable[str], name: str) -> str:
    """The name, with underscores added while a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Gives freed memory back to the system: a worker waits for its next task beside others that need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of a task's batches, which releases memory when the task ends."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return task
