"""Texts as numpy arrays of word and n-gram hashes, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = 0x9E3779B97F4A7C15
BLOCK_BYTES = 1 << 18
#: Hashes of fewer words than a shingle has start from here, so that no shingle equals them.
_SHORT = np.uint64(0xD6E8FEB86659FD93)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """1, s, s * s ... modulo 2 ** 64 for an odd s."""
    out = np.full(n, np.uint64(_STEP))
    out[:1] = 1
    return np.multiply.accumulate(out)


def _block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n" + b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined.lower(), dtype=np.uint8)  # of bytes, lower() changes A-Z only
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    lengths = ends - starts
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    letters = np.flatnonzero(~space)
    at = letters - np.repeat(starts, lengths)
    sums = np.add.reduceat(powers(int(lengths.max()) + 1)[at] * (raw[letters].astype(np.uint64) + np.uint64(1)), firsts)
    return mixed(sums + lengths.astype(np.uint64)), counts


def word_hashes(texts: list[str | bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of the texts: the first one's number, hashes of all words (A-Z lower-cased), the number in each text.

    Texts may come as UTF-8 already.
    """
    block, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
        if block and size + len(raw) > BLOCK_BYTES:
            yield first, *_block(block)
            block, size, first = [], 0, i
        block.append(raw)
        size += len(raw)
    if block:
        yield first, *_block(block)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, whatever text they are in."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    weights = powers(width + 1)[1:]
    n = len(hashes) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * weights[k]
    return mixed(total)


def shingle_sets(texts: list[str | bytes | None], width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its number and the sorted distinct hashes of its shingles; with fewer words, one of them all."""
    for first, hashes, counts in word_hashes(texts):
        every, at = windows(hashes, width), 0
        for k, n in enumerate(counts.tolist()):
            if n >= width:
                yield first + k, np.unique(every[at : at + n - width + 1])
            elif n:
                whole = (hashes[at : at + n] * powers(n + 1)[1:]).sum(dtype=np.uint64)
                yield first + k, mixed(np.array([whole ^ _SHORT]) + np.uint64(n))
            else:
                yield first + k, np.zeros(0, dtype=np.uint64)
            at += n
