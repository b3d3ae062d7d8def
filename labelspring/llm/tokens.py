"""Words of many texts as arrays: positions and hashes, without a loop over words.

Texts arrive as Arrow columns. They are worked on in pieces of about a megabyte
of whole texts; a longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: The bytes between words.
SPACES = b" \t\n\x0b\x0c\r"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def numbered(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers, the same on every machine."""
    base = np.uint64(seed) * np.uint64(1 << 32) + np.uint64(1)
    return _mixed(_mixed(np.arange(n, dtype=np.uint64) + base) + np.uint64(seed))


#: Two families of rolling hashes; each has its own base and its own value for a byte.
_BASES = tuple(int(numbered(seed, 1)[0]) | 5 for seed in (2, 5))
_VALUES = tuple(numbered(seed, 256) | np.uint64(1) for seed in (1, 4))
_powers: dict[tuple[bool, int], np.ndarray] = {}


def powers(n: int, back: bool = False, family: int = 0) -> np.ndarray:
    """The first ``n`` powers of the base of a rolling hash, or of its inverse."""
    name = back, family
    if len(_powers.get(name, ())) < n:
        base = _BASES[family]
        step = np.uint64(pow(base, -1, 1 << 64) if back else base)
        steps = np.full(max(n, PIECE + 1), step, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def prefix_sums(data: np.ndarray, family: int = 0) -> np.ndarray:
    """Sums from which :func:`span_hashes` gets the hash of any span of the bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[family][data] * powers(len(data), family=family), out=sums[1:])
    return sums


def span_hashes(
    sums: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0
) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``, equal for equal bytes anywhere.

    ``sums`` are of the same family; hashes of two families are independent, so
    that both together tell spans apart by 128 bits.
    """
    moved = (sums[end] - sums[start]) * powers(len(sums), back=True, family=family)[start]
    return _mixed(moved + (end - start).astype(np.uint64))


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: the first row, the bytes, and the rows' offsets. NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.cast(pa.large_string())
    _, where, what = wide.buffers()
    if len(wide) == 0:
        return
    at = np.frombuffer(where, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(wide):
        last = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        last = min(last, len(wide))
        yield row, data[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


def letters(separators: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


PLAIN = letters(SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = PLAIN
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    word = inside[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = word[edge]
    edge = edge[edge > 0]
    last[edge - 1] = word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words, piece by piece so that a long text needs little memory."""
    out = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(end, start[low] + PIECE, side="right")))
        base = start[low]
        sums = prefix_sums(data[base : end[high - 1]])
        out[low:high] = span_hashes(sums, start[low:high] - base, end[low:high] - base)
        low = high
    return out


def shingles(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and their texts.

    A text with fewer words, but at least one, gives its whole sequence as one.
    """
    weights = numbered(3, n) | np.uint64(1)
    size = max(0, len(words) - n + 1)
    full = text[:size] == text[n - 1 :] if size else np.zeros(0, bool)
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += words[k : k + size] * weights[k]
    hashes, owners = _mixed(total[full]), text[:size][full]
    counts = np.bincount(text) if len(text) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        starts = np.searchsorted(text, short)
        lengths = counts[short]
        extra = lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        for k in range(n - 1):
            has = lengths > k
            extra[has] += words[starts[has] + k] * weights[k]
        hashes = np.concatenate([hashes, _mixed(extra)])
        owners = np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    return hashes, owners
