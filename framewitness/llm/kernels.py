"""Array kernels for words, rolling hashes and window minimizers inside a task.

Every function works on one block of texts laid end to end, with numpy only, so a
task needs a few arrays of the block's length and nothing that grows with the table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at once.
BLOCK_BYTES = 1 << 20

#: ``[\x20\x09-\x0D]``, the white space of the contracts.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def text_blocks(ids, texts, limit: int = BLOCK_BYTES):
    """Yield ``(ids, buffer, bounds)``: whole texts, about ``limit`` bytes at a time.

    ``ids`` and ``texts`` are Arrow arrays; a null text counts as empty. ``buffer``
    holds the UTF-8 bytes, ``bounds`` the n + 1 offsets of the texts in it.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        bounds = offsets[start : stop + 1]
        yield ids.slice(start, stop - start), data[bounds[0] : bounds[-1]], bounds - bounds[0]
        start = stop


def lower_ascii(buffer: np.ndarray) -> np.ndarray:
    return _LOWER[buffer]


def word_spans(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the word offsets of
    the texts. A word never crosses a text."""
    n = len(buffer)
    inside = ~_SPACE[buffer]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _byte_values(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have


class Rolling:
    """Hashes of any stretch ``[start, end)`` of a sequence, in constant time each.

    Polynomials modulo 2^64 over mixed 64-bit values with an odd base; the result
    depends on the content of the stretch alone and is mixed once more.
    """

    BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)

    def __init__(self, values: np.ndarray, family: int = 0):
        up, self._down = _powers(self.BASES[family], len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mixed(raw + (ends - starts).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """The hash at each start of a stretch of ``length``."""
        n = len(self._sums) - 1 - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = (self._sums[length:] - self._sums[:n]) * self._down[:n]
        return mixed(raw + np.uint64(length))


def byte_values(buffer: np.ndarray, family: int = 0) -> np.ndarray:
    return _byte_values(family + 1)[buffer]


def word_hashes(buffer, starts, ends, family: int = 0) -> np.ndarray:
    return Rolling(byte_values(buffer, family), family).of(starts, ends)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each start of ``width`` values the position of the leftmost smallest."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best[:n]


def anchors(grams: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Minimizers of all windows of ``window`` items inside the texts.

    ``grams`` is the hash at each start of ``gram`` items in the whole block. Returns
    ``(p, a, b)``: the windows that start in ``[a, b]`` have their smallest gram at p.
    Equal windows have equal grams at equal offsets, wherever they are.
    """
    none = np.zeros(0, np.int64)
    width = window - gram + 1
    at = sliding_argmin(grams, width)
    if not len(at):
        return none, none, none
    lengths = np.maximum(np.diff(bounds) - window + 1, 0)
    if not lengths.sum():
        return none, none, none
    valid = np.zeros(len(at) + 1, np.int32)
    full = lengths > 0
    valid[bounds[:-1][full]] += 1
    np.add.at(valid, np.minimum(bounds[:-1][full] + lengths[full], len(at)), -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    p = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)
    new[np.isin(starts, bounds[:-1][full])] = True
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(starts)) - 1
    return p[heads], starts[heads], starts[tails]


_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def trimmed(buffer, starts, ends, rounds: int = 4):
    """The spans without up to ``rounds`` ASCII marks at each side; never empty."""
    starts, ends = starts.copy(), ends.copy()
    for _ in range(rounds):
        starts += _MARK[buffer[starts]] & (starts < ends - 1)
        ends -= _MARK[buffer[ends - 1]] & (starts < ends - 1)
    return starts, ends


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The position of each value among the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def hash_text(text: str) -> int:
    """The hash that ``word_hashes`` gives a word of these bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])
