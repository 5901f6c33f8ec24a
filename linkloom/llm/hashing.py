"""Words of many texts at once: byte positions and hashes, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash takes eight bytes after
the other, each mixed into all 64 bits before the next, so that no relation between bytes
at different places cancels out; no Python code runs per word. A second lane gives 128
bits where a hash alone decides. Hashes depend on the bytes of the word alone: equal in
every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow.compute as pc

#: Bytes hashed at once; a longer word makes a longer piece.
PIECE = 1 << 20
#: Bytes of text that one step of a task holds; a longer text is a step of its own.
STEP = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
#: A longer word is hashed as a whole.
LONG_WORD = 512
#: By lane: what the size is added to, and what each eight bytes are multiplied with.
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], dtype=np.uint64)
_ODD = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def _piece(data: np.ndarray, fold: bool, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[data], [True]))))
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    padded = (_FOLD[data] if fold else data).tobytes() + bytes(8)
    eight = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    hashes = mix(sizes.astype(np.uint64) + _SEEDS[:lanes, None])
    left, at = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(left):
        part = eight[starts[left] + at] & _TAIL[np.minimum(8, sizes[left] - at)]
        for lane in range(lanes):
            hashes[lane, left] = mix(hashes[lane, left] ^ part * _ODD[lane])
        at += 8
        left = left[sizes[left] > at]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        whole = blake2b(padded[starts[i] : ends[i]], digest_size=16).digest()
        hashes[:, i] = np.frombuffer(whole, dtype="<u8")[:lanes]
    return starts, ends, hashes


def words(data: np.ndarray, fold: bool = False, lanes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, hashes)`` of the words in an array of bytes; a row of hashes per lane if several.

    With ``fold``, A-Z count as a-z.
    """
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data):  # a piece ends between words
            gaps = np.flatnonzero(SPACE[data[max(at, end - 4096) : end]])
            if len(gaps):
                end = max(at, end - 4096) + int(gaps[-1]) + 1
                break
            end = min(len(data), end + 4096)
        starts, ends, hashes = _piece(data[at:end], fold, lanes)
        found.append((starts + at, ends + at, hashes))
        at = end
    if not found:
        found.append((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((lanes, 0), dtype=np.uint64)))
    starts, ends, hashes = (np.concatenate(part, axis=-1) for part in zip(*found, strict=True))
    return starts, ends, hashes if lanes > 1 else hashes[0]


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of a few words (at most eight), by the position of the first word."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(width):
        total = total * np.uint64(_BASE) + hashes[i : i + count]
    return mix(total)


def run_hashes(hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Hashes of runs of words; each has at least ``least`` of them and at most twice as many.

    A run is covered by four overlapping runs of a power of two, hashed by doubling.
    """
    step = 1 << (least.bit_length() - 1)
    doubled, reach = hashes, 1
    while reach < step:
        doubled = mix(doubled[: len(doubled) - reach] * np.uint64(_BASE) + doubled[reach:])
        reach *= 2
    out = mix(sizes.astype(np.uint64) + _SEEDS[0])
    for i in range(4):
        out = mix(out * np.uint64(_BASE) + doubled[begins + np.minimum(i * step, sizes - step)])
    return out


def text_steps(batches, column: str = "text", size: int = STEP) -> Iterator:
    """Slices of record batches with about ``size`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0)
        step = np.cumsum(lengths.to_numpy(zero_copy_only=False)) // size
        bounds = np.flatnonzero(np.diff(step)) + 1
        for at, end in zip([0, *bounds], [*bounds, batch.num_rows], strict=True):
            yield batch.slice(at, end - at)


def joined(batch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch in one array, a newline after each, and where each begins."""
    texts = [(x or "").encode() for x in batch.column(column).to_pylist()]
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return data, bounds


def word_runs(batch, column: str = "text", fold: bool = False, lanes: int = 1):
    """``(hashes, bounds)``: word hashes of all texts and where the words of each text begin."""
    data, bounds = joined(batch, column)
    starts, _, hashes = words(data, fold, lanes)
    return hashes, np.searchsorted(starts, bounds)
