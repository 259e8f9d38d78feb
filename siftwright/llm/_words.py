"""Words and shingles of Arrow text columns, vectorised over the column's own bytes.

Words are the runs of bytes other than space and 0x09-0x0D after A-Z are lower-cased. Hashes are 64-bit and depend on
the content only, so they agree between workers and runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1
#: Most bytes of text that are hashed at once; tables of powers, which a worker keeps, have this size.
_SEGMENT = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        have = tuple(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]).cumprod(dtype=U) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 1 << 22:
            _powers[base] = have
    return have[0][:n], have[1][:n]


@dataclass
class Words:
    """Words of some texts: ``first[d]:first[d + 1]`` are those of text d; starts and ends are byte offsets in ``raw``."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def words(texts: pa.Array) -> Words:
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2] if n else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    return Words(raw, starts, ends, _word_hashes(raw, starts, ends), first, offsets)


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SEGMENT, side="right")))
        base, end = starts[at], ends[to - 1]
        up, down = powers(_BASE, int(end - base) + 1)
        sums = np.concatenate([np.zeros(1, U), ((raw[base:end].astype(U) + U(1)) * up[:-1]).cumsum(dtype=U)])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s])
        at = to
    return out


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k successive word hashes (empty if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = powers(_STEP, len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, U), (hashes * up[:-1]).cumsum(dtype=U)])
    return mix((sums[k:] - sums[:-k]) * down[:n] + U(k))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of a text; with fewer words the whole sequence as one; none without words."""
    if not len(hashes):
        return np.zeros(0, U)
    return np.unique(runs(hashes, min(k, len(hashes))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
