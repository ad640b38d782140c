"""Word hashing over the byte buffer of a whole Arrow string column, without a Python object per word.

Texts of a batch lie end to end in one buffer. All functions work on numpy arrays of the buffer and the
texts' offsets; temporary 8-byte arrays cover at most ``SPAN`` bytes of text (or one longer word) at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPAN = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

_rng = np.random.default_rng(20240229)
#: One 64-bit number for each byte; FOLDED gives A-Z the numbers of a-z.
EXACT = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]

#: Byte classes. SPACE: the separators of the contracts, x20 and x09 to x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if "r" not in _powers or len(_powers["r"]) < n:
        m = max(n, SPAN + 4096)
        for k, base in (("r", _R), ("i", _R_INV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["r"], _powers["i"]


def word_spans(b: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes for which ``inside`` (by byte value) holds; none spans two texts."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = inside[b]
    start = w.copy()
    start[1:] &= ~w[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    start[first] = w[first]
    end = w.copy()
    end[:-1] &= ~w[1:]
    last = first[1:] - 1
    end[last] = w[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """A 64-bit hash of each of the sorted, disjoint byte spans [s, e)."""
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        if e[i] - s[i] > SPAN:
            out[i] = _long_hash(b[s[i] : e[i]], table)
            i += 1
            continue
        j = int(np.searchsorted(e, s[i] + SPAN, "right"))
        a, z = int(s[i]), int(e[j - 1])
        r, inv = powers(z - a + 1)
        c = np.zeros(z - a + 1, np.uint64)
        np.cumsum(table[b[a:z]] * r[: z - a], out=c[1:])
        lo, hi = s[i:j] - a, e[i:j] - a
        out[i:j] = mixed((c[hi] - c[lo]) * inv[lo] + (hi - lo).astype(np.uint64))
        i = j
    return out


def _long_hash(b: np.ndarray, table: np.ndarray) -> np.uint64:
    """The same hash of one span, ``SPAN`` bytes at a time."""
    r, _ = powers(SPAN)
    total, base = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    step = r[SPAN - 1 : SPAN] * np.uint64(_R)
    for a in range(0, len(b), SPAN):
        part = b[a : a + SPAN]
        total += base * (table[part] * r[: len(part)]).sum(dtype=np.uint64)
        base = base * step
    return mixed(total + np.uint64(len(b)))[0]


def owners(offs: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For sorted positions, the number of the text that holds each."""
    return np.searchsorted(offs, s, "right") - 1


def slices(owner: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of each text's run in an array sorted by owner."""
    return np.searchsorted(owner, np.arange(n + 1))


def run_sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of x over [bounds[k], bounds[k + 1]); 0 for empty runs."""
    c = np.concatenate([np.zeros(1, np.float64), np.cumsum(x, dtype=np.float64)])
    return c[bounds[1:]] - c[bounds[:-1]]


def blocks(offs: np.ndarray, most: int = 2 << 20) -> list[tuple[int, int]]:
    """Runs [i, j) of texts of at most ``most`` bytes together, or one longer text."""
    out, i, n = [], 0, len(offs) - 1
    while i < n:
        j = max(int(np.searchsorted(offs, offs[i] + most, "right")) - 1, i + 1)
        out.append((i, j))
        i = j
    return out


def windows(n: int, most: int = SPAN) -> list[tuple[int, int]]:
    """Ranges [a, z) of at most ``most`` numbers that make up [0, n)."""
    return [(a, min(a + most, n)) for a in range(0, n, most)]


def cut_before(b: np.ndarray, offs: np.ndarray, marks: np.ndarray, most: int) -> np.ndarray:
    """``offs`` and, within texts of more than ``most`` bytes, the positions of the first byte in ``marks`` after each ``most`` bytes."""
    long = np.flatnonzero(np.diff(offs) > most)
    more = []
    for k in long:
        at, end = int(offs[k]) + most, int(offs[k + 1])
        while at < end:
            near = np.flatnonzero(marks[b[at : min(at + most, end)]])
            if len(near):
                more.append(at + int(near[0]))
                at = more[-1] + most
            else:
                at += most
    return np.unique(np.concatenate([offs, np.array(more, np.int64)])) if more else offs
