"""Words and hashes of whole batches of texts, on their UTF-8 bytes with numpy."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

U = np.uint64
_BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_BLOCK = 1 << 19


def _lookup(keep) -> np.ndarray:
    return np.fromiter((bool(keep(b)) for b in range(256)), bool, 256)


#: Bytes that are not white space.
SOLID = _lookup(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Letters and digits, and every byte of a character beyond ASCII.
WORDLIKE = _lookup(lambda b: b >= 0x80 or chr(b).isalnum())
#: ASCII capitals to small letters, all else as it is.
SMALL = np.fromiter((b + 32 if 65 <= b <= 90 else b for b in range(256)), np.uint8, 256)
SAME = np.arange(256, dtype=np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Hashes of runs are polynomials modulo this prime, at one of two points drawn once and for all.
PRIME = (1 << 61) - 1
_P = U(PRIME)
_POINTS = (0x0D6E8FEB86659FD93 % PRIME, 0x1F0A2BE71D163D2A3 % PRIME)
_LOW31, _LOW30 = U((1 << 31) - 1), U((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for any 64-bit ``x``."""
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of values below it, from halves of 31 and 30 bits."""
    a_high, a_low, b_high, b_low = a >> U(31), a & _LOW31, b >> U(31), b & _LOW31
    middle = a_high * b_low + a_low * b_high
    return _reduced(U(2) * a_high * b_high + (middle >> U(30)) + ((middle & _LOW30) << U(31)) + a_low * b_low)


@functools.lru_cache(maxsize=8)
def _powers(point: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a point, ``n`` a power of two."""
    out = np.ones(n, U)
    have, step = 1, point
    while have < n:
        out[have : 2 * have] = _times(out[:have], np.full(have, step, U))
        have, step = 2 * have, step * step % PRIME
    return out


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    point = _POINTS[base]
    return _powers(point, size), _powers(pow(point, -1, PRIME), size)


def _prefix(values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total


def counts(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks each document has."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of the class ``inside`` within a document: starts, ends, runs before each document."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    hit = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = hit[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = hit[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(hit & ~before)
    ends = np.flatnonzero(hit & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_SHORT = 256
_SEEDS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_HEADS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME, base: int = 0) -> np.ndarray:
    """A 64-bit hash of every span, after mapping its bytes by ``fold``; ``base`` 0 and 1 are independent.

    Blocks of eight bytes are mixed in one after another, for all spans at once; spans of more than
    ``_SHORT`` bytes get the first 64 bits of their BLAKE2b digest. No sum of bytes, so no two
    arrangements of the same bytes meet by their algebra.
    """
    size = ends - starts
    out = mixed(size.astype(U) * _SEEDS[1 - base] + _SEEDS[base])
    if len(data) == 0 or len(starts) == 0:
        return out
    folded = data if fold is SAME else fold[data]
    padded = np.concatenate([folded, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= _SHORT))
    all_live = len(live) == len(starts)
    at, left = (starts, size) if all_live else (starts[live], size[live])
    state = out if all_live else out[live]
    while len(live):
        block = eight[at] & _HEADS[np.minimum(left, 8)]
        state = mixed((state ^ block) * _SEEDS[base])
        done = left <= 8
        out[live[done]] = state[done]
        more = ~done
        live, at, left, state = live[more], at[more] + 8, left[more] - 8, state[more]
    raw = memoryview(folded)
    for i in np.flatnonzero(size > _SHORT):
        digest = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, person=b"%d" % base).digest()
        out[i] = np.frombuffer(digest, U)[0]
    return out


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high * 2^31 + low modulo the prime."""
    high = _reduced(high)
    return _reduced((high >> U(30)) + ((high & _LOW30) << U(31)) + _reduced(low))


def fold_runs(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int = 0) -> np.ndarray:
    """One 64-bit hash for every run ``values[first:last]`` of hashes, in order of ``first``; the order within a run counts."""
    out = np.zeros(len(first), U)
    i = 0
    while i < len(first):
        at = first[i]
        j = max(i + 1, int(np.searchsorted(first, at + _BLOCK)))
        part = _reduced(values[at : max(int(last[i:j].max()), int(at))])
        power, inverse = _power_tables(base, len(part) + 1)
        term = _times(part, power[: len(part)])
        high, low = _prefix(term >> U(31)), _prefix(term & _LOW31)
        s, e = first[i:j] - at, last[i:j] - at
        out[i:j] = _times(_joined(high[e] - high[s], low[e] - low[s]), inverse[s])
        i = j
    return mixed(out + mixed((last - first).astype(U)))


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BLAKE2b names of 128 bits of whole texts: uint64[n, 2]."""
    raw = memoryview(np.ascontiguousarray(data))
    edges = offsets.tolist()
    out = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(edges[:-1], edges[1:]))
    return np.frombuffer(out, U).reshape(-1, 2)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row within each document (a shorter document: of all its words).

    Returns the hashes, the document of each, and the first word of each.
    """
    n = np.diff(bounds)
    each = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), each)
    first = bounds[:-1][doc] + np.arange(len(doc)) - (np.cumsum(each) - each)[doc]
    length = np.minimum(n, width)[doc]
    out = np.zeros(len(doc), U)
    for k in range(width):
        here = length > k
        at = first + k
        at[~here] = 0
        salt = U((k + 1) * int(_BASES[1]) % (1 << 64))
        term = mixed(words[at] + salt) if len(words) else np.zeros(len(doc), U)
        out = out * _BASES[0] + np.where(here, term, U(0))
    return mixed(out), doc, first
