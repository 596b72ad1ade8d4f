"""Token shingles and MinHash signatures of many texts at once.

Tokens are found on the bytes of a whole batch with array operations, without a Python loop over
tokens: runs of letters, digits and underscores, and single other characters. Each token has a
64-bit hash from prefix sums; a shingle is five consecutive tokens of one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 5
BINS = 120
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
EMPTY = np.uint32(0xFFFFFFFF)

SPACE, WORD, DIGIT, OTHER = 0, 1, 2, 3
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[128:] = WORD
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    _CLASS[_c] = WORD
for _c in b"0123456789":
    _CLASS[_c] = DIGIT

#: Words that are grammar, not names, in the languages at hand.
KEYWORDS = (
    "and as assert async await break case catch class const continue crate def default defer del do elif else enum except export "
    "extends false final finally fn for from func function go if impl implements import in interface is lambda let loop map match mod "
    "mut new nil None not null or package pass private protected pub public raise range return select self static struct super switch "
    "this throw trait true try type typeof unsafe use var void where while with yield True False int char float double long short "
    "unsigned signed size_t bool string number usize include define".split()
)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


@dataclass
class Tokens:
    """Tokens of a batch: text number, kind of the first character, length, hash, start."""

    text: np.ndarray
    kind: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    buf: np.ndarray
    n: int


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(int(_P), -1, 1 << 64)
        p = np.multiply.accumulate(np.full(size, _P))
        q = np.multiply.accumulate(np.full(size, np.uint64(inverse)))
        _POWERS[0] = (p, q)
    p, q = _POWERS[0]
    return p[:n], q[:n]


def tokenize(buf: np.ndarray, offsets: np.ndarray) -> Tokens:
    """``buf``: the bytes of all texts; text i lies at offsets[i]..offsets[i + 1]."""
    n = len(buf)
    cls = _CLASS[buf]
    alnum = (cls == WORD) | (cls == DIGIT)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = alnum[:-1]
    start = np.flatnonzero((alnum & (~before | first)) | (cls == OTHER))
    last = np.empty(n, bool)
    last[-1:] = True
    last[:-1] = ~alnum[1:] | first[1:]
    stop = np.flatnonzero((alnum & last) | (cls == OTHER)) + 1
    p, q = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    h = mix((sums[stop] - sums[start]) * q[start])
    return Tokens(np.searchsorted(offsets, start, side="right") - 1, cls[start], stop - start, h, start, buf, len(offsets) - 1)


def word_hash(word: str) -> np.uint64:
    b = np.frombuffer(word.encode(), np.uint8)
    return tokenize(b, np.array([0, len(b)])).hash[0]


_KEYS: list[np.ndarray] = []


def masked(t: Tokens) -> np.ndarray:
    """Token hashes with all names alike."""
    if not _KEYS:
        _KEYS.append(np.sort(np.array([word_hash(w) for w in KEYWORDS])))
    keys = _KEYS[0]
    at = np.minimum(np.searchsorted(keys, t.hash), len(keys) - 1)
    name = (t.kind == WORD) & (keys[at] != t.hash)
    return np.where(name, np.uint64(1), t.hash)


def shingle(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, text numbers); texts of fewer tokens have one shingle of all they have."""
    if not len(hashes):
        return hashes, text
    h = np.zeros(len(hashes), np.uint64)
    ok = np.ones(len(hashes), bool)
    for k in range(WIDTH):
        part = np.roll(hashes, -k)
        same = np.roll(text, -k) == text
        if k:
            same[-k:] = False
            ok &= same
        h = h * _P + np.where(same, part, np.uint64(7))
    firsts = np.ones(len(text), bool)
    firsts[1:] = text[1:] != text[:-1]
    size = np.bincount(text)[text]
    keep = ok | (firsts & (size < WIDTH))
    return mix(h[keep]), text[keep]


def signatures(shingles: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """n x BINS MinHash by one permutation; empty bins are filled from the next full one."""
    sig = np.full((n, BINS), EMPTY, np.uint32)
    bins = (shingles >> np.uint64(40)) % np.uint64(BINS)
    np.minimum.at(sig.reshape(-1), text * BINS + bins.astype(np.int64), (shingles & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    empty = sig == EMPTY
    if empty.any():
        rows = np.flatnonzero(empty.any(1) & ~empty.all(1))
        for r in rows:
            full = np.flatnonzero(~empty[r])
            at = np.searchsorted(full, np.arange(BINS)) % len(full)
            sig[r] = sig[r][full[at]]
    return sig


def low_bytes(sig: np.ndarray) -> np.ndarray:
    """One byte of each minimum, which is all that comparisons need: two that differ agree in it once in 256."""
    return mix(sig.astype(np.uint64)).astype(np.uint8)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """n x (BINS / rows) keys as signed 64-bit numbers."""
    n, b = len(sig), BINS // rows
    h = np.zeros((n, b), np.uint64)
    cols = sig.astype(np.uint64).reshape(n, b, rows)
    for k in range(rows):
        h = mix(h * _P + cols[:, :, k])
    return (h + np.arange(b, dtype=np.uint64) * _MIX1).view(np.int64)
