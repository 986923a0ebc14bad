"""Vectorised word tokens for Arrow text columns.

A token is a maximal run of ASCII letters and digits and non-ASCII characters of
the lower-cased text.  Other ASCII characters separate tokens, and so do the
non-ASCII spaces and punctuation: U+0080 to U+00BF (but for the letters ª, µ, º),
U+2000 to U+206F, U+3000 to U+303F, and the wide forms of ASCII punctuation.  Han
and kana, which are written without spaces, are tokens of one character each.  A whole batch
of texts is tokenised at once on its UTF-8 bytes, so the cost per byte stays in
numpy and no Python string is made.  Token hashes are 64-bit and depend on the
token alone, never on the batch or the process.

The same definition as a regular expression (RE2, used by the SQL oracles) is
:data:`TOKEN_RE` over ``lower(text)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKEN_RE = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]|[0-9a-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3100}-\x{33FF}\x{A000}-\x{FEFE}\x{FF10}-\x{FF19}\x{FF21}-\x{10FFFF}]+"

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads the bits of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


_POWERS: dict[int, np.ndarray] = {}
_CHUNK = 1 << 16


def _powers(base: int) -> np.ndarray:
    """base**0 .. base**(_CHUNK-1) modulo 2**64."""
    if base not in _POWERS:
        out = np.ones(_CHUNK, np.uint64)
        n, step = 1, base
        with np.errstate(over="ignore"):
            while n < _CHUNK:
                out[n : 2 * n] = out[:n] * np.uint64(step)
                n, step = 2 * n, step * step % 2**64
        _POWERS[base] = out
    return _POWERS[base]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: out[j] = sum of values[i] * base**i for i < j."""
    n = len(values)
    pw = _powers(_BASE)
    out = np.zeros(n + 1, np.uint64)
    top = pow(_BASE, _CHUNK, 2**64)
    lead = 1
    with np.errstate(over="ignore"):
        for at in range(0, n, _CHUNK):
            part = values[at : at + _CHUNK]
            np.multiply(part, pw[: len(part)] * np.uint64(lead), out=out[at + 1 : at + 1 + len(part)])
            lead = lead * top % 2**64
        np.cumsum(out, out=out)
    return out


def _inverse_powers(at: np.ndarray) -> np.ndarray:
    """base**-at for an array of exponents."""
    low = _powers(_INV)
    high_n = int(at.max() // _CHUNK) + 1 if len(at) else 1
    high = np.ones(high_n, np.uint64)
    step = pow(_INV, _CHUNK, 2**64)
    value = 1
    for i in range(high_n):
        high[i] = value
        value = value * step % 2**64
    with np.errstate(over="ignore"):
        return low[at % _CHUNK] * high[at // _CHUNK]


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the value ranges [start, end)."""
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * _inverse_powers(start)
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Tokens:
    """Tokens of a batch of texts, texts one after the other.

    doc[i]..doc[i+1] are text i's tokens; start/end are byte positions in the
    lower-cased UTF-8 text, counted from that text's own start.
    """

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lower: pa.Array
    stems: list[np.ndarray] = field(default_factory=list)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def owners(self) -> np.ndarray:
        """The text number of each token."""
        return np.repeat(np.arange(len(self.doc) - 1), self.counts)


def _buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(a.type)
    off = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = a.buffers()[2]
    return off, np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)


def as_strings(col) -> pa.Array:
    """An Arrow column as one string array, nulls as empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return pc.fill_null(col.cast(pa.large_string()), "")


#: Marks the hash of a stem, so that it differs from that of the same word.
_STEM = np.uint64(0x5851F42D4C957F2D)


def _starts_and_ends(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens begin, and where their last byte is, as masks over the bytes of texts."""
    n = len(data)
    word = _WORD[data]
    alone = np.zeros(0, np.int64)
    if data.max() >= 0xC2:
        more = [np.append(data[k:], np.zeros(k, np.uint8)) for k in (1, 2)]

        def clear(lead: np.ndarray, size: int) -> None:
            for k in range(size):
                word[lead + k] = False

        two = np.flatnonzero(data == 0xC2)
        if len(two):
            x = more[0][two]
            clear(two[(x != 0xAA) & (x != 0xB5) & (x != 0xBA)], 2)
        three = np.flatnonzero((data >= 0xE2) & (data <= 0xEF))
        if len(three):
            x, y, z = data[three], more[0][three], more[1][three]
            dash = (x == 0xE2) & ((y == 0x80) | (y == 0x81) & (z < 0xB0))
            wide = (x == 0xEF) & ((y == 0xBC) & ((z < 0x90) | (z > 0x99) & (z < 0xA1)) | (y == 0xBB) & (z == 0xBF))
            clear(three[dash | wide | (x == 0xE3) & (y == 0x80)], 3)
            alone = three[(x >= 0xE4) & (x <= 0xE9) | (x == 0xE3) & ((y >= 0x81) & (y <= 0x83) | (y >= 0x90))]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    if len(alone):
        starts[alone] = True
        ends[alone + 2] = True
        after, before = alone[alone + 3 < n] + 3, alone[alone > 0] - 1
        starts[after] = word[after]
        ends[before] = word[before]
    # a text's first byte starts a token even if the text before ended in one
    first = off[:-1][off[:-1] < n]
    starts[first] = word[first]
    last = off[1:][off[1:] > 0] - 1
    ends[last] = word[last]
    return starts, ends


def _tokenize_bytes(data: np.ndarray, off: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Token counts of the texts data[off[i]:off[i+1]], token hashes, starts, ends and stem hashes."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return (np.zeros(len(off) - 1, np.int64), np.zeros(0, np.uint64), none, none, *(np.zeros(0, np.uint64) for _ in stems))
    starts, ends = _starts_and_ends(data, off)
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    prefix = prefix_hash(_BYTE[data])
    h = range_hash(prefix, s, e)
    begins = [np.where(e - s > n, range_hash(prefix, s, np.minimum(e, s + n)) ^ _STEM, np.uint64(0)) for n in stems]
    counts = np.diff(np.searchsorted(s, off))
    begin = np.repeat(off[:-1], counts)
    return (counts, h, s - begin, e - begin, *begins)


#: Bytes tokenised at once, so that the working arrays stay in the processor's cache.
_PIECE = 1 << 19


def tokenize(col, stems: tuple[int, ...] = ()) -> Tokens:
    """Tokens of an Arrow string column; a null counts as the empty text.

    stems: for each number, the hashes of the tokens' first so many bytes are
    given too; 0 for tokens that are not longer.
    """
    low = pc.utf8_lower(as_strings(col))
    off, data = _buffers(low)
    if not len(low):
        off = np.zeros(1, np.int64)
    parts, i, n = [], 0, len(low)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + _PIECE, "right")) - 1)
        parts.append(_tokenize_bytes(data[off[i] : off[j]], off[i : j + 1] - off[i], stems))
        i = j
    if not parts:
        parts = [_tokenize_bytes(data[:0], off[:1], stems)]
    counts, h, s, e, *begins = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*parts))
    doc = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=doc[1:])
    return Tokens(doc, h, s, e, low, begins)


def token_counts(col) -> np.ndarray:
    """The number of tokens of each text of an Arrow string column."""
    low = as_strings(col)
    off, data = _buffers(low)
    n, parts, i = len(low), [np.zeros(0, np.int64)], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + _PIECE, "right")) - 1)
        piece, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        if len(piece):
            starts, _ = _starts_and_ends(piece, at)
            parts.append(np.diff(np.append(0, np.cumsum(starts))[at]))
        else:
            parts.append(np.zeros(j - i, np.int64))
        i = j
    return np.concatenate(parts)


def hash_words(words: list[str]) -> np.ndarray:
    """Token hashes of single words that are tokens already."""
    t = tokenize(pa.array(words, pa.large_string()))
    if len(t.hash) != len(words):
        raise ValueError("each word must be exactly one token")
    return t.hash


def string_hashes(a: pa.Array) -> np.ndarray:
    """Hashes of whole strings, as they are."""
    off, data = _buffers(as_strings(a))
    if not len(off):
        return np.zeros(0, np.uint64)
    off, base = off - off[0], int(off[0])
    return range_hash(prefix_hash(_BYTE[data[base : base + int(off[-1])]]), off[:-1], off[1:])


def text_hashes(texts: list[str]) -> list[np.ndarray]:
    """Token hash sequences of a few texts."""
    t = tokenize(pa.array(texts, pa.large_string()))
    return [t.hash[a:b] for a, b in zip(t.doc[:-1], t.doc[1:])]


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens from each position; positions near the end have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out *= np.uint64(_BASE)
            out += h[j : j + n]
    return mix(out)
