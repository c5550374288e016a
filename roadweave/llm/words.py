"""Vectorised word scanning: whole Arrow slices are cut into words and hashed without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: A text longer than two pieces is scanned in pieces of about so many bytes, cut between words.
PIECE_BYTES = 1 << 19
#: Longer words are hashed at once instead of by eight bytes a step.
LONG_WORD = 256
#: Odd multipliers of the splitmix64 finaliser and of the n-gram combination (fixed values, public domain).
_M1, _M2, _GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


class Scan:
    """Words of a slice: ``starts``/``ends`` are byte positions, ``first`` has each row's first word (and the count at its end)."""

    __slots__ = ("data", "ends", "first", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = ~separators[self.data]
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            edges = offsets[(offsets > 0) & (offsets < n)]
            begin[edges] = inside[edges]
            end[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word; a bijection of the bytes for words of up to eight bytes and one length."""
        if not len(self.starts):
            return np.zeros(0, U64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        lengths = self.ends - self.starts
        h = np.zeros(len(lengths), U64)
        long = np.flatnonzero(lengths > LONG_WORD)
        at, left, rows = self.starts, np.where(lengths > LONG_WORD, 1, lengths) if len(long) else lengths, None
        while True:
            piece = eights[at]
            short = np.minimum(left, 8).astype(U64)
            piece = piece & (~U64(0) >> ((U64(8) - short) << U64(3)))
            if rows is None:
                h = mix(piece + _GOLDEN)
            else:
                h[rows] = mix((h[rows] ^ piece) + _GOLDEN)
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            rows = more if rows is None else rows[more]
            at, left = at[more] + 8, left[more] - 8
        for i in long:
            piece = eights[self.starts[i] : self.ends[i] : 8].copy()
            piece[-1] &= ~U64(0) >> U64(8 * (-int(lengths[i]) % 8))
            h[i] = mix(piece + np.arange(1, len(piece) + 1, dtype=U64) * _GOLDEN).sum(dtype=U64)
        return mix(h ^ (lengths.astype(U64) * _M1))


def pieces(data: np.ndarray, separators: np.ndarray = SPACES) -> Iterator[tuple[int, np.ndarray]]:
    """(place, bytes) of one text's pieces, each ending between two words (a longer word makes a longer piece)."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        while end < len(data):
            gap = np.flatnonzero(separators[LOWER[data[end : end + 4096]]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + 4096)
        yield at, data[at:end]
        at = end


def is_long(data: np.ndarray, offsets: np.ndarray) -> bool:
    """Whether a slice is one text to be scanned in pieces."""
    return len(offsets) == 2 and len(data) > 2 * PIECE_BYTES


def piece_scans(data: np.ndarray, separators: np.ndarray = SPACES, lower: bool = True) -> Iterator[tuple[int, int, Scan]]:
    """(place, words before, scan) of one text's pieces."""
    words = 0
    for at, piece in pieces(data, separators):
        scan = Scan(piece, np.array([0, len(piece)]), separators, lower)
        yield at, words, scan
        words += len(scan.starts)


def overlapped(data: np.ndarray, offsets: np.ndarray, more: int, separators: np.ndarray = SPACES) -> Iterator[tuple[int, int, Scan]]:
    """(words before, own words, scan) of a slice: it as a whole, or a long text's pieces, each followed by the next ``more`` words."""
    if not is_long(data, offsets):
        scan = Scan(data, offsets, separators)
        yield 0, len(scan.starts), scan
        return
    words = 0
    for at, piece in pieces(data, separators):
        own = len(Scan(piece, np.array([0, len(piece)]), separators).starts)
        end, reach = at + len(piece), 64 * more
        while True:
            stop = min(len(data), end + reach)
            scan = Scan(data[at:stop], np.array([0, stop - at]), separators)
            if len(scan.starts) > own + more or stop == len(data):
                break
            reach *= 4
        kept = min(len(scan.starts), own + more)
        scan.starts, scan.ends, scan.first = scan.starts[:kept], scan.ends[:kept], np.array([0, kept])
        yield words, own, scan
        words += own


class Words:
    """Hashes ``h`` of a slice's words and the place ``first`` of each row's first one; of a long text nothing else is held at once."""

    __slots__ = ("first", "h")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        if not is_long(data, offsets):
            scan = Scan(data, offsets, separators)
            self.h, self.first = scan.hashes(), scan.first
            return
        held, n = np.empty(len(data) // 2 + 1, U64), 0  # pages that no word reaches are never touched
        for _, _, scan in piece_scans(data, separators):
            h = scan.hashes()
            held[n : n + len(h)] = h
            n += len(h)
        self.h, self.first = held[:n], np.array([0, n])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position (n - 1 fewer rows); runs over row ends are the caller's to leave out."""
    if len(h) < n:
        return np.zeros(0, U64)
    total, mult = h[: len(h) - n + 1] * _GOLDEN, _GOLDEN
    for i in range(1, n):
        mult = U64((int(mult) * int(_M1) + 2) & (2**64 - 1))
        total = total + h[i : len(h) - n + 1 + i] * (mult | U64(1))
    return mix(total)


def distinct(out: np.ndarray) -> np.ndarray:
    """The sorted distinct values, made in the array's own memory."""
    out.sort()
    n = 0
    last = None
    for lo in range(0, len(out), PIECE_BYTES):
        part = out[lo : lo + PIECE_BYTES]
        new = np.ones(len(part), bool)
        np.not_equal(part[1:], part[:-1], out=new[1:])
        new[0] = last is None or part[0] != last
        last = part[-1]
        part = part[new]
        out[n : n + len(part)] = part
        n += len(part)
    return out[:n]


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of one text; with fewer words the whole sequence is the one shingle."""
    return np.unique(grams(h, min(n, len(h)))) if len(h) else h


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """``shingle_set`` of every row of a slice; of a long text only the shingles are held at once."""
    if not is_long(data, offsets):
        scan = Scan(data, offsets)
        h, first = scan.hashes(), scan.first
        return [shingle_set(h[a:b], n) for a, b in zip(first[:-1], first[1:], strict=True)]
    held, count, tail = np.empty(len(data) // 2 + 1, U64), 0, np.zeros(0, U64)
    for _, _, scan in piece_scans(data):
        h = np.concatenate([tail, scan.hashes()])
        g = grams(h, n)
        held[count : count + len(g)] = g
        count, tail = count + len(g), h[max(0, len(h) - n + 1) :]
    return [distinct(held[:count]) if count else shingle_set(tail, n)]


def summed(u: np.ndarray, salt: np.uint64) -> int:
    """Signed 64-bit sum of the salted, mixed values: an identity of a set."""
    total = U64(0)
    with np.errstate(over="ignore"):
        for lo in range(0, len(u), PIECE_BYTES):
            total += mix(u[lo : lo + PIECE_BYTES] ^ salt).sum(dtype=U64)
    return int(np.uint64(total).view(np.int64))


def hash_words(words: list[bytes]) -> np.ndarray:
    """The same hashes for single words that are already lower case."""
    lengths = np.array([len(w) for w in words], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    scan = Scan(np.frombuffer(b"".join(w + b" " for w in words), np.uint8), offsets)
    return scan.hashes()
