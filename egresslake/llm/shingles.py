"""Hashed word shingles with numpy."""

from __future__ import annotations

import re

import numpy as np

SHINGLE = 5
_M = np.uint64
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_MULT = _M(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> _M(33))
    x = x * _M(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _M(33))
    x = x * _M(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _M(33))


_powers = np.multiply.accumulate(np.concatenate([np.ones(1, _M), np.full(4095, 0x100000001B3, _M)]))


def powers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _M(0x100000001B3))])
    return _powers[:n]


def placed_words(data: bytes, flags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Of the words that [\\x20\\x09-\\x0D] separates: 64-bit hashes, OR of the table `flags` over the bytes, first bytes' places."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_SPACES[raw]
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.empty(0, _M), None if flags is None else np.empty(0, flags.dtype), starts
    lengths = ends - starts
    chars = raw[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    sums = np.add.reduceat((chars.astype(_M) + _M(1)) * powers(int(lengths.max()))[place], first)
    return mixed(sums + lengths.astype(_M) * _MULT), None if flags is None else np.bitwise_or.reduceat(flags[chars], first), starts


def hashed_words(data: bytes, flags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    return placed_words(data, flags)[:2]


#: A byte's bits in the eight byte lanes of a word.
_LANES = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).view(_M).reshape(-1)


def _majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group of rows (n, 8) of hash bytes: the 64 bits that more than half of them set.

    Eight counters of a byte each are added at a time, over chunks of at most 255 rows.
    """
    chunks = -(-counts // 255)
    first = np.repeat(starts, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    ones = np.stack([np.add.reduceat(_LANES[hashes[:, i]], first) for i in range(8)], axis=1).view(np.uint8).reshape(len(first), 64)
    if len(first) > len(starts):
        ones = np.add.reduceat(ones.astype(np.int64), np.cumsum(chunks) - chunks, axis=0)
    return np.packbits(2 * ones.astype(np.int64) > counts[:, None], axis=1).reshape(-1).view(np.int64)


#: Lines of at most so many units have a key for each unit left out; from that many units on, keys of runs of units.
FEW_WORDS, FEW_CHARS = 8, 16
#: Length of runs: of words in shorter lines, of words in longer ones, of characters.
RUN, LONG_RUN, CHAR_RUN = 3, 4, 6
#: Lines of at least LONG words have long runs; those of under LONG_TOO words short ones too, since similar lines may lie on both sides.
LONG, LONG_TOO = 20, 25
#: A line whose words have over so many characters on average is taken as characters.
CHARS_A_WORD = 15
#: Runs kept of a line: those with the least hashes.
KEYS = 8


def _runs(h: np.ndarray, line: np.ndarray, ends: np.ndarray, size: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the KEYS runs of `size` units with the least hashes of every wanted line."""
    m = len(h) - size + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, _M)
    at = np.flatnonzero(wanted[line[:m]] & (np.arange(m) + size <= ends[line[:m]]))
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, _M)
    g = h[at].copy()
    for k in range(1, size):
        g = g * _MULT + h[at + k]
    g, row = mixed(g + _M(size)), line[at]
    bits = _M(max(1, int(row[-1]).bit_length()))
    order = np.argsort(row.astype(_M) << (_M(64) - bits) | g >> bits)
    row, g = row[order], g[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])])
    row, g = row[new], g[new]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < KEYS], g[rank < KEYS]


def _but_one(h: np.ndarray, starts: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of each line of 2 to `most` units whole and with each unit left out."""
    rows, keys = [], []
    for size in range(2, most + 1):
        mine = np.flatnonzero(n == size)
        if len(mine):
            units = h[starts[mine][:, None] + np.arange(size)]
            for out in range(size + 1):
                left = [k for k in range(size) if k != out]
                total = np.full(len(mine), len(left), _M)
                for k in left:
                    total = total * _MULT + units[:, k]
                rows.append(mine)
                keys.append(mixed(total ^ _M(0x2545F4914F6CDD1D)))
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.empty(0, np.int64), np.empty(0, _M))


def _char_line(words: str) -> tuple[int, np.ndarray]:
    """(SimHash over distinct character trigrams, keys) of a line taken as characters."""
    c = mixed(np.frombuffer(words.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_M) + _M(1))
    line, ends, yes = np.zeros(len(c), np.int64), np.array([len(c)]), np.array([True])
    padded = np.append(c, np.zeros(2, _M))
    grams = np.unique(mixed(padded[:-2] * _MULT * _MULT + padded[1:-1] * _MULT + padded[2:]))
    sim = int(_majority(grams.view(np.uint8).reshape(-1, 8), np.zeros(1, np.int64), np.array([len(grams)]))[0])
    keys = [_but_one(c, np.zeros(1, np.int64), ends, FEW_CHARS)[1]]
    if len(c) >= FEW_CHARS:
        keys.append(_runs(c, line, ends, CHAR_RUN, yes)[1])
    return sim, np.concatenate(keys) ^ _M(0xC0FFEE)


def line_parts(text: str, least: int = 1) -> tuple[np.ndarray, ...]:
    """Of the lines with at least so many words, in order.

    line (number), node (hash of the words in order), sim (SimHash over pairs of neighbouring words, or over
    character trigrams where the words are long), few (whether keys are of all units but one), size
    (characters of the normalised line), and keys with the number of keys of each line.
    """
    text = text.lower()
    data = text.encode("utf-8", "surrogatepass")
    h, _, starts = placed_words(data)
    raw = np.frombuffer(data, dtype=np.uint8)
    breaks = np.flatnonzero(raw == 10)
    line, first, n = np.unique(np.searchsorted(breaks, starts), return_index=True, return_counts=True)
    if not len(line) or n.max() < least:
        none = np.empty(0, np.int64)
        return none.astype(np.int32), none, none, none.astype(bool), none.astype(np.int32), none, none
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - first[row]
    node = mixed(np.add.reduceat(h * powers(int(n.max()))[place], first) + n.astype(_M))
    pair = mixed(h + _MULT * np.append(np.where(row[1:] == row[:-1], h[1:], _M(0)), _M(0)))
    pair = np.where((place < n[row] - 1) | (n[row] == 1), pair, pair[np.maximum(np.arange(len(h)) - 1, 0)])  # the last word has no pair
    sim = _majority(pair.view(np.uint8).reshape(-1, 8), first, n)
    used = (~_SPACES[raw]) & ((raw & 0xC0) != 0x80)
    before = np.concatenate([[0], np.cumsum(used)])
    size = before[np.append(starts[first[1:]], len(raw))] - before[starts[first]] + n - 1
    by_char = size > CHARS_A_WORD * n
    wanted, ends = (n >= least) & ~by_char, first + n
    few = wanted & (n <= FEW_WORDS)
    found = [_but_one(h, first, np.where(few, n, 0), FEW_WORDS)]
    found.append(_runs(h, row, ends, RUN, wanted & (n >= FEW_WORDS) & (n < LONG_TOO)))
    found.append(_runs(h, row, ends, LONG_RUN, wanted & (n >= LONG)))
    if by_char.any():
        texts = text.split("\n")
        for i in np.flatnonzero(by_char & (n >= least)).tolist():
            sim[i], keys = _char_line(" ".join(w for w in _words(texts[line[i]]) if w))
            few[i] = size[i] <= FEW_CHARS
            found.append((np.full(len(keys), i), keys))
    rows, keys = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    keys = keys[np.argsort(rows, kind="stable")].view(np.int64)
    keep = n >= least
    return line[keep].astype(np.int32), node.view(np.int64)[keep], sim[keep], few[keep], size[keep].astype(np.int32), keys, np.bincount(rows, minlength=len(n))[keep]


_words = re.compile(r"[\x20\x09-\x0D]+").split


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    return hashed_words((text or "").lower().encode("utf-8", "surrogatepass"))[0]


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a shorter text has one shingle, an empty text none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h = h * _MULT + w[i : len(w) - k + 1 + i]
    return np.unique(mixed(h + _M(k)))


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a set of hashes."""
    x = mixed(hashes ^ _M(0xA0761D6478BD642F))
    with np.errstate(over="ignore"):
        total = mixed(np.array([x.sum(dtype=_M) * _MULT + np.bitwise_xor.reduce(x, initial=_M(0)) + _M(len(x))], dtype=_M))
    return int(total.view(np.int64)[0])
