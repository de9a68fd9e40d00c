"""Hashes of the words of many texts at once, with numpy: no loop over words.

A word is read in blocks of 8 bytes. Each block is mixed into two lanes of 64 bits, and so is the word's length; the mixes
aren't linear, and differ between the lanes, so words that differ share both with a probability of about 2**-128. A
run of n words is hashed by doubling: the hash of 2m words is a mix of the hashes of its halves, so log2(n) passes over
the arrays give the hash of the run that starts at each word. There is no polynomial whose sums repeated patterns could
bring to agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

U = np.uint64
#: Bytes that are hashed at once.
CHUNK = 1 << 21
#: Bytes up to which words are read in blocks together; longer ones are hashed one by one.
LONGEST = 64
BLANK = re.compile(rb"[\x20\x09-\x0D]")
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: What is left of a block of 8 bytes, by how many are the word's.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Odd multipliers of the lanes.
LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def fmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes that end between words."""
    at = 0
    while len(text) - at > CHUNK and (m := BLANK.search(text, at + CHUNK)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both lanes of the hash of each word of some texts, and each text's number of words."""
    data = b"\n".join(texts) + b"\n" + bytes(16)
    size = len(data) - 16
    blank = BLANKS[np.frombuffer(data, np.uint8, size)]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    long = end - start
    at = np.ndarray((size + 8,), "<u8", data, strides=(1,))  # the 8 bytes from each place on
    lanes = [fmix(long.astype(U) * U(m)) for m in LANES]
    left = np.arange(len(start))
    for k in range(0, min(LONGEST, int(long.max(initial=0))), 8):
        if k:
            left = left[long[left] > k]
        block = at[start[left] + k] & MASKS[np.minimum(long[left] - k, 8)]
        for lane, m in zip(lanes, LANES):
            lane[left] = fmix(lane[left] * U(m) + (block ^ U(m >> 7)))
    for i in np.flatnonzero(long > LONGEST):
        lanes[0][i], lanes[1][i] = np.frombuffer(xxhash.xxh3_128_digest(data[start[i] : end[i]]), U)
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    return *lanes, np.diff(np.searchsorted(start, first))


def word_hashes(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Both lanes of the hash of each word, and the place of each text's first word (with the total as the last)."""
    owner, pieces = [], []
    for i, text in enumerate(texts):
        for part in parts(text):
            owner.append(i)
            pieces.append(part)
    found = [_words(pieces[i:j]) for i, j in chunks(pieces)]
    if not found:
        return [np.empty(0, U), np.empty(0, U)], np.zeros(len(texts) + 1, np.int64)
    a, b, n = (np.concatenate(x) for x in zip(*found))
    first = np.concatenate(([0], np.cumsum(np.bincount(owner, n, len(texts)).astype(np.int64))))
    return [a, b], first


def joined(left: np.ndarray, right: np.ndarray, lane: int, long: int) -> np.ndarray:
    """The hash of runs of long words from those of their first and second parts."""
    return fmix((left ^ (left >> U(29))) * U(LANES[lane]) + right + U(long))


def run_hashes(words: np.ndarray, n: int, lane: int) -> np.ndarray:
    """One lane of the hash of the n words from each place on (of len(words) - n + 1 places)."""
    if len(words) < n:
        return np.empty(0, U)
    out, long, power, size = None, 0, words, 1
    while True:
        if n & size:  # the run is made of powers of two, the smallest first
            if out is None:
                out, long = power, size
            else:
                k = len(words) - long - size + 1
                out, long = joined(out[:k], power[long : long + k], lane, long + size), long + size
        size *= 2
        if size > n:
            return out
        half = size // 2
        k = len(words) - size + 1
        power = joined(power[:k], power[half : half + k], lane, size)


def digest(data: bytes) -> tuple[int, int]:
    """128 bits as two signed integers."""
    raw = xxhash.xxh3_128_digest(data)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about CHUNK bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


from .common import by_value  # noqa: E402

by_value(__name__)
