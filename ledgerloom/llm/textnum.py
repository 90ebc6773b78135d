"""Words of many texts as numpy arrays of 64-bit hashes, in independent lanes.

A word is hashed in blocks of eight bytes, each scrambled into the hash of those
before it, and n-grams are combined from their halves, scrambled at every step.
No polynomial is involved, so words and n-grams of regular make do not collide
more often than others. Lanes differ in every step: two of them together are a
hash of 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer words are hashed one by one, by blake2b.
BLOCKS = 8
_U = np.uint64
#: Odd constants that tell the lanes apart, from the digits of a digest.
_KEYS = [[int.from_bytes(blake2b(bytes([lane, k]), digest_size=8).digest(), "little") | 1 for k in range(4)] for lane in range(2)]
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(texts: list[bytes], lower: bool = False, lanes: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """For each lane the hashes of all words, and for text i the words bounds[i]:bounds[i + 1].

    A word is a run of bytes other than space and 9 to 13.
    """
    if not texts:
        return [np.zeros(0, np.uint64)] * lanes, np.zeros(1, np.int64)
    buf = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    if lower:
        buf = _LOWER[buf]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    solid = ~_SPACE[buf]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum(lengths))))
    # Eight bytes from every place on, and how many of them belong to the word.
    wide = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    size = ends - starts
    keys = _KEYS[:lanes]
    out = [mix(size.astype(np.uint64) * _U(k[0]) ^ (wide[starts] & _MASKS[np.minimum(size, 8)]) + _U(k[1])) for k in keys]
    more = np.flatnonzero((size > 8) & (size <= 8 * BLOCKS))
    for block in range(1, BLOCKS):
        if not len(more):
            break
        x = wide[starts[more] + 8 * block] & _MASKS[np.minimum(size[more] - 8 * block, 8)]
        for h, k in zip(out, keys, strict=True):
            h[more] = mix(h[more] * _U(k[2]) ^ x + _U(k[3]))
        more = more[size[more] > 8 * (block + 1)]
    for w in np.flatnonzero(size > 8 * BLOCKS).tolist():
        digest = blake2b(buf[starts[w] : ends[w]].tobytes(), digest_size=16).digest()
        for lane, h in enumerate(out):
            h[w] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return out, bounds


def grams(hashes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hashes of the k words from each position on, len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = _KEYS[lane]

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(mix(a + _U(key[1])) ^ b * _U(key[2]))

    # Lengths of powers of two from their halves; the powers of k's binary digits make the whole.
    power, reach, whole, done = hashes, 1, None, 0
    while True:
        if k & reach:
            whole = power if whole is None else joined(whole[: len(power) - done], power[done:])
            done += reach
        if done == k:
            break
        power = joined(power[: len(power) - reach], power[reach:])
        reach *= 2
    return mix(whole[:n] + _U(k))


def chunks(rows: Iterable[tuple], size: int = 1 << 20) -> Iterator[list[tuple]]:
    """Lists of rows whose last members, the texts, have about size bytes together."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
