"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow string array.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r. Every word gets a
64-bit hash: a polynomial over randomly coded bytes, taken from prefix sums and mixed.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x):
    """A bijection of 64-bit integers that spreads every bit (splitmix64's last steps)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n):
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, U(base), U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offs: np.ndarray  # where each text starts, and the end
    start: np.ndarray  # byte at which each word starts
    end: np.ndarray
    doc: np.ndarray  # number of each word's text
    count: np.ndarray  # words of each text
    hash: np.ndarray
    prefix: np.ndarray  # prefix sums of coded bytes; one more than bytes

    def span_hash(self, a, b):
        """Hashes of the byte ranges from a to b."""
        return mix((self.prefix[b] - self.prefix[a]) * _power(len(self.prefix))[1][a] + (b - a).astype(U))


def buffers(texts):
    """(bytes, offsets) of a string array; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def words(texts, other=SPACE) -> Words:
    """`other`: the bytes that are in no word."""
    data, offs = buffers(texts)
    n = len(data)
    solid = ~other[data]
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:], after[: n - 1 if n else 0] = solid, solid[1:]
    before[offs] = after[offs - 1] = False  # a text's first byte has nothing before it, its last nothing after
    start, end = np.flatnonzero(solid & ~before[:n]), np.flatnonzero(solid & ~after[:n]) + 1
    count = np.diff(np.searchsorted(start, offs))
    prefix = np.zeros(n + 1, U)
    up, down = _power(n + 1)
    np.cumsum(_CODE[data] * up[:n], out=prefix[1:])
    hashes = mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U))
    return Words(data, offs, start, end, np.repeat(np.arange(len(count)), count), count, hashes, prefix)


def slices(batch, column="text", most=SLICE_BYTES):
    """Parts of a record batch with about `most` bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def windows(hashes, doc, n):
    """(first word, hash) of each run of n words inside a text. Hashes roll: each is a difference of two prefix sums."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    up, down = _power(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=prefix[1:])
    return at, mix((prefix[at + n] - prefix[at]) * down[at])


def repeated(key):
    """(is one of several equal keys, is equal to an earlier one); order is that of the array."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    if len(key):
        same[1:-1] = key[order][1:] == key[order][:-1]
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order], later[order] = same[1:] | same[:-1], same[:-1]
    return many, later


def per_doc(values, offs):
    """Sums of values between offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
