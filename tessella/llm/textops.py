"""Vectorised text primitives on Arrow string batches (numpy, no per-character Python)."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: One random odd-spread value per byte and one odd base: the polynomial hash of words.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at a time, so that temporaries stay small whatever the batch holds.
CHUNK = 1 << 20

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            x = np.full(max(n, CHUNK + 1), base, U64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    n, start = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if big else np.int32)[start : start + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, docs: int = 1023) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents: (first, last, bytes, offsets), each of CHUNK bytes or one document."""
    data, offsets = raw(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1
        j = min(max(j, i + 1), i + docs, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes other than white space."""
    inside = ~SPACE[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    last[tails] |= inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word, A-Z lower-cased if asked."""
    if lower:
        data = LOWER[data]
    start, end, doc = words(data, offsets)
    return span_hash(data, start, end), doc


def group_starts(doc: np.ndarray, n: int) -> np.ndarray:
    """For sorted ``doc``: the n+1 positions where each document's rows begin."""
    return np.searchsorted(doc, np.arange(n + 1))


def segment_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive starts; empty segments are 0. In float64 or integers."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else values.dtype)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[starts[1:]] - sums[starts[:-1]]


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """For each code point: 1 letter, 2 number, 3 white space, 0 other (Unicode general categories)."""
    if not _classes:
        out = np.zeros(sys.maxunicode + 1, np.uint8)
        of = {"L": 1, "N": 2}
        for a, b in ((0, 0x323B0), (0xE0000, 0xE01F0)):  # no letters, numbers or spaces beyond
            for c in range(a, b):
                kind = of.get(unicodedata.category(chr(c))[0])
                if kind:
                    out[c] = kind
        #: The code points with the White_Space property.
        out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
        out[0x2000:0x200B] = 3
        _classes.append(out)
    return _classes[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letter_stream(texts: list[str], kinds: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, a single 0 between words and at both ends, and each place's document.

    A 0 belongs to the document of the word before it. ``kinds`` is the highest
    character class that counts as part of a word: 1 letters, 2 also numbers.
    """
    lowered = [t.lower() for t in texts]
    codes = code_points("\n" + "\n".join(lowered) + "\n")
    kind = classes()[codes]
    codes = np.where((kind > 0) & (kind <= kinds), codes, 0).astype(np.uint32)
    keep = codes != 0
    keep[1:] |= keep[:-1].copy()
    keep[0] = True
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    doc = np.concatenate([np.zeros(1, doc.dtype), doc])[keep]
    return codes[keep], doc


def ngrams(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place; those that span two words keep their bucket too."""
    h = np.full(max(0, len(codes) - order + 1), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = h * np.uint32(0x85EBCA6B) + codes[k : len(codes) - order + 1 + k]
        h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - bits)


def text_runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters together, or one longer text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)
