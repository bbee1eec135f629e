"""Whole-batch text handling on code points: one table lookup for each character instead of Python loops.

The terms are those of the project's data description: the normal form keeps letters, marks and digits of the
lower-cased text; similarity counts distinct 5-character substrings of it; a unit is a CJK or kana character or a run
of other characters without white space.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

KEPT, LETTER, SPACE, CJK, DIGIT = 1, 2, 4, 8, 16
GRAM = 5
#: The code points that Unicode calls white space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LINE_BREAKS = "\\n\\r\\x0b\\x0c\\x85\\u2028\\u2029"


@functools.lru_cache(1)
def kinds() -> np.ndarray:
    """Bits KEPT, LETTER, SPACE, CJK, DIGIT of each code point."""
    t = np.zeros(0x110000, np.uint8)
    for block in (range(0x323B0), range(0xE0000, 0xE01F0)):
        for c in block:
            cat = unicodedata.category(chr(c))[0]
            if cat in "LMN":
                t[c] = KEPT | (LETTER if cat == "L" else 0) | (DIGIT if cat == "N" else 0)
    t[WHITE_SPACE] |= SPACE
    t[0x3040:0x3100] |= CJK
    t[0x3400:0xA000] |= CJK
    return t


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind each other, and the offsets of each (one more than texts)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return cp, off


def kept(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The normal forms, behind each other, with offsets (field lists in the order written)."""
    cp, off = codepoints([t.lower() for t in texts])
    mask = (kinds()[np.minimum(cp, 0x10FFFF)] & KEPT) != 0
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(mask, out=at[1:])
    return cp[mask], at[off]


def slices(texts: list[str], most: int = 300_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together, so arrays stay in cache; a longer text is alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(cp: np.ndarray, off: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 64-bit hash) of each n-character substring that lies inside one document. The hash is a
    polynomial; those of long substrings are put together from those of halves."""
    if len(cp) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = len(cp) - n + 1
    half, length, base = cp.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    h, done = None, 0
    while True:
        if n & length:
            h = half[:last].copy() if h is None else h[:last] * np.uint64(pow(base, length, 2**64)) + half[done : done + last]
            done += length
        if length * 2 > n:
            break
        half = half[: len(half) - length] * np.uint64(pow(base, length, 2**64)) + half[length:]
        length *= 2
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:last]
    inside = np.arange(last) + n <= off[1:][doc]
    return doc[inside], mix(h[inside])


def distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sorted distinct keys: the document number in the upper 20 bits, 44 bits of the hash below."""
    keys = (doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    keys.sort()
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def jaccard(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Similarity of each pair, with the numbers of distinct substrings of both sides."""
    a = distinct(*grams(*kept(left)))
    b = distinct(*grams(*kept(right)))
    n = len(left)
    na = np.bincount((a >> np.uint64(44)).astype(np.int64), minlength=n)
    nb = np.bincount((b >> np.uint64(44)).astype(np.int64), minlength=n)
    both = np.concatenate((a, b))
    both.sort()
    shared = both[1:][both[1:] == both[:-1]] if len(both) else both
    ns = np.bincount((shared >> np.uint64(44)).astype(np.int64), minlength=n)
    return ns / np.maximum(na + nb - ns, 1), na, nb


_FIELD = re.compile(r"\s*[^\W\d_]{2,20}:")
_CUT = re.compile(f"[{LINE_BREAKS}|]")


def fields(text: str) -> list[str] | None:
    """The parts of a field list, or None if the text is none."""
    if ":" not in text or not _CUT.search(text):
        return None
    parts = [p for p in _CUT.split(text) if p.strip()]
    return parts if len(parts) > 1 and all(_FIELD.match(p) for p in parts) else None


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def keys(texts: list[str]) -> tuple[list[bytes | None], list[bytes | None], np.ndarray]:
    """For each text: a key of its normal form as written, a key of its normal form (field lists without order), and
    the normal form's length. Texts without a letter, mark or digit have no key."""
    cp, off = kept(texts)
    written = [_digest(cp[off[i] : off[i + 1]].tobytes()) if off[i + 1] > off[i] else None for i in range(len(texts))]
    normal = list(written)
    for i, t in enumerate(texts):
        if written[i] is not None and (parts := fields(t)):
            pc, po = kept(parts)
            forms = sorted({pc[po[k] : po[k + 1]].tobytes() for k in range(len(parts))} - {b""})
            normal[i] = _digest(b"\xff\xff\xff\xff".join([b"", *forms]))
    return written, normal, np.diff(off)


def units(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) character positions of each unit of the text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kinds()[np.minimum(cp, 0x10FFFF)]
    cjk, other = (k & CJK) != 0, (k & (CJK | SPACE)) == 0
    before = np.concatenate(([False], other[:-1])) if len(cp) else other
    after = np.concatenate((other[1:], [False])) if len(cp) else other
    starts = np.flatnonzero(cjk | (other & ~before))
    ends = np.flatnonzero(cjk | (other & ~after)) + 1
    return starts, ends


def unit_counts(texts: list[str]) -> np.ndarray:
    """Units of each text, without positions."""
    out = np.zeros(len(texts), np.int64)
    for lo, hi in slices(texts):
        part = [t + "\n" for t in texts[lo:hi]]  # so that no run crosses into the next text
        cp, off = codepoints(part)
        k = kinds()[np.minimum(cp, 0x10FFFF)]
        other = (k & (CJK | SPACE)) == 0
        first = ((k & CJK) != 0) | (other & ~np.concatenate(([False], other[:-1])))
        at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(first, out=at[1:])
        out[lo:hi] = np.diff(at[off])
    return out
