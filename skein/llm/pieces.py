"""Problem 3: oversized items cut at natural boundaries, by range-maximum queries over boundary strengths.

Each gap between two units has a strength: paragraph end, sentence end, other white space, none. A sparse table over
(strength, position) answers "the strongest cut in this window, the last of equals" in constant time; every piece is
one query for its end and one for the start of the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textkit as T

LIMIT, OVERLAP, SLACK = 500, 50, 10
NONE, BLANK, SENTENCE, PARAGRAPH = 0, 1, 2, 3
#: Marks that end a sentence, and marks that may follow them before the next one begins.
ENDS, CLOSERS = ".!?…。！？؟।۔", "\"'”’»)]）」』】*_"
_NAMES = ["inside a run", "white space", "sentence end", "paragraph end"]


def strengths(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strength of the gap after each unit but the last."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.isin(cp, [10, 11, 12, 13, 0x85, 0x2028, 0x2029])
    ending = np.isin(cp, [ord(c) for c in ENDS])
    closing = np.isin(cp, [ord(c) for c in CLOSERS])
    at = np.concatenate(([0], np.cumsum(breaks)))
    last = ends[:-1] - 1
    for _ in range(3):  # look behind up to three closing marks
        last = np.where((last > starts[:-1]) & closing[last], last - 1, last)
    gap = starts[1:] > ends[:-1]
    wide = np.isin(cp[last], [ord(c) for c in "。！？"])
    out = np.where(gap, BLANK, NONE)
    out[ending[last] & (gap | wide)] = SENTENCE
    out[at[starts[1:]] > at[ends[:-1]]] = PARAGRAPH
    # a CJK mark is a run of its own or stands before the next character: the gap before it is no boundary
    follows = np.isin(cp[starts[1:]], [ord(c) for c in ENDS + CLOSERS + "，、；：,;:"]) & ~gap
    out[follows] = NONE
    return out


class Strongest:
    """Sparse table over (strength, position)."""

    def __init__(self, strength: np.ndarray):
        key = (strength.astype(np.int64) << 40) | np.arange(len(strength))
        self.levels = [key]
        while len(key) > (w := 1 << (len(self.levels) - 1)) and len(self.levels[-1]) > w:
            self.levels.append(np.maximum(self.levels[-1][:-w], self.levels[-1][w:]))

    def query(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, position) of the strongest in lo..hi (both included), the last of equals."""
        k = (hi - lo + 1).bit_length() - 1
        best = int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]))
        return best >> 40, best & ((1 << 40) - 1)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int, int, int, int]]:
    """(first unit, end unit, first character, end character, strength of the end) of each piece; one piece if the text
    is within the limit. White space goes with the piece before it, so the pieces cover every character."""
    starts, ends = T.units(text)
    n = len(starts)
    if n <= limit:
        return [(0, n, 0, len(text), PARAGRAPH)]
    table = Strongest(strengths(text, starts, ends))
    out, s = [], 0
    while n - s > limit:
        strength, gap = table.query(s + limit // 2 - 1, s + limit - 1)
        if strength < SENTENCE:  # none in the upper half: any natural boundary that still makes headway
            low = table.query(s + overlap + slack, s + limit - 1)
            strength, gap = low if low[0] >= SENTENCE else (strength, gap)
        e = gap + 1
        out.append((s, e, int(starts[s]) if s else 0, int(starts[e]), strength))
        back, at = table.query(max(s, e - overlap - slack - 1), e - overlap + slack - 1)
        s = at + 1 if back >= SENTENCE else e - overlap
    out.append((s, n, int(starts[s]) if s else 0, len(text), PARAGRAPH))
    return out


def _cut(limit: int, overlap: int):
    schema = pa.schema([("doc_id", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("first_unit", pa.int32()), ("n_units", pa.int32()), ("first_char", pa.int32()), ("ends_at", pa.string()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            over = np.flatnonzero(T.unit_counts(texts) > limit)
            rows: list[tuple] = []
            size = 0
            for i in over:
                parts = cut(texts[i], limit, overlap)
                rows += [(ids[i], k, len(parts), s, e - s, c, _NAMES[w], texts[i][c:z]) for k, (s, e, c, z, w) in enumerate(parts)]
                size += len(texts[i])
                if size > 4_000_000:  # a batch of long texts goes out in portions
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def pieces(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every document over ``limit`` units, however long it says it is. Documents within the limit, and null
    texts, have no row. The length test before the Python step drops only texts that are too short for the limit."""
    if not 0 <= overlap + SLACK < limit // 2:
        raise ValueError("overlap must be under half the limit")
    ship(docs.sparkSession)
    long = docs.select(F.col("doc_id").cast("string"), "text").where(F.length("text") > limit)
    return long.mapInArrow(_cut(limit, overlap), "doc_id string, piece_no int, n_pieces int, first_unit int, n_units int, first_char int, ends_at string, piece string")


def oversized(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id of each document that had to be cut."""
    return pieces(docs, limit).where("piece_no = 0").select("doc_id")
