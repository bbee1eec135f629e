"""Sizes of texts: in units, or in tokens of a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textkit as T

#: Where the vocabulary files are, and the one used unless another is named.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
UNITS = "units"
#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
@functools.lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, taken whole: the tokenizer's time is in proportion to the text even in one long run."""
    enc = _encoding(path)
    return [len(enc.encode_ordinary(t)) for t in texts]


def counter(measure: str) -> Callable[[list[str]], np.ndarray]:
    """``units``, or the path of a tiktoken vocabulary."""
    if measure == UNITS:
        return T.unit_counts
    return lambda texts: np.array(token_counts(texts, measure), np.int64)


def measured(docs: DataFrame, measure: str, *keep: str) -> DataFrame:
    """(doc_id, *keep, size): the text's size; 0 for a null or empty text. ``keep`` are further columns of ``docs``."""
    ship(docs.sparkSession)
    names = ["doc_id", *keep]
    rows = docs.select(*names, "text")
    kinds = rows.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(measure)
        for b in batches:
            sizes = count([t or "" for t in b.column(len(names)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(sizes, pa.int64())], names=[*names, "size"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", size bigint")
