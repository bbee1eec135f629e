"""Sparse text vectors worked out inside the task that reads the texts: neither terms nor pairs are shuffled or written.

A batch of texts is a list of distinct words with the terms of each; a word is multiplied once a batch by a block of
queries, and a text's scores are the sum over its words. The queries' vectors are worked out once and written. What
leaves a task is the best candidates of each query or the number of pairs at each rounded score, these and terms'
frequencies as packed ranges. Keys are distinct (one row a document).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import ship, stash

#: Scores are compared at this many decimals, as in ``scoring.DECIMALS``.
SCALE = 10**6
#: Queries of a block, rows and tokens of a batch of texts, words and pairs that many texts of a group have, terms of a task
#: before they are handed on, characters of a batch of pairs, groups of a batch and words they are told by. None changes a
#: result.
BLOCK, ROWS, TOKENS, HOT, TERMS, CHARS, GROUPS, SIGNS = 128, 8192, 1_000_000, 512, 1_000_000, 2_000_000, 24, 512
#: Scores of a range, and bits of a digest that name a range. Neither changes a result.
SCORES, BITS = 1 << 14, 10
#: Whole numbers below this are exact in single precision.
EXACT = 1 << 24
NGRAMS = (3, 4, 5)


def digest(term: str) -> int:
    """The first eight bytes of md5."""
    return int.from_bytes(hashlib.md5(term.encode("utf-8", "surrogatepass")).digest()[:8], "big")


_seen: dict[str, int] = {}


def digests(terms: list[str]) -> list[int]:
    """Worked out once for a term that comes again soon."""
    if len(_seen) > 300_000:
        _seen.clear()
    out = []
    for t in terms:
        h = _seen.get(t)
        if h is None:
            h = _seen[t] = digest(t)
        out.append(h)
    return out


def grams(word: str) -> list[str]:
    """n-grams of the padded word; one no longer than n yields itself once and no longer sizes."""
    w = f" {word} "
    return [w[p : p + n] for n in NGRAMS for p in range(len(w) - n + 1)]


def tokens_of(df: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """(key, others, words): lower-cased runs without white space; rows without text are left out."""
    return df.where(F.col(text).isNotNull()).select(key, *others, X.tokens(F.lower(F.col(text))).alias("words"))


class Ragged:
    """Lists of different lengths behind each other."""

    def __init__(self, flat: np.ndarray, off: np.ndarray):
        self.flat, self.off = flat, off

    @staticmethod
    def of(lists: list[list[int]], dtype=np.int64) -> Ragged:
        off = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=off[1:])
        return Ragged(np.fromiter((y for x in lists for y in x), dtype, int(off[-1])), off)

    def take(self, rows: np.ndarray) -> Ragged:
        n = np.diff(self.off)[rows]
        off = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(n, out=off[1:])
        return Ragged(self.flat[np.repeat(self.off[:-1][rows] - off[:-1], n) + np.arange(off[-1])], off)


class Hashed:
    """Terms in ``n`` buckets: padded n-grams, words and word pairs, each with weight 1."""

    pairs = whole = True

    def __init__(self, n: int):
        self.n, self.weight = n, np.ones(n)

    def places(self, terms: list[str]) -> np.ndarray:
        h = np.array(digests(terms), np.uint64)
        return ((h >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def pair_places(self, terms: list[str]) -> np.ndarray:
        md5 = hashlib.md5
        first = b"".join([md5(t.encode("utf-8", "surrogatepass")).digest()[:4] for t in terms])
        return np.frombuffer(first, ">u4").astype(np.int64) % self.n

    def word_terms(self, word: str) -> list[str]:
        return [*grams(word), "w:" + word]


class Weighted:
    """Padded n-grams that stand in a table of (digest, df); the others have no place and no weight."""

    pairs = whole = False

    def __init__(self, path: str, n_docs: int):
        t = read(path).read().combine_chunks()
        h, df = t["h"].to_numpy().view(np.uint64), t["df"].to_numpy()
        by = np.argsort(h)
        self.h, self.n = h[by], len(h) + 1
        self.weight = np.append(np.log((1.0 + n_docs) / (1.0 + df[by])) + 1, 0.0)  # the last place is that of no term

    def places(self, terms: list[str]) -> np.ndarray:
        h = np.array(digests(terms), np.uint64)
        at = np.searchsorted(self.h, h)
        return np.where((at < self.n - 1) & (np.append(self.h, np.uint64(0))[at] == h), at, self.n - 1)

    def word_terms(self, word: str) -> list[str]:
        return grams(word)


class Numbered:
    """Padded n-grams by number as they come."""

    pairs = False

    def __init__(self):
        self.place: dict[int, int] = {}

    def places(self, terms: list[str]) -> np.ndarray:
        return np.fromiter((self.place.setdefault(h, len(self.place)) for h in digests(terms)), np.int64, len(terms))

    def word_terms(self, word: str) -> list[str]:
        return grams(word)


class Folder:
    """A written table as the workers read it."""

    def __init__(self, path: str):
        import pyarrow.dataset as ds
        from pyarrow import fs

        where, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        files = sorted(f.path for f in where.get_file_info(fs.FileSelector(inside)) if f.path.endswith(".parquet"))
        self.data = ds.dataset(files, filesystem=where, format="parquet")

    def read(self) -> pa.Table:
        return self.data.to_table()

    def batches(self, n: int) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in self.data.to_batches(batch_size=n, batch_readahead=1, fragment_readahead=1):
            while b.num_rows:
                part, b = b.slice(0, n - size), b.slice(n - size)
                held.append(part)
                size += part.num_rows
                if size == n:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def read(path: str) -> Folder:
    # Spark writes file:/x for file:///x in places
    return Folder("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


class Texts:
    """A batch of texts: its distinct words, their terms' places, and for each text its words with their numbers."""

    def __init__(self, words: pa.ListArray, space: Hashed | Weighted | Numbered):
        n = len(words)
        off = np.zeros(n + 1, np.int64)
        lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        np.cumsum(lengths, out=off[1:])
        enc = words.flatten().dictionary_encode()
        ids = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words: list[str] = enc.dictionary.to_pylist()
        lists = [space.word_terms(w) for w in self.words]
        self.terms = Ragged(space.places([t for x in lists for t in x]), np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))))
        doc, v = np.repeat(np.arange(n), lengths), max(len(self.words), 1)
        keys, count = np.unique(doc * v + ids, return_counts=True)
        self.item, self.count = keys % v, count.astype(np.float64)
        self.off = np.searchsorted(keys, np.arange(n + 1) * v)
        self.pair, self.pair_of, self.pair_place = Ragged(np.zeros(0, np.int64), np.zeros(n + 1, np.int64)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if space.pairs and len(ids) > 1:
            inside = doc[1:] == doc[:-1]
            both, back = np.unique(ids[:-1][inside] * v + ids[1:][inside], return_inverse=True)
            w = self.words
            place = space.pair_places([f"w:{w[a]} {w[b]}" for a, b in zip((both // v).tolist(), (both % v).tolist())])
            self.pair_of, self.pair_place = back, place
            self.pair = Ragged(place[back], np.concatenate(([0], np.cumsum(np.bincount(doc[1:][inside], minlength=n)))))
        self.doc_terms = lambda i: np.concatenate((self.terms.take(ids[off[i] : off[i + 1]]).flat, self.pair.flat[self.pair.off[i] : self.pair.off[i + 1]]))
        self.n = n
        self._laid: dict[type, tuple] = {}

    def laid(self, kind: type) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
        """Texts of like words as (texts, columns, counts), a column being a word or, behind the words, a pair that many of
        them have; and text, column and count of all else, by text."""
        if kind not in self._laid:
            doc = np.concatenate((np.repeat(np.arange(self.n), np.diff(self.off)), np.repeat(np.arange(self.n), np.diff(self.pair.off))))
            column, count = np.concatenate((self.item, len(self.words) + self.pair_of)), np.concatenate((self.count, np.ones(len(self.pair_of))))
            by = np.argsort(doc, kind="stable")
            doc, column, count = doc[by], column[by], count[by]
            off, groups = np.searchsorted(doc, np.arange(self.n + 1)), self.alike()
            dense, cold, n = [], np.ones(len(doc), bool), len(self.words) + len(self.pair_place)
            place = np.empty(n, np.int64)
            for g in np.unique(groups).tolist():
                rows = np.flatnonzero(groups == g)
                at = Ragged(np.arange(len(doc)), off).take(rows)
                df = np.bincount(column[at.flat], minlength=n)
                hot = np.flatnonzero(df > max(len(rows) // 50, 1))
                hot = np.sort(hot[np.argsort(-df[hot], kind="stable")[:HOT]])
                if not len(hot):
                    continue
                place[:] = -1
                place[hot] = np.arange(len(hot))
                h = place[column[at.flat]]
                row, at = np.repeat(np.arange(len(rows)), np.diff(at.off))[h >= 0], at.flat[h >= 0]
                dense.append((rows, hot, np.bincount(row * len(hot) + h[h >= 0], count[at], len(rows) * len(hot)).reshape(len(rows), -1).astype(kind)))
                cold[at] = False
            self._laid = {kind: (dense, doc[cold], column[cold], count[cold].astype(kind))}
        return self._laid[kind]

    def alike(self) -> np.ndarray:
        """A group of each text by the words that most texts have (a few rounds of k-means)."""
        top = np.argsort(-np.bincount(self.item, minlength=1), kind="stable")[:SIGNS]
        place = np.full(max(len(self.words), 1), -1)
        place[top] = np.arange(len(top))
        h = place[self.item]
        x = np.zeros((self.n, len(top)), np.float32)
        x[np.repeat(np.arange(self.n), np.diff(self.off))[h >= 0], h[h >= 0]] = 1
        x /= np.maximum(np.sqrt(x.sum(1)), 1)[:, None]
        centre = x[np.linspace(0, self.n - 1, min(GROUPS, self.n)).astype(np.int64)]
        for _ in range(4):
            group = (x @ centre.T).argmax(1) if self.n else np.zeros(0, np.int64)
            centre = np.eye(len(centre), dtype=np.float32)[group].T @ x
            centre /= np.maximum(np.sqrt((centre * centre).sum(1)), 1e-9)[:, None]
        return group

    def vectors(self, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Of each text: places in order, weighted counts, and length."""
        for i in range(self.n):
            t = self.doc_terms(i).astype(np.int32)
            t.sort()
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else t
            at = t[first]
            w = np.diff(np.append(first, len(t))) * weight[at]
            yield at, w, math.sqrt(float(w @ w))


def encoded(b: pa.RecordBatch, space: Hashed | Weighted) -> pa.RecordBatch:
    """Key, author, and in the words' stead the places that have a weight, as steps from one to the next, with their terms'
    counts."""
    steps, counts = [], []
    for at, n, _ in Texts(b.column(2), space).vectors(np.ones(space.n)):
        keep = space.weight[at] > 0
        steps.append(np.diff(at[keep], prepend=0))
        counts.append(n[keep].astype(np.int32))
    off = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in steps]))), pa.int32())
    lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate([np.zeros(0, np.int32), *x]), pa.int32())) for x in (steps, counts)]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["key", "author", "steps", "counts"])


class Queries:
    """Vectors of a block of queries from their words, or as ``encoded``: counts if these are all weights there are, else of
    unit length and weighted once more for the other side."""

    def __init__(self, b: pa.RecordBatch, space: Hashed | Weighted):
        b = encoded(b, space) if b.num_columns == 3 else b
        self.ids, self.authors = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
        n, nq = b.column(2).value_lengths().to_numpy(zero_copy_only=False), b.num_rows
        step, count = (b.column(i).flatten().to_numpy() for i in (2, 3))
        total = np.concatenate(([0], np.cumsum(step, dtype=np.int64)))
        place = total[1:] - np.repeat(total[np.cumsum(n) - n], n)
        self.query = np.repeat(np.arange(nq), n)
        w = count * space.weight[place]
        self.norm = np.sqrt(np.bincount(self.query, w * w, minlength=nq))
        self.norm[self.norm == 0] = 1
        self.whole = space.whole
        self.value = w if self.whole else w * space.weight[place] / self.norm[self.query]
        self.known, self.row = np.unique(place, return_inverse=True)  # the places that a query of the block has
        self.at_id = {k: i for i, k in enumerate(self.ids.tolist())}
        self.of_author: dict[str, list[int]] = {}
        for i, a in enumerate(self.authors):
            if a is not None:
                self.of_author.setdefault(a, []).append(i)


def sums(table: np.ndarray, rows: Ragged, out: np.ndarray, most: float = math.inf, count: np.ndarray | None = None) -> None:
    """out[i] += the sum of the table's rows of list i, each times its count if there are counts. Lists of about one length go
    together, a place of all of them at a time. most: the table's largest number; sums that whole numbers of the table's
    kind hold are added up in it."""
    n = np.diff(rows.off)
    by = np.argsort(-n, kind="stable")
    by = by[n[by] > 0]
    few, held = 256, np.empty((256, table.shape[1]), table.dtype)
    long = int(np.searchsorted(-n[by], -2 * few, "right"))
    for i in by[:long].tolist():
        for lo in range(rows.off[i], rows.off[i + 1], few):
            at = slice(lo, min(lo + few, rows.off[i + 1]))
            got = np.take(table, rows.flat[at], 0, held[: at.stop - lo], "clip")
            out[i] += got.sum(0, dtype=out.dtype) if count is None else count[at] @ got
    for lo in range(long, len(by), few):
        w = by[lo : lo + few]
        off, length = rows.off[w], n[w]
        total = np.zeros((len(w), table.shape[1]), table.dtype if table.dtype.kind == "f" or length[0] * most < 1 << 16 else out.dtype)
        left = np.searchsorted(-length, -np.arange(length[0]), "left")  # lists longer than the place
        for j, m in enumerate(left.tolist()):
            at = off[:m] + j
            got = np.take(table, rows.flat[at], 0, held[:m], "clip")
            if count is not None and (c := count[at]).max() > 1:
                got *= c[:, None]
            total[:m] += got
        out[w] += total


def products(t: Texts, q: Queries, n_places: int, longest: float = math.inf) -> np.ndarray:
    """texts x queries, without the texts' lengths. Whole numbers are added up in single precision where no sum, which is
    at most the product of the lengths (``longest``: of the texts), can be more than it holds."""
    nq, n_words = len(q.ids), len(t.words)
    kind = np.float32 if q.whole and longest * q.norm.max(initial=0) < EXACT else np.float64
    both = np.empty((n_words + len(q.known) + 1, nq), kind)
    m, table = both[:n_words], both[n_words:]  # of words, of places; the last row is that of places no query has
    both[:] = 0
    table[q.row, q.query] = q.value
    to_row = np.full(n_places, len(q.known), np.int64)
    to_row[q.known] = np.arange(len(q.known))
    out = np.zeros((t.n, nq), kind)
    rows = to_row[t.terms.flat]
    there = rows < len(q.known)
    left = np.concatenate(([0], np.cumsum(there)))[t.terms.off]
    most = q.value.max(initial=0)
    sums(table.astype(np.uint16) if q.whole and most < 1 << 16 else table, Ragged(rows[there], left), m, most)
    dense, doc, column, count = t.laid(kind)
    at = np.concatenate((np.arange(n_words), n_words + to_row[t.pair_place]))  # of the columns in ``both``
    for texts, columns, counts in dense:
        out[texts] = counts @ both[at[columns]]
    used = np.concatenate((np.diff(left) > 0, to_row[t.pair_place] < len(q.known)))[column]
    item, count = at[column[used]], count[used]
    sums(both, Ragged(item, np.searchsorted(doc[used], np.arange(t.n + 1))), out, count=count)
    return out / q.norm if q.whole else out


_spaces: dict[object, object] = {}


def _kept(key: object, make: Callable):
    """One value of its kind stays in the worker."""
    if key not in _spaces:
        for k in [k for k in _spaces if k[0] == key[0]]:
            del _spaces[k]
        _spaces[key] = make()
    return _spaces[key]


def _space(space_key: tuple) -> Hashed | Weighted:
    return _kept(space_key, lambda: Hashed(*space_key[1:]) if space_key[0] == "hashed" else Weighted(*space_key[1:]))


def _written(queries: DataFrame, space_key: tuple) -> str:
    """The queries' vectors as a table, worked out once; every batch of texts reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches, 2):
            yield encoded(b, _space(space_key))

    key, author = (queries.schema[i].dataType.simpleString() for i in (0, 1))
    return stash(queries.mapInArrow(run, f"key {key}, author {author}, steps array<int>, counts array<int>"), "queries")._stash


def _cut(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows and about TOKENS tokens, from small batches joined and large ones cut."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for b in batches:
        n = b.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        lo = 0
        for i, k in enumerate(n.tolist()):
            if rows and (size + k > TOKENS or rows >= ROWS):
                held.append(b.slice(lo, i - lo))
                yield whole()
                held, lo, rows, size = [], i, 0, 0
            rows += 1
            size += k
        if b.num_rows > lo:
            held.append(b.slice(lo))
    if rows:
        yield whole()


def _scored(batches: Iterator[pa.RecordBatch], path: str, space_key: tuple) -> Iterator[tuple[np.ndarray, pa.RecordBatch, int, Queries, np.ndarray]]:
    """For each batch of texts and block of queries: the scores as whole numbers of 1 / SCALE (-1: no common term)."""
    space = _space(space_key)
    for b in _cut(batches, 2):
        t = Texts(b.column(2), space)
        norm = np.fromiter((n for _, _, n in t.vectors(space.weight)), np.float64, t.n)
        norm[norm == 0] = 1
        longest = norm.max(initial=0)
        ids = b.column(0).to_numpy(zero_copy_only=False)
        first = 0
        for b_q in read(path).batches(BLOCK):
            q = Queries(b_q, space)
            s = products(t, q, space.n, longest)
            s /= norm[:, None]
            none = s == 0
            s *= SCALE
            s += 0.5
            k = s.astype(np.int32)
            k[none] = -1
            yield ids, b, first, q, k
            first += len(q.ids)
        del t


def _own(ids: np.ndarray, q: Queries) -> tuple[list[int], list[int]]:
    """Places of the pairs of a document with itself."""
    own = [(i, q.at_id[d]) for i, d in enumerate(ids.tolist()) if d in q.at_id]
    return [i for i, _ in own], [j for _, j in own]


def best(rows: DataFrame, queries: DataFrame, space_key: tuple, k: int) -> DataFrame:
    """(query_id, candidate_id, score): a superset of the ``k`` best candidates of each query by rounded score, then id;
    each task's own best. ``rows`` and ``queries`` have key, author, words."""
    ship(rows.sparkSession)
    path = _written(queries, space_key)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by block: query ids, floor of each query, and (place, score, id) of candidates
        for ids, _, first, q, s in _scored(batches, path, space_key):
            s[_own(ids, q)] = -1
            have = held.setdefault(first, [q.ids, np.zeros(len(q.ids), np.int32), None])
            floor = np.maximum(have[1], np.partition(s, len(s) - k, 0)[len(s) - k]) if len(s) > k else have[1]
            i, j = np.nonzero(s >= floor)
            new = (j, s[i, j], ids[i])
            if have[2] is not None:
                new = tuple(np.concatenate(x) for x in zip(have[2], new))
            by = np.lexsort((new[2], -new[1], new[0]))
            j = new[0][by]
            start = np.searchsorted(j, np.arange(len(q.ids)))
            rank = np.arange(len(j)) - start[j]
            have[2] = tuple(x[by][rank < k] for x in new)
            last = rank == k - 1
            have[1][j[last]] = new[1][by][last]
        for qids, _, (j, s, c) in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(qids[j]), pa.array(c), pa.array(s / SCALE)], names=["query_id", "candidate_id", "score"])

    return rows.mapInArrow(run, f"query_id {kind}, candidate_id {kind}, score double")


def packed(x: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, compressed with the bytes of each place side by side: small numbers' upper ones are all 0."""
    return zlib.compress(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def merged(parts: DataFrame, of: Callable[[int, list[list[np.ndarray]]], pa.RecordBatch], schema: str) -> DataFrame:
    """``of`` each part and the unpacked columns of all its rows. ``parts`` has part and packed columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, []
        for b in batches:
            for p, *x in zip(*(c.to_pylist() for c in b.columns)):
                if p != part and held:
                    yield of(part, held)
                    held = []
                part = p
                held.append([unpacked(y) for y in x])
        if held:
            yield of(part, held)

    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def at_scores(rows: DataFrame, queries: DataFrame, space_key: tuple) -> DataFrame:
    """(score, p, n): pairs of one author and other pairs at each rounded score, those without a common term at 0; all pairs
    of different ids that both have a text. ``rows`` and ``queries`` have key, author, words."""
    ship(rows.sparkSession)
    path = _written(queries, space_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, same = np.zeros(SCALE + 2, np.int64), np.zeros(SCALE + 2, np.int64)
        for ids, b, _, q, s in _scored(batches, path, space_key):
            np.maximum(s, 0, out=s)
            every += np.bincount(s.ravel(), minlength=SCALE + 2)
            i, j = _own(ids, q)
            np.subtract.at(every, s[i, j], 1)
            s[i, j] = -1
            hits = [(i, x) for i, a in enumerate(b.column(1).to_pylist()) if a in q.of_author for x in q.of_author[a]]
            if hits:
                i, j = np.array(hits).T
                v = s[i, j]
                np.add.at(same, v[v >= 0], 1)
        every -= same
        some = [lo for lo in range(0, SCALE + 2, SCORES) if every[lo : lo + SCORES].any() or same[lo : lo + SCORES].any()]
        sides = [pa.array([packed(x[lo : lo + SCORES]) for lo in some], pa.binary()) for x in (same, every)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *sides], names=["part", "p", "n"])

    def add(lo: int, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        p, n = (sum(x) for x in zip(*held))
        at = np.flatnonzero(p + n)
        return pa.RecordBatch.from_arrays([pa.array((lo + at) / SCALE), pa.array(p[at]), pa.array(n[at])], names=["score", "p", "n"])

    return merged(rows.mapInArrow(run, "part int, p binary, n binary"), add, "score double, p bigint, n bigint")


def document_frequencies(rows: DataFrame, least: int = 2) -> DataFrame:
    """(h, df): digest and number of documents of each padded n-gram of at least ``least`` documents. Counted in the tasks
    first, so what is shuffled is each distinct term of a task, as the step from the digest before it."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Numbered()
        place, df = space.place, np.zeros(1 << 16, np.int64)

        def out() -> pa.RecordBatch:
            h = np.fromiter(place, np.uint64, len(place))
            by = np.argsort(h)
            h, n = h[by], df[by]
            cut = np.flatnonzero(np.diff(h >> np.uint64(64 - BITS))) + 1
            some = np.split(h, cut)
            part = pa.array([int(x[0]) >> (64 - BITS) for x in some], pa.int32())
            steps = pa.array([packed(np.diff(x, prepend=np.uint64(0))) for x in some], pa.binary())
            return pa.RecordBatch.from_arrays([part, steps, pa.array([packed(x) for x in np.split(n, cut)], pa.binary())], names=["part", "h", "df"])

        for b in _cut(batches, 2):
            t = Texts(b.column(2), space)
            if len(place) > len(df):
                df = np.concatenate((df, np.zeros(len(place), np.int64)))
            ones = np.ones(len(df))
            for at, _, _ in t.vectors(ones):
                df[at] += 1
            if len(place) > TERMS:
                yield out()
                place.clear()
                df[:] = 0
        if place:
            yield out()

    def add(_: int, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        h, back = np.unique(np.concatenate([np.cumsum(x, dtype=np.int64) for x, _ in held]), return_inverse=True)
        df = np.zeros(len(h), np.int64)
        np.add.at(df, back, np.concatenate([x for _, x in held]))
        return pa.RecordBatch.from_arrays([pa.array(h[df >= least]), pa.array(df[df >= least])], names=["h", "df"])

    return merged(rows.mapInArrow(run, "part int, h binary, df binary"), add, "h bigint, df bigint")


def hashed_space(n: int) -> tuple:
    return ("hashed", n)


def tfidf_space(rows: DataFrame, n_docs: int) -> tuple:
    return ("tfidf", stash(document_frequencies(rows), "frequencies")._stash, n_docs)


# -- given pairs


def contexts(texts: list[str], size: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of each text the buckets of its substrings of ``size`` characters in order, their counts, and the substrings' number.
    Equal substrings of a slice of texts are hashed once."""
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= CHARS):
            total += len(texts[hi])
            hi += 1
        part = texts[lo:hi]
        lo = hi
        length = np.array([len(t) for t in part])
        cp = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        used = np.flatnonzero(np.bincount(cp))  # at most 1,114,112 characters there are
        if len(used) ** size >= 1 << 63:
            if len(part) > 1:
                for t in part:
                    yield from contexts([t], size, n)
                continue
            found = [part[0][p : p + size] for p in range(len(part[0]) - size + 1)]
            place = np.array([digest(x) >> 32 for x in found], np.int64) % n
        else:
            number = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
            number[used] = np.arange(len(used))
            c, last = number[cp], max(len(cp) - size + 1, 0)
            packed = np.zeros(last, np.int64)
            for x in range(size):
                packed = packed * len(used) + c[x : x + last]
            end = np.repeat(np.cumsum(length), length)[:last]
            packed = packed[np.arange(last) + size <= end]
            different, back = np.unique(packed, return_inverse=True)
            chars = np.empty((len(different), size), np.uint32)
            for x in range(size - 1, -1, -1):
                different, at = np.divmod(different, max(len(used), 1))
                chars[:, x] = used[at]
            whole = chars.tobytes().decode("utf-32-le", "surrogatepass")
            md5 = hashlib.md5
            first = b"".join([md5(whole[x : x + size].encode("utf-8", "surrogatepass")).digest()[:4] for x in range(0, len(whole), size)])
            place = (np.frombuffer(first, ">u4").astype(np.int64) % n)[back]
        off = np.concatenate(([0], np.cumsum(np.maximum(length - size + 1, 0))))
        for i in range(len(part)):
            own = place[off[i] : off[i + 1]]
            count = np.bincount(own, minlength=n)
            at = np.flatnonzero(count)
            yield at, count[at], len(own)


def entropies(pairs: DataFrame, order: int, n: int, alpha: float) -> DataFrame:
    """(query_id, candidate_id, forward, backward, mean_entropy, gap) of pairs with query_text and candidate_text: smoothed
    cross entropy of each text under the other's counts of (order + 1)-grams in ``n`` buckets. A text too short for
    one, or null, has a total of 1, as in the smoothing."""
    ship(pairs.sparkSession)
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("query_id", "candidate_id")]

    def some(b: pa.RecordBatch) -> pa.RecordBatch:
        sides = [b.column(2).dictionary_encode(), b.column(3).dictionary_encode()]
        have = [list(contexts(x.dictionary.to_pylist(), order + 1, n)) for x in sides]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
        most = max((int(c.max()) for h in have for _, c, _ in h if len(c)), default=0)
        gain = np.log(np.arange(most + 1) + alpha) - math.log(alpha)
        of = np.zeros(n, np.int64)
        f, g, nq, nc = (np.zeros(b.num_rows) for _ in range(4))
        for i, (x, y) in enumerate(zip(*[s.indices.to_pylist() for s in sides])):
            (qa, qn, qt), (ca, cn, ct) = none if x is None else have[0][x], none if y is None else have[1][y]
            nq[i], nc[i] = max(qt, 1), max(ct, 1)
            of[ca] = cn
            met = of[qa]
            of[ca] = 0
            f[i] = qn @ gain[met]
            g[i] = met @ gain[qn]
        base = lambda total: math.log(alpha) - np.log(total + alpha * n)
        fw, bw = -(base(nc) + f / nq), -(base(nq) + g / nc)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (fw, bw, (fw + bw) / 2, np.abs(fw - bw)))], names=["query_id", "candidate_id", "forward", "backward", "mean_entropy", "gap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([sum(len(t or "") for t in x) for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())])
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(size[lo:]), CHARS, "right")))
                yield some(b.slice(lo, hi - lo))
                lo = hi

    cols = pairs.select("query_id", "candidate_id", "query_text", "candidate_text")
    return cols.mapInArrow(run, f"query_id {kinds[0]}, candidate_id {kinds[1]}, forward double, backward double, mean_entropy double, gap double")
