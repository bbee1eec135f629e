"""Problem 7: language of each document and of each passage, by nearest centroids of TF-IDF n-gram vectors.

A text's vector is the sum of its words' vectors; a word's vector holds its character n-grams (1 to 3, with word ends),
weighted by inverse document frequency and hashed with signs into DIM places. Each language has several centroids,
clustered from labelled documents; a sentence belongs to the language of the centroid of greatest cosine and to none
when even that is under REJECT. The products are sums over words, so a task multiplies each distinct word once. Neighbouring sentences of a language form a passage; stretches too short to be a
passage go to their longer neighbour.

The centroids are fitted on at most SAMPLE labelled documents of a language, chosen by hash over all rows; labelled
documents that lie nearer to another language's mean are taken as mislabelled and left out before clustering.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ship
from . import textkit as T
from .labels import CODES, language_code

DIM, TABLE = 8192, 1 << 18
SKETCH, WORDS = 32, 200_000
SAMPLE, SAMPLE_CHARS, CENTROIDS, REJECT = 300, 20_000, 3, 0.15
MIN_LETTERS, PASSAGE_WORDS, PASSAGE_CHARS = 40, 12, 24
#: Sentence-ending marks after which a sentence may be in another language.
_ENDS = np.array([ord(c) for c in ".!?…。！？؟।۔\n\r\x0b\x0c\x85  "], np.uint32)
_MISSING = ["", "unknown", "und"]


def _end_table() -> np.ndarray:
    t = np.zeros(0x110000, bool)
    t[_ENDS] = True
    return t


_END = None


@dataclass
class Model:
    """idf: weight of each n-gram slot; centroids: unit rows; langs: language number of each row."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: np.ndarray


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.int64)


@dataclass
class Words:
    """The words of a batch: sentence and hash of each; its letters are ``letters[first : first + length]``."""

    sentence: np.ndarray
    hash: np.ndarray
    letters: np.ndarray
    first: np.ndarray
    length: np.ndarray


def words(cp: np.ndarray, sentence: np.ndarray) -> Words:
    """Letters and marks form words, a CJK character is a word by itself. ``cp`` is lower-cased text."""
    k = T.kinds()[np.minimum(cp, 0x10FFFF)]
    letter = ((k & T.KEPT) != 0) & ((k & T.DIGIT) == 0)
    cjk = letter & ((k & T.CJK) != 0)
    prev = np.concatenate(([False], letter[:-1]))
    prev_cjk = np.concatenate(([False], cjk[:-1]))
    new = np.concatenate(([True], sentence[1:] != sentence[:-1])) if len(cp) else letter
    start = letter & (~prev | cjk | prev_cjk | new)
    at = np.flatnonzero(letter)
    if not len(at):
        z = np.zeros(0, np.int64)
        return Words(z, np.zeros(0, np.uint64), np.zeros(0, np.uint64), z, z)
    c = cp[at].astype(np.uint64)
    first = np.flatnonzero(start[at])
    length = np.diff(np.concatenate((first, [len(c)])))
    place = np.arange(len(c)) - np.repeat(first, length)
    h = np.add.reduceat(T.mix(c * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), first)
    return Words(sentence[at[first]], h, c, first, length)


def word_grams(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``which``, hash) of the n-grams of the words numbered ``which``, each word between two zeros; the places
    ascend."""
    f, n = w.first[which], w.length[which]
    size = n + 2
    base = np.concatenate(([0], np.cumsum(size)))
    flat = np.zeros(base[-1], np.uint64)
    inner = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
    flat[np.repeat(base[:-1] + 1, n) + inner] = w.letters[np.repeat(f, n) + inner]
    owner = np.repeat(np.arange(len(n)), size)
    left = np.repeat(base[1:], size) - np.arange(len(flat))
    hashes, owners = [], []
    for g in (1, 2, 3):
        x = np.full(len(flat) - g + 1, g, np.uint64) if len(flat) >= g else np.zeros(0, np.uint64)
        for j in range(g):
            x = x * np.uint64(0x9E3779B97F4A7C15) + flat[j : len(flat) - g + 1 + j]
        ok = left[: len(x)] >= g
        if g == 1:
            ok &= flat[: len(x)] > 0x2000  # single characters tell only non-alphabetic scripts apart
        hashes.append(T.mix(x[ok]))
        owners.append(owner[: len(x)][ok])
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return o[order], h[order]


def _places(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place among DIM and signed weight of each n-gram."""
    return (h & np.uint64(DIM - 1)).astype(np.int64), np.where((h >> np.uint64(20)) & np.uint64(1), 1.0, -1.0) * idf[_slots(h)]


def _sums(table: np.ndarray, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, columns): for each owner, in ascending order, the sum of its rows of the table."""
    out = np.zeros((n, table.shape[1]), np.float32)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else owner
    for lo in range(0, len(first), 512):
        hi = min(lo + 512, len(first))
        a, b = first[lo], first[hi] if hi < len(first) else len(owner)
        out[owner[first[lo:hi]]] = np.add.reduceat(table[rows[a:b]], first[lo:hi] - a, axis=0)
    return out


def vectors(w: Words, n: int, idf: np.ndarray) -> np.ndarray:
    """(n, DIM) unit vectors of sentences 0..n-1; the sentences of the words ascend."""
    out = np.zeros((n, DIM), np.float32)
    for lo in range(0, n, 256):
        hi = min(lo + 256, n)
        a, b = np.searchsorted(w.sentence, (lo, hi))
        _, one, which = np.unique(w.hash[a:b], return_index=True, return_inverse=True)
        if not len(one):
            continue
        owner, h = word_grams(w, one + a)
        place, weight = _places(h, idf)
        begin = np.searchsorted(owner, np.arange(len(one) + 1))
        pair, count = np.unique((w.sentence[a:b] - lo) * len(one) + which, return_counts=True)
        at, word = _spread(begin, pair % len(one))
        out[lo:hi] = np.bincount((pair // len(one))[at] * DIM + place[word], count[at] * weight[word], minlength=(hi - lo) * DIM).reshape(-1, DIM)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def _spread(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges begin[k] : begin[k + 1] of the k in ``which``: the place in ``which`` and the member, for each member."""
    size = begin[which + 1] - begin[which]
    at = np.repeat(np.arange(len(which)), size)
    return at, np.arange(size.sum()) + np.repeat(begin[which] - np.concatenate(([0], np.cumsum(size)))[:-1], size)


class Lexicon:
    """Cosines of sentences with the centroids. Products are sums over words, so each distinct word is multiplied once:
    its row holds its products with the centroids and with SKETCH random signs, whose sums give the length of the
    sentence's vector within about an eighth. Where the cosine comes out under twice REJECT the vector itself is made,
    so that the rejection is exact. Rows are kept from batch to batch; past WORDS of them the table starts anew."""

    def __init__(self, model: Model):
        self.model = model
        signs = np.where(np.random.default_rng(7).random((DIM, SKETCH)) < 0.5, 1.0, -1.0) / np.sqrt(SKETCH)
        self.basis = np.concatenate([model.centroids.T, signs], 1).astype(np.float32)
        self.known: dict[int, int] = {}
        self.table = np.zeros((0, self.basis.shape[1]), np.float32)

    def rows(self, w: Words) -> np.ndarray:
        """The table row of each word."""
        unique, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
        keys = unique.tolist()
        if len(self.known) > WORDS:
            self.known = {}
        at = np.array([self.known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            owner, h = word_grams(w, one[new])
            place, weight = _places(h, self.model.idf)
            made = np.zeros((len(new), self.basis.shape[1]), np.float32)
            for lo in range(0, len(new), 2000):
                a, b = np.searchsorted(owner, (lo, lo + 2000))
                if b > a:
                    first = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
                    made[owner[a:b][first]] = np.add.reduceat(self.basis[place[a:b]] * weight[a:b, None].astype(np.float32), first, axis=0)
            start = len(self.known)
            at[new] = start + np.arange(len(new))
            if start + len(new) > len(self.table):
                grown = np.zeros((2 * (start + len(new)), self.table.shape[1]), np.float32)
                grown[:start] = self.table[:start]
                self.table = grown
            self.table[start : start + len(new)] = made
            self.known.update(zip(unique[new].tolist(), range(start, start + len(new))))
        return at[which]

    def cosines(self, w: Words, n: int) -> np.ndarray:
        """(n, centroids) cosines of sentences 0..n-1."""
        c = len(self.model.langs)
        rows = self.rows(w)
        sums = _sums(self.table, rows, w.sentence, n)
        out = sums[:, :c] / np.maximum(np.sqrt((sums[:, c:] ** 2).sum(1, keepdims=True)), 1e-9)
        near = out.max(1, initial=-1) < 2 * REJECT
        mine = near[w.sentence]
        if mine.any():
            number = np.cumsum(near) - 1
            part = Words(number[w.sentence[mine]], w.hash[mine], w.letters, w.first[mine], w.length[mine])
            out[near] = vectors(part, int(near.sum()), self.model.idf) @ self.model.centroids.T
        return np.minimum(out, 1.0)


def fit(texts: list[str], labels: list[str]) -> Model:
    """Centroids of labelled texts. Deterministic: seeded by the order of the rows."""
    numbers = np.array([CODES.index(x) for x in labels], np.int64)
    cp, off = T.codepoints([t.lower() for t in texts])
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    w = words(cp, doc)
    n = max(len(texts), 1)
    # document frequency of each n-gram slot, by way of the distinct words of each document
    _, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
    owner, h = word_grams(w, one)
    slot, begin = _slots(h), np.searchsorted(owner, np.arange(len(one) + 1))
    pairs = np.unique(w.sentence * len(one) + which) if len(one) else which
    df = np.zeros(TABLE)
    for lo in np.flatnonzero(np.diff(pairs // max(len(one), 1), prepend=-1)).tolist():
        d = pairs[lo] // len(one)
        _, member = _spread(begin, pairs[lo : np.searchsorted(pairs, (d + 1) * len(one))] % len(one))
        df[np.unique(slot[member])] += 1
    idf = np.log((1 + n) / (1 + df)) + 0.1
    v = vectors(w, len(texts), idf)
    keep = np.ones(len(texts), bool)
    present = np.unique(numbers)
    for _ in range(3):
        means = np.stack([v[(numbers == k) & keep].mean(0) if ((numbers == k) & keep).any() else v[numbers == k].mean(0) for k in present]) if len(present) else np.zeros((0, DIM), np.float32)
        means /= np.maximum(np.sqrt((means * means).sum(1, keepdims=True)), 1e-9)
        keep = present[np.argmax(v @ means.T, 1)] == numbers if len(present) else keep
    rows, langs = [], []
    for k in present:
        x = v[(numbers == k) & keep]
        if not len(x):
            continue
        c = x[np.linspace(0, len(x) - 1, min(CENTROIDS, len(x))).astype(int)]
        for _ in range(10):
            own = np.argmax(x @ c.T, 1)
            c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-9)
        rows.append(c)
        langs += [k] * len(c)
    return Model(idf.astype(np.float32), np.concatenate(rows) if rows else np.zeros((0, DIM), np.float32), np.array(langs, np.int64))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each label, by smallest hash, of 80 to SAMPLE_CHARS characters, whole.
    Bounded: languages x sample x SAMPLE_CHARS characters reach the driver."""
    code = language_code(F.col("lang"))
    ids = docs.select(F.col("doc_id").cast("string"), code.alias("code"), F.xxhash64("doc_id").alias("u"), F.length("text").alias("n")).where(F.col("code").isNotNull() & F.col("n").between(80, SAMPLE_CHARS))
    rank = F.row_number().over(W.partitionBy("code").orderBy("u", "doc_id"))
    chosen = F.broadcast(ids.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "code"))
    rows = docs.select(F.col("doc_id").cast("string"), "text").join(chosen, "doc_id").collect()
    rows.sort(key=lambda r: (r.code, r.doc_id))
    return fit([r.text for r in rows], [r.code for r in rows])


def _sentences(texts: list[str]):
    """Lower-cased code points, document and sentence number of each, and per sentence: document, first character,
    words (runs without white space that hold a letter or digit) and kept characters."""
    global _END
    if _END is None:
        _END = _end_table()
    low = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower()[:1] for c in t) for t in texts]
    cp, off = T.codepoints(low)
    capped = np.minimum(cp, 0x10FFFF)
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    end = _END[capped]
    k = T.kinds()[capped]
    # an end counts if no end follows directly, and a full stop only before white space, or if the mark is CJK
    follow = np.concatenate((end[1:], [True]))
    blank = np.concatenate(((k[1:] & T.SPACE) != 0, [True]))
    stops = end & ~follow & (blank | (cp > 0x2FFF) | ((k & T.SPACE) != 0))
    new = np.concatenate(([True], stops[:-1] | (doc[1:] != doc[:-1]))) if len(cp) else stops
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    n = len(first)
    kept = (k & T.KEPT) != 0
    run = (k & T.SPACE) == 0
    run_new = run & (~np.concatenate(([False], run[:-1])) | new)
    token = np.cumsum(run_new) - 1
    has = np.zeros(token[-1] + 1 if len(token) else 0, bool)
    has[token[kept]] = True
    n_words = np.bincount(sentence[run_new], has.astype(float), minlength=n).astype(int) if n else np.zeros(0, int)
    n_chars = np.bincount(sentence[kept], minlength=n)
    letters = np.bincount(doc[(k & T.LETTER) != 0], minlength=len(texts))
    return cp, sentence, doc[first], first - off[doc[first]], n_words, n_chars, letters


def _merge(runs: list[list]) -> list[list]:
    """Join neighbours of one language; stretches too short for a passage go to the longer neighbour, the shortest
    first, the later of equals to the earlier neighbour. A run is [language, first, words, chars, score sums]."""
    while True:
        out: list[list] = []
        for r in runs:
            if out and out[-1][0] == r[0]:
                out[-1] = [r[0], out[-1][1], out[-1][2] + r[2], out[-1][3] + r[3], out[-1][4] + r[4]]
            else:
                out.append(list(r))
        weak = [i for i, r in enumerate(out) if r[0] < 0 or not is_passage(r[0], r[2], r[3])]
        if len(out) == 1 or not weak:
            return out
        i = min(weak, key=lambda i: (out[i][3], i))
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(out)]
        j = max(near, key=lambda j: (out[j][0] >= 0, out[j][3], -j))
        out[i][0] = out[j][0]
        runs = out


def is_passage(lang: int, n_words: int, n_chars: int) -> bool:
    return n_chars >= PASSAGE_CHARS if CODES[lang] in ("zh", "ja") else n_words >= PASSAGE_WORDS


def _hides(lang: np.ndarray, sure: np.ndarray, n_words: np.ndarray, n_chars: np.ndarray) -> bool:
    """Whether the short sentences of one other language between two sure sentences are enough for a passage."""
    main, stretch = int(lang[sure][0]), np.cumsum(sure)
    other = (lang >= 0) & (lang != main)
    for k in np.unique(lang[other]):
        mine = other & (lang == k)
        if any(is_passage(int(k), w, c) for w, c in zip(np.bincount(stretch[mine], n_words[mine]), np.bincount(stretch[mine], n_chars[mine]))):
            return True
    return False


def passages(texts: list[str], lexicon: Lexicon) -> tuple[list[tuple], np.ndarray]:
    """(text number, passage number, first character, language number or -1, confidence, words, characters) of every
    passage, and the number of letters of each text."""
    cp, sentence, doc, first, n_words, n_chars, letters = _sentences(texts)
    n, model = len(doc), lexicon.model
    if not n or not len(model.langs):
        return [], letters
    cos = lexicon.cosines(words(cp, sentence), n)
    score = np.full((n, len(CODES)), -1.0, np.float32)
    for k in np.unique(model.langs):
        score[:, k] = cos[:, model.langs == k].max(1)
    best = score.argmax(1)
    top = score[np.arange(n), best]
    lang = np.where((top >= REJECT) & (n_chars > 0), best, -1)
    weak = (lang >= 0) & (n_words < 4) & (n_chars < PASSAGE_CHARS // 2)
    mass = np.sqrt(np.maximum(n_chars, 1)).astype(np.float32)[:, None] * np.maximum(score, 0)
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    bounds = np.concatenate((starts, [n]))
    # documents whose sentences name one language are one passage, unless the rejected stretches may outweigh it
    low, high = np.minimum.reduceat(np.where(lang < 0, len(CODES), lang), starts), np.maximum.reduceat(lang, starts)
    plain = (low >= high) & ((high < 0) | np.logical_or.reduceat((lang >= 0) & ~weak, starts) | (np.minimum.reduceat(lang, starts) >= 0))
    all_words, all_chars, all_mass = (np.add.reduceat(x, starts, axis=0) for x in (n_words, n_chars, mass))
    share = np.exp(12 * all_mass / np.maximum(all_mass.max(1, keepdims=True), 1e-9))
    share /= share.sum(1, keepdims=True)
    rows: list[tuple] = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if plain[i]:
            rows.append((int(doc[a]), 0, int(first[a]), int(high[i]), float(share[i, high[i]]) if high[i] >= 0 else 0.0, int(all_words[i]), int(all_chars[i])))
            continue
        used = lang[a:b]
        certain = (used >= 0) & ~weak[a:b]
        sure = used[certain]
        if len(sure) and (sure == sure[0]).all() and not _hides(used, certain, n_words[a:b], n_chars[a:b]):
            runs = [[int(sure[0]), int(first[a]), int(all_words[i]), int(all_chars[i]), all_mass[i]]]
        else:
            runs = _merge([[int(lang[k]), int(first[k]), int(n_words[k]), int(n_chars[k]), mass[k]] for k in range(a, b)])
        for no, (code, at, words_, chars, sums) in enumerate(runs):
            e = np.exp(12 * sums / max(float(sums.max()), 1e-9))
            rows.append((int(doc[a]), no, at, code, float(e[code] / e.sum()) if code >= 0 else 0.0, words_, chars))
    return rows, letters


_SCHEMA = "doc_id string, code string, missing boolean, n_letters int, passage_no int, first_char int, lang string, confidence double, n_words int, n_chars int, is_passage boolean"


def _label(model: Model):
    fields = [("doc_id", pa.string()), ("code", pa.string()), ("missing", pa.bool_()), ("n_letters", pa.int32()), ("passage_no", pa.int32()), ("first_char", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int32()), ("n_chars", pa.int32()), ("is_passage", pa.bool_())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model)
        for b in batches:
            texts = b.column(3).to_pylist()
            for lo, hi in T.slices(texts):
                rows, letters = passages(texts[lo:hi], lexicon)
                at = np.array([r[0] for r in rows], np.int64)
                where = pa.array(at + lo)
                ok = [r[3] >= 0 and is_passage(r[3], r[5], r[6]) for r in rows]
                cols = [b.column(0).take(where), b.column(1).take(where), b.column(2).take(where), pa.array(letters[at], pa.int32())]
                cols += [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([CODES[r[3]] if r[3] >= 0 else None for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.float64())]
                cols += [pa.array([r[5] for r in rows], pa.int32()), pa.array([r[6] for r in rows], pa.int32()), pa.array(ok, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def segments(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every passage of every document with a text: its place, language (null if rejected) and confidence, with the
    document's own label (code; missing if null, blank, a placeholder or no language known here).

    Null and empty texts have no row. A text without letters is one segment without language.
    """
    ship(docs.sparkSession)
    model = model or train(docs)
    code = language_code(F.col("lang"))
    rows = docs.select(F.col("doc_id").cast("string"), code.alias("code"), code.isNull().alias("missing"), "text").where("text is not null and text <> ''")
    return rows.mapInArrow(_label(model), _SCHEMA)


def documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, label, lang, confidence, n_languages, verdict): the language of most characters, and whether the label
    is right, wrong, missing or one of several (mixed)."""
    s = segments(docs, model)
    by = s.groupBy("doc_id", "code", "lang").agg(F.sum("n_chars").alias("n"), F.sum(F.col("confidence") * F.col("n_chars")).alias("c"), F.max("is_passage").alias("p"))
    one = by.groupBy("doc_id", "code").agg(F.max_by(F.struct("lang", (F.col("c") / F.greatest("n", F.lit(1))).alias("confidence")), F.struct("n", "lang")).alias("top"), F.sum(F.col("p").cast("int")).alias("n_languages"), F.max(F.coalesce(F.col("lang") == F.col("code"), F.lit(False))).alias("there"))
    verdict = F.when(F.col("n_languages") > 1, "mixed").when(F.col("code").isNull(), "missing").when(F.col("there"), "right").otherwise("wrong")
    return one.select("doc_id", F.col("code").alias("label"), "top.lang", "top.confidence", "n_languages", verdict.alias("verdict"))


def mislabelled(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang): documents of at least MIN_LETTERS letters whose label is missing or names no language of the
    text, or that have passages in several languages; a row for each language with a passage."""
    s = segments(docs, model).where(F.col("n_letters") >= MIN_LETTERS)
    by = s.groupBy("doc_id").agg(F.max("missing").alias("missing"), F.max(F.coalesce(F.col("lang") == F.col("code"), F.lit(False))).alias("there"), F.collect_set(F.when(F.col("is_passage"), F.col("lang"))).alias("langs"))
    odd = by.where(F.col("missing") | ~F.col("there") | (F.size("langs") > 1))
    return odd.select("doc_id", F.explode("langs").alias("lang"))
