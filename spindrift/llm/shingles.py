"""Weighted shingles: runs of five words, weighted by how often a text has them and by how rare their words are.

A shingle's weight is its number of places times the mean IDF of its words. IDF: 1 + ln((N + 1) / (max(df, N / 1000) + 1))
/ ln(1001), from the document frequencies of words over all documents: no word counts more than twice another, so that the
rare words of an edit don't outweigh the text around it. Words in fewer than a thousandth of the documents share one
IDF, so that the table of the others is bounded by 1000 times the mean number of distinct words in a document. The IDF
of whole shingles isn't used: it falls with each copy, so that in a large group of near copies the few edited shingles
would outweigh the hundreds that are shared, and the group would be lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkit as tk

U = np.uint64
SHINGLE = 5
RARE = 1000


@dataclass
class Idf:
    """Sorted word hashes and their IDF; all other words have `rest`."""

    words: np.ndarray
    idf: np.ndarray
    rest: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.rest, np.float32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.idf[at], np.float32(self.rest)).astype(np.float32)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word once for each document, counted over the texts of a piece."""
    for batch in shared.slices(batches, "text", 4 * shared.PIECE_BYTES):
        w = tk.words(batch.column("text"))
        h = w.hashes()
        # one key for word and document: sorting by a single number is much the faster
        key = tk.mix(h + tk.owner(w.doc).astype(U) * tk.M1)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(h) else np.zeros(0, np.int64)
        words, count = np.unique(h[order[first]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(count.astype(np.int64))], ["word", "df"])


def fit(docs: DataFrame, text: str = "text") -> Idf:
    """Document frequencies over all documents; what comes to the driver is bounded as above."""
    shared.small_batches(docs.sparkSession)
    n = docs.count()
    floor = n / RARE
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_word_counts, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).where(F.col("df") > floor)
    got = counts.toArrow()
    words, df = got["word"].to_numpy().view(U), got["df"].to_numpy()
    order = np.argsort(words)
    idf = lambda x: 1 + np.log((n + 1) / (np.maximum(x, floor) + 1)) / np.log(RARE + 1)
    return Idf(words[order], idf(df[order]).astype(np.float32), float(idf(0.0)))


def weighted(column: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets (n + 1), hashes (sorted within a text) and weights of each text's distinct shingles. A text of fewer than five
    words has one shingle, of all of them; one without words has none."""
    w = tk.words(column)
    h = w.hashes()
    rare = idf.of(h)
    size = np.diff(w.doc)
    count = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    start = tk.runs(w.doc[:-1], count)
    text = np.repeat(np.arange(len(size)), count)
    end = np.minimum(start + SHINGLE, w.doc[1:][text])
    shingle = tk.hash_ranges(h, start, end, 0)
    sums = np.r_[0.0, np.cumsum(rare, dtype=np.float64)]
    weight = (sums[end] - sums[start]) / np.maximum(end - start, 1)
    # by text, then by the 48 high bits of the hash: one number to sort by; a batch has fewer than 65536 texts
    order = np.argsort(text.astype(U) << U(48) | shingle >> U(16)) if len(size) < 1 << 16 else np.lexsort((shingle, text))
    shingle, text, weight = shingle[order], text[order], weight[order]
    if not len(shingle):
        return np.zeros(len(size) + 1, np.int64), shingle, weight.astype(np.float32)
    first = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])])
    times = np.diff(np.r_[first, len(shingle)])
    # to a 64th: the mean's rounding differs with the place in the piece
    weight = (np.round(weight[first] * 64) / 64 * times).astype(np.float32)
    return np.searchsorted(text[first], np.arange(len(size) + 1)), shingle[first], weight


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - both
    return both / total if total else 1.0


def similarities(at: np.ndarray, shingle: np.ndarray, weight: np.ndarray, head: int) -> np.ndarray:
    """similarity() of the text `head` to each text."""
    own = slice(at[head], at[head + 1])
    order = np.argsort(shingle[own])
    words, heavy = shingle[own][order], weight[own][order]
    both = np.zeros(len(at) - 1)
    text = tk.owner(at)
    if len(words):
        place = np.minimum(np.searchsorted(words, shingle), len(words) - 1)
        same = np.flatnonzero(words[place] == shingle)
        both = np.bincount(text[same], weights=np.minimum(weight[same], heavy[place[same]]), minlength=len(at) - 1)
    sums = np.bincount(text, weights=weight, minlength=len(at) - 1)
    total = sums + sums[head] - both
    return np.where(total > 0, both / np.where(total > 0, total, 1), 1.0)
