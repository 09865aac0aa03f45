"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks.

Words are lower-cased and freed of ASCII punctuation. Benchmark items are cut into passages of 64 words, half
overlapping; their TF-IDF rows (document frequencies over all documents) are factored, RANK passages at a time, by a
distributed randomised SVD: each task multiplies its passages' rows with the present basis, and only sums of the size of the
basis come together. The terms are those of the passages. As no group has more passages than its space has dimensions,
nothing of a passage is lost, however large the benchmark is; the search takes time in proportion to the groups. Documents
are cut into windows of two blocks of 16 words; their images in each latent space are compared with the passages' by cosine,
with the norm of the whole window, so that words foreign to the benchmark count against it. All windows are searched.

A candidate's region, the window with the passage's length on both sides, is then aligned with the passage. It counts as a
leak of the item where the longest common subsequence has 0.75 of the passage's words, or 0.5 (a paraphrase) and the
item's answer stands there whole, whatever other regions have; without an answer column the answer is the item's last sentence, or its last five words where that has fewer.

Defined results: null texts are empty ones; items without words match nothing; repeated items and documents each count;
other columns are not read. Without documents or items there are no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textkit as tk

U = np.uint64
PASSAGE, BLOCK = 64, 16
RANK, POWER = 256, 2
COSINE, COPY, PARAPHRASE = 0.35, 0.75, 0.5
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of each text's words."""
    body, at = tk.raw(column)
    w = tk.split(np.frombuffer(body.tobytes().translate(_PLAIN), dtype=np.uint8), at)
    return w.doc, w.hashes()


def plain_words(text: str) -> list[int]:
    return plain(pa.array([text]))[1].tolist()


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]
    masks: dict[int, int]


def masks(words: list[int]) -> dict[int, int]:
    """The places of each word, as bits."""
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs(item: Item, region: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    full = (1 << len(item.words)) - 1
    v = full
    for w in region:
        m = item.masks.get(w)
        if m:
            u = v & m
            v = (v + u) | (v - u)
    return len(item.words) - (v & full).bit_count()


def _has(region: list[int], part: list[int]) -> bool:
    n, i = len(part), -1
    while n:
        try:
            i = region.index(part[0], i + 1, len(region) - n + 1)
        except ValueError:
            return False
        if region[i : i + n] == part:
            return True
    return False


@dataclass
class Group:
    """At most RANK passages in their latent space."""

    row: np.ndarray  # of each of the benchmark's terms, its row of the basis, or -1
    basis: np.ndarray  # terms by rank, times IDF
    passages: np.ndarray  # passages by rank, of unit length in the space of terms
    parts: list[Item]  # each passage, with its item's id and answer


@dataclass
class Space:
    """The benchmark's terms and their IDF, and the groups of passages."""

    terms: tk.Index
    idf: np.ndarray
    foreign: float
    groups: list[Group]


def last_sentence(text: str) -> list[int]:
    return next((w for w in map(plain_words, reversed(re.split(r"[.!?]+", text))) if w), [])


def read_items(benchmark: DataFrame, item_id: str, text: str, answer: str | None) -> list[Item]:
    """The benchmark is a stated set of queries; it comes to the driver whole."""
    out = []
    for r in benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")).toLocalIterator():
        words = plain_words(r.t)
        if words:
            last = plain_words(r.a) if r.a else last_sentence(r.t)
            out.append(Item(r.i, words, last if len(last) >= 3 or r.a else words[-5:], masks(words)))
    return out


def _frequencies(terms):
    """How many texts have each term, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = terms.value, None
        for batch in shared.slices(batches, "text"):
            at, h = plain(batch.column("text"))
            found = index.find(h)
            pick = found >= 0
            pairs = np.unique(tk.owner(at)[pick] * len(index.keys) + found[pick])
            n = np.bincount(pairs % len(index.keys), minlength=len(index.keys))
            total = n if total is None else total + n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["term", "df"])

    return run


def _rows(passages: list[list[int]], column: dict[int, int], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for p in passages:
        c, n = np.unique([column[w] for w in p], return_counts=True)
        v = n * idf[c]
        size = np.linalg.norm(v)
        out.append((c, v / size if size else v))
    return out


def _project(basis):
    """The sum over a task's passages of row^T (row basis), in blocks of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, out = basis.value, None
        for batch in batches:
            out = np.zeros_like(q) if out is None else out
            for c, v in zip(batch.column("c"), batch.column("v")):
                c, v = c.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False)
                out[c] += np.outer(v, v @ q[c])
        if out is not None:
            for i in np.flatnonzero(out.any(axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([out[i].tolist()], pa.list_(pa.float64()))], ["term", "row"])

    return run


def svd(rows: DataFrame, n_terms: int, rank: int) -> np.ndarray:
    """An orthonormal basis (n_terms by rank) of the leading right singular vectors. rows: c (terms), v (values) of each
    passage. Sums of task results are n_terms by rank, whatever the number of passages."""
    sc = rows.sparkSession.sparkContext
    q = np.random.default_rng(7).standard_normal((n_terms, rank))
    for _ in range(POWER + 1):
        q, _ = np.linalg.qr(q)
        z = np.zeros_like(q)
        parts = rows.mapInArrow(_project(sc.broadcast(q)), "term long, row array<double>").select("term", F.posexplode("row").alias("k", "x")).groupBy("term", "k").agg(F.sum("x").alias("x")).toArrow()
        z[parts["term"].to_numpy(), parts["k"].to_numpy()] = parts["x"].to_numpy()
        q_before, q = q, z
    # Rayleigh-Ritz: the eigenvectors within the last basis, leading first
    values, vectors = np.linalg.eigh((q_before.T @ q + q.T @ q_before) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-300)
    return (q_before @ vectors[:, keep])[:, ::-1]


def factor(spark: SparkSession, parts: list[Item], place: dict[int, int], idf: np.ndarray) -> Group:
    sparse = _rows([p.words for p in parts], place, idf)
    own = np.unique(np.concatenate([c for c, _ in sparse]))
    row = np.full(len(idf), -1, np.int32)
    row[own] = np.arange(len(own))
    # as an Arrow table, which Spark takes in without Python workers: those of a list would stay, beside the others
    edges = pa.array(np.cumsum([0, *(len(c) for c, _ in sparse)]), pa.int32())
    c, v = (pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x))) for x in ([row[c].astype(np.int64) for c, _ in sparse], [v.astype(np.float64) for _, v in sparse]))
    rows = spark.createDataFrame(pa.table({"c": c, "v": v}), "c array<long>, v array<double>")
    basis = svd(shared.table(rows), len(own), min(RANK, len(own), len(parts)))
    image = np.stack([v @ basis[row[c]] for c, v in sparse]).astype(np.float32)
    return Group(row, (basis * idf[own, None]).astype(np.float32), image, parts)


def fit(docs: DataFrame, items: list[Item]) -> Space:
    spark = docs.sparkSession
    words = np.array(sorted({w for i in items for w in i.words}), dtype=U)
    index = tk.Index(words)
    got = docs.select("text").mapInArrow(_frequencies(shared.Sent(spark, index)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(words))
    df[got["term"].to_numpy()] = got["df"].to_numpy()
    idf = np.log((docs.count() + 1) / (df + 1))
    place = {w: i for i, w in enumerate(words.tolist())}
    passages = [i.words[a : a + PASSAGE] for i in items for a in range(0, max(len(i.words) - PASSAGE // 2, 1), PASSAGE // 2)]
    owners = [i for i in items for _ in range(0, max(len(i.words) - PASSAGE // 2, 1), PASSAGE // 2)]
    parts = [Item(i.item_id, p, i.answer, masks(p)) for i, p in zip(owners, passages)]
    groups = [factor(spark, parts[a : a + RANK], place, idf) for a in range(0, len(parts), RANK)]
    return Space(index, idf.astype(np.float32), float(np.median(idf)), groups)


def _search(space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for batch in shared.slices(batches, "text"):
            at, h = plain(batch.column("text"))
            found = s.terms.find(h)
            size = np.diff(at)
            blocks = np.r_[0, np.cumsum(-(-size // BLOCK))]
            text = tk.owner(at)
            block = blocks[:-1][text] + (np.arange(len(h)) - at[text]) // BLOCK
            weight = np.where(found >= 0, s.idf[np.maximum(found, 0)], np.float32(s.foreign))
            square = np.bincount(block, weights=weight.astype(np.float64) ** 2, minlength=blocks[-1])
            # windows: each block with the next one of its text
            count = np.maximum(np.diff(blocks) - 1, (size > 0).astype(np.int64))
            first = tk.runs(blocks[:-1], count)
            of = np.repeat(np.arange(len(size)), count)
            second = np.minimum(first + 1, blocks[of + 1] - 1)
            two = second > first
            pairs: dict[tuple[int, int, int], list] = {}
            able_words = np.flatnonzero(found >= 0)
            for g, group in enumerate(s.groups):
                row = group.row[found[able_words]]
                pick, row = able_words[row >= 0], row[row >= 0]
                image = np.zeros((blocks[-1], group.basis.shape[1]), np.float32)
                for a in range(0, len(pick), 1 << 13):
                    b = block[pick[a : a + (1 << 13)]]
                    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                    image[b[starts]] += np.add.reduceat(group.basis[row[a : a + (1 << 13)]], starts)
                for a in range(0, len(first), 1 << 12):
                    c = slice(a, a + (1 << 12))
                    x = image[first[c]] + np.where(two[c, None], image[second[c]], 0)
                    norm = np.sqrt(square[first[c]] + np.where(two[c], square[second[c]], 0))
                    able = np.flatnonzero(np.einsum("ij,ij->i", x, x) >= (COSINE * norm) ** 2)
                    able = able[norm[able] > 0]
                    cos = x[able] @ group.passages.T / norm[able, None]
                    for i, j in zip(*np.nonzero(cos >= COSINE)):
                        w = a + int(able[i])
                        pairs.setdefault((int(of[w]), g, int(j)), []).append((int(first[w] - blocks[of[w]]), float(cos[i, j])))
            top: dict[tuple, tuple] = {}
            ids = batch.column("doc_id").to_pylist() if pairs else []
            tags = batch.column("tag").to_pylist() if pairs else []
            for (d, g, n), hits in pairs.items():
                item, best = s.groups[g].parts[n], None
                hits.sort()
                reach = len(item.words)
                for b, cos in hits:
                    lo, hi = max(0, b * BLOCK - reach), min(int(size[d]), (b + 2) * BLOCK + reach)
                    region = h[at[d] + lo : at[d] + hi].tolist()
                    share, answer = lcs(item, region) / reach, _has(region, item.answer)
                    # each region is judged for itself: one with the answer isn't hidden by a likelier one without it
                    row = (share >= COPY or share >= PARAPHRASE and answer, share, min(cos, 1.0), answer, lo, hi)
                    best = max(best, row) if best else row
                top[d, item.item_id] = max(top.get((d, item.item_id), best), best)
            out = [(ids[d], tags[d], i, cos, share, answer, leak, lo, hi) for (d, i), (leak, share, cos, answer, lo, hi) in top.items()]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["doc_id", "tag", "item_id", "cosine", "common", "answer", "leak", "first_word", "last_word"])

    return run


FOUND = "doc_id long, tag int, item_id long, cosine double, common double, answer boolean, leak boolean, first_word long, last_word long"


def candidates(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """doc_id, tag (hash of the text), item_id, cosine, common (share of the item's words in order), answer, leak, first_word, last_word (the region) of
    each document and item that the retrieval brings together. answer: the benchmark's column of answers, if it has one."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.hash("text"))
    items = read_items(benchmark, item_id, item_text, answer)
    if not items:
        return spark.createDataFrame([], FOUND)
    return rows.mapInArrow(_search(shared.Sent(spark, fit(rows, items))), FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """The candidates that are leaks."""
    return candidates(docs, benchmark, **columns).where("leak").drop("leak")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tag")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns."""
    return shared.without(docs, leaks(docs, benchmark).select("doc_id", "tag"))
