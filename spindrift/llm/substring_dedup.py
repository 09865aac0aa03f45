"""Substring dedup by super-k-mer partitioning: windows of words that also stand earlier are removed.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket; there, sorting the
windows groups equal ones exactly, with the earliest first (superkmer.py).

Defined results: a null or empty text has no words; repeated ids count as one document in the order, so that equal rows
keep the same words; a null id comes before all others; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import superkmer as sk
from . import textkit as tk

U = np.uint64
WINDOW, MER = 20, 3


#: Words that are hashed at once; a longer text goes in stretches that overlap by a window less one word.
STRETCH = 200_000


def _elements(k: int):
    def elements(column: pa.Array) -> Iterator[tuple]:
        w = tk.words(column)
        parts = [(0, w.doc, 0, len(w.start))]
        if len(w.start) > 2 * STRETCH:
            parts = []
            for i, (a, b) in enumerate(zip(w.doc[:-1].tolist(), w.doc[1:].tolist())):
                for x in range(a, max(b - k + 1, a + 1), STRETCH):
                    y = min(b, x + STRETCH + k - 1)
                    parts.append((x - a, np.r_[np.zeros(i + 1, np.int64), np.full(len(w.doc) - 1 - i, y - x)], x, y))
        for base, at, x, y in parts:
            if x < y:
                lo, hi = int(w.start[x]), int(w.end[y - 1])
                yield base, at, *_hashed(tk.Words(w.body[lo:hi], at, w.start[x:y] - lo, w.end[x:y] - lo))

    return elements


def _hashed(w: tk.Words) -> tuple:
    h1, h2 = w.hashes(0), w.hashes(1)
    n = np.arange(max(len(h1) - MER + 1, 0))
    mers = tk.hash_ranges(h1, n, n + MER, 0)

    def content(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tk.hash_ranges(h1, a, b, 0), tk.hash_ranges(h2, a, b, 1)

    def strings(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, size = w.start[a], w.end[b - 1] - w.start[a] + 1
        ends = np.cumsum(size)
        body = np.r_[w.body, np.uint8(32)][tk.runs(lo, size)]
        body[ends - 1] = 32
        return body, ends

    return mers, content, strings


def _judge(k: int):
    def judge(doc, tag, pos, size, least, bodies):
        w = tk.split(np.frombuffer(b"".join(bodies), dtype=np.uint8), np.zeros(1, np.int64))
        at = np.r_[0, np.cumsum(size + k - 1)]
        keep = np.flatnonzero(sk.repeated(least))
        own = tk.runs(at[keep], size[keep] + k - 1)
        w = tk.Words(w.body, w.doc, w.start[own], w.end[own])
        doc, tag, pos, size = doc[keep], tag[keep], pos[keep], size[keep]
        at = np.r_[0, np.cumsum(size + k - 1)]
        element = tk.runs(at[:-1], size)
        which = np.repeat(np.arange(len(size)), size)
        place = pos[which] + element - at[which]
        order, late = sk.settle(doc[which], place, tk.hash_ranges(w.hashes(0), element, element + k, 0), tk.hash_ranges(w.hashes(1), element, element + k, 1))
        late = order[late]
        return doc[which[late]], tag[which[late]], place[late], place[late] + k

    return judge


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = tk.words(batch.column("text"))
        body, out = w.body.tobytes(), {k: [] for k in ("doc_id", "n_words", "n_removed", "kept")}
        for doc, i, begin, end in sk.rows_of(batch):
            a, b = int(w.doc[i]), int(w.doc[i + 1])
            start, stop = w.start[a:b], w.end[a:b]
            n = b - a
            if len(begin):
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, begin, 1)
                np.add.at(gone, end, -1)
                keep = np.cumsum(gone)[:n] == 0
                start, stop = start[keep], stop[keep]
            out["doc_id"].append(doc), out["n_words"].append(n), out["n_removed"].append(n - len(start))
            out["kept"].append(b" ".join([body[x:y] for x, y in zip(start.tolist(), stop.tolist())]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string())], list(out))


def removed_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """doc_id, tag, spans (array of begin, end): words covered by a window that also starts earlier."""
    return sk.removals(sk.keyed(docs, text, doc_id), _elements(window), _judge(window), window, MER, buckets)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of each document."""
    rows = sk.keyed(docs, text, doc_id)
    found = sk.repeats(rows, _elements(window), _judge(window), window, MER, buckets)
    return sk.cut(rows, found, _apply, "doc_id long, n_words long, n_removed long, kept string", buckets)


#: DuckDB SQL for query()'s rows: every window spelt out, its first place looked up.
SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x, ws FROM w),
win AS (SELECT doc_id, i, x, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i : i + 19], ' ') END AS s FROM word),
late AS (SELECT doc_id, i, x, s IS NOT NULL AND (doc_id, i) > min((doc_id, i)) OVER (PARTITION BY s) AS again FROM win),
gone AS (SELECT doc_id, i, x, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS removed FROM late),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT removed), '') AS t FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
