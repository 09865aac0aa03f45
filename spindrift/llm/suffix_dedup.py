"""Suffix-array dedup: byte strings that also stand earlier, found from the maximal repeats of enhanced suffix arrays.

Texts are cut into super-k-mers of bytes (superkmer.py), so that all copies of a string of `least` bytes meet in one
bucket. A bucket drops strings whose minimiser is alone, settles strings that are equal as a whole, and sorts the
suffixes of the rest. A stack scan over the common-prefix lengths of neighbours walks the interval tree from the leaves;
an interval of at least `least` bytes whose occurrences differ in the byte to their left is a maximal repeat. All its
occurrences are given out, and all but the earliest are removed; repeat_groups() returns them all.

Defined results: a null or empty text has no bytes; repeated ids count as one document in the order, so that equal rows
lose the same bytes; a null id comes before all others; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import superkmer as sk
from . import textkit as tk

U = np.uint64
LEAST, MER = 100, 16
#: Suffixes sorted at once; minimisers aren't split between sorts.
AT_ONCE = 100_000


def _mers(body: np.ndarray) -> np.ndarray:
    if len(body) < MER:
        return np.zeros(0, U)
    at = np.ndarray(shape=(len(body) - 7,), dtype="<u8", buffer=body, strides=(1,))
    n = len(body) - MER + 1
    out = at[:n] * tk.M1
    for j in range(8, MER - 7, 8):
        out = (out ^ out >> U(29)) * tk.M2 + at[j : j + n] * tk.M3
    return tk.mix(out)


def _elements(least: int):
    def elements(column: pa.Array) -> Iterator[tuple]:
        whole, at = tk.raw(column)
        whole = np.ascontiguousarray(whole)
        pieces = [(0, whole, at)]
        if len(whole) > 2 * shared.PIECE_BYTES:  # one long text: slices() cuts between rows otherwise
            step = shared.PIECE_BYTES
            pieces = []
            for a, b, i in zip(at[:-1].tolist(), at[1:].tolist(), range(len(at))):
                for x in range(a, max(b - least + 1, a + 1), step):
                    y = min(b, x + step + least - 1)
                    pieces.append((x - a, whole[x:y], np.r_[np.zeros(i + 1, np.int64), np.full(len(at) - 1 - i, y - x)]))
        for base, body, at in pieces:

            def content(a, b, body=body):
                return tk.hash_ranges(body, a, b, 0), tk.hash_ranges(body, a, b, 1)

            def strings(a, b, body=body):
                return np.frombuffer(tk.joined(body.tobytes(), a, b), dtype=np.uint8), np.cumsum(b - a)

            yield base, at, _mers(body), content, strings

    return elements


def suffix_array(body: bytes, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the strings at[i]:at[i + 1] that have `least` bytes or more, sorted: their places and lengths, and the
    length of the common prefix of each with the one before it. Those whose first `least` bytes no other begins with (no other
    has their hash) are left out: they are in no repeat of that length, and no two others have more in common without them."""
    count = np.maximum(np.diff(at) - least + 1, 0)
    place = tk.runs(at[:-1], count)
    size = np.repeat(at[1:], count) - place
    some = np.flatnonzero(sk.repeated(tk.hash_ranges(np.frombuffer(body, dtype=np.uint8), place, place + least, 0)))
    place, size = place[some], size[some]
    keys = [body[p : p + n] for p, n in zip(place.tolist(), size.tolist())]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
    place, size = place[order], size[order]
    common = np.zeros(len(place), np.int64)
    if len(place) > 1:
        most = np.minimum(size[1:], size[:-1])
        padded = np.frombuffer(body + bytes(8), dtype=np.uint8)
        eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        left, open_ = np.zeros(len(most), np.int64), np.arange(len(most))
        while len(open_):
            x = eight[place[open_] + left[open_]] ^ eight[place[open_ + 1] + left[open_]]
            same = np.full(len(open_), 8)
            rest = x != 0
            low = x[rest] & (~x[rest] + U(1))
            same[rest] = np.log2(low.astype(np.float64)).astype(np.int64) // 8
            left[open_] += same
            open_ = open_[(same == 8) & (left[open_] < most[open_])]
        common[1:] = np.minimum(left, most)
    return place, size, common


def maximal_repeats(place: np.ndarray, common: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last + 1, length) of each interval of the suffix array that is a maximal repeat of `least` bytes or more.
    before: what stands to the left of each suffix; a negative value differs from all others."""
    # stack of [length, first, left byte, or None where there are several]
    lcp, left = common.tolist(), before.tolist()
    edges = np.flatnonzero(common >= least)
    if not len(edges):
        return
    breaks = np.flatnonzero(np.diff(edges) > 1)
    for a, b in zip(edges[np.r_[0, breaks + 1]].tolist(), edges[np.r_[breaks, len(edges) - 1]].tolist()):
        stack: list[list] = []  # suffixes a - 1 to b share `least` bytes or more with a neighbour
        for i in range(a, b + 2):
            here = lcp[i] if i <= b else 0
            byte = left[i - 1] if left[i - 1] >= 0 else None
            first = i - 1
            while stack and stack[-1][0] > here:
                length, first, own = stack.pop()
                own = own if own == byte else None
                if own is None:
                    yield first, i, length
                byte = own
            if here:
                if stack and stack[-1][0] == here:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else None
                else:
                    stack.append([here, first, byte])


def _judge(least: int):
    def judge(doc, tag, pos, size, minimiser, bodies):
        whole = b"".join(bodies)
        at = np.r_[0, np.cumsum(size + least - 1)]
        keep = np.flatnonzero(sk.repeated(minimiser))
        # strings that are equal as a whole: the earliest stays
        offsets = np.r_[0, np.cumsum(size[keep] + least - 1)]
        whole = tk.joined(whole, at[keep], at[keep] + size[keep] + least - 1)
        body = np.frombuffer(whole, dtype=np.uint8)
        doc, tag, pos, size, minimiser = (x[keep] for x in (doc, tag, pos, size, minimiser))
        c = [tk.hash_ranges(body, offsets[:-1], offsets[1:], k) for k in range(2)]
        order, late = sk.settle(doc, pos, *c)
        gone, stay = order[late], order[~late]
        found = [(doc[gone], tag[gone], pos[gone], pos[gone] + size[gone] + least - 1)]
        stay = stay[sk.repeated(minimiser[stay])]
        stay = stay[np.lexsort((pos[stay], doc[stay], minimiser[stay]))]
        fresh = np.flatnonzero(np.r_[True, minimiser[stay][1:] != minimiser[stay][:-1]]) if len(stay) else np.zeros(0, np.int64)
        total = np.r_[0, np.cumsum(size[stay])]
        begin = 0
        while begin < len(stay):
            more = fresh[(fresh > begin) & (total[fresh] - total[begin] > AT_ONCE)]
            end = int(more[0]) if len(more) else len(stay)
            part = stay[begin:end]
            begin = end
            length = size[part] + least - 1
            text = tk.joined(whole, offsets[part], offsets[part] + length)
            starts = np.r_[0, np.cumsum(length)]
            place, _, common = suffix_array(text, starts, least)
            string = np.searchsorted(starts, place, "right") - 1
            inner = place - starts[string]
            left = np.where(inner > 0, np.frombuffer(text, dtype=np.uint8)[np.maximum(place - 1, 0)].astype(np.int64), -1)
            where, d, t = pos[part][string] + inner, doc[part][string], tag[part][string]
            rank = np.empty(len(place), np.int64)
            by_place = np.lexsort((where, d))
            rank[by_place] = np.arange(len(place))
            for a, b, n in maximal_repeats(place, common, left, least):
                head = a + int(np.argmin(rank[a:b]))
                later = a + np.flatnonzero((d[a:b] != d[head]) | (where[a:b] != where[head]))
                found.append((d[later], t[later], where[later], where[later] + n))
        return tuple(np.concatenate(x) for x in zip(*found))

    return judge


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, at = tk.raw(batch.column("text"))
        body, out = body.tobytes(), {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
        for doc, i, begin, end in sk.rows_of(batch):
            own = body[at[i] : at[i + 1]]
            edges = [0, *(x for pair in zip(begin.tolist(), end.tolist()) for x in pair), len(own)]
            kept = b"".join(own[x:y] for x, y in zip(edges[::2], edges[1::2]))
            out["doc_id"].append(doc), out["n_bytes"].append(len(own)), out["n_removed"].append(len(own) - len(kept)), out["n_spans"].append(len(begin)), out["kept"].append(kept)
        yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in list(out)[:4]), pa.array(out["kept"], pa.binary())], list(out))


def _groups(least: int):
    def run(rows: pa.Table) -> pa.Table:
        got, bodies = [], []
        for n, meta, body in zip(rows["n"].to_pylist(), rows["meta"].to_pylist(), rows["body"].to_pylist()):
            got.append(sk.unpack(meta, n, *sk.META))
            bodies.append(zstandard.ZstdDecompressor().decompress(body))
        doc, tag, pos, size, minimiser = (np.concatenate(x) for x in zip(*got))
        text, out = b"".join(bodies), []
        length = size.astype(np.int64) + least - 1
        starts = np.r_[0, np.cumsum(length)]
        keep = np.flatnonzero(sk.repeated(minimiser))
        body = np.frombuffer(text, dtype=np.uint8)[tk.runs(starts[keep], length[keep])].tobytes()
        at = np.r_[0, np.cumsum(length[keep])]
        place, _, common = suffix_array(body, at, least)
        string = np.searchsorted(at, place, "right") - 1
        inner = place - at[string]
        left = np.where(inner > 0, np.frombuffer(body, dtype=np.uint8)[np.maximum(place - 1, 0)].astype(np.int64), -1)
        for a, b, n in maximal_repeats(place, common, left, least):
            name = hashlib.sha256(body[place[a] : place[a] + n]).hexdigest()
            own = keep[string[a:b]]
            out.append((np.full(b - a, name, object), doc[own], tag[own], pos[own] + inner[a:b], pos[own] + inner[a:b] + n))
        name, doc, tag, begin, end = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, t) for t in (object, "i8", "i4", "i8", "i8")]
        return pa.table({"repeat": pa.array(name.tolist(), pa.string()), "doc_id": pa.array(doc, pa.int64()), "tag": pa.array(tag, pa.int32()), "begin": pa.array(begin, pa.int64()), "end": pa.array(end, pa.int64())})

    return run


def repeat_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, buckets: int | None = None) -> DataFrame:
    """repeat (the string's SHA-256), doc_id, tag, begin, end (bytes): the maximal repeats, each with all its occurrences. A
    repeat that goes beyond its bucket's strings is given in parts of `least` bytes or more that overlap. Unlike dedup(), which
    settles equal strings on their way, this sends every copy: it is made for a look at what repeats."""
    rows = sk.keyed(docs, text, doc_id)
    shared.small_batches(docs.sparkSession)
    n = sk.buckets_of(docs.sparkSession, buckets)
    packed = rows.mapInArrow(sk.packer(_elements(least), least, MER, n, settled=False), sk.PACKED)
    found = packed.groupBy("bucket").applyInArrow(_groups(least), "repeat string, doc_id long, tag int, begin long, end long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != sk.NULL_ID, F.col("doc_id"))).distinct()


def removed_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, buckets: int | None = None) -> DataFrame:
    """doc_id, tag, spans (array of begin, end): bytes covered by a string of `least` bytes that also starts earlier."""
    return sk.removals(sk.keyed(docs, text, doc_id), _elements(least), _judge(least), least, MER, buckets)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay; a cut may fall within a character)."""
    rows = sk.keyed(docs, text, doc_id)
    found = sk.repeats(rows, _elements(least), _judge(least), least, MER, buckets)
    return sk.cut(rows, found, _apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", buckets)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
