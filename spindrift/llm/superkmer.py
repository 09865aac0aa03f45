"""Super-k-mers: runs of windows that share a minimiser, packed and sent to the minimiser's bucket.

A text is a row of elements (words or bytes). A window is k of them; its minimiser is the least hash of the m-element
strings in it. Equal windows have equal minimisers, so that all copies of a window meet in one bucket, and consecutive
windows with one minimiser travel as one string. Super-k-mers that repeat whole within a piece of a task are settled
there: only the earliest is sent. So a passage that thousands of documents share comes to its bucket once from each piece.

A minimiser of HOT strings or more, as in a passage that many documents share among surroundings of their own, would fill
its bucket: its windows are sent each for itself, by their own hashes (128 bits), to buckets of their own. A first pass over the
texts counts minimisers by SLOTS slots; what is hot is a set of bits of that size, the same in all tasks.

What is removed and the texts then meet by a hash of the document (packed, at every size of the input alike).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkit as tk

U = np.uint64
NULL_ID = -(1 << 63)
PACKED = "bucket int, n int, meta binary, body binary"
SPANS = "doc_id long, tag int, begin long, end long"
#: Bits that tell places apart; a minimiser keeps the 40 others of its hash.
PLACE = U((1 << 24) - 1)


#: Bytes of strings that a task gathers before it sends them, and buckets for each shuffle partition.
HELD_BYTES, BUCKETS = 16 << 20, 8
#: Bytes of text whose minimisers are counted at once; the arrays are then a fourth of those that pack them.
COUNTED_BYTES = 1 << 18
#: Strings of one minimiser beyond which its windows are spread; slots that minimisers are counted by; and how many a task
#: must see of a slot in HELD_BYTES of text for that to count.
HOT, SLOTS, FEW = 20_000, 1 << 22, 8


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id (null: least of all), tag (a hash that tells apart texts that share an id), text."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.hash(F.col(text)).alias("tag"), F.col(text).alias("text"))


def find(mers: np.ndarray, at: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of the first window, number of windows, minimiser and text of each super-k-mer. at: texts' offsets in elements."""
    count = np.maximum(np.diff(at) - k + 1, 0)
    window = tk.runs(at[:-1], count)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U), none
    # the place in the low bits: a run ends where another place has the least hash, so that a window and its copy nearby never share a string
    least = tk.sliding_min(mers & ~PLACE | np.arange(len(mers), dtype=U) & PLACE, k - m + 1)[window]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1)])
    size = np.diff(np.r_[new, len(window)])
    start = window[new]
    return start, size, least[new] & ~PLACE, np.searchsorted(at, start, "right") - 1


def settle(doc: np.ndarray, pos: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by content, doc and pos; and for each place in it, whether the same content also stands earlier.
    same[0] is sorted by; the others tell apart what agrees in it by chance."""
    order = np.lexsort((pos, doc, *same[1:], same[0]))
    n = len(order)
    if not n:
        return order, np.zeros(0, bool)
    new = np.ones(n, dtype=bool)
    new[1:] = False
    for x in same:
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return order, (doc[order] != doc[head]) | (pos[order] != pos[head])


def spans(doc: np.ndarray, tag: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Half-open ranges, joined within each document where they meet."""
    if len(doc):
        order = np.lexsort((begin, tag, doc))
        doc, tag, begin, end = doc[order], tag[order], begin[order], end[order]
        group = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        wide = int(end.max()) + 2
        if wide * (int(group[-1]) + 1) < 1 << 62:
            b, e = tk.merged(begin + group * wide, end + group * wide)
            first = np.searchsorted(group, b // wide)
            doc, tag, begin, end = doc[first], tag[first], b - b // wide * wide, e - b // wide * wide
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(tag.astype(np.int32)), pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64))], ["doc_id", "tag", "begin", "end"])


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for t in types:
        size = np.dtype(t).itemsize * n
        out.append(np.frombuffer(data, dtype=t, count=n, offset=at))
        at += size
    return out


META = ("<i8", "<i4", "<i8", "<u4", "<u4")  # doc_id, tag, place of the first window, windows, minimiser


WINDOWS = ("<u8", "<u8", "<i8", "<i4", "<i8")  # both hashes, doc_id, tag, place


def census(elements: Callable, k: int, m: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many strings each slot's minimisers have."""

    def counted(held: list) -> pa.RecordBatch:
        slot, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(slot[n >= FEW].astype(np.int32)), pa.array(n[n >= FEW].astype(np.int64))], ["slot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in shared.slices(batches, "text", COUNTED_BYTES):
            for _, at, mers, _, _ in elements(batch.column("text")):
                held.append(slots(find(mers, at, k, m)[2]))
            weight += batch.nbytes
            if weight > HELD_BYTES and held:
                yield counted(held)
                held, weight = [], 0
        if held:
            yield counted(held)

    return run


def slots(least: np.ndarray) -> np.ndarray:
    return (tk.mix(least ^ tk.M2) % U(SLOTS)).astype(np.int64)


def packer(elements: Callable, k: int, m: int, buckets: int, hot: np.ndarray | None = None, settled: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """elements(text column) yields (rows, first elements' places in their texts, offsets, m-element hashes, content hash of ranges, strings of ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bodies, weight, turn = [], [], 0, 0
        for batch in shared.slices(batches, "text"):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            for base, at, mers, content, strings in elements(batch.column("text")):
                start, size, least, text = find(mers, at, k, m)
                if not len(start):
                    continue
                doc, tag, pos = ids[text], tags[text], start - at[text] + base
                if settled:
                    order, late = settle(doc, pos, *content(start, start + size + k - 1))
                    gone, keep = order[late], np.sort(order[~late])
                else:
                    gone, keep = np.zeros(0, np.int64), np.arange(len(start))
                if len(gone):
                    turn += 1
                    yield sent([turn % buckets], [-len(gone)], [pack(doc[gone].astype("<i8"), tag[gone].astype("<i4"), pos[gone].astype("<i8"), (pos[gone] + size[gone] + k - 1).astype("<i8"))], [b""])
                if hot is not None:
                    spread = hot[slots(least[keep])]
                    wide, keep = keep[spread], keep[~spread]
                    first = tk.runs(start[wide], size[wide])
                    if len(first):
                        of = np.repeat(wide, size[wide])
                        yield each_window(content(first, first + k), doc[of], tag[of], pos[of] + first - start[of], k, buckets)
                    if not len(keep):
                        continue
                spread = tk.mix(least[keep] ^ tk.M1)
                body, ends = strings(start[keep], start[keep] + size[keep] + k - 1)
                held.append((spread, doc[keep], tag[keep], pos[keep], size[keep], ends + weight))
                bodies.append(body)
                weight += len(body)
            if weight > HELD_BYTES:
                yield flush(held, bodies, buckets)
                held, bodies, weight = [], [], 0
        if held:
            yield flush(held, bodies, buckets)

    return run


def each_window(hashes: tuple, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, k: int, buckets: int) -> pa.RecordBatch:
    """Windows to the buckets of their hashes: the earliest of equal ones, and what is found to stand earlier."""
    order, late = settle(doc, pos, *hashes)
    gone, stay = order[late], order[~late]
    bucket = (hashes[0][stay] >> U(32)) % U(buckets)
    by = np.argsort(bucket, kind="stable")
    stay, bucket = stay[by], bucket[by].astype(np.int64)
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(stay)].tolist()
    columns = [np.ascontiguousarray(x[stay], dtype=t) for x, t in zip((*hashes, doc, tag, pos), WINDOWS)]
    to, n, meta = bucket[cuts[:-1]].tolist(), np.diff(cuts).tolist(), [pack(*(x[a:b] for x in columns)) for a, b in zip(cuts[:-1], cuts[1:])]
    if len(gone):
        to.append(int(bucket[0])), n.append(-len(gone))
        meta.append(pack(doc[gone].astype("<i8"), tag[gone].astype("<i4"), pos[gone].astype("<i8"), (pos[gone] + k).astype("<i8")))
    return sent(to, n, meta, [b""] * len(to))


def sent(bucket: list, n: list, meta: list, body: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(n, pa.int32()), pa.array(meta, pa.binary()), pa.array(body, pa.binary())], ["bucket", "n", "meta", "body"])


def flush(held: list, bodies: list, buckets: int) -> pa.RecordBatch:
    """One row for each bucket that has super-k-mers."""
    spread, doc, tag, pos, size, ends = (np.concatenate(x) for x in zip(*held))
    whole = b"".join(x.tobytes() for x in bodies)
    begins = np.r_[0, ends[:-1]]
    bucket = ((spread >> U(32)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    meta = [np.ascontiguousarray(x[order], dtype=t) for x, t in zip((doc, tag, pos, size, spread & U(0xFFFFFFFF)), META)]
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(order)].tolist()
    metas, texts = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        metas.append(pack(*(x[a:b] for x in meta)))
        texts.append(zstandard.ZstdCompressor(level=3).compress(tk.joined(whole, begins[own], ends[own])))
    return sent(bucket[cuts[:-1]].tolist(), np.diff(cuts).tolist(), metas, texts)


def unpacker(judge: Callable, k: int) -> Callable[[pa.Table], pa.Table]:
    """judge(doc, tag, pos, windows, minimiser, bodies) gives doc, tag, begin, end of what also stands earlier."""

    def run(rows: pa.Table) -> pa.Table:
        found, got, bodies, windows = [], [], [], []
        for n, meta, body in zip(rows["n"].to_pylist(), rows["meta"].to_pylist(), rows["body"].to_pylist()):
            if n < 0:
                found.append(unpack(meta, -n, "<i8", "<i4", "<i8", "<i8"))
            elif not body:
                windows.append(unpack(meta, n, *WINDOWS))
            else:
                got.append(unpack(meta, n, *META))
                bodies.append(zstandard.ZstdDecompressor().decompress(body))
        if got:
            doc, tag, pos, size, least = (np.concatenate(x) for x in zip(*got))
            found.append(judge(doc, tag, pos, size.astype(np.int64), least, bodies))
        if windows:
            h1, h2, doc, tag, pos = (np.concatenate(x) for x in zip(*windows))
            order, late = settle(doc, pos, h1, h2)
            gone = order[late]
            found.append((doc[gone], tag[gone], pos[gone], pos[gone] + k))
        return pa.Table.from_batches([spans(*(np.concatenate(x) for x in zip(*found)))])

    return run


def repeated(least: np.ndarray) -> np.ndarray:
    """Whether each minimiser occurs more than once."""
    _, which, count = np.unique(least, return_inverse=True, return_counts=True)
    return count[which] > 1


def buckets_of(spark, buckets: int | None) -> int:
    return buckets or BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def repeats(docs: DataFrame, elements: Callable, judge: Callable, k: int, m: int, buckets: int | None) -> DataFrame:
    """doc_id, tag, begin, end: ranges of elements that each document loses, which may overlap. docs: what keyed() returned."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    n = docs.mapInArrow(census(elements, k, m), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).select("slot").toArrow()
    hot = None
    if n.num_rows:
        hot = np.zeros(SLOTS, bool)
        hot[n["slot"].to_numpy()] = True
    buckets = buckets_of(spark, buckets)
    packed = docs.mapInArrow(packer(elements, k, m, buckets, hot), PACKED)
    return packed.groupBy("bucket").applyInArrow(unpacker(judge, k), SPANS)


def removals(docs: DataFrame, *how) -> DataFrame:
    """doc_id, tag, spans: what each document loses, as ranges of elements."""
    found = repeats(docs, *how)
    return found.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


BUNDLES = "bucket int, n int, meta binary, body binary"


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each bucket, packed. Equal rows travel once, with their number."""
    held: dict[tuple, int] = {}
    weight = 0

    def flush() -> pa.RecordBatch:
        by: dict[int, list] = {}
        for row, times in held.items():
            by.setdefault(row[0], []).append((row, times))
        metas, bodies = [], []
        for rows in by.values():
            columns = [np.array([r[1] for r, _ in rows], "<i8"), np.array([r[2] for r, _ in rows], "<i4"), np.array([len(r[3]) for r, _ in rows], "<i8"), np.array([t for _, t in rows], "<i8")]
            metas.append(pack(*columns))
            bodies.append(zstandard.ZstdCompressor(level=3).compress(b"".join(r[3] for r, _ in rows)))
        return sent(list(by), [len(rows) for rows in by.values()], metas, bodies)

    for batch in shared.slices(batches, "text"):
        body, at = tk.raw(batch.column("text"))
        body, at = body.tobytes(), at.tolist()
        for i, (bucket, doc, tag) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "tag")))):
            row = (bucket, doc, tag, body[at[i] : at[i + 1]])
            held[row] = held.get(row, 0) + 1
        weight += len(body)
        if weight > HELD_BYTES:
            yield flush()
            held, weight = {}, 0
    if held:
        yield flush()


def _cutter(apply: Callable) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(bundles: pa.Table, spans: pa.Table) -> pa.Table:
        doc, tag, begin, end = (spans[c].to_numpy() for c in ("doc_id", "tag", "begin", "end"))
        order = np.lexsort((begin, tag, doc))
        doc, tag, begin, end = doc[order], tag[order], begin[order], end[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]) if len(doc) else np.zeros(0, np.int64)
        place = dict(zip(zip(doc[first].tolist(), tag[first].tolist()), zip(first.tolist(), [*first[1:].tolist(), len(doc)])))
        out = []
        for n, meta, body in zip(*(bundles[c].to_pylist() for c in ("n", "meta", "body"))):
            ids, tags, size, times = unpack(meta, n, "<i8", "<i4", "<i8", "<i8")
            body = zstandard.ZstdDecompressor().decompress(body)
            ends = np.cumsum(size).tolist()
            own = [place.get(key) for key in zip(ids.tolist(), tags.tolist())]
            lists = lambda x: pa.array([x[a[0] : a[1]] if a else None for a in own], pa.list_(pa.int64()))  # noqa: E731, B023
            texts = pa.array([body[e - k : e] for e, k in zip(ends, size.tolist())], pa.large_binary())
            rows = pa.RecordBatch.from_arrays([pa.array(ids), texts, lists(begin), lists(end)], ["doc_id", "text", "begin", "end"])
            for done in apply(iter([rows])):
                out.append(done if times.max() == 1 else done.take(pa.array(np.repeat(np.arange(n), times))))
        return pa.Table.from_batches(out, out[0].schema)

    return run


def cut(docs: DataFrame, found: DataFrame, apply: Callable, schema: str, buckets: int | None) -> DataFrame:
    """Each document with what repeats() found of it, through apply."""
    place = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(buckets_of(docs.sparkSession, buckets))).cast("int").alias("bucket")
    texts = docs.select(place, "doc_id", "tag", "text").mapInArrow(_bundles, BUNDLES)
    both = texts.groupBy("bucket").cogroup(found.select(place, *found.columns).groupBy("bucket"))
    return both.applyInArrow(_cutter(apply), schema).withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """doc_id, place of text, begin, end of each row."""
    for i, (doc, b, e) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("begin"), batch.column("end"))):
        if b.is_valid:
            yield doc, i, *tk.merged(b.values.to_numpy(zero_copy_only=False).astype(np.int64), e.values.to_numpy(zero_copy_only=False).astype(np.int64))
        else:
            yield doc, i, np.zeros(0, np.int64), np.zeros(0, np.int64)
