"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Each text gets 64 samples (Ioffe's scheme: two texts share a sample with the probability of their weighted Jaccard
similarity), in 16 bands of 4. Texts that agree in a band meet in its bucket. Equal texts are one from the start.

Within a bucket no pairs are listed. All members are compared with the bucket's least one, its leader: by the samples
first (the estimate's error is at most 0.06; what lies 4 of these below a bound is dropped), then by their shingles.
Members similar to it are linked; the others stay for the next round, with a leader of their own. A member that isn't
similar to the leader can be similar to one that is only if the leader's similarity to it is 0.6 or more (1 less
similarity is a metric); such members are compared with the leader's linked ones. After ROUNDS rounds the rest of a
bucket is compared pair by pair. Links make components: a document's class is the least id in its component.

Defined results: a null text is an empty one; texts without words are equal; repeated ids and rows are members like
others; a null id is no class's id unless no other is there; other columns are kept out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import shingles as sh
from . import textkit as tk
from .components import components

U = np.uint64
BANDS, DEPTH = 16, 4
SIMILAR = 0.8
ROUNDS = 5
#: Members compared with a leader in one task.
CHUNK = 256
#: Bytes up to which the list of texts to compare is broadcast to where the texts are.
EACH_BYTES = 16 << 20
#: Of a text's weight, how much a sample is sought within at first.
WITHIN = 4.0
_tables: list[np.ndarray] = []
_bounds: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """Quantiles of Gamma(2, 1) at 65536 places: the values, their inverses, their logarithms."""
    if not _tables:
        p = (np.arange(65536) + 0.5) / 65536
        low, high = np.zeros(65536), np.full(65536, 40.0)
        for _ in range(60):  # 1 - (1 + x) exp(-x) = p
            x = (low + high) / 2
            over = 1 - (1 + x) * np.exp(-x) > p
            low, high = np.where(over, low, x), np.where(over, x, high)
        _tables.extend(v.astype(np.float32) for v in (x, 1 / x, np.log(x)))
    return _tables


def lower_bounds() -> np.ndarray:
    """For the 16 high bits of a hash, eight times the least that log_samples() can give for a weight of 1, rounded down."""
    if not _bounds:
        r_of, _, log_of = tables()
        low = log_of[::256][None, :] - r_of[255::256][:, None]
        _bounds.append(np.clip(np.floor(low * 8 - 0.01), -128, 127).astype(np.int8).ravel())
    return _bounds[0]


def hashed(shingle: np.ndarray, turn: np.ndarray | np.uint64, out: np.ndarray | None = None, spare: np.ndarray | None = None) -> np.ndarray:
    """The hash of each shingle (itself a mixed hash) for one sample."""
    x = np.multiply(shingle, turn, out=out)
    x ^= np.right_shift(x, U(32), out=spare)
    x *= tk.M3
    return x


def log_samples(x: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """What Ioffe's scheme compares, of shingles with the hashes x."""
    r_of, inverse_of, log_of = tables()
    f = x.view(np.uint16).reshape(-1, 4)
    # the high bytes of both quantiles stand together, so that lower_bounds() has one place for them
    i1, i2 = f[:, 3] & 0xFF00 | f[:, 2] >> 8, f[:, 3] << 8 | f[:, 2] & 0xFF
    t = log_weight * inverse_of[i1]
    beta = f[:, 1].astype(np.float32)
    beta *= np.float32(1 / 65536)
    t += beta
    np.floor(t, out=t)
    t -= beta
    t += np.float32(1)
    t *= r_of[i1]
    return np.subtract(log_of[i2], t, out=t)


def samples(at: np.ndarray, shingle: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k samples of each text, as an array of n by k of 32 bits; texts without shingles have zeros.

    A sample is the least of what log_samples() gives for a text's shingles. It is worked out for those only whose lower bound
    is below log(WITHIN / the text's weight). The least is below that but with a probability of exp(-WITHIN); where it isn't,
    all the text's shingles are taken."""
    out = np.zeros((len(at) - 1, k), dtype=np.uint32)
    turns = tk.mix(np.arange(1, k + 1, dtype=U) * tk.M1) | U(1)
    bounds = lower_bounds()
    filled = np.flatnonzero(np.diff(at))
    step = 1 << 15
    # stretches of whole texts that fit the cache
    cuts, i = [0], 0
    while i < len(filled):
        i = max(i + 1, int(np.searchsorted(at[filled], at[filled[i]] + step)))
        cuts.append(i)
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = filled[a:b]
        lo, hi = int(at[own[0]]), int(at[own[-1] + 1])
        s, w, starts = shingle[lo:hi], weight[lo:hi], at[own] - lo
        size, lw = np.diff(np.r_[starts, hi - lo]), np.log(w)
        most = np.log(WITHIN / np.add.reduceat(w, starts, dtype=np.float64))
        limit = np.clip(np.floor(8 * (np.repeat(most, size) + lw)), -128, 127).astype(np.int8)
        x, y, low, below = np.empty_like(s), np.empty_like(s), np.empty(len(s), np.int8), np.empty(len(s), bool)
        picks, hashes, edges, n = [], [], [], 0
        for turn in turns:
            hashed(s, turn, x, y)
            np.right_shift(x, U(48), out=y)
            bounds.take(y.view(np.int64), out=low, mode="clip")
            pick = np.flatnonzero(np.less_equal(low, limit, out=below))
            picks.append(pick), hashes.append(x[pick]), edges.append(np.searchsorted(pick, starts) + n)
            n += len(pick)
        edge = np.r_[np.concatenate(edges), n]
        some = np.flatnonzero(np.diff(edge))
        least = np.full(k * len(own), np.inf, np.float32)
        if n:
            least[some] = np.minimum.reduceat(log_samples(np.concatenate(hashes), lw[np.concatenate(picks)]), edge[some])
        again = np.flatnonzero(least > np.tile(most - 0.001, k))  # less what float32 rounds
        if len(again):
            j, t = np.divmod(again, len(own))
            p = tk.runs(starts[t], size[t])
            least[again] = np.minimum.reduceat(log_samples(hashed(s[p], np.repeat(turns[j], size[t])), lw[p]), np.cumsum(size[t]) - size[t])
        out[own] = least.reshape(k, -1).T.view(np.uint32)
    return out


def _signer(idf, bands: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.slices(batches, "text"):
            at, shingle, weight = sh.weighted(batch.column("text"), idf.value)
            sig = samples(at, shingle, weight, bands * depth)
            key = np.zeros((len(sig), bands), dtype=U)
            for j in range(depth):
                key = tk.mix(key * tk.M1 + sig[:, j::depth].astype(U) + U(1))
            key = tk.mix(key ^ np.arange(bands, dtype=U) * tk.M2).view(np.int64)
            empty = np.diff(at) == 0
            keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(empty, 0, bands))].astype(np.int32)), pa.array(key[~empty].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("doc_id"), keys, pa.array([s.tobytes() for s in sig], pa.binary())], ["node", "doc_id", "keys", "sig"])

    return run


def _judge(idf):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        nodes, leaders = rows["node"].to_pylist(), rows["leader"].to_pylist()
        at, shingle, weight = sh.weighted(rows["text"].combine_chunks() if isinstance(rows["text"], pa.ChunkedArray) else rows["text"], idf.value)
        head = next((i for i, (n, a) in enumerate(zip(nodes, leaders)) if n == a), None)
        like = [] if head is None else sh.similarities(at, shingle, weight, head).tolist()
        done = {n: x for n, x in zip(nodes, like) if n != leaders[0]}
        return pa.table({"a": pa.array([leaders[0]] * len(done), pa.string()), "b": pa.array(list(done), pa.string()), "similarity": pa.array(list(done.values()), pa.float64())})

    return run


def agreeing(x: str, y: str, k: int) -> F.Column:
    """Share of samples that two texts have in common; sig: binary of 4 bytes each."""
    return F.expr(f"size(filter(sequence(0, {k - 1}), i -> substring({x}, 4 * i + 1, 4) = substring({y}, 4 * i + 1, 4)))") / k


def verify(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """a, b, similarity of each pair a, b. texts: node, text, as head_texts() gives them."""
    pairs = pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.greatest(F.ceil(F.col("n") / CHUNK), F.lit(1))))
    each = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("leader"), "chunk").distinct()
    each = shared.table(each)
    each = F.broadcast(each) if shared.table_bytes(each) <= EACH_BYTES else each.hint("shuffle_hash")
    found = texts.join(each, "node").select("leader", "chunk", "node", "text")
    return found.groupBy("leader", "chunk").applyInArrow(_judge(idf), "a string, b string, similarity double")


def head_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes. rows: node, doc_id, text; wanted: node, id (the text with that doc_id counts). The texts
    are moved once: where later joins will be too large to broadcast their other side, they are kept in buckets of the node,
    and only that side moves."""
    spark = rows.sparkSession
    wanted = shared.table(wanted)
    found = rows.withColumnRenamed("doc_id", "id").join(shared.sized(wanted, EACH_BYTES), ["node", "id"]).select("node", "text")
    if shared.table_bytes(wanted) <= EACH_BYTES // 4:
        return shared.table(found)
    return shared.bucketed(found, "node")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR, bands: int = BANDS, depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id, class_size, n_links (links found of its text), text_md5 and class_md5 (the least of its class: where
    ids repeat, it tells classes apart) of each document."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    k = bands * depth
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    idf = shared.Sent(spark, sh.fit(rows))
    rows = rows.withColumn("node", F.md5(F.col("text").cast("binary")))
    signed = shared.table(rows.mapInArrow(_signer(idf, bands, depth), "node string, doc_id long, keys array<long>, sig binary"))
    nodes = shared.table(signed.groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min_by("keys", "doc_id").alias("keys"), F.min_by("sig", "doc_id").alias("sig")))
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rest = shared.table(buckets.join(crowded, "key"))
    # only texts that share a bucket are compared
    texts = head_texts(rows, rest.select("node").distinct().join(nodes.select("node", "id"), "node"))
    brief = nodes.select("node", "sig")
    links = None
    far, slack = 2 * similar - 1, 4 * (0.25 / k) ** 0.5
    known = None

    def compare(pairs: DataFrame) -> DataFrame:
        """a, b, similarity of pairs a, b, those far apart by their samples left out; pairs compared before aren't again."""
        nonlocal known
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        a, b = (brief.select(F.col("node").alias(x), F.col("sig").alias(f"{x}_sig")) for x in "ab")
        likely = pairs.join(a, "a").join(b, "b").where(agreeing("a_sig", "b_sig", k) >= max(far - slack, 0)).drop("a_sig", "b_sig")
        likely = shared.table(likely)
        count = likely.groupBy("a").agg(F.count("*").alias("n"))
        got = shared.table(verify(likely.join(count, "a"), texts, idf))
        known = got if known is None else known.union(got)
        return known

    for turn in range(ROUNDS + 1):
        if turn == ROUNDS:
            other = rest.select("key", F.col("node").alias("b"))
            compare(rest.withColumnRenamed("node", "a").join(other, "key").where("a < b").select("a", "b").distinct())
            break
        leader = rest.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
        stars = shared.table(rest.join(leader, "key").where("node <> a").select("key", "a", F.col("node").alias("b")))
        if not stars.limit(1).count():
            break
        result = stars.join(compare(stars.select("a", "b").distinct()), ["a", "b"], "left").select("key", "a", "b", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
        result = shared.table(result)
        nearby = result.where((F.col("similarity") < similar) & (F.col("similarity") >= far)).select("key", F.col("b").alias("x"))
        linked = result.where(F.col("similarity") >= similar).select("key", F.col("b").alias("y"))
        cross = shared.table(nearby.join(linked, "key").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if cross.limit(1).count():
            compare(cross)
        rest = shared.table(result.where(F.col("similarity") < similar).select("key", F.col("b").alias("node")))
    empty = spark.createDataFrame([], "a string, b string, similarity double")
    links = shared.table((known if known is not None else empty).where(F.col("similarity") >= similar).select("a", "b").distinct())
    labels = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of = nodes.select("node", "id", "copies").join(labels, "node", "left").join(degree, "node", "left").select("node", "id", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of = shared.table(of)
    heads = of.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    each = signed.select("node", "doc_id").join(of.select("node", "label", "n_links").join(heads, "label"), "node")
    null = lambda c: F.when(F.col(c) != (1 << 63) - 1, F.col(c)).alias(c)
    return each.select(null("doc_id"), null("class_id"), "class_size", "n_links", F.col("node").alias("text_md5"), F.col("label").alias("class_md5"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The documents (doc_id, text and all other columns) less all but one of each class: the least id stays, of several
    texts with that id the one of the least hash, of equal rows one."""
    found = shared.table(classes(docs, **options))
    own = F.col("doc_id").eqNullSafe(F.col("class_id"))
    head = found.groupBy("class_md5").agg(F.min(F.when(own, F.col("text_md5"))).alias("head"))
    each = found.groupBy("doc_id", "class_id", "class_md5", "text_md5").agg(F.count("*").alias("rows")).join(head, "class_md5")
    stays = own & (F.col("text_md5") == F.col("head"))
    out = shared.table(each.select(F.col("doc_id").alias("own_id"), "text_md5", stays.alias("stays"), "rows").where("not stays or rows > 1"))
    md5 = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    same = lambda x: docs["doc_id"].cast("long").eqNullSafe(x["own_id"]) & (md5 == x["text_md5"])
    listed = shared.sized(out, 16 << 20)
    kept = docs.join(listed, same(listed), "left_anti")
    again = out.where("stays")
    if not again.limit(1).count():
        return kept
    return kept.union(docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
