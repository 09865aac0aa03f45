"""LM scoring by logistic context mixing over binary decisions.

A token is coded by the decisions on its way through a Huffman tree of the most frequent training tokens; one leaf stands
for all others, whose own share follows (below). Each decision is predicted from three contexts: the tree's node alone, the
node with the token before, and with the two before, the last two hashed into tables of counters. The logits of the
predictions are mixed by weights that a gate selects (depth in the tree, and how often each context was seen), and a table
of the contexts' joint states refines the mixture. Counters, weights and refinement come from all training documents, as
sums of integers, so that a score doesn't depend on how documents are spread over files and tasks. While a text is scored,
its own shift of the weights is learnt after 64, 192, 448 ... of its tokens, so that only what stands before affects a
prediction.

A training text's decisions are predicted as if their own counts weren't in the tables, as an online coder would that hasn't
seen the text yet: a text scores low in bits where others, or itself before, say the same. Tokens below the common leaf keep
their own count, as in the base.

Below the common leaf, a training token of count c has (1 - u)(c + 1) / (N' + V'), N' and V' the occurrences and kinds of
such tokens; u, for any unknown token, is the share of those that occur once (Good and Turing). Known tokens and one
"unknown" so share the probability 1, as they do in the add-one base.

What is gathered grows with the corpus: all tokens are counted; leaves grow as the square root of the training tokens, and
counters as table_bits() says.

Defined results: a null text is an empty one, of one token (the end); a null id trains; repeated rows are scored each for
itself, alike; other columns are not read. With no training documents every token is unknown. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textkit as tk

U = np.uint64
FOLDS, HELD = 7, 2
#: Leaves of the tree: so many times the square root of the number of training tokens. Tokens looked up: so many times those.
LEAVES_PER_ROOT, LOOKUP_PER_LEAF = 8, 4
BLOCK_BITS = 16
ORDERS = 2
END = U(0x8F1BBCDCBFA53E0B)
#: Classes of depth in the tree, and bins of a node's own logit (from -8 to 8) for the fit of the weights.
DEPTHS, BINS = 4, 16
PIECE = 4 << 20
#: Tokens whose decisions are worked on at once; the arrays then fit the cache. Places that are sorted before they are counted.
CHUNK, SORTED = 1 << 12, 1 << 22
FIRST = 64
INPUTS = 3


def trains(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of each text's words, A-Z lower-cased, and the end."""
    w = tk.words(column, lower=True)
    n = len(w.doc) - 1
    at = w.doc + np.arange(n + 1)
    out = np.empty(at[-1], dtype=U)
    ends = at[1:] - 1
    is_word = np.ones(len(out), dtype=bool)
    is_word[ends] = False
    out[is_word] = w.hashes()
    out[ends] = END
    return at, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in shared.slices(batches, "text", PIECE):
        token, c = np.unique(tokens(batch.column("text"))[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(c)], ["token", "c"])


def _states() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a pair of counters says: the state of each entry (n1 << 8 | n0), each state's logit, and its class of how often
    it was seen (0, 1 to 2, 3 to 9, more)."""
    n0, n1 = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
    n, t = n0 + n1, np.log((n1 + 0.4) / (n0 + 0.4))
    seen = np.digitize(n, (1, 3, 10))
    bins, width = np.array([1, 5, 9, 15]), np.array([1.0, 0.75, 0.7, 0.87])
    half = (bins[seen] - 1) // 2
    near = np.clip(np.round(t / width[seen]), -half, half).astype(np.int64)
    first = np.r_[0, np.cumsum(bins)]
    state = first[seen] + half + near
    logit = np.concatenate([(np.arange(k) - (k - 1) // 2) * w for k, w in zip(bins, width)])
    return state.astype(np.uint8), logit, np.repeat(np.arange(4), bins)


STATE, STATE_LOGIT, STATE_SEEN = _states()
STATES = len(STATE_LOGIT)


def _without() -> np.ndarray:
    """The states again, three times: of the entry itself, and of the entry less one count of bit 0, or of bit 1: what all
    other decisions say. An entry that is full (255) is scaled down, so that one count is next to nothing in it."""
    e = np.arange(1 << 16)
    n0, n1 = e & 255, e >> 8
    full = (n0 == 255) | (n1 == 255)
    less = [np.where(full, e, np.where(n > 0, e - step, e)) for n, step in ((n0, 1), (n1, 256))]
    return np.stack([STATE, *(STATE[x] for x in less)]).astype(np.uint16)


#: Bits of a state. A slot's three states fit one number, so that one look at a table gives whichever is asked for.
STATE_BITS = 5
SEEN_AS = np.bitwise_or.reduce(_without() << np.array([[0], [STATE_BITS], [2 * STATE_BITS]], np.uint16))
WIDE = 1 << STATE_BITS


def widened(by_state: np.ndarray) -> np.ndarray:
    """[depth, state, state] in rows of WIDE, as joined() counts them."""
    out = np.zeros((DEPTHS, WIDE, WIDE), by_state.dtype)
    out[:, :STATES, :STATES] = by_state.reshape(DEPTHS, STATES, STATES)
    return out.ravel()


@dataclass
class Model:
    """words: sorted hashes of the most frequent tokens; c their counts; leaf their leaves, or that of all others."""

    words: np.ndarray
    c: np.ndarray
    leaf: np.ndarray
    total: int
    kinds: int
    rest_total: int
    rest_kinds: int
    unknown: float
    code_at: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    node_logit: np.ndarray
    table_bits: int
    tables: np.ndarray | None = None  # [order, slot]: entries as _states() reads them
    mixed: np.ndarray | None = None  # [depth, state, state]: what the contexts add to the logit
    prior: np.ndarray | None = None  # the same: the weight of the node's own logit
    states: np.ndarray | None = None  # in workers, instead of the tables

    def __post_init__(self) -> None:
        # where the words begin whose hashes have the same 20 high bits
        self.first = np.searchsorted(self.words, np.arange((1 << 20) + 1, dtype=U) << U(44)).astype(np.int32) if len(self.words) else None
        if self.first is not None:
            self.first[-1] = len(self.words)
        self.size = np.diff(self.code_at)
        depth = np.minimum(np.arange(len(self.node)) - np.repeat(self.code_at[:-1], self.size), 4 * DEPTHS - 1) // 4
        # of a place in the codes: its node, depth and bit
        self.what = self.node.astype(np.uint32) << np.uint32(3) | depth.astype(np.uint32) << np.uint32(1) | self.bit.astype(np.uint32)
        self.near = np.clip(np.round(self.node_logit + BINS / 2), 0, BINS - 1).astype(np.uint8)

    @cached_property
    def node_hash(self) -> np.ndarray:
        return (self.node.astype(U) + U(1)) * tk.M2

    @cached_property
    def own_logit(self) -> np.ndarray:
        return self.node_logit[self.node]

    def __getstate__(self) -> dict:
        """Workers get the states of the tables' entries, not the entries."""
        return self.__dict__ | ({"tables": None, "states": self.seen_as()} if self.tables is not None else {})

    def __setstate__(self, given: dict) -> None:
        # what is unpickled lies in small pages; copies of large arrays don't, and are looked up faster
        self.__dict__.update((k, v.copy() if isinstance(v, np.ndarray) else v) for k, v in given.items())

    def seen_as(self) -> np.ndarray:
        """[order, slot]: the states as SEEN_AS has them."""
        return self.states if self.tables is None else SEEN_AS[self.tables]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and count (-1: not in the table) of each token."""
        leaf, count = np.full(len(h), len(self.size) - 1, np.int64), np.full(len(h), -1, np.int64)
        if self.first is not None:
            high = (h >> U(44)).astype(np.int64)
            at = self.first.take(high, mode="clip").astype(np.int64)
            # most words are the first of their bits
            here = self.words.take(at, mode="clip") == h
            np.copyto(leaf, self.leaf.take(at, mode="clip"), where=here)
            np.copyto(count, self.c.take(at, mode="clip"), where=here)
            open_ = np.flatnonzero(~here)
            at, end = at[open_] + 1, self.first[high[open_] + 1]
            while len(open_):
                on = at < end
                open_, at, end = open_[on], at[on], end[on]
                here = self.words[at] == h[open_]
                leaf[open_[here]], count[open_[here]] = self.leaf[at[here]], self.c[at[here]]
                open_, at, end = open_[~here], at[~here] + 1, end[~here]
        return leaf, count


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each leaf's decisions; their nodes (the root last made) and bits; and each node's logit of bit 1."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side, weight = [0] * (2 * n - 1), [0] * (2 * n - 1), [int(c) for c in counts] + [0] * (n - 1)
    logit = np.zeros(max(n - 1, 1))
    for k in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j], side[j] = k, k, 1
        weight[k] = a + b
        logit[k - n] = np.log((b + 0.5) / (a + 0.5))
        heapq.heappush(heap, (a + b, k))
    at, node, bit = [0], [], []
    for i in range(n):
        way, x = [], i
        while x < 2 * n - 2:
            way.append((parent[x] - n, side[x]))
            x = parent[x]
        for a, b in reversed(way):
            node.append(a), bit.append(b)
        at.append(len(node))
    return np.array(at), np.array(node, dtype=np.int64), np.array(bit, dtype=np.int8), logit.astype(np.float32)


def table_bits(tokens: int) -> int:
    """Counters (2 ** bits of each order) grow as the power 0.25 of the training tokens: 23 bits for 73 million, 24 for four
    thousand million. In proportion to the tokens they would outgrow any executor."""
    return max(12, round(0.25 * np.log2(max(tokens, 1)) + 16.4))


def packed(counts: np.ndarray) -> bytes:
    """Counters of 32 bits, their low bytes first: most others are zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def start(counts: DataFrame) -> Model:
    """The model without its tables. counts: token, c of all training documents. To the driver come as many rows as the square
    root of the number of training tokens asks for; leaves and tables grow with the corpus so."""
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    most = LEAVES_PER_ROOT * int(total**0.5) + 255
    top = counts.orderBy(F.desc("c"), "token").limit(LOOKUP_PER_LEAF * most).toArrow()
    words, c = top["token"].to_numpy().view(U), top["c"].to_numpy()
    leaves = min(most, len(words))
    rest_total, rest_kinds = total - int(c[:leaves].sum()), kinds - leaves
    least = int(c[leaves - 1]) if leaves else 0
    ones = counts.where("c = 1").count() if least > 1 or kinds > leaves else 0
    unknown = min(0.5, (ones + 1) / (rest_total + 2)) if rest_kinds else 1.0
    code = huffman(np.r_[c[:leaves], max(rest_total, 1)])
    leaf = np.minimum(np.arange(len(words)), leaves)
    order = np.argsort(words)
    return Model(words[order], c[order], leaf[order], int(total), int(kinds), rest_total, rest_kinds, unknown, *code, table_bits(int(total)))


def contexts(at: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Hashes of the token before each, and of the two before; beyond a text's beginning stand ends."""
    before = np.empty_like(h)
    before[:1], before[1:] = END, h[:-1]
    before[at[:-1]] = END
    second = np.empty_like(h)
    second[:1], second[1:] = END, before[:-1]
    second[at[:-1]] = END
    return [tk.mix(before * tk.M1), tk.mix(tk.mix(before * tk.M3) + second * tk.M1)]


def decisions(m: Model, leaf: np.ndarray, ctx: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """The number of each token's decisions; their Model.what and nodes; and their slots in the tables, order by order."""
    size = m.size[leaf]
    ends = np.cumsum(size)
    token = np.zeros(ends[-1], np.int64)
    if len(token):  # a tree of one leaf has no decisions, else each leaf has some
        token[ends[:-1]] = 1
        np.cumsum(token, out=token)
    d = (m.code_at[leaf] - ends + size).take(token, mode="clip")
    d += np.arange(len(d))
    what = m.what.take(d, mode="clip")
    node = np.right_shift(what, np.uint32(3), out=d, casting="unsafe")

    def slots() -> Iterator[np.ndarray]:
        node_hash, high = node.astype(U), np.empty(len(node), U)
        node_hash += U(1)
        node_hash *= tk.M2
        for c in ctx:
            x = c.take(token, mode="clip")
            x += node_hash
            np.right_shift(x, U(31), out=high)
            x ^= high
            x *= tk.M3
            x >>= U(64 - m.table_bits)
            yield x.view(np.int64)

    return size, what, node, slots()


class Places:
    """Counts places of an array. They are sorted first, SORTED at a time: the array is then gone through in order, not at random."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, self.held, self.n = counts, np.empty(SORTED, np.uint32 if len(counts) <= 1 << 32 else U), 0

    def add(self, places: np.ndarray) -> None:
        while len(places):
            part = places[: SORTED - self.n]
            self.held[self.n : self.n + len(part)] = part
            self.n, places = self.n + len(part), places[len(part) :]
            if self.n == SORTED:
                self.done()

    def done(self) -> None:
        held = self.held[: self.n]
        held.sort()
        for a in range(0, self.n, 1 << 16):
            np.add.at(self.counts, held[a : a + (1 << 16)].astype(np.int64), np.uint32(1))
        self.n = 0


def _fill(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        seen, any_, task = None, False, 0
        for batch in shared.slices(batches, "text"):
            if seen is None:
                seen = np.zeros((ORDERS, 2 << m.table_bits), dtype=np.uint32)
                places = [Places(x) for x in seen]
            at, h = tokens(batch.column("text"))
            leaf, ctx = m.find(h)[0], contexts(at, h)
            for a in range(0, len(h), CHUNK):
                _, what, _, slots = decisions(m, leaf[a : a + CHUNK], [c[a : a + CHUNK] for c in ctx])
                bit = what & np.uint32(1)
                for place, slot in zip(places, slots):
                    slot <<= 1
                    slot |= bit
                    place.add(slot)
            any_, task = True, batch.column("task")[0].as_py()
        if any_:
            for place in places:
                place.done()
            del places, place
            width = min(2 << BLOCK_BITS, 2 << m.table_bits)
            for k in range(ORDERS):
                for b, part in enumerate(seen[k].reshape(-1, width)):
                    if part.any():
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b], pa.int32()), pa.array([task], pa.int32()), pa.array([packed(part)], pa.binary())], ["k", "block", "task", "seen"])

    return run


def _sum(rows: pa.Table) -> pa.Table:
    total = None
    for x in rows["seen"]:
        data = unpacked(x.as_py())
        total = data.astype(np.int64) if total is None else total + data
    total = np.minimum(total, 0xFFFFFFFF)
    return pa.table({"k": rows["k"][:1], "block": rows["block"][:1], "task": pa.array([rows["task"][0].as_py() // 64], pa.int32()), "seen": pa.array([packed(total)], pa.binary())})


def entries(counts: np.ndarray) -> np.ndarray:
    """Counts [slot, 2] as 16 bits; where one is above 255, both are scaled down alike."""
    most = np.maximum(counts.max(axis=1), 1)
    scaled = np.where(most[:, None] > 255, np.ceil(counts * (255.0 / most[:, None])), counts).astype(np.uint16)
    return scaled[:, 0] | scaled[:, 1] << 8


def fill(m: Model, rows: DataFrame) -> np.ndarray:
    """Both tables' entries, from all rows (text) of training documents. Tasks' counts are summed 64 at a time, in as many
    rounds as that takes, so that no group grows with the corpus."""
    spark = rows.sparkSession
    given = rows.select("text", F.spark_partition_id().alias("task"))
    schema = "k int, block int, task int, seen binary"
    parts = shared.table(given.mapInArrow(_fill(shared.Sent(spark, m)), schema))
    most = parts.agg(F.max("task")).first()[0] or 0
    while True:
        parts = parts.groupBy("k", "block", (F.col("task") / 64).cast("int").alias("group")).applyInArrow(_sum, schema)
        most //= 64
        if not most:
            break
    out = np.zeros((ORDERS, 1 << m.table_bits), dtype=np.uint16)
    for r in parts.toLocalIterator():
        counts = unpacked(bytes(r.seen)).reshape(-1, 2)
        out[r.k, r.block * len(counts) : (r.block + 1) * len(counts)] = entries(counts)
    return out


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def joined(states: np.ndarray, slots: Iterator[np.ndarray], what: np.ndarray, learnt: np.ndarray | None) -> np.ndarray:
    """The joint state of each decision's contexts and its depth, in rows of WIDE. states: seen_as(); what: Model.what of the
    decisions; learnt: 1 where the decision's own count is to be left out, 0 where the tables don't hold it; None: all 1."""
    left_out = (what & np.uint32(1)).astype(np.uint16)
    left_out += np.uint16(1)
    left_out *= np.uint16(STATE_BITS)
    if learnt is not None:
        left_out *= learnt
    out = (what & np.uint32(2 * DEPTHS - 2)).astype(np.uint16)
    out <<= np.uint16(2 * STATE_BITS - 1)
    for k, slot in enumerate(slots):
        s = states[k].take(slot, mode="clip")
        s >>= left_out
        s &= np.uint16(WIDE - 1)
        if not k:
            s <<= np.uint16(STATE_BITS)
        out |= s
    return out


def _census(model):
    """How often each bit follows each joint state and bin of the node's own logit: integers, whose sums don't depend on how
    documents are spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = model.value, np.zeros(DEPTHS * WIDE * WIDE * BINS * 2, np.int64)
        states = m.seen_as()
        for batch in shared.slices(batches, "text"):
            at, h = tokens(batch.column("text"))
            leaf, ctx = m.find(h)[0], contexts(at, h)
            for a in range(0, len(h), CHUNK):
                _, what, node, slots = decisions(m, leaf[a : a + CHUNK], [c[a : a + CHUNK] for c in ctx])
                cell = joined(states, slots, what, None).astype(np.int64)
                cell *= BINS
                cell += m.near.take(node, mode="clip")
                cell *= 2
                cell += what & np.uint32(1)
                np.add.at(seen, cell, 1)
        seen = seen.reshape(DEPTHS, WIDE, WIDE, BINS * 2)[:, :STATES, :STATES].ravel()
        cells = np.flatnonzero(seen)
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(seen[cells])], ["cell", "n"])

    return run


def learn(m: Model, model: shared.Sent, rows: DataFrame) -> None:
    """The mixture's weights, from all training documents, each decision seen as if its own count weren't there. What comes
    back has a fixed size: the weights of each gate (depth, and how often each context was seen) are a logistic regression
    on it. Then each joint state's own error is taken back, as far as its counts bear that out (the refinement)."""
    got = rows.select("text").mapInArrow(_census(model), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(DEPTHS * STATES * STATES * BINS * 2)
    cells[got["cell"].to_numpy()] = got["n"].to_numpy()
    n = cells.reshape(DEPTHS, STATES, STATES, BINS, 2)
    joint = np.indices(n.shape[:4]).reshape(4, -1)
    gate = (joint[0] * 4 + STATE_SEEN[joint[1]]) * 4 + STATE_SEEN[joint[2]]
    x = np.stack([joint[3] - BINS / 2, STATE_LOGIT[joint[1]], STATE_LOGIT[joint[2]], np.ones(joint.shape[1])], axis=1)
    n = n.reshape(-1, 2)
    some = np.flatnonzero(n.sum(axis=1))
    first, ridge = np.array([0.6, 0.3, 0.5, 0.0]), 50.0
    w = np.tile(first, (DEPTHS * 16, 1))
    pick, own = x[some], gate[some]
    total, ones = n[some].sum(axis=1), n[some, 1]
    for _ in range(15):  # Newton's steps, held near the first weights where there is little to learn from
        p = squash(np.clip((pick * w[own]).sum(axis=1), -12, 12))
        slope = np.stack([np.bincount(own, pick[:, i] * (ones - total * p), len(w)) for i in range(4)], axis=1) - ridge * (w - first)
        bend = np.stack([np.bincount(own, pick[:, i] * pick[:, j] * total * p * (1 - p), len(w)) for i in range(4) for j in range(4)], axis=1).reshape(-1, 4, 4) + ridge * np.eye(4)
        w = w + np.clip(np.linalg.solve(bend, slope[:, :, None])[:, :, 0], -0.5, 0.5)
    p = squash(np.clip((x * w[gate]).sum(axis=1), -12, 12))
    by = lambda v: v.reshape(-1, BINS).sum(axis=1)
    error, spread = by(n[:, 1] - n.sum(axis=1) * p), by(n.sum(axis=1) * p * (1 - p))
    without = x.copy()
    without[:, 0] = 0
    mixed = (without * w[gate]).sum(axis=1).reshape(-1, BINS)[:, 0]
    m.mixed = (mixed + np.clip(error / (spread + 20), -2, 2)).astype(np.float32)
    m.prior = w[gate][:, 0].reshape(-1, BINS)[:, 0].astype(np.float32)


def text_bits(m: Model, at: np.ndarray, h: np.ndarray, leaf: np.ndarray, trains: np.ndarray | None = None) -> np.ndarray:
    """Bits of each text's decisions. trains: whether the tables hold the text's own counts, which are then left out."""
    n = len(at) - 1
    out, text = np.zeros(n), tk.owner(at)
    # stretches of tokens between refinements: [0, 64), [64, 192), ...
    stage = np.log2((np.arange(len(h)) - at[text]) // FIRST + 1).astype(np.int8)
    order = np.argsort(stage, kind="stable")
    stages = np.searchsorted(stage[order], np.arange(int(stage.max()) + 2 if len(h) else 1))
    text, leaf, ctx = text[order], leaf[order], [c[order] for c in contexts(at, h)]
    own = np.zeros((INPUTS, n), np.float32)
    learnt = np.zeros(n, np.uint16) if trains is None else trains.astype(np.uint16)
    states, mixing, prior = m.seen_as(), widened(m.mixed), widened(m.prior)
    for s, (lo, hi) in enumerate(zip(stages[:-1].tolist(), stages[1:].tolist())):
        last = s == len(stages) - 2
        gradient, count = np.zeros((INPUTS, n)), np.zeros(n)
        for a in range(lo, hi, CHUNK):
            b = min(a + CHUNK, hi)
            size, what, node, slots = decisions(m, leaf[a:b], [c[a:b] for c in ctx])
            ends = np.cumsum(size)
            # one row for each text: its first token here, its first decision, and how many it has
            first = np.flatnonzero(np.r_[True, text[a + 1 : b] != text[a : b - 1]])
            who, starts = text[a:b][first], (ends - size)[first]
            many = np.diff(np.r_[starts, ends[-1]])
            state = joined(states, slots, what, np.repeat(learnt[who], many)).astype(np.int64)
            x, y = mixing.take(state, mode="clip"), prior.take(state, mode="clip")
            y *= m.node_logit.take(node, mode="clip")
            mixed = x + y
            if s:
                mixed += np.repeat(own[0][who], many) * x
                mixed += np.repeat(own[1][who], many) * y
                mixed += np.repeat(own[2][who], many)
            np.clip(mixed, -12, 12, out=mixed)
            # with the sign of what didn't happen
            flip = what << np.uint32(31)
            mixed.view(np.uint32)[:] ^= flip
            odds = np.exp(mixed, out=mixed)
            cost = odds + np.float32(1)
            rest = None if last else odds / cost
            np.log(cost, out=cost)
            out[who] += np.add.reduceat(cost, starts, dtype=np.float64)
            if not last:
                rest.view(np.uint32)[:] ^= flip ^ np.uint32(1 << 31)
                count[who] += many
                for i, z in enumerate((x, y, None)):
                    gradient[i, who] += np.add.reduceat(rest if z is None else rest * z, starts, dtype=np.float64)
        own += (0.3 * gradient / (count + 200)).astype(np.float32)
    return out / np.log(2)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in shared.slices(batches, "text"):
            at, h = tokens(batch.column("text"))
            leaf, c = m.find(h)
            known, rest = c >= 0, (c >= 0) & (leaf == len(m.size) - 1)
            text = tk.owner(at)
            # of no tokens, bincount gives integers
            add = lambda pick, value: np.bincount(text[pick], weights=value, minlength=len(at) - 1).astype(np.float64)
            logs = np.log10(np.maximum(c, 0) + 1.0)
            # tokens that the table lacks, once for each text, with their number
            lack = np.flatnonzero(~known)
            own, rare = text[lack], h[lack]
            order = np.lexsort((rare, own))
            own, rare = own[order], rare[order]
            first = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (own[1:] != own[:-1])]) if len(rare) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(rare)]).astype(np.int32)
            edges = pa.array(np.searchsorted(own[first], np.arange(len(at))).astype(np.int32))
            columns = {"doc_id": batch.column("doc_id"), "tag": batch.column("tag"), "n_tokens": pa.array(np.diff(at)), "known": pa.array(add(known, None).astype(np.int64)), "logs": pa.array(add(known, logs[known])), "rest": pa.array(add(rest, None).astype(np.int64)), "rest_logs": pa.array(add(rest, logs[rest])), "bits": pa.array(text_bits(m, at, h, leaf, batch.column("trains").to_numpy(zero_copy_only=False))), "n_bytes": pa.array(shared.lengths(batch.column("text"))), "rare": pa.ListArray.from_arrays(edges, pa.array(rare[first].view(np.int64))), "times": pa.ListArray.from_arrays(edges, pa.array(times))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bits_per_byte of each document."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    small = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(small)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), trains(F.col(doc_id)).alias("trains"))
    rows = rows.withColumn("tag", F.hash("text"))
    training = rows.where("trains")
    counts = shared.table(training.select("text").mapInArrow(_count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")))
    m = start(counts)
    m.tables = fill(m, training)
    model = shared.Sent(spark, m)
    learn(m, model, training)
    model.destroy()
    model = shared.Sent(spark, m)
    each = rows.select("doc_id", "tag", "text", "trains").mapInArrow(_score(model), "doc_id long, tag int, n_tokens long, known long, logs double, rest long, rest_logs double, bits double, n_bytes long, rare array<long>, times array<int>")
    each = shared.table(each)
    model.destroy()
    # equal rows lack the same tokens: their sums are shared out among them
    copies = each.groupBy("doc_id", "tag").agg(F.count("*").alias("copies"))
    rare = each.select("doc_id", "tag", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("doc_id", "tag", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    found = rare.join(counts, "token", "left").groupBy("doc_id", "tag").agg(F.sum("times").alias("lacking"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times") * F.log10(F.col("c") + 1)).otherwise(0.0)).alias("more_logs"))
    found = found.join(copies, ["doc_id", "tag"]).select("doc_id", "tag", *(F.expr(f"{c} div copies").alias(c) for c in ("lacking", "more")), (F.col("more_logs") / F.col("copies")).alias("more_logs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = each.drop("rare", "times").join(found, ["doc_id", "tag"], "left").select("*", zero("lacking").alias("l"), zero("more").alias("k"), F.coalesce("more_logs", F.lit(0.0)).alias("kl"))
    base = F.col("logs") + F.col("kl") - F.col("n_tokens") * F.log10(F.lit(float(m.total + m.kinds + 1)))
    share = float(np.log10((1 - m.unknown) / max(m.rest_total + m.rest_kinds, 1))) if m.unknown < 1 else 0.0
    own = F.col("rest_logs") + F.col("kl") + (F.col("rest") + F.col("k")) * share + (F.col("l") - F.col("k")) * float(np.log10(m.unknown))
    result = own - F.col("bits") * float(np.log10(2))
    out = joined.select(F.when(F.col("doc_id") != small, F.col("doc_id")).alias("doc_id"), "n_tokens", (F.col("known") + F.col("k")).alias("n_known"), F.lit(m.total).cast("long").alias("train_tokens"), base.alias("base_score"), result.alias("score"), "n_bytes")
    out = out.withColumn("held_out", ~trains(F.col("doc_id"))).withColumn("bits", -F.col("score") / float(np.log10(2)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits", (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
