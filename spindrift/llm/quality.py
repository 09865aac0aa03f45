"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and perplexity thresholds by language.

The units are the bytes of UTF-8 text, the order is six. The model is fitted on the whole text of all trusted rows. Counts,
continuation counts, discounts and back-off weights come from joins of count tables, sharded by n-gram. The table that results
has a row for each distinct n-gram, of which new ones get ever rarer as text is added, and only then is sent to the
scorers; each document's perplexity takes all of its text. A join of every n-gram of every document with that table would
shuffle many times the input.

Thresholds cover all trusted rows. A model finds the text that it is fitted on too easy; so each half of the trusted rows, by
a hash of the id, is judged by a model of the other half as well. Of each language and class of length (powers of four bytes),
the bounds are the quantile HIGH of perplexity by the other half and the lesser of the quantiles LOW by that and by the
model of all, widened by MARGIN of their distance. Text of too many surprises is rejected, and so is text of too few,
as repetition makes it. A class of length of fewer than ENOUGH trusted rows uses those of its language. A language of fewer
has no model of its own but that of all languages, and the thresholds of all, widened to DEVIATIONS of its own few rows, so
that its clean texts aren't rejected for being rare.

Defined results: a null text is an empty one; an empty text has perplexity 1 and is rejected; a null language is one of
its own; null labels aren't trusted; a document with several labels is trusted if all are; repeated rows are judged each
for itself, alike; columns with clashing names stay with their table. With no trusted rows nothing is rejected. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from . import textkit as tk

U = np.uint64
ORDER = 6
LOW, HIGH, MARGIN, ENOUGH = 0.01, 0.99, 0.25, 200
#: Languages that may have a model of their own: those of the most trusted rows, each of ENOUGH or more.
LANGS = 120
#: Standard deviations of ln perplexity about the mean that a language of few trusted rows is allowed at least.
DEVIATIONS = 4
#: Bytes of text that are counted or scored at once, and new n-grams after which a task's counts are merged: a worker's arrays
#: are dozens of times as large, and stand beside an executor's full heap.
PIECE, MERGE = 1 << 18, 1 << 18
#: What n-grams of all languages together are filed under.
ALL = "*"


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of all texts, the ORDER bytes that end with it as a number, the last highest; offsets; body."""
    body, at = tk.raw(column)
    n = len(at) - 1
    wide = np.zeros(len(body) + (n + 1) * ORDER + 8, np.uint8)
    place = np.arange(len(body)) + np.repeat(np.arange(1, n + 1) * ORDER, np.diff(at))
    wide[place] = body
    eight = np.ndarray(shape=(len(wide) - 7,), dtype="<u8", buffer=wide, strides=(1,))
    return eight[place - (ORDER - 1)] & U((1 << 8 * ORDER) - 1), at, body


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each n-gram with its language's number in the highest byte, and how often the task's texts have it."""
    have, new = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        both, counts = (np.concatenate(x) for x in zip(*have))
        order = np.argsort(both, kind="stable")
        both, counts = both[order], counts[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        return both[first], np.add.reduceat(counts, first) if len(first) else counts

    for batch in shared.slices(batches, "text", PIECE):
        keys, at, _ = _padded(batch.column("text"))
        lang = np.repeat(batch.column("lang").to_numpy(zero_copy_only=False).astype(U), np.diff(at))
        have.append(np.unique(keys | lang << U(56), return_counts=True))
        new += len(have[-1][0])
        if new > max(MERGE, len(have[0][0])):  # merged now and then, so that a task holds little more than its n-grams
            have, new = [merged()], 0
    if have:
        key, c = merged()
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c)], ["key", "c"])


def discounts(c: DataFrame) -> list[float]:
    """Of counts of one, two, and three or more (Chen and Goodman), from the numbers of n-grams with counts of 1 to 4."""
    n = [0, *c.agg(*(F.coalesce(F.sum((F.col("c") == i).cast("long")), F.lit(0)) for i in range(1, 5))).first()]
    if not all(n[1:]):
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]


#: A language's number stands above the bytes of an n-gram.
_LANG, _BYTES = 0x7F << 56, (1 << 56) - 1


def fit(texts: DataFrame) -> Iterator[dict]:
    """For each order from one up: the keys and log2 probabilities of n-grams (p), and those of contexts' back-off weights (b).
    texts: text, lang (a number below 128)."""
    counts = texts.mapInArrow(_count, "key long, c long")
    levels = [shared.table(counts.groupBy("key").agg(F.sum("c").alias("c")))]
    tail = F.shiftright(F.col("key").bitwiseAND(F.lit(_BYTES)), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(_LANG)))
    for _ in range(ORDER - 1):  # how many different bytes stand before each
        levels.append(shared.table(levels[-1].groupBy(tail.alias("key")).agg(F.count("*").alias("c"))))
    below = None
    for k, c in enumerate(reversed(levels), 1):
        d1, d2, d3 = discounts(c)
        less = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1 | _LANG))
        w = W.partitionBy("context")
        rows = c.select("key", "c", context.alias("context")).withColumns({"n": F.sum("c").over(w), "b": F.sum(less).over(w)})
        rows = rows.select("key", "context", (F.col("b") / F.col("n")).alias("b"), ((F.col("c") - less) / F.col("n")).alias("own"))
        if below is None:
            p = rows.select("key", "context", "b", (F.col("own") + F.col("b") / 256).alias("p"))
        else:
            lower = below.select(F.col("key").alias("tail"), F.col("p").alias("lower"))
            p = rows.withColumn("tail", tail).join(lower, "tail").select("key", "context", "b", (F.col("own") + F.col("b") * F.col("lower")).alias("p"))
        below = shared.table(p)
        weights = below.groupBy(F.col("context").alias("key")).agg(F.log2(F.first("b")).cast("float").alias("v"))
        yield {"p": below.select("key", F.log2("p").cast("float").alias("v")).toArrow(), "b": weights.toArrow()}


class Model:
    """Log2 of the probability of each byte after the ORDER - 1 before it, by language."""

    def __init__(self, levels: Iterable[dict], langs: dict[str, int]) -> None:
        self.langs = langs
        self.levels = []
        for level in levels:
            self.levels.append([])
            for name in ("p", "b"):
                key, v = level[name]["key"].to_numpy().view(U), level[name]["v"].to_numpy()
                order = tk.hash_order(key)
                self.levels[-1] += [tk.Index(key[order]), v[order]]
            del level, key, v, order  # the next is made while none of this is held
            shared.give_back()

    def logs(self, keys: np.ndarray, lang: np.ndarray) -> np.ndarray:
        out, open_, tag = np.zeros(len(keys), np.float32), np.arange(len(keys)), lang.astype(U) << U(56)
        for k in range(ORDER, 0, -1):
            p, pv, b, bv = self.levels[k - 1]
            own = keys[open_] >> U(8 * (ORDER - k))
            at = p.find(own | tag[open_])
            found = at >= 0
            out[open_[found]] += pv[at[found]]
            open_, own = open_[~found], own[~found]
            if not len(open_):
                return out
            at = b.find(own & U((1 << 8 * (k - 1)) - 1) | tag[open_])
            here = at >= 0
            out[open_[here]] += bv[at[here]]
        out[open_] += -8  # a byte that no trusted text has
        return out


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in shared.slices(batches, "text", PIECE):
            keys, at, body = _padded(batch.column("text"))
            size = np.diff(at)
            lang = np.array([m.langs.get(x, m.langs.get(ALL, 0)) for x in batch.column("lang").to_pylist()])
            bits, who, whose = np.zeros(len(size)), tk.owner(at), np.repeat(lang, size)
            for a in range(0, len(keys), 1 << 16):
                s = slice(a, a + (1 << 16))
                bits -= np.bincount(who[s], weights=m.logs(keys[s], whose[s]), minlength=len(size))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(np.exp2(bits / np.maximum(size, 1))), pa.array(size)], [*(c for c in batch.schema.names if c != "text"), "perplexity", "n_bytes"])

    return run


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("quality")).where("quality = 1 and doc_id is not null").select("doc_id")


def length_class(n_bytes: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log2(F.greatest(n_bytes, F.lit(1)).cast("double")) / 2), F.lit(3)), F.lit(8)).cast("int")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), lang, perplexity, low, high, keep of each document. docs: doc_id, text, lang; labels:
    doc_id, quality."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("lang").alias("given"), F.coalesce("lang", F.lit("")).alias("lang"), F.hash(F.coalesce("text", F.lit(""))).alias("tag"))
    # ids only; the texts stay where they are unless these are very many
    trusted = shared.sized(shared.table(_trusted(labels)))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.octet_length("text").alias("n")).where("n > 0").join(trusted, "doc_id")
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()}
    if not sizes:
        return rows.select("doc_id", "tag", F.col("given").alias("lang"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(True).alias("keep"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    if sum(sizes.values()) < ENOUGH:  # so few that chance might leave a half empty
        few = sorted({r.doc_id for r in ids.select("doc_id").collect()}, key=lambda i: (i * 0x9E3779B97F4A7C15 & (1 << 64) - 1, i))
        half = F.col("doc_id").isin(few[: (len(few) + 1) // 2])
    text = rows.where(F.octet_length("text") > 0).join(trusted, "doc_id").withColumn("half", half)
    own = [lang for lang, n in sizes.items() if n >= ENOUGH]
    langs = {lang: i for i, lang in enumerate(own)}
    number = F.create_map(*(F.lit(x) for pair in langs.items() for x in pair))[F.col("lang")] if langs else F.lit(None)
    others = rows.where(~F.col("lang").isin(own)).limit(1).count() if own else 1
    if others:  # languages without a model of their own have the model of all
        langs[ALL] = len(langs)

    def judged(by: DataFrame, whom: DataFrame) -> DataFrame:
        """whom (doc_id, tag, given, lang, text) with its perplexity by a model of the texts `by`, n_bytes and size."""
        fitted = by.select("text", number.cast("int").alias("lang")).where("lang is not null")
        if others:
            fitted = fitted.union(by.select("text", F.lit(langs[ALL]).alias("lang")))
        model = shared.Sent(spark, Model(fit(fitted), langs))
        out = whom.select("doc_id", "tag", "given", "lang", "text").mapInArrow(_score(model), "doc_id long, tag int, given string, lang string, perplexity double, n_bytes long")
        out = shared.table(out.withColumn("size", length_class(F.col("n_bytes"))))
        model.destroy()
        return out

    scored = judged(text, rows)
    known = scored.join(trusted, "doc_id").where("n_bytes > 0").withColumn("fitted", F.lit(True))
    for mine in (F.col("half"), ~F.col("half")):
        if text.where(~mine).limit(1).count():
            known = known.unionByName(judged(text.where(~mine), text.where(mine)).withColumn("fitted", F.lit(None).cast("boolean")))
    known = known.select("lang", "size", "perplexity", "fitted")
    # copies of trusted rows are as easy for the model as these rows themselves: the lower end takes both
    ends = lambda p, mine: F.percentile_approx(F.when(F.col("fitted").isNotNull() if mine else F.col("fitted").isNull(), F.col("perplexity")), p, 10_000)
    q = F.array(F.least(ends(LOW, True), ends(LOW, False)), ends(HIGH, False))
    cuts = lambda keys: known.groupBy(*keys).agg(q.alias("q"), F.count(F.when(F.col("fitted").isNull(), 1)).alias("n"))
    by_both = cuts(["lang", "size"]).where(F.col("n") >= ENOUGH).select("lang", "size", F.col("q").alias("q2"))
    by_lang = cuts(["lang"]).where(F.col("n") >= ENOUGH).select("lang", F.col("q").alias("q1"))
    # few trusted rows: as far as they lie by their mean and deviation, and as the rows of all languages do
    log = F.ln("perplexity")
    rare = known.groupBy("lang").agg(F.avg(log).alias("m"), F.coalesce(F.stddev_samp(log), F.lit(0.0)).alias("sd"), F.count(F.when(F.col("fitted").isNull(), 1)).alias("n")).where(F.col("n") < ENOUGH).select("lang", F.array(F.exp(F.col("m") - DEVIATIONS * F.col("sd")), F.exp(F.col("m") + DEVIATIONS * F.col("sd"))).alias("q0"))
    overall = cuts([]).first()["q"]
    overall = overall if overall and overall[1] is not None else [0.0, 1e300]
    out = scored.join(by_both, ["lang", "size"], "left").join(by_lang, "lang", "left").join(rare, "lang", "left")
    of_all = F.array(F.least(F.lit(overall[0]), F.col("q0")[0]), F.greatest(F.lit(overall[1]), F.col("q0")[1]))
    q = F.coalesce("q2", "q1", of_all)
    wide = (q[1] - q[0]) * MARGIN
    out = out.select("doc_id", "tag", F.col("given").alias("lang"), "perplexity", (q[0] - wide).alias("low"), (q[1] + wide).alias("high"), "n_bytes")
    return out.withColumn("keep", (F.col("n_bytes") > 0) & F.col("perplexity").between(F.col("low"), F.col("high"))).drop("n_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.drop("tag")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    bad = judge(docs, labels).where("not keep").select("doc_id", "tag")
    return shared.without(docs, bad)
