"""Document fingerprints: SimHash of 128 bits, with permuted block tables to find those within a Hamming radius.

Terms are runs of five words (all words, where a text has fewer), each once for every place it stands. A term's weight
grows with its length in characters, from 1 to 8: longer terms are rarer. Two 64-bit hashes of a term vote with its weight
on 128 signed bits; a bit is 1 where the sum is above zero. A text's sums hold two bits' counts in their halves, so that one
of up to 2 ** 28 terms can't overflow.

near_pairs() cuts the distinct fingerprints into radius + 2 blocks. Two fingerprints that differ in at most `radius`
bits agree in two blocks at least, so that a table for each pair of blocks, keyed by both, finds all of them. A bucket of
more than CROWDED is split again, by each of radius + 1 parts of the bits: one of them agrees too.

Only DataFrame functions run here. Defined results: a null text is an empty one; a text without words has all bits 0; a
null id comes last in the order of documents, equal ids in the order of their texts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE, RADIUS = 5, 3
#: Fingerprints in one table's bucket beyond which it is split by further bits.
CROWDED = 64
#: Documents are put into ranges of ids of about so many; never more ranges than RANGES * INNER.
ROWS, RANGES, INNER = 1000, 256, 256
#: A sum holds the counts of every LANE-th bit of a hash, 16 bits each: STRETCH terms of weight 8 stay below the sign. Two such
#: sums make the PAIRs of 32 bits in which a whole text's counts are added.
LANE, LANES, PAIR = 16, 0x0001000100010001, 0x0000FFFF0000FFFF
STRETCH = 4095


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def terms(text: Column) -> Column:
    """For each run of five words, a hash with the term's weight less 1 in its three lowest bits."""

    def words(w: Column) -> Column:  # a hash, with the length in its six lowest bits
        return F.xxhash64(w).bitwiseAND(F.lit(~63)).bitwiseOR(F.least(F.char_length(w), F.lit(63)).cast("long"))

    def runs(h: Column) -> Column:
        # past the end, where a text has fewer words, get() gives null, which the hash skips
        def run(i: Column) -> Column:
            five = [F.get(h, i + j) for j in range(SHINGLE)]
            length = sum((F.coalesce(x.bitwiseAND(F.lit(63)), F.lit(0)) for x in five[1:]), five[0].bitwiseAND(F.lit(63)))
            return F.xxhash64(*five).bitwiseAND(F.lit(~7)).bitwiseOR(F.least(F.shiftright(length, 4), F.lit(7)))

        return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - SHINGLE, F.lit(0))), run)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), words), runs)


def half(h: str) -> Column:
    """The 64 bits that the sums of one hash decide."""
    total, bits = F.coalesce(F.col("total"), F.lit(0)), F.lit(0).cast("long")
    for k in range(LANE):
        for j in range(2):
            s = F.coalesce(F.col(f"{h}_{k}_{j}"), F.lit(0))
            for value, bit in ((s.bitwiseAND(F.lit(0xFFFFFFFF)), k + LANE * j), (F.shiftrightunsigned(s, 32), k + LANE * j + 32)):
                bits = bits.bitwiseOR(F.when(2 * value > total, F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return bits


def fingerprint(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, hi, lo: the two halves of each text's fingerprint. Rows that agree in all keys count as one text.

    A stretch of STRETCH terms of one row is summed four bits to a number, which halves the sums that each term is added to;
    then stretches are added up, two bits to a number."""
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # before its terms become rows
    exploded = numbered.select(*keys, "row", F.posexplode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("place", "term"))
    stretch = F.floor(F.coalesce(F.col("place"), F.lit(0)) / STRETCH).cast("int")
    hashed = exploded.select(*keys, "row", stretch.alias("stretch"), F.xxhash64("term").alias("h1"), F.xxhash64(F.lit(1), "term").alias("h2"), F.col("term").bitwiseAND(F.lit(7)).alias("w"))
    weight = F.col("w") + 1
    hashes = [(h, k) for h in ("h1", "h2") for k in range(LANE)]
    parts = hashed.groupBy(*keys, "row", "stretch").agg(*(F.sum(F.shiftrightunsigned(F.col(h), k).bitwiseAND(F.lit(LANES)) * weight).alias(f"{h}_{k}") for h, k in hashes), F.sum(weight).alias("total"))
    sums = [F.sum(F.shiftrightunsigned(F.col(f"{h}_{k}"), LANE * j).bitwiseAND(F.lit(PAIR))).alias(f"{h}_{k}_{j}") for h, k in hashes for j in range(2)]
    return parts.groupBy(*keys).agg(*sums, F.sum("total").alias("total")).select(*keys, half("h1").alias("hi"), half("h2").alias("lo"))


def digits(hi: Column, lo: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a_hi, a_lo, b_hi, b_lo, distance: all pairs of distinct fingerprints (hi, lo) that differ in at most `radius` bits, each
    once. Equal fingerprints stand for one another: join them back by hi and lo."""
    blocks = radius + 2
    edges = [round(i * 128 / blocks) for i in range(blocks + 1)]
    one = prints.select("hi", "lo").distinct()

    def bits(a: int, b: int) -> list[Column]:
        out = []
        for word, base in ((F.col("hi"), 0), (F.col("lo"), 64)):
            x, y = max(a, base) - base, min(b, base + 64) - base
            if x < y:
                mask = ((1 << (y - x)) - 1) << (64 - y)
                out.append(word.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        return out

    tables = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *bits(edges[i], edges[i + 1]), *bits(edges[j], edges[j + 1])).alias("key")) for t, (i, j) in enumerate(combinations(range(blocks), 2))]
    keyed = one.withColumn("k", F.explode(F.array(*tables))).select("hi", "lo", "k.t", "k.key")
    # keys that one fingerprint has alone, most of them, are dropped before the join; that takes the exchange which the join needs anyway
    several = keyed.withColumn("n", F.count("*").over(W.partitionBy("t", "key"))).where("n > 1")
    # a crowded bucket is split: of what a pair's other bits are cut into, radius + 1 parts, one at least agrees
    parts = [round(i * 128 / (radius + 1)) for i in range(radius + 2)]
    finer = F.array(*(F.xxhash64(F.lit(i), "key", *bits(x, y)) for i, (x, y) in enumerate(zip(parts, parts[1:]))))
    several = several.withColumn("key", F.explode(F.when(F.col("n") > CROWDED, finer).otherwise(F.array("key")))).drop("n")
    a, b = (several.select("t", "key", F.col("hi").alias(f"{x}_hi"), F.col("lo").alias(f"{x}_lo")) for x in "ab")
    pairs = a.join(b, ["t", "key"]).where("a_hi < b_hi or (a_hi = b_hi and a_lo < b_lo)").withColumn("distance", distance(*map(F.col, ("a_hi", "a_lo", "b_hi", "b_lo"))))
    return pairs.where(F.col("distance") <= radius).select("a_hi", "a_lo", "b_hi", "b_lo", "distance").distinct()


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """range, doc_id, text, extra: documents in ranges of ids. The first document of each range stands also, as `extra`, at
    the end of the range before it (the very first: of the last range), so that each has its successor at hand.

    The ranges: RANGES quantiles of the ids, each cut evenly. What comes to the driver is those quantiles; the table of
    ranges that is broadcast has at most RANGES * INNER rows of a few numbers."""
    from . import shared

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    count, *_ = ids.agg(F.count("*")).first()
    outer = min(RANGES, max(1, count // ROWS))
    inner = min(INNER, max(1, count // ROWS // outer))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / outer for i in range(outer + 1)], 10_000)).first()[0] or [0]
    cuts = sorted(set(cuts))
    edges = F.array(*(F.lit(c) for c in cuts))
    # null ids: after all ranges
    i = F.greatest(F.size(F.filter(edges, lambda c: c <= F.col("doc_id"))), F.lit(1))
    lo, hi = F.element_at(edges, i), F.coalesce(F.try_element_at(edges, i + 1), F.lit(cuts[-1] + 1))
    part = F.least(F.greatest(F.floor((F.col("doc_id") - lo).cast("double") * inner / (hi - lo)), F.lit(0)), F.lit(inner - 1))
    ranged = F.when(F.col("doc_id").isNull(), F.lit((len(cuts) + 1) * inner)).otherwise(i * inner + part).cast("long").alias("range")
    first = ids.groupBy(ranged).agg(F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("first_id"))
    first = shared.table(first).coalesce(1)
    w = W.orderBy("range")
    first = first.select("range", "first_id", F.lag("range").over(w).alias("before"), F.max("range").over(W.partitionBy()).alias("last"))
    first = first.select("range", "first_id", F.coalesce("before", "last").alias("before"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("range", ranged)
    joined = rows.join(F.broadcast(first), "range")
    places = F.when(F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("first_id"), F.array(F.struct(F.col("range"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("range"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("extra"))))
    return joined.withColumn("place", F.explode(places)).select("place.range", "place.extra", "doc_id", "text")


def edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """range, rn, extra, doc_id, text, edited: the last half of each text replaced by the beginning of the next one's."""
    w = W.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_last(), "text")
    n = F.char_length("text")
    half_n = F.floor(n / 2).cast("int")
    rows = in_order(docs, doc_id, text).withColumn("next_text", F.lead("text").over(w)).withColumn("rn", F.row_number().over(w))
    # extra rows are the ends of their ranges: they have no successor there, nor need one
    return rows.withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("substring(coalesce(next_text, ''), 1, cast(floor(char_length(text) / 2) as int))"))).drop("next_text")


def compare(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document. After the
    exchange by ranges of ids, all steps keep that partitioning."""
    base = edited(docs, text, doc_id)
    info = base.select("range", "rn", "extra", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v"))
    info = info.select("range", "rn", "extra", "doc_id", "n_chars", "edited_sha256", "v.which", "v.text").where("not (extra and which = 1)")
    keys = ["range", "rn", "extra", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprint(info, [*keys, "which"], "text")
    pick = lambda c, which: F.max(F.when(F.col("which") == which, F.col(c)))
    both = prints.groupBy(*keys).agg(pick("hi", 0).alias("hi"), pick("lo", 0).alias("lo"), pick("hi", 1).alias("e_hi"), pick("lo", 1).alias("e_lo"))
    w = W.partitionBy("range").orderBy("rn")
    both = both.withColumn("next_hi", F.lead("hi").over(w)).withColumn("next_lo", F.lead("lo").over(w)).where("not extra")
    like = lambda x: (1 - distance(F.col("hi"), F.col("lo"), F.col(f"{x}_hi"), F.col(f"{x}_lo")) / 128).cast("double")
    return both.select("doc_id", "n_chars", "edited_sha256", "hi", "lo", digits(F.col("hi"), F.col("lo")).alias("fingerprint"), digits(F.col("e_hi"), F.col("e_lo")).alias("edited_fingerprint"), like("e").alias("near_edited"), like("next").alias("near_next"))


def with_near(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints with n_near: other distinct fingerprints within the radius."""
    pairs = near_pairs(prints, radius)
    each = pairs.select(F.explode(F.array(*(F.struct(F.col(f"{x}_hi").alias("hi"), F.col(f"{x}_lo").alias("lo")) for x in "ab"))).alias("p")).groupBy("p.hi", "p.lo").agg(F.count("*").alias("n_near"))
    return prints.join(each, ["hi", "lo"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shared

    prints = shared.table(compare(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    found = with_near(prints)
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")
