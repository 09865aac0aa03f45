"""URL filters: listed rules first; elsewhere two variable-order Markov models of characters, for accepted and rejected URLs.

URLs that a rule decides are the examples. A model gives a character's probability after up to ORDER characters by
Witten-Bell smoothing: at each order, the share that the context's distinct successors take goes to the next shorter
context, down to a uniform distribution. A URL's score is the log-likelihood of rejected less that of accepted, over its
length. The threshold is calibrated on every fifth labelled text, which the models don't see: midway between the medians
of both classes' scores. A score above it blocks.

What is modelled is host and path: the rules speak of those, queries and fragments hold what tells visits apart.

Scores are summed in whole millionths, so that results don't depend on the order of rows. Only DataFrame functions run.

Defined results: a null URL, or one without ://, has an empty host and path; repeated rows are judged each for itself, alike;
a null id stays null; other columns are not read. If one class has no examples, the other's verdict is given; with
neither, all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

ORDER = 4
#: Every so many-th labelled text, by hash, calibrates.
HOLD = 5
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables of n-grams are broadcast up to this many bytes of files; beyond it, they are joined by shuffles.
TABLE_BYTES = 8 << 20


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict: of the longest rule that fits, else null. The rules are a list of the caller's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(text: Column) -> Column:
    """Each character with the ORDER before it; an end mark counts as one."""
    padded = F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substring(padded, i, ORDER + 1))


def model(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, llr: millionths of the log-likelihood ratio of each n-gram's last character. texts: text, side (1 rejected, 0
    accepted, null neither)."""
    one = lambda side: F.sum(F.when(F.col("side") == side, 1).otherwise(0))
    counts = shared.table(texts.select(F.explode(grams(F.col("text"))).alias("gram"), "side").groupBy("gram").agg(one(1).alias("b"), one(0).alias("a")))
    all_b, all_a = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    out = counts.select("gram").withColumns({"pb": F.lit(1 / 65536), "pa": F.lit(1 / 65536)})
    for k in range(order + 1):
        own = counts.groupBy(F.expr(f"right(gram, {k + 1})").alias("tail")).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
        totals = [F.sum("b").alias("nb"), F.sum("a").alias("na"), F.sum((F.col("b") > 0).cast("long")).alias("tb"), F.sum((F.col("a") > 0).cast("long")).alias("ta")]
        if k:
            head = own.groupBy(F.expr(f"left(tail, {k})").alias("head")).agg(*totals)
            both = own.withColumn("head", F.expr(f"left(tail, {k})")).join(head, "head").drop("head")
        else:
            nb, na, tb, ta = own.agg(*totals).first()
            both = own.withColumns({"nb": F.lit(nb or 0), "na": F.lit(na or 0), "tb": F.lit(tb or 0), "ta": F.lit(ta or 0)})
        smooth = lambda n, c, t, p: F.when(F.col(c) > 0, (F.col(n) + F.col(t) * F.col(p)) / (F.col(c) + F.col(t))).otherwise(F.col(p))
        out = out.withColumn("tail", F.expr(f"right(gram, {k + 1})")).join(both, "tail").withColumns({"pb": smooth("b", "nb", "tb", "pb"), "pa": smooth("a", "na", "ta", "pa")}).select("gram", "pb", "pa")
    return out.select("gram", F.round(F.log(F.col("pb") / F.col("pa")) * 1_000_000).cast("long").alias("llr"))


def judge(pages: DataFrame, url: str = "url", page_id: str = "page_id", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score (null where a rule decides)."""
    rules = RULES if rules is None else rules
    host, path = parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("by", rule_of(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    # equal texts are scored once, however many pages have them
    texts = shared.table(rows.groupBy("text").agg(F.first("by").getField("verdict").alias("verdict"), F.count("*").alias("n")))
    side = F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", 0)
    held = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(HOLD)) == 0
    llr = shared.sized(shared.table(model(texts.select("text", F.when(~held, side).alias("side")))), TABLE_BYTES)
    scored = texts.select("text", F.explode(grams(F.col("text"))).alias("gram")).join(llr, "gram").groupBy("text").agg((F.sum("llr") / F.count("*") / 1e6).alias("score"))
    scored = shared.table(scored.join(texts.select("text", side.alias("side"), held.alias("held")), "text"))
    t = threshold(scored)
    each = spread(rows, scored.join(texts.select("text", "n"), "text").select("text", "score", "n"))
    return each.select("page_id", "url", "host", "path", F.col("by.rule").alias("rule"), F.coalesce(F.col("by.verdict"), F.when(F.col("score") > t, "block").otherwise("allow")).alias("verdict"), F.when(F.col("by").isNull(), F.col("score")).alias("score"))


def spread(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """rows with their texts' scores. Texts that more than a thousandth of the rows have (the empty one of null URLs, say) are
    fewer than a thousand: they are looked up where the rows lie, and only the others' rows are shuffled. scored: text,
    score, n (rows that have it)."""
    scored = shared.table(scored)
    least = (scored.agg(F.sum("n")).first()[0] or 0) / 1000
    hot = scored.where(F.col("n") > least).select(F.col("text").alias("hot_text"), F.col("score").alias("hot_score"))
    near = rows.join(F.broadcast(hot), F.col("text") == F.col("hot_text"), "left")
    some = near.where("hot_text is null").drop("hot_text", "hot_score").join(scored.where(F.col("n") <= least).select("text", "score"), "text", "left")
    return near.where("hot_text is not null").drop("hot_text").withColumnRenamed("hot_score", "score").unionByName(some)


def threshold(scored: DataFrame) -> float:
    """Midway between the medians of both classes' held-out scores: a few examples unlike their class don't move it.
    scored: side, held, score."""
    got = {r.side: r.m for r in scored.where("held and side is not null").groupBy("side").agg(F.percentile_approx("score", 0.5, 10_000).alias("m")).collect()}
    if not got.keys() >= {0, 1}:
        seen = {r.side for r in scored.where("side is not null").select("side").distinct().collect()}
        return 0.0 if seen == {0, 1} else -1e300 if seen == {1} else 1e300
    return (got[1] + got[0]) / 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")
