"""Whether records are what was written: canonical forms, hash chains plain and keyed, ledgers, signed posts, audits."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sequence


def pads(key: bytes) -> tuple[str, str]:
    """The inner and outer pads of HMAC-SHA-256, in hexadecimal digits."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of text, in the JVM: lower-case hexadecimal digits."""
    inner, outer = (F.unhex(F.lit(p)) for p in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def canonical(json: Column) -> Column:
    """JSON text with its keys sorted and no blanks; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def embedded_json(text: Column) -> Column:
    """What stands from the first { to the last } of a text, if it is JSON."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def verify_all(signed: DataFrame, steps: DataFrame, seed: Column, key: bytes | None = None) -> DataFrame:
    """trace_id, verdict, step: intact, tampered, unsigned, or for keyed chains intact-keyed, wrong-key (already the first hash
    differs) and keyed (no key is given). signed: trace_id, hashes, keyed."""
    plain = signed.where("not keyed").select("trace_id", "hashes")
    own = sequence.tampered(plain, steps, seed)
    with_key = signed.where("keyed").select("trace_id", "hashes")
    rest = own.join(with_key.select("trace_id"), "trace_id", "left_anti")
    if key is None:
        return rest.unionByName(with_key.select("trace_id", F.lit("keyed").alias("verdict"), F.lit(None).cast("long").alias("step")))
    judged = sequence.tampered(with_key, steps.join(with_key.select("trace_id"), "trace_id", "left_semi"), seed, lambda m: hmac(key, m))
    verdict = F.when(F.col("verdict") == "intact", "intact-keyed").when(F.col("step") == 0, "wrong-key").otherwise(F.col("verdict"))
    return rest.unionByName(judged.withColumn("verdict", verdict))


def tally(verdicts: DataFrame, strict: bool = False) -> DataFrame:
    """verdict, n, fails: which verdicts fail an audit; unsigned and unread ones only if it is strict."""
    bad = F.col("verdict").isin("tampered", "wrong-key") | F.lit(strict) & F.col("verdict").isin("unsigned", "keyed")
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n")).withColumn("fails", bad)


def audit(checks: DataFrame) -> DataFrame:
    """checks (check, ok) with all_ok."""
    return checks.withColumn("all_ok", F.min("ok").over(W.partitionBy()))


# ledgers


def entries(lines: DataFrame) -> DataFrame:
    """seq (-1: the line is corrupt), trace_id, root, chain of ledger lines (value)."""
    got = F.from_json("value", "struct<seq:bigint,trace_id:string,root:string,chain:string>")
    whole = got.getField("seq").isNotNull() & got.getField("root").isNotNull()
    return lines.select(F.when(whole, got.getField("seq")).otherwise(-1).alias("seq"), *(F.when(whole, got.getField(c)).alias(c) for c in ("trace_id", "root", "chain")))


def latest_roots(ledger: DataFrame) -> DataFrame:
    """trace_id, root, entries, rolled_back: the last root, and whether it was left and came again."""
    w = W.partitionBy("trace_id").orderBy("seq")
    rows = ledger.where("seq >= 0").withColumns({"left": F.lag("root").over(w)})
    per = rows.groupBy("trace_id").agg(F.max_by("root", "seq").alias("root"), F.count("*").alias("entries"), F.max("seq").alias("last"))
    back = rows.join(per.select("trace_id", F.col("root").alias("now"), "last"), "trace_id").groupBy("trace_id").agg(F.coalesce(F.max((F.col("root") == F.col("now")) & (F.col("seq") < F.col("last"))), F.lit(False)).alias("again"), F.max_by("left", "seq").alias("left_root"))
    return per.join(back, "trace_id").select("trace_id", "root", "entries", (F.col("again") & (F.col("left_root") != F.col("root"))).alias("rolled_back"))


# posts


def signed_posts(posts: DataFrame, key: bytes, now_us: int, window_s: int = 300) -> DataFrame:
    """Posts (received_us, sent_s, body, signature) with `accepted`: signed with the key over time and body, sent within the
    window about their receipt, and the first with that signature."""
    want = hmac(key, F.concat(F.col("sent_s").cast("string"), F.lit("\n"), F.col("body")))
    near = F.abs(F.col("received_us") / 1e6 - F.col("sent_s")) <= window_s
    first = F.row_number().over(W.partitionBy("signature").orderBy("received_us", "row")) == 1
    return posts.where(F.col("received_us") <= now_us).withColumn("accepted", F.coalesce((want == F.col("signature")) & near & first, F.lit(False)))
