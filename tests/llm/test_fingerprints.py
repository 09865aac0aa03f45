import hashlib
from itertools import combinations

from pyspark.sql import functions as F

from spindrift.llm import fingerprints as fp


def likeness(a, b):
    return 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128


def test_edited_texts_and_likeness(docs, rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.setdefault((i, len(t), hashlib.sha256(edited.encode()).hexdigest()), []).append(t)
    got = fp.compare(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.doc_id, r.n_chars, r.edited_sha256) in want
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint)
    of = {}
    for r in got:
        for t in want[r.doc_id, r.n_chars, r.edited_sha256]:
            assert of.setdefault(t, r.fingerprint) == r.fingerprint or len(want[r.doc_id, r.n_chars, r.edited_sha256]) > 1
    assert of[""] == "0" * 32
    kept = {(r.doc_id, r.n_chars): r for r in got}
    assert kept[6, len(dict(rows)[6])].near_next == 1.0


def test_empty(nothing):
    assert fp.compare(nothing).collect() == []
    assert fp.with_near(fp.compare(nothing)).collect() == []


def test_sums_of_long_texts(spark):
    """Votes are those of a plain count, in texts of several stretches and in rows of one key too, with half the sums a term."""
    texts = [(1, " ".join(f"word{i % 5000}aaaaaaaaaaaaaaaaaaaaaaaa" for i in range(3 * fp.STRETCH))), (2, "the same heavyweight words once more " * 2500), (3, ""), (3, "a b c d e f"), (3, "a b c d e f " * 2000), (None, None)]
    df = spark.createDataFrame(texts, "k long, text string")
    each = df.select("k", F.explode(fp.terms(F.coalesce("text", F.lit(""))))).select("k", F.xxhash64("col"), F.xxhash64(F.lit(1), "col"), F.col("col").bitwiseAND(F.lit(7))).collect()
    want = {k: [0, 0] for k, _ in texts}
    for k in want:
        mine = [r for r in each if r[0] == k]
        for half in range(2):
            for bit in range(64):
                if sum((1 if r[1 + half] >> bit & 1 else -1) * (r[3] + 1) for r in mine) > 0:
                    want[k][half] |= 1 << bit
    prints = fp.fingerprint(df, ["k"], "text")
    got = {r.k: [r.hi % (1 << 64), r.lo % (1 << 64)] for r in prints.collect()}
    assert got == want
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    steps = [line for line in prints._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in line]
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert steps[-1].count("sum(") == 33  # that which each term goes through


def test_near_pairs(spark):
    import random

    r = random.Random(1)
    base = [r.getrandbits(128) for _ in range(30)]
    prints = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in r.sample(range(128), r.randint(1, 6)):
                x ^= 1 << bit
            prints.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in prints] * 2
    got = {(r.a_hi, r.a_lo, r.b_hi, r.b_lo, r.distance) for r in fp.near_pairs(spark.createDataFrame(rows, "hi long, lo long")).collect()}
    whole = lambda h, l: ((h % (1 << 64)) << 64) | l % (1 << 64)  # noqa: E731, E741
    found = {(frozenset((whole(a, b), whole(c, d))), n) for a, b, c, d, n in got}
    want = {(frozenset((a, b)), (a ^ b).bit_count()) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= fp.RADIUS}
    assert found == want and len(got) == len(want)


def test_crowded_buckets(spark, monkeypatch):
    """Many fingerprints that agree in half their bits: the split buckets find the same pairs."""
    import random

    monkeypatch.setattr(fp, "CROWDED", 8)
    r = random.Random(2)
    base = r.getrandbits(64)
    prints = {base << 64 | r.getrandbits(64) for _ in range(120)}
    prints |= {x ^ 1 << r.randrange(128) ^ 1 << r.randrange(128) for x in list(prints)[:40]}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in prints]
    got = fp.near_pairs(spark.createDataFrame(rows, "hi long, lo long")).collect()
    assert len(got) == sum((a ^ b).bit_count() <= fp.RADIUS for a, b in combinations(prints, 2)) > 0


def test_no_python_on_executors(docs):
    plan = fp.compare(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert docs.select(F.size(fp.terms(F.lit("a b c d e f")))).first()[0] == 2
