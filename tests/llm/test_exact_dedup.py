"""Both exact removals against brute force, on texts with nulls, copies, repeated rows and ids, and on random periodic texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import substring_dedup, suffix_dedup, superkmer


def key(i):
    return superkmer.NULL_ID if i is None else i


def brute(rows, units, k):
    """For each row, which of its units are covered by a window that starts earlier."""
    first = {}
    for i, t in rows:
        u = units(t)
        for p in range(len(u) - k + 1):
            w = tuple(u[p : p + k])
            first[w] = min(first.get(w, (key(i), p)), (key(i), p))
    out = []
    for i, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for p in range(len(u) - k + 1):
            if first[tuple(u[p : p + k])] < (key(i), p):
                gone[p : p + k] = [True] * k
        out.append((i, u, gone))
    return out


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def octets(t):
    return list((t or "").encode())


def check_words(frame, rows, k=20):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in frame.collect())
    want = Counter((i, len(u), sum(g), b" ".join(x for x, y in zip(u, g) if not y).decode()) for i, u, g in brute(rows, words, k))
    assert got == want


def check_bytes(frame, rows, k=100):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in frame.collect())
    spans = lambda g: sum(b and not a for a, b in zip([False, *g], g))
    want = Counter((i, len(u), sum(g), spans(g), bytes(x for x, y in zip(u, g) if not y)) for i, u, g in brute(rows, octets, k))
    assert got == want


def test_words(docs, rows):
    check_words(substring_dedup.dedup(docs), rows)


def test_bytes(docs, rows):
    check_bytes(suffix_dedup.dedup(docs), rows)


def test_repeat_groups_have_all_occurrences(spark):
    r = random.Random(9)
    some = lambda n: "".join(r.choices("abcdefgh", k=n))
    shared = some(130)
    rows = [(i, some(50 + i) + shared + some(60)) for i in range(5)] + [(9, some(300)), (10, None)]
    got = suffix_dedup.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for x in got:
        assert x.end - x.begin >= 100
        groups.setdefault(x.repeat, []).append((x.doc_id, x.begin, dict(rows)[x.doc_id][x.begin : x.end]))
    # some documents share a byte more by chance: a longer repeat of their own
    assert all(len({t for _, _, t in g}) == 1 and len({i for i, _, _ in g}) > 1 for g in groups.values())
    assert any({i for i, _, _ in g} == set(range(5)) for g in groups.values())
    covered = {(x.doc_id, p) for x in got for p in range(x.begin, x.end)}
    assert all((i, 50 + i + p) in covered for i in range(5) for p in range(130))


def test_hot_minimisers(spark, monkeypatch):
    """A passage among surroundings that differ everywhere: its windows are spread, with the same results."""
    monkeypatch.setattr(superkmer, "HOT", 30)
    monkeypatch.setattr(superkmer, "FEW", 2)
    monkeypatch.setattr(substring_dedup, "STRETCH", 40)
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(r.randint(3, 30))) + " " + passage + " " + " ".join(word() for _ in range(r.randint(3, 30)))) for i in range(150)]
    rows += [rows[3], rows[3], (900, " ".join(word() for _ in range(200)) + " " + passage + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    n = superkmer.keyed(docs, "text", "doc_id").mapInArrow(superkmer.census(suffix_dedup._elements(100), 100, suffix_dedup.MER), "slot int, n long").groupBy("slot").sum("n").where("`sum(n)` >= 30").count()
    assert n
    check_words(substring_dedup.dedup(docs), rows)
    check_bytes(suffix_dedup.dedup(docs), rows)


def test_empty(nothing):
    assert substring_dedup.dedup(nothing).collect() == []
    assert suffix_dedup.dedup(nothing).collect() == []


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements differ, however they are arranged; so do words of any length but for one byte."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(19)]
    rows = []
    for n in (8, 64, 256, 257, 1024, 2048, 4096):
        x = word[:n]
        for y in (x, x.translate(str.maketrans("ab", "ba")), x[:-1] + "c", "c" + x[1:]):
            rows.append((len(rows), " ".join([*around[:7], y, *around[7:]])))
    check_words(substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_periodic(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choices("ab", k=r.choice([3, 7, 40]))) * r.choice([1, 9, 60])) for i in range(40)]
    rows += [(100 + i, " ".join(r.choices(["p", "q"], k=r.choice([2, 5, 30])) * r.choice([1, 8, 20]))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_words(substring_dedup.dedup(docs), rows)
    check_bytes(suffix_dedup.dedup(docs), rows)


def test_pieces_of_a_long_text(spark, monkeypatch):
    """Texts longer than a piece are cut with overlaps; the result stays the same."""
    from spindrift.llm import shared

    monkeypatch.setattr(shared, "PIECE_BYTES", 700)
    r = random.Random(5)
    part = "".join(r.choices("abcd ", k=400))
    rows = [(1, "".join(r.choices("abcdefgh ", k=3000)) + part), (2, part + "".join(r.choices("abcdefgh ", k=2500)) + part)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0], pa.int32()), pa.array([t for _, t in rows])], ["doc_id", "tag", "text"])
    packed = pa.Table.from_batches(list(superkmer.packer(suffix_dedup._elements(100), 100, suffix_dedup.MER, 1)(iter([batch]))))
    found = superkmer.unpacker(suffix_dedup._judge(100), 100)(packed).to_pylist()
    for i, _, gone in brute(rows, octets, 100):
        got = np.zeros(len(gone), bool)
        for f in found:
            if f["doc_id"] == i:
                got[f["begin"] : f["end"]] = True
        assert got.tolist() == gone


def test_only_suffixes_that_may_repeat_are_sorted():
    """Two texts share 130 bytes: of all suffixes, those 31 of each that begin with 100 shared bytes are sorted."""
    r = random.Random(8)
    some = lambda n: bytes(r.choices(b"abcdefgh", k=n))
    shared = some(130)
    texts = [some(900) + b"<" + shared + b">" + some(500), some(40) + b"(" + shared + b")" + some(700), some(1200)]
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    place, size, common = suffix_dedup.suffix_array(b"".join(texts), at, 100)
    want = sorted((t[p:], at[i] + p) for i, t in enumerate(texts[:2]) for p in range(t.index(shared), t.index(shared) + 31))
    assert place.tolist() == [p for _, p in want] and size.tolist() == [len(s) for s, _ in want]
    assert sorted(common.tolist()) == sorted([*range(100, 131), *common[common < 100].tolist()])


@pytest.mark.parametrize("text,least", [(b"banana$bandana", 2), (b"abcabcabc", 3), (b"aaaaaa", 2), (b"xyzw", 1), (b"mississippi", 1)])
def test_maximal_repeats(text, least):
    """All substrings that occur twice or more and can't be extended on either side, with all their places."""
    at = np.array([0, len(text)])
    place, _, common = suffix_dedup.suffix_array(text, at, 1)
    before = np.where(place > 0, np.frombuffer(text, np.uint8)[np.maximum(place - 1, 0)].astype(np.int64), -1)
    got = {(text[place[a] : place[a] + n], tuple(sorted(place[a:b].tolist()))) for a, b, n in suffix_dedup.maximal_repeats(place, common, before, least)}
    want = set()
    for n in range(least, len(text)):
        for s in {text[i : i + n] for i in range(len(text) - n + 1)}:
            where = [i for i in range(len(text) - n + 1) if text[i : i + n] == s]
            left = {text[i - 1 : i] if i else None for i in where}
            right = {text[i + n : i + n + 1] or None for i in where}
            if len(where) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                want.add((s, tuple(where)))
    assert got == want
