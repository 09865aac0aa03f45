from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from spindrift.llm import packing


def test_round_trip(docs, rows):
    slow = Tokenizer.from_file(packing.vocabulary())
    want = Counter((i, tuple([*slow.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    pieces, sizes = defaultdict(list), Counter()
    got = packing.pack(docs).collect()
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length == 2**r.bucket <= 1024 and r.offset == 0
        pieces[r.doc_id, r.doc_tokens].append((r.start, tuple(ids.tolist())))
        sizes[r.sequence_id] += 1
    assert set(sizes.values()) == {1}
    for (i, n), parts in pieces.items():
        copies = sum(c for (j, ids), c in want.items() if (i, n) == (j, len(ids)))
        assert sum(len(p) for _, p in parts) == copies * n
        if copies == 1:
            joined = tuple(x for _, p in sorted(parts) for x in p)
            assert want[i, joined] == 1


def test_decompose():
    for n in [*range(1, 70), 1023, 1024, 1025, 5000]:
        parts = packing.decompose(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)
        assert Counter(p for p in parts if p < 1024).most_common(1)[:1] in ([], [(parts[-1], 1)]) or max(Counter(p for p in parts if p < 1024).values()) == 1


def test_empty(nothing):
    assert packing.pack(nothing).collect() == []


def test_longest_is_a_power_of_two(docs):
    with pytest.raises(ValueError):
        packing.pack(docs, longest=1000)


def test_fast_path_gives_the_same_ids():
    fast = packing.encoder(packing.vocabulary(), packing.vocabulary("byte_bpe_50k.tiktoken"))
    slow = Tokenizer.from_file(packing.vocabulary())
    for text in ["", " ", "a  b\n\n c\t\td \n", "don't I'LL we've 12 3.5e7", "été—ñ “quoted” … ¡hola!", "x" * 3000, "É\u0301 ſ ŉ\u00a0 \u00ad", "\r\n \x0b 漢字"]:
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids, text
