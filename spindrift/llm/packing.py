"""Packing by power-of-two decomposition: a document's tokens are cut into pieces whose lengths are powers of two.

A document of n tokens becomes floor(n / longest) pieces of the longest length and one piece for each bit of the rest,
longest first. Pieces of equal length form a bucket; each is a sequence of its own, so that no sequence crosses
documents and none needs padding. Each row depends on its document alone: nothing is shuffled.

Tokens: byte-level BPE, then the end id. The `tokenizers` library gives the ids. Texts whose characters are all in the
Latin blocks go through tiktoken with the same vocabulary, which gives the same ids several times faster (tested); texts
with other characters, or with the marker of a special token, go through `tokenizers` itself.

Defined results: a null text is an empty one, of one token (the end id); equal rows are packed each for itself; a null id
stays null; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LONGEST = 1024
END = 0
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
#: Up to the Latin letters with marks, and the usual punctuation: what both libraries split alike beyond doubt.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧]*")
_loaded: dict = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, fast_path: str | None):
    """A function from texts to lists of ids."""
    if (path, fast_path) in _loaded:
        return _loaded[path, fast_path]
    slow, fast = [], None
    if fast_path:
        import public_tokenizers
        import tiktoken

        with open(fast_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if fast is not None and "<|" not in text and _PLAIN.fullmatch(text):
            return fast.encode_ordinary(text)
        if not slow:  # many tasks never need it
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path))
        return slow[0].encode(text, add_special_tokens=False).ids

    _loaded[path, fast_path] = encode
    return encode


def decompose(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to n, none above the longest, in falling order."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if (n % longest) >> b & 1]


def _cutter(path: str, fast_path: str | None, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, fast_path)
        for batch in shared.slices(batches, "text"):
            doc, start, length, total, ids = [], [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = np.array([*encode(text or ""), END], dtype="<u4")
                body, at = tokens.tobytes(), 0
                for n in decompose(len(tokens), longest):
                    doc.append(d), start.append(at), length.append(n), total.append(len(tokens))
                    ids.append(body[4 * at : 4 * (at + n)])
                    at += n
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, start, length, total)), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, fast: str | None = "byte_bpe_50k.tiktoken", longest: int = LONGEST) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, ids (binary: little-endian unsigned 32 bits), bucket (log2
    of the length), sequence_id, offset. longest: a power of two."""
    if longest < 2 or longest & (longest - 1):
        raise ValueError("longest is not a power of two")
    shared.small_batches(docs.sparkSession)
    path = tokenizer or vocabulary()
    pieces = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cutter(path, vocabulary(fast) if fast else None, longest), PIECES)
    return pieces.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
