"""Token counts of whole texts.

An Arrow function encodes batches balanced by bytes and returns lengths only.
The tokenizer drops white space and lets no token cross it, so a text may be
split at any ASCII white space: long texts are cut there into pieces, pieces
are gathered into batches of about the same number of bytes, and each distinct
word of a batch is encoded once (``encode_batch``); a bounded table of counts
is kept for later batches of the same worker. A text's count is the sum over
its words; memory is bounded by the batch and the kept table.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a text without any
white space is one word and is encoded whole; repeated rows are counted row by
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
KEPT_WORDS = 800_000
KEPT_WORD_BYTES = 64
ASCII_SPACE = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_TOKENIZERS: dict = {}
_COUNTS: dict[str, dict[bytes, int]] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once per worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def count_words(groups: list[list[bytes]], path: str) -> list[int]:
    """Tokens of each group of words; new words are encoded in one batch."""
    known = _COUNTS.setdefault(path, {})
    if len(known) > KEPT_WORDS:
        known.clear()
    new = list(set().union(*groups).difference(known))
    encoded = tokenizer(path).encode_batch([w.decode() for w in new], add_special_tokens=False)
    known.update(zip(new, (len(e.ids) for e in encoded), strict=True))
    totals = [sum(map(known.__getitem__, g)) for g in groups]
    for w in new:
        if len(w) > KEPT_WORD_BYTES:
            del known[w]
    return totals


def pieces(data: bytes, limit: int) -> Iterator[bytes]:
    """``data`` cut at ASCII white space into pieces of at most ``limit``
    bytes; only a single longer word exceeds the limit."""
    start = 0
    while len(data) - start > limit:
        cut = max(data.rfind(c, start, start + limit) for c in ASCII_SPACE)
        if cut <= start:
            found = [p for p in (data.find(c, start + limit) for c in ASCII_SPACE) if p > 0]
            cut = min(found, default=len(data))
        yield data[start:cut]
        start = cut
    yield data[start:]


def batches(texts: list[bytes], limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """(row, piece) lists of about ``limit`` bytes each."""
    batch, size = [], 0
    for row, data in enumerate(texts):
        for piece in pieces(data, limit):
            if batch and size + len(piece) > limit:
                yield batch
                batch, size = [], 0
            batch.append((row, piece))
            size += len(piece)
    if batch:
        yield batch


def count_texts(texts: list[bytes], path: str, limit: int = BATCH_BYTES) -> list[int]:
    """Tokens of every text."""
    totals = [0] * len(texts)
    for batch in batches(texts, limit):
        counts = count_words([piece.split() for _, piece in batch], path)
        for (row, _), n in zip(batch, counts, strict=True):
            totals[row] += n
    return totals


def count_tokens(docs: DataFrame, tokenizer_path: str, limit_tokens: int,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row. The tokenizer file
    must be one that drops white space, at a path every executor has."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(count_texts(texts, tokenizer_path), pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    schema = f"id {slim.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    return slim.mapInArrow(encode, schema).withColumn(
        "over_limit", F.col("n_tokens") > limit_tokens)
