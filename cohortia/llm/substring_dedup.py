"""Substring dedup over sliding sentence spans.

Every run of several consecutive sentences is hashed, the hashes are joined
over the whole corpus, and sentences covered by any non-first occurrence of a
repeated run are removed. A run starts (or ends) at every sentence and takes
the fewest sentences, two at least, that reach ``MIN_WORDS`` words; a sentence
of ``LONG_WORDS`` words or more counts as several and is a run of its own (else
a long sentence between two edited ones would escape). So a run
depends only on its own text, and a passage gives the same runs wherever it
stands. Runs are taken in both directions so that the sentences at either end
of a passage are covered as well.

A sentence ends after ``. ! ?`` before white space, or at a line break. Case
and white space are ignored when runs are compared. The first occurrence is
the one with the smallest (doc_id, text hash, position).

Edge cases: null texts stay null, empty ones empty, and neither has runs; a
document with too few words, or one short sentence, has no runs; a document that is
a full copy loses all sentences and keeps an empty text; rows repeating both
doc_id and text share one verdict and all stay; a null doc_id sorts first; an
empty table gives an empty result; other columns pass through. The run table
is aggregated before it is joined back, and the join is one that Spark splits
when a passage is very common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

MIN_SENTENCES = 2
MIN_WORDS = 20
LONG_WORDS = 30
_BREAK = re.compile(r"(?:[.!?]\s+|\n\s*)")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence; end includes the white space after it,
    so the sentences of a text follow each other without gaps."""
    cuts = [m.end() for m in _BREAK.finditer(text)]
    bounds = [0, *[c for c in cuts if 0 < c < len(text)], len(text)]
    return [(a, b) for a, b in zip(bounds, bounds[1:]) if b > a]


def runs(text: str, least: int = MIN_SENTENCES, least_words: int = MIN_WORDS
         ) -> list[tuple[int, int, int]]:
    """(hash, first sentence, last sentence) of every run of a text."""
    hashes, counts = [], []
    for a, b in sentences(text):
        words = text[a:b].lower().split()
        hashes.append(xxhash.xxh64_intdigest(" ".join(words).encode()))
        counts.append(len(words))
    n = len(hashes)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(n)
    # fewest sentences from i on, and back from i, that reach the words
    ahead = np.maximum(np.searchsorted(total, total[:-1] + least_words) - 1, at + least - 1)
    back = np.minimum(np.searchsorted(total, total[1:] - least_words, side="right") - 1,
                      at - least + 1)
    spans = {(i, int(j)) for i, j in enumerate(ahead) if j < n}
    spans |= {(int(i), j) for j, i in enumerate(back) if i >= 0}
    spans |= {(i, i) for i, c in enumerate(counts) if c >= LONG_WORDS}
    data = np.array(hashes, np.uint64)
    return [(xxhash.xxh3_64_intdigest(data[i:j + 1].tobytes()) - (1 << 63), i, j)
            for i, j in sorted(spans)]


def run_table(docs: DataFrame, least: int = MIN_SENTENCES, least_words: int = MIN_WORDS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, run, first, last`` for every run of every text."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("doc_id"), text_hash(text).alias("text_hash"),
                       text.alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, found = [], []
            for i, value in enumerate(b.column("text").to_pylist()):
                got = runs(value or "", least, least_words)
                found += got
                row += [i] * len(got)
            rows = pa.array(row, pa.int64())
            hashes, first, last = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(rows), b.column("text_hash").take(rows),
                 pa.array(hashes, pa.int64()), pa.array(first, pa.int32()),
                 pa.array(last, pa.int32())],
                names=["doc_id", "text_hash", "run", "first", "last"])

    return slim.mapInArrow(run, f"doc_id {kind}, text_hash bigint, run bigint, first int, last int")


def text_hash(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(text)


def repeated(spans: DataFrame) -> DataFrame:
    """Non-first occurrences: the rows of ``run_table`` whose run occurs
    earlier."""
    place = F.struct("doc_id", "text_hash", "first")
    # written first: one copy on the join's other side, of known size
    firsts = written(spans.groupBy("run").agg(
        F.min(place).alias("f_place"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.col("run").alias("f_run"), "f_place"), "repeated-runs")
    # the table grows with the corpus: merged at every size, never broadcast
    return (spans.join(firsts.hint("merge"), F.col("run") == F.col("f_run"))
            .filter(~place.eqNullSafe(F.col("f_place")))
            .select("doc_id", "text_hash", "first", "last"))


def covered_by(packed: np.ndarray, n: int) -> list[bool]:
    """Which of n sentences lie in a span (first * 2^32 + last)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, packed >> 32, 1)
    np.add.at(steps, (packed & 0xFFFFFFFF) + 1, -1)
    return (np.cumsum(steps[:n]) > 0).tolist()


def remove_spans(docs: DataFrame, covered: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Cut the covered sentences out of the texts.

    ``covered``: ``doc_id, text_hash, first, last``. Adds ``n_sentences`` and
    ``n_removed``; all columns of ``docs`` stay.
    """
    packed = F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")
    # a set: rows repeating doc_id and text add the same spans
    cuts = written(covered.groupBy(F.col("doc_id").alias("__cut_id"), F.col("text_hash").alias(
        "__cut_hash")).agg(F.collect_set(packed).alias("__cuts")), "cuts")
    names = docs.columns
    joined = docs.join(cuts.hint("merge"), docs[id_col].eqNullSafe(F.col("__cut_id"))
                       & (text_hash(docs[text_col].cast("string")) == F.col("__cut_hash")),
                       "left").drop("__cut_id", "__cut_hash")
    added = [("n_sentences", pa.int32()), ("n_removed", pa.int32())]
    joined = joined.drop(*[n for n, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, removed = [], [], []
            cuts_of = b.column("__cuts")
            values = cuts_of.values.to_numpy(zero_copy_only=False)
            bounds = cuts_of.offsets.to_numpy()
            for i, value in enumerate(b.column(text_col).to_pylist()):
                spans = sentences(value) if value else []
                mine = values[bounds[i]:bounds[i + 1]]
                n = 0
                if len(mine):
                    drop = covered_by(mine, len(spans))
                    value = "".join(value[x:y] for (x, y), gone in zip(
                        spans, drop, strict=True) if not gone).rstrip()
                    n = sum(drop)
                texts.append(value), total.append(len(spans)), removed.append(n)
            columns = {n: b.column(n) for n in b.schema.names if n != "__cuts"}
            columns[text_col] = pa.array(texts, b.schema.field(text_col).type)
            for (n, t), v in zip(added, (total, removed), strict=True):
                columns[n] = pa.array(v, t)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema
                       if f.name != "__cuts") + ", n_sentences int, n_removed int"
    return joined.mapInArrow(run, schema).select(
        *[n for n in names if n not in ("n_sentences", "n_removed")], "n_sentences", "n_removed")


def dedup(docs: DataFrame, least: int = MIN_SENTENCES, least_words: int = MIN_WORDS) -> DataFrame:
    """The documents without repeated runs, plus ``n_sentences`` and
    ``n_removed`` (sentences before and removed)."""
    spans = written(run_table(docs, least, least_words), "runs")
    return remove_spans(docs, repeated(spans))
