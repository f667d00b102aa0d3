"""SimHash near-duplicates by a byte-position inverted index.

A fingerprint has 64 bits: bit i is set if it is set in over half of the
XXH64 hashes (seed 42) of the text's word shingles. Two fingerprints link when
at most 3 bits differ; then at most 3 of their 8 bytes differ, so they share at
least 5 positional bytes, the guaranteed minimum of the count filter.

Index: the postings of single bytes would hold 1/256 of all rows each, so the
index is kept on groups of four byte positions, the 14 position sets
{a, b, c, d} with a ^ b ^ c ^ d = 0. Every choice of three positions lies in
exactly one of them, and the complement of such a set is such a set; so two
fingerprints that differ in at most three bytes agree in all four bytes of at
least one set, and no link is lost. The pairs of a posting are tallied (equal
positional bytes, at least 5) and verified (at most 3 differing bits).

Long postings: pairs are only formed in postings of at most ``PAIR_LIMIT``
fingerprints, so their number is linear in the rows. Longer ones are linked
exactly without pairs: inside a posting only 32 bits are free, and a, b differ
in at most 3 of them if and only if some value x is within 2 bits of one and
within 1 bit of the other. Every fingerprint sends its 529 values within 2 bits
(33 of them within 1); at each value that someone reaches within 1 bit, all who
reach it are linked to the smallest of those: every such link is real, and all
links of the posting are connected through them.

Edge cases: null and empty texts have the fingerprint zero, linked like any
other; fewer words than a shingle: the whole sequence is one shingle; repeated
rows share a fingerprint; a null id is ignored when the smallest id of a
component is taken (a component of null ids has a null id); an empty table
gives an empty result. Equal fingerprints are collapsed before any pair is
formed, so a group of exact copies of any size is one index entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import written

SHINGLE = 3
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
SEED = 42
PAIR_LIMIT = 256
CHUNK = 1 << 16
POSITIONS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)]))
        total = len(words) - width + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, total)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` (signed 64-bit) for every row; the text hash
    tells rows of one doc_id with different texts apart."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py().encode(), width) if t.is_valid else 0
                   for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(fps, pa.int64())],
                names=["doc_id", "text_hash", "fp"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _posting_key(fp: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(255 << (8 * p) for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _xor_masks(bits: int, most: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``u, v``: links between distinct fingerprints (column ``fp``) that
    connect all fingerprints at most ``MAX_BITS`` bits apart."""
    keys = F.array(*[F.struct(F.lit(i).alias("k"), _posting_key(F.col("fp"), s).alias("key"))
                     for i, s in enumerate(POSITIONS)])
    index = fps.select("fp", F.explode(keys).alias("e")).select("fp", "e.k", "e.key")
    sizes = index.groupBy("k", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(index.join(sizes, ["k", "key"]), "postings")

    short = shared.filter(F.col("size") <= pair_limit)
    a = short.select("k", "key", F.col("fp").alias("u"))
    b = short.select("k", "key", F.col("fp").alias("v"))
    tally = sum(((_byte(F.col("u"), p) == _byte(F.col("v"), p)).cast("int") for p in range(8)),
                F.lit(0))
    pairs = (a.join(b, ["k", "key"]).filter(F.col("u") < F.col("v"))
             .filter(tally >= MIN_SHARED)
             .filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
             .select("u", "v"))

    # masks over the 32 free bits of each position set, moved to their places
    long = shared.filter(F.col("size") > pair_limit).select("k", "key", "fp")
    if long.isEmpty():
        return pairs
    meeting = None
    for i, s in enumerate(POSITIONS):
        free = [8 * p + b for p in range(8) if p not in s for b in range(8)]
        masks = [sum(1 << free[b] for b in range(32) if m >> b & 1) for m in _xor_masks(32, 2)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        near = F.array(*[F.lit(m).cast("bigint") for m in signed])
        one = (long.filter(F.col("k") == i)
               .select("k", "fp", F.posexplode(near).alias("n", "mask"))
               .select("k", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("x"),
                       (F.col("n") <= 32).alias("close")))
        meeting = one if meeting is None else meeting.unionByName(one)
    centres = meeting.groupBy("k", "x").agg(
        F.min(F.when(F.col("close"), F.col("fp"))).alias("v"), F.count(F.lit(1)).alias("n")
    ).filter("v is not null and n > 1").select("k", "x", "v")
    far = meeting.select("k", "x", F.col("fp").alias("u")).join(centres, ["k", "x"]).filter("u <> v")
    return pairs.unionByName(far.select("u", "v").distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE, pair_limit: int = PAIR_LIMIT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp, component_id, root`` for every row:
    component_id is the smallest doc_id that can be reached over links between
    fingerprints, root the smallest fingerprint."""
    marked = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    groups = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp-groups")
    roots = written(components(links(groups.select("fp"), pair_limit)), "roots")
    named = groups.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = written(named.join(least, "root").select(
        F.col("fp").alias("c_fp"), "component_id", "root"), "classes")
    return marked.join(classes, F.col("fp") == F.col("c_fp")).select(
        "doc_id", "text_hash", "fp", "component_id", "root")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One document per component: the one with its smallest doc_id. Rows
    without a doc_id stay only where their component has no id at all; of rows
    that share the id the smallest text hash stays, of equal rows one."""
    first = near_duplicates(docs, width).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = first.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    stays = written(rows.groupBy("root").agg(
        F.min(F.struct("text_hash", "n", "doc_id")).alias("r")).select(
            F.col("r.doc_id").alias("__keep_id"), F.col("r.text_hash").alias("__keep_hash"),
            F.col("r.n").alias("__keep_rows")), "representatives")
    names = docs.columns
    # the ids grow with the corpus: merged at every size, never broadcast
    kept = docs.join(stays.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__keep_id")) & (
        F.xxhash64(F.col("text").cast("string")) == F.col("__keep_hash")))
    once = kept.filter("__keep_rows = 1").select(*names)
    again = kept.filter("__keep_rows > 1").dropDuplicates(["doc_id", "__keep_hash"]).select(*names)
    return once.unionByName(again)
