"""Best-fit-decreasing packing of token sequences.

1. ``tokenize`` turns whole texts into ids (an Arrow function); texts longer
   than a sequence are cut into full pieces, the first one may be shorter.
2. ``plan`` runs best-fit decreasing on the histogram of piece lengths, which
   has at most ``capacity`` entries however large the data is. Pieces of one
   length are interchangeable, and so are open bins of one remaining capacity,
   so the plan treats runs of them at once; a segment tree over remaining
   capacities finds the tightest open bin in logarithmic time.
3. ``pack`` ranks the pieces of each length (task-local numbers plus prefix
   sums over tasks, no global sort) and looks each rank up in the plan.

Edge cases: null and empty texts are one piece holding only the end id;
very long texts and runs of white space are encoded whole;
repeated rows are packed as often as they occur; an empty table gives an empty
result; other columns are ignored. Hot lengths: ranks are task-local, so no
group of equal lengths ever meets in one task.
"""

from __future__ import annotations

import json
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .token_count import tokenizer

END_ID = 2
CAPACITY = 1024
_ENCODERS: dict = {}


def _encoder(path: str):
    """Byte-level BPE of a tokenizers .json file by its ranks; special strings
    become their ids as in that library. Same ids, several times faster."""
    if path not in _ENCODERS:
        import tiktoken
        with open(path) as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        enc = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks,
                                special_tokens=special)
        _ENCODERS[path] = enc
    return _ENCODERS[path]


def encode(text: str, path: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit numbers. A run of
    about a million white-space characters is beyond the fast encoder's
    pattern matcher, which refuses it; such a text goes to the library."""
    try:
        ids = _encoder(path).encode(text, allowed_special="all")
    except ValueError:
        ids = tokenizer(path).encode(text, add_special_tokens=False).ids
    return array("I", ids).tobytes()


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids`` (binary,
    little-endian unsigned 32-bit), and ``part, local_rank``: the task and the
    piece's number among the task's pieces of the same length."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = array("I", [END_ID]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            row, piece, start, length, ids, rank = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                data = encode(text or "", tokenizer_path) + end
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    take = (n - at) % capacity or capacity
                    row.append(i), piece.append(k), start.append(at), length.append(take)
                    ids.append(data[4 * at:4 * (at + take)]), rank.append(seen[take])
                    seen[take] += 1
                    at, k = at + take, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array([part] * len(row), pa.int32()),
                 pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids", "part", "local_rank"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, "
                                "ids binary, part int, local_rank bigint")


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a node counts the
    runs of open bins below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _add(self, remaining: int, by: int) -> None:
        node = self.leaves + remaining
        while node:
            self.count[node] += by
            node //= 2

    def push(self, remaining: int, first_bin: int, bins: int) -> None:
        self.runs[remaining].append((first_bin, bins))
        self._add(remaining, 1)

    def pop(self, remaining: int) -> tuple[int, int]:
        self._add(remaining, -1)
        return self.runs[remaining].pop()

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity >= need that has an open bin."""
        node = self.leaves + need
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Best-fit decreasing over ``length -> pieces``.

    Returns rows ``(length, rank_from, rank_to, first_bin, offset, per_bin)``:
    the pieces of that length with ranks in [rank_from, rank_to) go, per_bin at
    a time, into consecutive bins from first_bin, at offset. After a piece is
    placed in the tightest bin, that bin is still the tightest one while it
    fits, so one run of bins takes a whole run of pieces.
    """
    tree, out, bins = CapacityTree(capacity), [], 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                per = capacity // length
                first, count = bins, -(-left // per)
                bins += count
            else:
                first, count = tree.pop(remaining)
                per = remaining // length
            for many, each in ((min(count, left // per), per), (1, left % per)):
                # runs of full bins, then one bin with what is left
                if not many or not each or not count or left < each or (
                        each != per and left >= per):
                    continue
                out.append((length, rank, rank + many * each, first, capacity - remaining, each))
                tree.push(remaining - many // many * each * length, first, many)
                rank, left = rank + many * each, left - many * each
                first, count = first + many, count - many
            if count:
                tree.push(remaining, first, count)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (of ``tokenize``, written).

    The histogram (at most ``capacity`` rows) is the only thing that reaches
    the driver; the plan it gives has a few rows per length, so it is
    broadcast. Counts per (length, task) are joined by the planner's choice.
    """
    spark = pieces.sparkSession
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, capacity)
    places = spark.createDataFrame(
        rows, "p_length bigint, rank_from bigint, rank_to bigint, first_bin bigint, "
              "p_offset bigint, per_bin bigint")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = written(counts.select(
        F.col("length").alias("b_length"), F.col("part").alias("b_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "rank-bases")
    ranked = pieces.join(bases, (F.col("length") == F.col("b_length"))
                         & (F.col("part") == F.col("b_part")))
    rank = F.col("base") + F.col("local_rank")
    within = rank - F.col("rank_from")
    names = [c for c in pieces.columns if c not in ("part", "local_rank")]
    return (ranked.join(F.broadcast(places), (F.col("length") == F.col("p_length"))
                        & (rank >= F.col("rank_from")) & (rank < F.col("rank_to")))
            .select(*names,
                    (F.col("first_bin") + F.floor(within / F.col("per_bin"))).cast("long")
                    .alias("sequence_id"),
                    (F.col("p_offset") + (within % F.col("per_bin")) * F.col("length"))
                    .cast("long").alias("offset")))


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``tokenize``, written once: their task-local numbers hold
    only within one written table."""
    return written(tokenize(docs, tokenizer_path, capacity), "pieces")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack: ``doc_id, piece, start, length, ids, sequence_id,
    offset``."""
    return pack(tokenized(docs, tokenizer_path, capacity), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Assemble the sequences: ``sequence_id, length, ids``. A sequence holds
    at most ``capacity`` ids, so the groups are bounded."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
            "sequence_id", "length",
            F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
