"""Phrase collocations by Rabin-Karp fingerprints.

Texts become *blocks* of about ``BLOCK_WORDS`` words of one language: a list of
distinct words and one code per occurrence, 0 between pieces. Every n-gram of a
block gets a 64-bit polynomial fingerprint from numpy prefix sums; a block
counts its own n-grams first, so a fingerprint is shuffled once per block, with
its count and an occurrence pointer (position and length in the block).

Fingerprints are searched in two passes: pairs of words, then three to five
words whose pairs are all frequent. A phrase is never more frequent than its
parts, and a fingerprint that several phrases share counts at least as much as
each of them, so no pass loses a phrase. (A pass over single words first would
spare little: nearly all words of a large corpus are frequent ones.) The
frequent fingerprints go back to their blocks, each with its pointer. There
every occurrence is compared with the words at the pointer, so phrases that
only share a fingerprint are told apart, and the text of the frequent ones
alone is written out. The final counts are sums over equal texts: they do not
depend on the fingerprints at all. Single words are counted by text at once.

Nothing here is broadcast by force or gathered on the driver. A group of one
fingerprint has one row per block at most; ranks per language are cut down in
every task before they meet.

Edge cases: a null or empty text has no words; a null language is ``und``
(together with a language of that name); a very long text is cut into blocks at
piece ends, only one piece of more than ``BLOCK_WORDS`` words is a longer
block; ties in score and count are ordered by the phrase's UTF-8 bytes; rows
that repeat count as often as they occur; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import Rolling
from .scratch import discard, written

BLOCK_WORDS = 1 << 20
CHUNK_BYTES = 1 << 22
LONGEST = 5
MIN_COUNT = 100
FIRST = 2000
NO_LANG = "und"
SPLITTERS = b",;:!?\n\x0b\x0c\r"  # all end a piece, as "." does

_ONE_STOP = bytes.maketrans(SPLITTERS, b"." * len(SPLITTERS))
_U64 = np.uint64
_BLOCK = ("block bigint, lang string, n_words bigint, vocab binary, codes binary, "
          "phrases array<string>, counts array<bigint>")
_FIELDS = pa.schema([
    ("block", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()),
    ("vocab", pa.binary()), ("codes", pa.binary()),
    ("phrases", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def piece_tokens(text: str) -> Iterator[list[bytes]]:
    """Words of a text with ``b"."`` between pieces, in lists that end where a
    piece ends and cover about ``CHUNK_BYTES`` each. "." is in no word."""
    data = text.encode().lower().translate(_ONE_STOP)
    at = 0
    while at < len(data):
        end = data.find(b".", at + CHUNK_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(b".", b" . ").split()
        at = end


class Block:
    """Words of a block: ``vocab`` (0 is the gap) and ``codes``."""

    def __init__(self, vocab: list[bytes], codes: np.ndarray, lang: str, bits: int = 64):
        self.vocab, self.codes, self.lang, self.bits = vocab, codes, lang, bits

    @cached_property
    def rolling(self) -> Rolling:
        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.vocab], _U64)
        return Rolling(hashes[self.codes])

    @cached_property
    def room(self) -> np.ndarray:
        """Words from each position to the next gap."""
        n = len(self.codes)
        gaps = np.where(self.codes == 0, np.arange(n), n)
        return np.minimum.accumulate(gaps[::-1])[::-1] - np.arange(n)

    def starts(self, n: int) -> np.ndarray:
        """Positions where n words follow without a gap."""
        return np.flatnonzero(self.room >= n)

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n words from each position."""
        return self.rolling.windows(at, n) & _U64((1 << self.bits) - 1)

    def counted(self, sizes: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct fingerprints of the n-grams, a pointer to the first
        occurrence of each, and their counts."""
        fps, pointers, counts = [], [], []
        for n in sizes:
            at = self.starts(n)
            fp, first, many = np.unique(self.fingerprints(at, n), return_index=True,
                                        return_counts=True)
            fps.append(fp), pointers.append(at[first] * 8 + n), counts.append(many)
        return np.concatenate(fps), np.concatenate(pointers), np.concatenate(counts)

    def found(self, n: int, fps: np.ndarray, pointers: np.ndarray
              ) -> tuple[np.ndarray, list[str], list[int]]:
        """Starts of all n-grams whose fingerprint is given, and the texts and
        counts of the phrases there. Occurrences that differ from the words at
        their pointer are phrases of their own."""
        at = self.starts(n)
        mine = pointers % 8 == n
        if not mine.any() or not len(at):
            return at[:0], [], []
        order = np.argsort(fps[mine])
        known, where = fps[mine][order], (pointers[mine] // 8)[order]
        value = self.fingerprints(at, n)
        hit = np.minimum(np.searchsorted(known, value), len(known) - 1)
        keep = known[hit] == value
        at, hit = at[keep], hit[keep]
        offsets = np.arange(n)
        same = np.ones(len(at), bool)
        for k in range(n):
            same &= self.codes[at + k] == self.codes[where[hit] + k]
        many = np.bincount(hit[same], minlength=len(known))
        rows = [self.codes[where[:, None] + offsets][many > 0]]
        counts = [many[many > 0]]
        if not same.all():
            other, often = np.unique(self.codes[at[~same][:, None] + offsets], axis=0,
                                     return_counts=True)
            rows.append(other), counts.append(often)
        words = self.words()
        texts = [" ".join([words[c] for c in row]) for row in np.concatenate(rows).tolist()]
        return at, texts, np.concatenate(counts).tolist()

    def words(self) -> list[str]:
        return [w.decode() for w in self.vocab]

    def pruned(self, keep: np.ndarray, least: int) -> Block:
        """The block with only the words of kept pairs (``keep``: their
        starts), in runs of ``least`` words or more."""
        codes = self.codes.copy()
        joined = np.zeros(len(codes) + 1, bool)
        joined[keep] = True
        follows = np.concatenate([[False], joined[:-2]])  # the pair before it is kept
        codes[~(joined[:-1] | follows)] = 0
        # a gap where two kept words meet but their pair is not kept
        codes = np.insert(codes, np.flatnonzero(follows & ~joined[:-1]) + 1, 0)
        gap = codes == 0
        bounds = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        lengths = bounds[1::2] - bounds[::2]
        alive = np.repeat(lengths >= least, lengths)
        kept = np.flatnonzero(~gap)
        codes[kept[~alive]] = 0
        codes = codes[~((codes == 0) & (np.concatenate([[0], codes[:-1]]) == 0))]
        used, codes = np.unique(np.concatenate([[0], codes]), return_inverse=True)
        return Block([self.vocab[c] for c in used.tolist()], codes[1:].astype(np.int32),
                     self.lang, self.bits)


def _row(block: int, lang: str, n_words: int, b: Block | None, phrases: list[str],
         counts: list[int]) -> pa.RecordBatch:
    def one(values, kind) -> pa.Array:
        values = pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), pa.array([lang]), pa.array([n_words], pa.int64()),
        pa.array([b and zlib.compress(b" ".join(b.vocab), 1)], pa.binary()),
        pa.array([b and zlib.compress(b.codes.tobytes(), 1)], pa.binary()),
        one(phrases, pa.string()), one(counts, pa.int64())], schema=_FIELDS)


def _read(row: dict, bits: int) -> Block:
    return Block(zlib.decompress(row["vocab"].as_py()).split(b" "),
                 np.frombuffer(zlib.decompress(row["codes"].as_py()), np.int32),
                 row["lang"].as_py(), bits)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i] for n in batch.schema.names}


def blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per block; its ``phrases`` are its single words."""
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        vocabs: dict[str, defaultdict] = {}
        codes: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}

        def flush(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang in langs:
                every = np.concatenate(codes.pop(lang))
                b = Block(list(vocabs.pop(lang)), every, lang)
                made, held[lang] = made + 1, 0
                counts = np.bincount(every, minlength=1)[1:]
                yield _row(part + made, lang, int(counts.sum()), b, b.words()[1:], counts.tolist())
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(),
                                  batch.column("text").to_pylist(), strict=True):
                for tokens in piece_tokens(text or ""):
                    if lang not in vocabs:
                        vocabs[lang] = defaultdict()
                        vocabs[lang].default_factory = vocabs[lang].__len__
                        vocabs[lang][b"."], codes[lang], held[lang] = 0, [], 0
                    got = np.fromiter(map(vocabs[lang].__getitem__, tokens), np.int32, len(tokens))
                    codes[lang] += [got, np.zeros(1, np.int32)]
                    held[lang] += len(got)
                    if held[lang] >= block_words:
                        yield from flush([lang])
            if sum(held.values()) >= 2 * block_words:  # many languages, none of them full
                yield from flush(list(codes))
        yield from flush(list(codes))

    return slim.mapInArrow(run, _BLOCK)


def fingerprints(step: DataFrame, sizes: range, bits: int = 64) -> DataFrame:
    """``block, fp, pointer, n``: every distinct n-gram of every block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            fps, pointers, counts = _read(row, bits).counted(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(fps), row["block"].as_py(), np.int64)),
                 pa.array(fps.view(np.int64)), pa.array(pointers.astype(np.int64)),
                 pa.array(counts.astype(np.int64))], names=["block", "fp", "pointer", "n"])

    return step.select("block", "lang", "vocab", "codes").mapInArrow(
        run, "block bigint, fp bigint, pointer bigint, n bigint")


def frequent(seen: DataFrame, min_count: int) -> DataFrame:
    """Per block its fingerprints that are frequent over all blocks:
    ``__block, __fps, __pointers``. A block has a bounded number of them."""
    total = F.sum("n").over(Window.partitionBy("fp"))
    kept = seen.withColumn("total", total).filter(F.col("total") >= min_count)
    return kept.groupBy(F.col("block").alias("__block")).agg(
        F.collect_list(F.struct("fp", "pointer")).alias("found")).select(
            "__block", F.col("found.fp").alias("__fps"), F.col("found.pointer").alias("__pointers"))


def next_pass(step: DataFrame, sets: DataFrame, found: range, bits: int = 64) -> DataFrame:
    """Blocks with the frequent phrases of ``found`` words as ``phrases``, cut
    down to what longer phrases can be made of (nothing after the longest)."""
    # both sides grow with the corpus: merged at every size, never broadcast
    joined = step.select("block", "lang", "n_words", "vocab", "codes").join(
        sets.hint("merge"), F.col("block") == F.col("__block")).drop("__block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _read(row, bits)
            fps = row["__fps"].values.to_numpy().view(_U64)
            pointers = row["__pointers"].values.to_numpy()
            keep, texts, counts = np.empty(0, np.int64), [], []
            for n in found:
                keep, new, many = b.found(n, fps, pointers)
                texts, counts = texts + new, counts + many
            rest = b.pruned(keep, found.stop) if found.stop <= LONGEST else None
            yield _row(row["block"].as_py(), b.lang, row["n_words"].as_py(), rest, texts, counts)

    return joined.mapInArrow(run, _BLOCK)


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang",
                  text_col: str = "text", block_words: int = BLOCK_WORDS,
                  bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, a`` of all phrases of one to five words with
    ``a >= min_count`` (both tables written), and ``lang, n``."""
    def common(step: DataFrame) -> DataFrame:
        counted = step.select("lang", F.inline(F.arrays_zip("phrases", "counts")))
        return written(counted.groupBy("lang", F.col("phrases").alias("phrase")).agg(
            F.sum("counts").alias("a")).filter(F.col("a") >= min_count), "phrases")

    step = written(blocks(docs, lang_col, text_col, block_words), "blocks")
    totals = written(step.groupBy("lang").agg(F.sum("n_words").alias("n")), "word-totals")
    counts = common(step)
    for found in (range(2, 3), range(3, LONGEST + 1)):
        sets = written(frequent(fingerprints(step, found, bits), min_count), "frequent")
        after = written(next_pass(step, sets, found, bits), "blocks")
        counts = counts.unionByName(common(after))
        discard(sets), discard(step)
        step = after
    discard(step)
    return counts, totals


def _sub(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, first: int = FIRST,
                 lang_col: str = "lang", text_col: str = "text",
                 block_words: int = BLOCK_WORDS, bits: int = 64) -> DataFrame:
    """Each language's ``first`` phrases: ``lang, rank, phrase, a, l, r, n,
    score``. A phrase's score is that of its weakest cut into two parts,
    floor(1000 a n / (l r)); phrases that occur only inside a longer one are
    left out."""
    counts, totals = phrase_counts(docs, min_count, lang_col, text_col, block_words, bits)
    phrases = counts.withColumn("words", F.split("phrase", " "))
    phrases = phrases.withColumn("size", F.size("words")).filter("size > 1")

    # every cut, with the counts of both parts
    cuts = phrases.select("lang", "phrase", "a", "words", "size",
                          F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _sub(F.col("words"), F.lit(1), F.col("k")).alias("left"),
        _sub(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    wide = [F.col(c).cast("decimal(20,0)").alias(f"__{c}") for c in ("a", "n", "l", "r")]
    scored = (cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
              .join(totals, "lang").select("*", *wide)
              .withColumn("score", F.expr("(1000 * __a * __n) div (__l * __r)")))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the most frequent longer phrase around each phrase
    inner = phrases.filter("size > 2").select(
        "lang", "a", "words", "size",
        F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")).select(
        "lang", "a", "words", "m",
        F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    around = inner.groupBy("lang", _sub(F.col("words"), F.col("at"), F.col("m")).alias("phrase")).agg(
        F.max("a").alias("longer"))
    alone = weakest.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") < F.col("a")))

    alone = written(alone.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "scored")
    return top_by_language(alone, first)


def top_by_language(scored: DataFrame, first: int) -> DataFrame:
    """The ``first`` rows of each language by score, count and phrase, with
    their ``rank``. Groups of about ten times as many rows are cut down first,
    by a hash of the phrase, until the groups that are left make one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]

    def cut(rows: DataFrame, *keys: Column | str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*order))
        return rows.withColumn("rank", place.cast("long")).filter(F.col("rank") <= first)
    groups = scored.count() // (10 * first)
    while groups > 1:
        scored = cut(scored, F.pmod(F.xxhash64("phrase"), F.lit(groups))).drop("rank")
        groups //= 10
    return cut(scored).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
