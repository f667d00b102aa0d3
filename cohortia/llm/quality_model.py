"""Quality classifier: supervised subword embeddings.

A text is the bag of its words, the character n-grams of its words (three to
five code points, word ends marked) and its word pairs, each hashed to one of
``BUCKETS`` learned vectors. The vectors are averaged over all occurrences, a
softmax layer gives the probability of each label, and numpy stochastic
gradient descent trains both. In a pair a word that repeats its neighbour is
written as the same mark for all words, so that repetition itself is a feature.

Training takes at most ``TRAIN_ROWS`` labelled documents with ``TRAIN_ENTRIES``
distinct features, drawn by a hash of the id, in one task; it is the only step
of bounded size. Scoring reads every
text whole, in Arrow batches: as the layer is linear, each bucket is reduced to
one number per label before, and the model of a fixed size travels with the
tasks. Equal inputs give equal models and scores.

Edge cases: a null or empty text, or one of white space, has no feature and gets
the softmax of the bias alone; very long texts are read whole; repeated rows
get equal scores; labels that are null, no 0 or 1, or contradict each other for
one id are not trained on; of documents that repeat an id the smallest text is
trained on; without labels of both kinds all scores are 0.5; an empty table
gives an empty result; columns of any other names are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import BASE, Rolling

BUCKETS = 1 << 18
DIMENSIONS = 16
CHAR_GRAMS = (3, 4, 5)
TRAIN_ROWS = 5000
TRAIN_ENTRIES = 24_000_000  # distinct features, eight bytes each
EPOCHS = 6
RATE = 0.5
BIAS_RATE = 0.1             # of the rate; the bias serves texts with no feature
SEED = 11
PORTION = 1 << 20       # characters that are worked on at once
KNOWN_WORDS = 1 << 18   # words whose features a task keeps; only saves work

_U64 = np.uint64
_SAME = _U64(0x5851F42D4C957F2D)


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((value ^ (value >> _U64(32))) % _U64(buckets)).astype(np.int64)


class Words:
    """Words seen so far. Each has a hash and its own features: the buckets of
    the word and of its character n-grams. With ``weights`` (a number per
    bucket) only their sum and number are kept."""

    def __init__(self, buckets: int, weights: np.ndarray | None = None):
        self.buckets, self.weights = buckets, weights
        self.code: defaultdict[str, int] = defaultdict()
        self.code.default_factory = self.code.__len__
        self.hash = np.empty(0, _U64)
        self.size = np.empty(0, np.int64)
        self.sum = np.empty(0)
        self.features = np.empty(0, np.int32)

    def codes(self, text: str) -> np.ndarray:
        tokens = text.split()
        return np.fromiter(map(self.code.__getitem__, tokens), np.int64, len(tokens))

    def update(self) -> None:
        """Compute the features of words that are new."""
        new = list(islice(self.code, len(self.hash), None))
        if not new:
            return
        points = np.frombuffer(("<" + "> <".join(new) + ">").encode("utf-32-le", "surrogatepass"),
                               np.uint32).astype(_U64)
        rolling = Rolling(points)
        gap = points == 32
        word = np.cumsum(gap)
        starts = np.concatenate([[0], np.flatnonzero(gap) + 1])
        ends = np.concatenate([np.flatnonzero(gap), [len(points)]])
        whole = rolling.windows(starts, ends - starts)
        owner, bucket = [np.arange(len(new))], [_bucket(whole, self.buckets)]
        left = ends[word] - np.arange(len(points))
        for n in CHAR_GRAMS:
            at = np.flatnonzero((left >= n) & ~gap)
            owner.append(word[at]), bucket.append(_bucket(rolling.windows(at, n), self.buckets))
        owner, bucket = np.concatenate(owner), np.concatenate(bucket)
        self.hash = np.concatenate([self.hash, whole])
        self.size = np.concatenate([self.size, np.bincount(owner)])
        if self.weights is not None:
            self.sum = np.concatenate([self.sum, np.bincount(owner, self.weights[bucket])])
        else:
            order = np.argsort(owner, kind="stable")
            self.features = np.concatenate([self.features, bucket[order].astype(np.int32)])

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Buckets of pairs of neighbours, given by their codes."""
        a, b = self.hash[a], self.hash[b]
        mixed = (a ^ (a >> _U64(31))) * _U64(BASE) + b
        return _bucket(np.where(a == b, _SAME, mixed), self.buckets)

    def bag(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a text and how often each occurs."""
        first = np.concatenate([[0], np.cumsum(self.size)])
        word, many = np.unique(codes, return_counts=True)
        size = self.size[word]
        at = np.repeat(first[word] - np.concatenate([[0], np.cumsum(size)])[:-1], size)
        own = self.features[at + np.arange(size.sum())]
        every = np.concatenate([own, self.pairs(codes[:-1], codes[1:])])
        times = np.concatenate([np.repeat(many, size), np.ones(max(len(codes) - 1, 0), np.int64)])
        found, where = np.unique(every, return_inverse=True)
        return found.astype(np.int32), np.bincount(where, times, len(found)).astype(np.int32)


class Embeddings:
    """Vectors of the buckets, and the softmax layer over their mean."""

    def __init__(self, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1, 1, (buckets, dimensions)).astype(np.float32) / dimensions
        self.layer = np.zeros((dimensions, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = mean @ self.layer + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    def train(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int],
              epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> None:
        """Stochastic gradient descent, one text at a time, with a rate that
        falls to zero."""
        rng = np.random.default_rng(seed)
        steps = epochs * len(bags)
        order = [i for _ in range(epochs) for i in rng.permutation(len(bags))]
        for step, i in enumerate(order):
            buckets, counts = bags[i]
            share = (counts / max(counts.sum(), 1)).astype(np.float32)
            mean = share @ self.vectors[buckets]
            wrong = self.probabilities(mean)
            wrong[labels[i]] -= 1
            now = np.float32(rate * (1 - step / steps))
            back = self.layer @ wrong
            self.layer -= now * np.outer(mean, wrong)
            self.bias -= now * wrong * np.float32(BIAS_RATE)
            self.vectors[buckets] -= now * np.outer(share, back)


@dataclass(frozen=True)
class Model:
    """A trained model as a text is scored by it: what one occurrence of each
    bucket adds for label 1 against 0, and the same of the bias."""

    weights: np.ndarray
    bias: float

    def probability(self, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(total / np.maximum(size, 1) + self.bias)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", rows: int = TRAIN_ROWS, entries: int = TRAIN_ENTRIES) -> Model:
    """Model of the labelled documents: at most ``rows`` of them, and of these
    in turn no more than hold ``entries`` distinct features together."""
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    agreed = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).alias("label"), F.max(label_col).alias("most")).filter(
        "label = most and label in (0, 1)").join(ids, "id", "left_semi")
    # at most `rows` rows, whatever the size of the tables
    drawn = agreed.select("id", F.col("label").cast("int").alias("label"),
                          F.xxhash64("id").alias("turn")).orderBy("turn", "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    drawn = texts.join(F.broadcast(drawn), "id").groupBy("turn", "id", "label").agg(
        F.min("text").alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for texts in portions(batch.column("text")):
                words = Words(BUCKETS)
                codes = [words.codes(t) for t in texts]
                words.update()
                found += [words.bag(c) for c in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("turn"), batch.column("label"),
                 pa.array([b.tobytes() for b, _ in found], pa.binary()),
                 pa.array([n.tobytes() for _, n in found], pa.binary())],
                names=["turn", "label", "buckets", "counts"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds, room = [], [], entries
        for batch in batches:
            for label, buckets, counts in zip(*(batch.column(c).to_pylist() for c in (
                    "label", "buckets", "counts")), strict=True):
                room -= len(buckets) // 4
                if room >= 0:
                    held.append((np.frombuffer(buckets, np.int32), np.frombuffer(counts, np.int32)))
                    kinds.append(label)
        weights, bias = np.zeros(BUCKETS, np.float32), 0.0
        if len(set(kinds)) == 2:
            model = Embeddings()
            model.train(held, kinds)
            weights = model.vectors @ (model.layer[:, 1] - model.layer[:, 0])
            bias = float(model.bias[1] - model.bias[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    # the features of the drawn documents meet in one task: bounded by `entries`
    one = (drawn.mapInArrow(bags, "turn bigint, label int, buckets binary, counts binary")
           .repartition(1).sortWithinPartitions("turn")
           .mapInArrow(fit, "weights binary, bias double"))
    got = one.first()
    if got is None:
        return Model(np.zeros(BUCKETS), 0.0)
    return Model(np.frombuffer(got["weights"], np.float32).astype(np.float64), got["bias"])


def portions(texts: pa.Array) -> Iterator[list[str]]:
    """A column's texts in lists of about ``PORTION`` characters, so that the
    arrays of a step do not grow with the rows of a batch."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scored(model: Model, words: Words, texts: list[str]) -> np.ndarray:
    codes = [words.codes(t) for t in texts]
    words.update()
    lengths = np.array([len(c) for c in codes], np.int64)
    codes, n = np.concatenate(codes), len(texts)
    text = np.repeat(np.arange(n), lengths)
    near = np.flatnonzero(text[1:] == text[:-1])
    pair = model.weights[words.pairs(codes[near], codes[near + 1])]
    total = np.bincount(text, words.sum[codes], n) + np.bincount(text[near], pair, n)
    size = np.bincount(text, words.size[codes], n) + np.maximum(lengths - 1, 0)
    return model.probability(total, size)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``id, score``: the probability of label 1, for every row."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Words(len(model.weights), model.weights)
        for batch in batches:
            scores = []
            for texts in portions(batch.column("text")):
                scores.append(_scored(model, words, texts))
                if len(words.code) > KNOWN_WORDS:
                    words = Words(len(model.weights), model.weights)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.concatenate([np.empty(0), *scores]))],
                names=["id", "score"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, score double")
