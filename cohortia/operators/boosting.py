"""Second-order boosting for two classes (M7).

Every round fits one tree to the gradients g and Hessians h of the logistic
loss. A leaf's weight is -T(G) / (H + lambda) with its sums G and H and
T(G) = sign(G) max(|G| - alpha, 0); a split gains
T(Gl)² / (Hl + lambda) + T(Gr)² / (Hr + lambda) - T(G)² / (H + lambda), and is
made if that is more than gamma and both sides have a Hessian of
``min_child_weight`` at least. Rows are drawn anew for every tree, and so is
one set of columns.

The rows stay where they are, packed in blocks: the bin of every value, label
and margin. Each level of a tree is one job: as many tasks as there are cores add
up histograms of g and h, nodes x columns x bins of them however many rows there
are; they meet by node, and the best split of each node reaches the driver. The margins of a round come from those of the round
before; every ``CHECKPOINT_ROUNDS`` rounds they are written to the checkpoint
folder, so a lost executor costs a few rounds of margins. A table of one block
has nothing to add up: its task grows the same trees from the same histograms,
``CHECKPOINT_ROUNDS`` of them a job.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .linear import Design

CHECKPOINT_ROUNDS = 25
BLOCK_ROWS = 50_000


@dataclass(frozen=True)
class Boosting:
    rounds: int = 150
    depth: int = 6
    rate: float = 0.1
    gamma: float = 0.0
    alpha: float = 0.1
    lambda_: float = 1.0
    min_child_weight: float = 1.0
    subsample: float = 0.8
    colsample: float = 0.8
    base_score: float = 0.5
    bins: int = 256
    seed: int = 123


@dataclass
class Tree:
    """Nodes in heap order (root 1, children 2n and 2n + 1): ``splits`` node ->
    (column, bin, gain), ``leaves`` node -> what a row's margin grows by."""
    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Node each row (its bins) has come to."""
        at, size = np.ones(len(bins), np.int64), 2 * max(self.splits, default=0) + 2
        column, cut = np.full(size, -1), np.zeros(size, np.int64)
        for n, (c, b, _) in self.splits.items():
            column[n], cut[n] = c, b
        go = np.arange(len(bins))
        while len(go := go[column[at[go]] >= 0]):
            n = at[go]
            at[go] = 2 * n + (bins[go, column[n]] > cut[n])
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        value = np.zeros(max(self.leaves, default=1) + 1)
        for n, v in self.leaves.items():
            value[n] = v
        return value[self.nodes(bins)]


@dataclass
class Boosted:
    """A boosted model: ``edges`` are the upper bounds of each column's bins
    but the last, ``losses`` the mean log loss after every round."""
    params: Boosting
    names: list[str]
    terms: list[str]
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    losses: list[tuple[int, float, float | None]] = field(default_factory=list)

    def base(self) -> float:
        return float(np.log(self.params.base_score / (1 - self.params.base_score)))


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int) -> list[np.ndarray]:
    """Quantiles of each column from a sketch: at most ``bins`` - 1 distinct
    bounds, the largest value left out."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    r = df.agg(*[F.percentile_approx(c, shares, 10 * bins).alias(c) for c in cols],
               *[F.max(c).alias(f"{c}_max") for c in cols]).first()
    return [np.array(sorted({v for v in r[c] or [] if v < r[f"{c}_max"]}), float) for c in cols]


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of the values: those of bin k are at most ``edges[k]``."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)],
                    axis=1).astype(np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16)


_STATE = "test boolean, n bigint, ids binary, draws binary, y binary, bins binary, margin binary"


def _blocks(d: Design, id_col: str, edges: list[np.ndarray], test: bool, start: float) -> DataFrame:
    rows = d.df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col).alias("draw"),
                       F.col(d.y).cast("double").alias("y"), *d.cols)
    # no more partitions than there are rows for, nor than cores: a task adds up
    # all its blocks, so the histograms of a level do not grow with the rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.coalesce(max(1, min(rows.rdd.getNumPartitions(), -(-rows.count() // BLOCK_ROWS), cores)))
    cols = list(d.cols)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(held: list[pd.DataFrame]) -> pd.DataFrame:
            b = pd.concat(held)
            return pd.DataFrame({
                "test": [test], "n": [len(b)], "ids": [b["id"].to_numpy(np.int64).tobytes()],
                "draws": [b["draw"].to_numpy(np.int64).tobytes()],
                "y": [b["y"].to_numpy(float).tobytes()],
                "bins": [_binned(b[cols].to_numpy(float), edges).tobytes()],
                "margin": [np.full(len(b), start).tobytes()]})
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= BLOCK_ROWS:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    return rows.mapInPandas(pack, _STATE)


@dataclass
class _Block:
    test: bool
    y: np.ndarray
    bins: np.ndarray
    margin: np.ndarray
    draws: np.ndarray

    @staticmethod
    def read(row, columns: int) -> _Block:
        n = int(row.n)
        kind = np.uint8 if len(row.bins) == n * columns else np.uint16
        return _Block(bool(row.test), np.frombuffer(row.y), np.frombuffer(row.bins, kind).reshape(n, columns),
                      np.frombuffer(row.margin), np.frombuffer(row.draws, np.int64))


def _drawn(draws: np.ndarray, turn: int, seed: int, share: float) -> np.ndarray:
    salt = (seed * 0x9E3779B97F4A7C15 + (turn + 1) * 0xD1B54A32D192ED03) & (1 << 64) - 1
    z = draws.view(np.uint64) + np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / 2.0 ** 64 < share


def _log_loss(y: np.ndarray, margin: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -margin, margin)).sum())


def _sums(b: _Block, p: Boosting, turn: int, tree: Tree, level: list[int], columns: list[int],
          size: int) -> np.ndarray:
    """g and h of a block's drawn rows per node of the level, column and bin."""
    at = tree.nodes(b.bins)
    known = np.full(max(int(at.max(initial=1)), max(level)) + 1, -1)
    known[level] = range(len(level))
    rows = np.flatnonzero((known[at] >= 0) & _drawn(b.draws, turn, p.seed, p.subsample))
    share = 1 / (1 + np.exp(-b.margin[rows]))
    cell = (known[at[rows]][:, None] * len(columns) + np.arange(len(columns))) * size \
        + b.bins[rows][:, columns]
    return np.stack([np.bincount(cell.ravel(), np.repeat(v, len(columns)), len(level) * len(columns) * size)
                     for v in (share - b.y[rows], share * (1 - share))])


def _cells(sums: np.ndarray, level: list[int], columns: list[int], size: int) -> pd.DataFrame:
    full = np.flatnonzero(sums[1])
    node, rest = np.divmod(full, len(columns) * size)
    return pd.DataFrame({"node": np.array(level)[node], "column": rest // size, "bin": rest % size,
                         "g": sums[0][full], "h": sums[1][full]})


# nodes whose histograms one task merges
MERGED_NODES = 16


def _merged(state: DataFrame, p: Boosting, turn: int, tree: Tree, level: list[int], columns: list[int],
            width: int, size: int, losses: bool, of_node, schema: str) -> pd.DataFrame:
    """``of_node`` of the sums of g and h per node, column and bin, over all
    blocks; with ``losses`` also rows of node -1 (train) and -2 (test): G the
    log loss, H the number of rows. A task sends one row per node."""
    read = state.select("test", "n", "draws", "y", "bins", "margin")
    if not losses:
        read = read.filter("not test")
    cells = len(columns) * size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, loss = np.zeros((2, len(level) * cells)), np.zeros((2, 2))
        for batch in batches:
            for row in batch.itertuples():
                b = _Block.read(row, width)
                if losses:
                    loss[int(b.test)] += _log_loss(b.y, b.margin), len(b.y)
                if not b.test:
                    sums += _sums(b, p, turn, tree, level, columns, size)
        part = TaskContext.get().partitionId()
        for k, node in enumerate(level):
            own = sums[:, k * cells:(k + 1) * cells]
            if own[1].any():
                yield pd.DataFrame({"node": [node], "part": [part], "sums": [own.tobytes()]})
        if losses:
            yield pd.DataFrame({"node": [-1, -2], "part": part, "sums": [v.tobytes() for v in loss]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        node = int(pdf["node"].iloc[0])
        # in the order of the tasks: equal sums in every run
        total = sum(np.frombuffer(v) for v in pdf.sort_values("part")["sums"])
        if node < 0:
            return pd.DataFrame({"node": [node], "G": [total[0]], "H": [total[1]]}).reindex(columns=names)
        return of_node(_cells(total.reshape(2, -1), [node], columns, size)).reindex(columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return read.mapInPandas(run, "node bigint, part int, sums binary").repartition(
        1 + len(level) // MERGED_NODES, "node").groupBy("node").applyInPandas(merge, schema).toPandas()


def _best_splits(state: DataFrame, p: Boosting, turn: int, tree: Tree, level: list[int], columns: list[int],
                 width: int, size: int, losses: bool) -> pd.DataFrame:
    """The best allowed split of every node of the level, see ``best_splits``."""
    return _merged(state, p, turn, tree, level, columns, width, size, losses, lambda c: best_splits(c, p),
                   "node bigint, G double, H double, column double, bin double, gain double, lg double, lh double")


def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _quality(g, h, p: Boosting):
    return _shrunk(g, p.alpha) ** 2 / (h + p.lambda_)


def split_gains(cells: pd.DataFrame, p: Boosting) -> pd.DataFrame:
    """Every split of every node: ``node, column, bin, gain`` (values up to the
    bin go left), the sums ``G, H`` of the node and ``lg, lh`` of the left side;
    ``ok`` if the split is allowed."""
    cells = cells.sort_values(["node", "column", "bin"]).reset_index(drop=True)
    of = cells.groupby(["node", "column"])
    lg, lh = of["g"].cumsum(), of["h"].cumsum()
    G, H = of["g"].transform("sum"), of["h"].transform("sum")
    ok = (lh >= p.min_child_weight) & (H - lh >= p.min_child_weight) & of["bin"].shift(-1).notna()
    gain = _quality(lg, lh, p) + _quality(G - lg, H - lh, p) - _quality(G, H, p)
    return cells[["node", "column", "bin"]].assign(gain=gain, G=G, H=H, lg=lg, lh=lh, ok=ok)


def best_splits(cells: pd.DataFrame, p: Boosting) -> pd.DataFrame:
    """A row per node: its sums ``G, H`` and the allowed split that gains most
    (``column, bin, gain, lg, lh``, missing if none is allowed)."""
    found = split_gains(cells, p)
    best = found[found["ok"]].sort_values(["node", "gain", "column", "bin"], ascending=[True, False, True, True])
    best = best.groupby("node", as_index=False).first()[["node", "column", "bin", "gain", "lg", "lh"]]
    return found.groupby("node", as_index=False)[["G", "H"]].first().merge(best, "left", "node")


def _extend(tree: Tree, best: pd.DataFrame, columns: list[int], p: Boosting, last: bool) -> list[int]:
    """Split the nodes of a level where that gains more than gamma, make leaves
    of the others, and of the children of the ``last`` level that is split;
    returns the nodes of the next level."""
    def leaf(g: float, h: float) -> float:
        return float(-p.rate * _shrunk(g, p.alpha) / (h + p.lambda_))
    new = []
    for b in best.sort_values("node").to_dict("records"):
        node, G, H = int(b["node"]), b["G"], b["H"]
        if not b["gain"] > p.gamma + 1e-12:
            tree.leaves[node] = leaf(G, H)
            continue
        tree.splits[node] = (columns[int(b["column"])], int(b["bin"]), float(b["gain"]))
        if last:
            tree.leaves[2 * node], tree.leaves[2 * node + 1] = leaf(b["lg"], b["lh"]), leaf(G - b["lg"], H - b["lh"])
        else:
            new += [2 * node, 2 * node + 1]
    return new


def _columns(p: Boosting, width: int, turn: int) -> list[int]:
    """The columns a tree may use: one draw per tree."""
    rng = np.random.default_rng([p.seed, turn])
    return sorted(rng.choice(width, max(1, int(p.colsample * width)), replace=False).tolist())


def fit(train: Design, params: Boosting, id_col: str, test: Design | None = None
        ) -> tuple[Boosted, DataFrame]:
    """The model, and ``id, test, label, score`` of all rows of both tables.

    The designs keep an integer id; their columns must be the same.
    """
    spark = train.df.sparkSession
    p, width = params, len(train.cols)
    model = Boosted(p, train.names, train.terms, bin_edges(train.df, train.cols, p.bins))
    size = max(map(len, model.edges)) + 1
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    state = _blocks(train, id_col, model.edges, False, model.base())
    if test is not None:
        state = state.unionByName(_blocks(test, id_col, model.edges, True, model.base()))
    # packed rows of their own: later plans do not carry the designs' along
    state = state.checkpoint()
    blocks = {r["test"]: r["n"] for r in state.groupBy("test").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not blocks.get(False):
        raise ValueError("no complete rows to train on")
    grow = _grow_alone if max(blocks.values()) == 1 else _grow_together
    state = grow(model, state, width, size)

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame({"id": np.frombuffer(row.ids, np.int64), "test": bool(row.test),
                                    "label": np.frombuffer(row.y).astype(np.int32),
                                    "score": 1 / (1 + np.exp(-np.frombuffer(row.margin)))})
    return model, state.mapInPandas(scores, "id bigint, test boolean, label int, score double")


def _grow_together(model: Boosted, state: DataFrame, width: int, size: int) -> DataFrame:
    """All rounds, a job a level; the blocks with their last margins."""
    p, before = model.params, None
    state = state.persist(StorageLevel.MEMORY_AND_DISK)

    def losses(found: pd.DataFrame, turn: int) -> None:
        by = {int(r.node): r.G / r.H for r in found[found["node"] < 0].itertuples() if r.H}
        model.losses.append((turn, by.get(-1), by.get(-2)))
    for turn in range(p.rounds):
        columns, tree, level = _columns(p, width, turn), Tree(), [1]
        for depth in range(p.depth):
            found = _best_splits(state, p, turn, tree, level, columns, width, size, depth == 0)
            if depth == 0 and before is not None:
                before.unpersist()
            if depth == 0 and turn:
                losses(found, turn)
            level = _extend(tree, found[found["node"] >= 0], columns, p, depth == p.depth - 1)
            if not level:
                break
        model.trees.append(tree)
        # the margins before are kept until the first job of the next round has those after
        before, state = state, _step(state, tree, width, turn)
    losses(_best_splits(state, p, p.rounds, Tree(), [1], [0], width, size, True), p.rounds)
    return state


def _grow_alone(model: Boosted, state: DataFrame, width: int, size: int) -> DataFrame:
    """The same for one block of training rows, ``CHECKPOINT_ROUNDS`` rounds a
    job. Test blocks are few as well: both tables are dealt alike."""
    p = model.params
    state = state.coalesce(1)
    for first in range(0, p.rounds, CHECKPOINT_ROUNDS):
        turns = range(first, min(first + CHECKPOINT_ROUNDS, p.rounds))

        def run(batches, turns=turns):
            rows = pd.concat(list(batches), ignore_index=True)
            blocks = [_Block.read(r, width) for r in rows.itertuples()]
            made = []
            for turn in turns:
                columns, tree, level = _columns(p, width, turn), Tree(), [1]
                for depth in range(p.depth):
                    sums = sum(_sums(b, p, turn, tree, level, columns, size) for b in blocks if not b.test)
                    best = best_splits(_cells(sums, level, columns, size), p)
                    level = _extend(tree, best, columns, p, depth == p.depth - 1)
                    if not level:
                        break
                mean = []
                for b in blocks:
                    b.margin = b.margin + tree.margins(b.bins)
                for test in (False, True):
                    own = [b for b in blocks if b.test == test]
                    n = sum(len(b.y) for b in own)
                    mean.append(sum(_log_loss(b.y, b.margin) for b in own) / n if n else None)
                made.append((tree, (turn + 1, *mean)))
            rows["margin"] = [b.margin.tobytes() for b in blocks]
            rows["made"] = [pickle.dumps(made) if not b.test else None for b in blocks]
            yield rows

        after = state.drop("made").mapInPandas(run, _STATE + ", made binary").checkpoint()
        for r in after.filter("made is not null").select("made").collect():
            for tree, losses in pickle.loads(r["made"]):
                model.trees.append(tree)
                model.losses.append(losses)
        state = after
    return state.drop("made")


def _step(state: DataFrame, tree: Tree, width: int, turn: int) -> DataFrame:
    """The blocks with the tree's margins added."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["margin"] = [(b.margin + tree.margins(b.bins)).tobytes() for b in (
                _Block.read(row, width) for row in batch.itertuples())]
            yield batch
    after = state.mapInPandas(run, _STATE)
    if (turn + 1) % CHECKPOINT_ROUNDS == 0:
        after = after.checkpoint()
    return after.persist(StorageLevel.MEMORY_AND_DISK)


def predict(model: Boosted, d: Design, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``label`` and ``score`` of any design with the same columns."""
    names, base = list(d.cols), model.base()
    trees, edges = model.trees, model.edges

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins = _binned(b[names].to_numpy(float), edges)
            margin = sum((t.margins(bins) for t in trees), np.full(len(b), base))
            yield b[[*keep, "label"]].assign(score=1 / (1 + np.exp(-margin)))

    rows = d.df.select(*keep, F.col(d.y).cast("int").alias("label"), *names)
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep, "label").dtypes)
    return rows.mapInPandas(run, kept + ", score double")


def gain_importance(spark: SparkSession, model: Boosted) -> DataFrame:
    """Share of all splits' gains per column, largest first."""
    total: dict[int, float] = {}
    for t in model.trees:
        for column, _, gain in t.splits.values():
            total[column] = total.get(column, 0.0) + gain
    every = sum(total.values()) or 1.0
    rows = sorted(((model.names[c], model.terms[c], v / every) for c, v in total.items()), key=lambda r: -r[2])
    return spark.createDataFrame(rows, "Variable string, term string, Importance double")


def root_gains(train: Design, params: Boosting, id_col: str) -> DataFrame:
    """All splits of the first tree's root without drawing rows or columns:
    ``Variable, cut, gain``."""
    p = Boosting(**{**params.__dict__, "subsample": 1.0})
    edges = bin_edges(train.df, train.cols, p.bins)
    start = float(np.log(p.base_score / (1 - p.base_score)))
    found = _merged(_blocks(train, id_col, edges, False, start), p, 0, Tree(), [1], list(range(len(train.cols))),
                    len(train.cols), max(map(len, edges)) + 1, False, lambda c: split_gains(c, p),
                    "node bigint, column bigint, bin bigint, gain double, G double, H double, lg double, lh double, "
                    "ok boolean")
    rows = [(train.names[int(r.column)], float(edges[int(r.column)][int(r.bin)]), float(r.gain))
            for r in found[found["ok"]].itertuples()]
    return train.df.sparkSession.createDataFrame(rows, "Variable string, cut double, gain double")
