"""Histogram boosting with second-order gain: one model over all rows, or a search over many.

The loss is squared error on the label. A split of a node with gradient sum G
and weight H gains S(L) + S(R) - S(node), where S = T(G)^2 / (H + l2) and T
shrinks towards zero by l1; a leaf's value is -T(G) / (H + l2). Features are
cut into at most ``BINS`` bins at percentiles of the whole training table, and
the binned matrix is stored once, in blocks of rows: (fold, x, y).

* ``fit_shared`` fits models over all rows in shared passes. Every level of
  every model's current tree is ONE pass without a shuffle: tasks add up their
  blocks, the driver adds up the tasks' sums, whose number is fixed by depth,
  features and bins, and picks the splits. The blocks are kept with their margins.
  Equal binned rows are one cell with a count, unless rows are drawn by chance.
* ``search`` runs all draws and folds at once. The models are dealt to tasks; a
  model learns from ALL labelled rows of the other folds, which its task keeps in
  files, and is judged on all rows of its fold, cell by cell. Models never travel.

Both use the same histograms and the same choice of splits.
"""

from __future__ import annotations

import itertools
import os
import random
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonon.session import scratch_path, ship_package

from .prepare import hash_bucket

BINS = 32
BLOCK_ROWS = 16_384
MANY_ROWS = 4096
PART_ROWS = 1 << 18
IN_MEMORY = 32 << 20
SENT_ROWS = 2048            # rows of a block that is sent to the tasks of a search


@dataclass(frozen=True)
class Settings:
    """Parameters of one model; the defaults are those of the untuned second configuration."""

    rounds: int = 100
    step: float = 0.3
    depth: int = 6
    row_share: float = 1.0
    column_share: float = 1.0
    least_gain: float = 0.0
    l1: float = 0.0
    l2: float = 1.0
    least_weight: float = 1.0
    seed: int = 42


def draws(n: int, seed: int = 42, rounds: tuple[int, int] = (100, 999)) -> list[Settings]:
    """Seeded draws over the ranges of the reference's search.

    Fixed values: rounds 100-999, step 0.01-0.31, depth 3-14, row and column shares 0.6-1.0,
    least gain 0-0.5, l1 0-1, l2 1-3.
    """
    rng = random.Random(seed)
    return [Settings(rounds=rng.randint(*rounds), step=rng.uniform(0.01, 0.31), depth=rng.randint(3, 14),
                     row_share=rng.uniform(0.6, 1.0), column_share=rng.uniform(0.6, 1.0),
                     least_gain=rng.uniform(0.0, 0.5), l1=rng.uniform(0.0, 1.0), l2=rng.uniform(1.0, 3.0),
                     seed=seed + k) for k in range(n)]


# ---------------------------------------------------------------- kernels

def soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def histograms(x: np.ndarray, node: np.ndarray, g: np.ndarray, nodes: int, n: np.ndarray | None = None,
               bins: int = BINS, rows: np.ndarray | None = None) -> np.ndarray:
    """(2, nodes, features, bins): gradient sums and weights (``n``, or 1 a row) of rows with bins ``x`` in ``node``.

    With ``rows`` only those rows of ``x`` count, and the other arrays hold them alone.
    """
    width = x.shape[1]
    if len(node) > MANY_ROWS:                     # the same sums, column by column
        out, start = np.empty((2, nodes, width, bins)), node * bins
        for k in range(width):
            at = start + (x[:, k] if rows is None else x[:, k][rows])
            out[0, :, k] = np.bincount(at, g, nodes * bins).reshape(nodes, bins)
            out[1, :, k] = np.bincount(at, n, nodes * bins).reshape(nodes, bins)
        return out
    x = x if rows is None else x[rows]
    at = ((node[:, None] * width + np.arange(width)) * bins + x).ravel()
    size = nodes * width * bins
    return np.stack([np.bincount(at, np.repeat(g, width), size),
                     np.bincount(at, None if n is None else np.repeat(n, width), size)]).reshape(2, nodes, width, bins)


def best_splits(sums: np.ndarray, s: Settings, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) of the best split of every node; rows up to ``bin`` go left. Ties: the first
    feature, then the lowest bin. ``columns`` marks the features this tree may use."""
    g, h = sums
    total_g, total_h = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
    left_g, left_h = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    with np.errstate(divide="ignore", invalid="ignore"):      # an empty side without l2: out in the next line
        gain = soft(left_g, s.l1) ** 2 / (left_h + s.l2) + soft(right_g, s.l1) ** 2 / (right_h + s.l2) \
            - soft(total_g, s.l1) ** 2 / (total_h + s.l2)
    gain[(left_h < s.least_weight) | (right_h < s.least_weight)] = -np.inf
    gain[:, ~columns] = -np.inf
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    return flat[np.arange(len(at)), at], at // gain.shape[2], at % gain.shape[2]


def drawn_columns(s: Settings, model: int, rnd: int, width: int) -> np.ndarray:
    keep = max(1, int(s.column_share * width))
    out = np.zeros(width, bool)
    out[np.random.default_rng([s.seed, model, rnd]).permutation(width)[:keep]] = True
    return out


def drawn_rows(s: Settings, model: int, rnd: int, block: int, n: int) -> np.ndarray:
    if s.row_share >= 1.0:
        return np.arange(n)
    return np.flatnonzero(np.random.default_rng([s.seed, model, rnd, block]).random(n) < s.row_share)


class Tree:
    """Nodes level by level: feature (-1: leaf), bin, first child, value, weight of the rows, gain of the split."""

    def __init__(self) -> None:
        self.feature, self.bin, self.left, self.value, self.cover, self.gain = (np.full(1, v, t) for v, t in (
            (-1, np.int16), (0, np.int16), (0, np.int32), (0.0, np.float64), (0.0, np.float64), (0.0, np.float64)))
        self.start = 0                            # first node of the lowest level

    def extend(self, sums: np.ndarray, s: Settings, columns: np.ndarray, last: bool) -> bool:
        """Give the lowest level its values and, unless it is the ``last``, its splits."""
        g, h = sums[0][:, 0].sum(axis=1), sums[1][:, 0].sum(axis=1)
        self.value[self.start:] = -soft(g, s.l1) / (h + s.l2) * s.step
        self.cover[self.start:] = h
        if last:
            return False
        gain, feature, cut = best_splits(sums, s, columns)
        good = gain > max(s.least_gain, 1e-6)
        if not good.any():
            return False
        at = self.start + np.flatnonzero(good)
        n = len(self.feature)
        self.feature[at], self.bin[at], self.gain[at] = feature[good], cut[good], gain[good]
        self.left[at] = n + 2 * np.arange(len(at))
        more = 2 * len(at)
        self.feature = np.concatenate((self.feature, np.full(more, -1, np.int16)))
        self.bin, self.left, self.value, self.cover, self.gain = (
            np.concatenate((v, np.zeros(more, v.dtype)))
            for v in (self.bin, self.left, self.value, self.cover, self.gain))
        self.start = n
        return True

    def down(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The next node of every row (leaves stay)."""
        return self.walk(x, 1, node)

    def walk(self, x: np.ndarray, steps: int, node: np.ndarray | None = None) -> np.ndarray:
        """The node of every row, ``steps`` levels below ``node`` (the root) or at a leaf above."""
        inner = self.feature >= 0
        feature, cut = np.where(inner, self.feature, 0).astype(np.int64), np.where(inner, self.bin, 32_767)
        after = np.where(inner, self.left, np.arange(len(inner), dtype=np.int64))
        flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x), dtype=np.int64) * x.shape[1]
        node = np.zeros(len(x), np.int64) if node is None else node
        for _ in range(steps):
            node = after[node] + (flat[row + feature[node]] > cut[node])
        return node

    def levels(self) -> int:
        """Levels below the root."""
        at, n = np.zeros(1, np.int64), 0
        while len(at := at[self.feature[at] >= 0]):
            at, n = np.concatenate((self.left[at], self.left[at] + 1)), n + 1
        return n

    def leaves(self, x: np.ndarray) -> np.ndarray:
        return self.walk(x, self.levels())


def in_file(shape: tuple[int, ...], kind: type) -> np.ndarray:
    """An array of zeros; a large one lies in a file of the task's local folder, and the system keeps in memory
    what fits. The file goes with the array."""
    if int(np.prod(shape)) * np.dtype(kind).itemsize <= IN_MEMORY:
        return np.zeros(shape, kind)
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as f:
        return np.memmap(f, kind, "w+", shape=shape)


def parts(n: int) -> Iterator[slice]:
    return (slice(a, min(n, a + PART_ROWS)) for a in range(0, n, PART_ROWS))


def base_value(y: np.ndarray) -> float:
    return float(sum(y[p].sum() for p in parts(len(y))) / len(y)) if len(y) else 0.0


def grown(x: np.ndarray, y: np.ndarray, s: Settings, model: int = 0) -> Iterator[Tree]:
    """The trees of one model on all rows, one after the other.

    A level is one pass over the rows in parts of ``PART_ROWS``: beside the arrays of ``in_file`` only a part and
    the sums of a level are held. The lowest level's values follow from the sums of the splits above it.
    """
    n, width = x.shape
    by_column = in_file((width, n), np.uint8)
    margin, node, keep = in_file((n,), float), in_file((n,), np.int32), in_file((n,), bool)
    base = base_value(y)
    for p in parts(n):
        by_column[:, p], margin[p] = x[p].T, base
    for rnd in range(s.rounds if n else 0):
        tree, columns, sums = Tree(), drawn_columns(s, model, rnd, width), np.zeros(0)
        for level in range(s.depth + 1):
            last = level == s.depth and level > 0
            sums = _child_totals(tree, sums) if last else np.zeros((2, len(tree.feature) - tree.start, width, BINS))
            for number, p in enumerate(parts(n)):
                if level == 0:
                    keep[p], node[p] = False, 0
                    keep[p][drawn_rows(s, model, rnd, number, p.stop - p.start)] = True
                    at = node[p]
                else:
                    node[p] = at = tree.walk(x[p], 1, node[p])
                if not last:
                    rows = np.flatnonzero(keep[p] & (at >= tree.start))
                    sums += histograms(by_column[:, p].T, at[rows].astype(np.int64) - tree.start,
                                       (margin[p] - y[p])[rows], sums.shape[1], rows=rows)
            if not tree.extend(sums, s, columns, level == s.depth):
                break
        for p in parts(n):
            margin[p] += tree.value[node[p]]
        yield tree


def boost(x: np.ndarray, y: np.ndarray, s: Settings, model: int = 0) -> tuple[float, list[Tree]]:
    """(base value, trees) of one model on the rows."""
    return base_value(y), list(grown(x, y, s, model))


def predict(base: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), base)
    for tree in trees:
        out += tree.value[tree.leaves(x)]
    return out


# ---------------------------------------------------------------- binned blocks

@dataclass
class Binning:
    """Cut points of every feature and its median, from the whole training table."""

    features: list[str]
    cuts: list[np.ndarray]
    medians: list[float]

    def apply(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(columns[0]), len(columns)), np.uint8)
        for k, v in enumerate(columns):
            v = np.where(np.isnan(v), self.medians[k], v)
            out[:, k] = np.searchsorted(self.cuts[k], v, side="left")
        return out


def fit_binning(train: DataFrame, features: list[str], bins: int = BINS) -> Binning:
    """Percentile cuts and medians over all rows (one aggregate); a value up to a cut is left of it."""
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    clean = [F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")) for f in features]
    row = train.agg(*[F.percentile_approx(c, at, 10_000).alias(f"c{k}") for k, c in enumerate(clean)],
                    *[F.percentile_approx(c, 0.5, 10_000).alias(f"m{k}") for k, c in enumerate(clean)]).first()
    return Binning(features, [np.unique(np.asarray(row[f"c{k}"] or [], float)) for k in range(len(features))],
                   [row[f"m{k}"] if row[f"m{k}"] is not None else 0.0 for k in range(len(features))])


BLOCKS = "fold int, block long, x binary, y binary"


def binned(train: DataFrame, binning: Binning, label: str, key: str, folds: int,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of at most ``block_rows`` rows of one fold, without a shuffle. Rows without a label are
    left out; the fold is a stable hash of ``key``."""
    rows = train.where(F.col(label).isNotNull() & ~F.isnan(label)).select(
        hash_bucket(key, folds).alias("fold"), F.col(label).cast("double").alias("y"),
        *[F.col(f"`{f}`").cast("double").alias(f"x{k}") for k, f in enumerate(binning.features)])
    width = len(binning.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def made(f: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([f], pa.int32()), pa.array([number], pa.int64()), pa.array([x.tobytes()], pa.binary()),
                 pa.array([y.tobytes()], pa.binary())], names=["fold", "block", "x", "y"])

        for batch in batches:
            fold = batch.column(0).to_numpy()
            y = batch.column(1).to_numpy()
            x = binning.apply([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(width)])
            for f in np.unique(fold).tolist():
                part = held.setdefault(f, [])
                part.append((x[fold == f], y[fold == f]))
                if sum(len(p[1]) for p in part) >= block_rows:
                    x_all, y_all = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
                    whole = len(y_all) // block_rows * block_rows
                    for a in range(0, whole, block_rows):
                        yield made(f, x_all[a:a + block_rows], y_all[a:a + block_rows])
                    held[f] = [(x_all[whole:], y_all[whole:])]
        for f, part in held.items():
            y_all = np.concatenate([p[1] for p in part])
            if len(y_all):
                yield made(f, np.concatenate([p[0] for p in part]), y_all)

    ship_package(train.sparkSession)
    return rows.mapInArrow(run, BLOCKS)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(x: bytes, width: int) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(-1, width)


# ---------------------------------------------------------------- cells: equal binned rows as one

CELLS = "fold int, x binary, n double, mean double, spread double"


def cells(train: DataFrame, binning: Binning, label: str, key: Column | str, folds: int) -> DataFrame:
    """One row per (fold, binned row): the rows in it, their mean label and its variance.

    Squared error needs no more of the rows, and there are never more cells than rows or than the grid
    of bins has places.
    """
    rows = train.where(F.col(label).isNotNull() & ~F.isnan(label)).select(
        hash_bucket(key, folds).alias("fold"), F.col(label).cast("double").alias("y"),
        *[F.col(f"`{f}`").cast("double").alias(f"x{k}") for k, f in enumerate(binning.features)])
    width = len(binning.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = binning.apply([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(width)])
            edges = np.arange(0, len(x) * width + 1, width, dtype=np.int32) if width else np.zeros(len(x) + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(edges), pa.py_buffer(x)]),
                 batch.column(1)], names=["fold", "x", "y"])

    ship_package(train.sparkSession)
    return rows.mapInArrow(run, "fold int, x binary, y double").groupBy("fold", "x").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("spread"))


def cell_blocks(held: DataFrame) -> DataFrame:
    """Blocks of cells for ``fit_shared``: labels are means, ``n`` the rows behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            folds = batch.column(0).to_numpy()
            for f in np.unique(folds).tolist():
                number += 1
                part = batch.filter(pa.array(folds == f))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f], pa.int32()), pa.array([number], pa.int64()),
                     pa.array([b"".join(part.column(1).to_pylist())], pa.binary()),
                     *(pa.array([part.column(k).to_numpy().tobytes()], pa.binary()) for k in (3, 2))],
                    names=["fold", "block", "x", "y", "n"])

    return held.mapInArrow(run, BLOCKS + ", n binary")


# ---------------------------------------------------------------- all rows, in shared passes

STATE = BLOCKS + ", n binary, m binary"
NAMES = ["fold", "block", "x", "y", "n", "m"]
STORE_EVERY = 20


def fit_shared(blocks: DataFrame, width: int, models: list[tuple[Settings, int | None]],
               first_step: float | None = None, usable: list[np.ndarray] | None = None
               ) -> list[tuple[float, list[Tree]]]:
    """Models (settings, fold left out or None), all grown at once over all rows of ``blocks``.

    ``first_step`` is the step of the first round if it differs; ``usable`` marks the features of each model.
    ``blocks`` may hold cells (column ``n``: the rows behind each label). Jobs: one a level (the deepest
    model's) without a shuffle, whatever the number of models; the values of the lowest level follow from the
    sums of the splits above it. The blocks are kept with their margins; a round's first pass brings
    them up to date, and every ``STORE_EVERY`` rounds they are stored.
    """
    spark = blocks.sparkSession
    weight = F.col("n") if "n" in blocks.columns else F.lit(None).cast("binary")
    state = blocks.select("fold", "block", "x", "y", weight.alias("n"))
    parts = max(1, spark.sparkContext.defaultParallelism)
    mean = _block_means(state)
    bases = []
    for _, out in models:
        kept = [(n, t) for f, (n, t) in mean.items() if f != out]
        bases.append(sum(t for _, t in kept) / max(1.0, sum(n for n, _ in kept)))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [np.repeat(bases, len(y) // 8).tobytes() for y in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m, pa.binary())], names=NAMES)

    state = _stored(state.repartition(parts, "block").mapInArrow(start, STATE), "boost").coalesce(parts).persist()
    old = state
    grown: list[list[Tree]] = [[] for _ in models]
    for rnd in range(max(s.rounds for s, _ in models)):
        trees: dict[int, Tree] = {k: Tree() for k, (s, _) in enumerate(models) if rnd < s.rounds}
        columns = {k: drawn_columns(models[k][0], k, rnd, width) for k in trees}
        if usable is not None:
            columns = {k: v & usable[k] for k, v in columns.items()}
        now = [s if rnd or first_step is None else replace(s, step=first_step) for s, _ in models]
        open_trees, level, sums = dict(trees), 0, {}
        while open_trees:
            low = {k: t for k, t in open_trees.items() if level and level == models[k][0].depth}
            sums = {k: _child_totals(t, sums[k]) for k, t in low.items()} | _level_sums(
                state, width, models, {k: t for k, t in open_trees.items() if k not in low}, rnd)
            open_trees = {k: t for k, t in open_trees.items()
                          if t.extend(sums[k], now[k], columns[k], level == now[k].depth)}
            level += 1
        for k, t in trees.items():
            grown[k].append(t)
        if old is not state:
            old.unpersist()
        old, state = state, _with_margins(state, width, trees)
        if rnd % STORE_EVERY == STORE_EVERY - 1:
            state = _stored(state, "boost").coalesce(parts)
        state = state.persist()                       # the next round's first pass fills it
    old.unpersist()
    state.unpersist()
    return list(zip(bases, grown, strict=True))


def _weights(n: bytes | None, rows: int) -> np.ndarray:
    return np.ones(rows) if n is None else np.frombuffer(n, float)


def _block_means(state: DataFrame) -> dict[int, tuple[float, float]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = [np.frombuffer(v, float) for v in batch.column(1).to_pylist()]
            n = [_weights(v, len(y[k])) for k, v in enumerate(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(v.sum()) for v in n], pa.float64()),
                 pa.array([float((v * w).sum()) for v, w in zip(y, n, strict=True)], pa.float64())],
                names=["fold", "n", "t"])

    got = state.select("fold", "y", "n").mapInArrow(run, "fold int, n double, t double").groupBy("fold").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    return {r["fold"]: (r["n"], r["t"]) for r in got}


def _child_totals(t: Tree, sums: np.ndarray) -> np.ndarray:
    """Gradient sums and weights of the lowest level, from the histograms of the level above it."""
    parents = np.flatnonzero(t.left >= t.start)
    local = parents - (t.start - sums.shape[1])
    own = sums[:, local, t.feature[parents]]
    left = np.where(np.arange(own.shape[2]) <= t.bin[parents, None], own, 0.0).sum(axis=2)
    return np.stack((left, own.sum(axis=2) - left), axis=2).reshape(2, -1, 1, 1)


def _level_sums(state: DataFrame, width: int, models: list, trees: dict[int, Tree], rnd: int) -> dict[int, np.ndarray]:
    """Histograms of the lowest level of every open tree: one pass, one row of fixed size a task."""
    if not trees:
        return {}
    shapes = {k: (2, len(t.feature) - t.start, width, BINS) for k, t in trees.items()}
    depths = {k: t.levels() for k, t in trees.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(v) for k, v in shapes.items()}
        for batch in batches:
            for fold, block, xb, yb, nb, mb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = _matrix(xb, width), np.frombuffer(yb, float)
                n = _weights(nb, len(y))
                margins = np.frombuffer(mb, float).reshape(-1, len(y))
                for k, t in trees.items():
                    s, out = models[k]
                    if out == fold:
                        continue
                    px, g, w = x, (margins[k] - y) * n, n
                    if s.row_share < 1.0:
                        picked = drawn_rows(s, k, rnd, block, len(y))
                        px, g, w = x[picked], g[picked], n[picked]
                    node = t.walk(px, depths[k])
                    low = np.flatnonzero(node >= t.start)
                    if len(low) < len(node):
                        px, g, w, node = px[low], g[low], w[low], node[low]
                    sums[k] += histograms(px, node - t.start, g, sums[k].shape[1], w)
        packed = zlib.compress(b"".join(v.tobytes() for v in sums.values()), 1)
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["v"])

    total = np.zeros(sum(int(np.prod(v)) for v in shapes.values()))
    for r in state.mapInArrow(run, "v binary").collect():
        total += np.frombuffer(zlib.decompress(r["v"]))
    out, at = {}, 0
    for k, v in shapes.items():
        out[k] = total[at:at + int(np.prod(v))].reshape(v)
        at += int(np.prod(v))
    return out


def _with_margins(state: DataFrame, width: int, trees: dict[int, Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for xb, yb, mb in zip(*(batch.column(i).to_pylist() for i in (2, 3, 5)), strict=True):
                x, n = _matrix(xb, width), len(yb) // 8
                m = np.frombuffer(mb, float).reshape(-1, n).copy()
                for k, t in trees.items():
                    m[k] += t.value[t.leaves(x)]
                new.append(m.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(new, pa.binary())], names=NAMES)

    return state.mapInArrow(run, STATE)


@dataclass
class BoostedModel:
    """A fitted model: ``transform`` adds the prediction; features are binned as in the fit."""

    binning: Binning
    base: float
    trees: list[Tree]

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` and its prediction; a missing feature counts as the training median."""
        ship_package(df.sparkSession)
        held = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            m = held.value
            for part in parts:
                x = m.binning.apply([part[c].to_numpy(float) for c in part.columns])
                yield pd.Series(predict(m.base, m.trees, x))

        return df.withColumn(name, score(F.struct(*[F.col(f"`{f}`").cast("double").alias(f"x{k}")
                                                    for k, f in enumerate(self.binning.features)])))


def fit_boosted(train: DataFrame, features: list[str], label: str, key: str,
                settings: Settings = Settings()) -> BoostedModel:
    """The second boosted-tree configuration over all rows of ``train`` with a label."""
    binning = fit_binning(train, features)
    blocks = (binned(train, binning, label, key, 1) if settings.row_share < 1.0 else     # rows are drawn one by one
              cell_blocks(cells(train, binning, label, key, 1)))
    (base, trees), = fit_shared(_stored(blocks, "binned"), len(features), [(settings, None)])
    return BoostedModel(binning, base, trees)


# ---------------------------------------------------------------- a model on the grid of all bins

MOST_PLACES = 1 << 21


def boxes(trees: list[Tree], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, value) of all leaves: the bins from ``low`` to below ``high`` of every feature."""
    out = []
    for t in trees:
        low, high = np.zeros((len(t.feature), len(sizes)), np.int16), np.tile(np.array(sizes, np.int16), (len(t.feature), 1))
        level = np.zeros(1, np.int64)
        while len(inner := level[t.feature[level] >= 0]):
            f, cut, left = t.feature[inner], t.bin[inner], t.left[inner].astype(np.int64)
            for child in (left, left + 1):
                low[child], high[child] = low[inner], high[inner]
            high[left, f], low[left + 1, f] = np.minimum(cut + 1, high[left, f]), np.maximum(cut + 1, low[left + 1, f])
            level = np.concatenate((left, left + 1))
        at = np.flatnonzero((t.feature < 0) & (low < high).all(axis=1))
        out.append((low[at], high[at], t.value[at]))
    return (tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else
            (np.zeros((0, len(sizes)), np.int16), np.zeros((0, len(sizes)), np.int16), np.zeros(0)))


def judge(base: float, trees: list[Tree], sizes: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """The model as a function of binned rows that come in ascending order.

    A leaf is a box of bins. Each adds its value at the corners of its box, and running sums along the
    features spread it over the box: so a slab of the grid (one bin of the first feature) is predicted
    at once, whatever the number of trees, and a row only looks its place up. Grids whose slabs would
    be larger than ``MOST_PLACES`` are not spread; the trees are then followed row by row.
    """
    shape, size = sizes[1:], int(np.prod(sizes[1:], dtype=object))
    if size > MOST_PLACES:
        return lambda x: predict(base, trees, x)
    low, high, value = boxes(trees, sizes)
    steps = np.array([int(np.prod(shape[k + 1:])) for k in range(len(shape))], np.int64)
    change, slab, at = np.zeros(size), np.zeros(size), -1

    def corners(rows: np.ndarray, sign: float) -> None:
        for ends in itertools.product((False, True), repeat=len(shape)):
            place = np.where(ends, high[rows, 1:], low[rows, 1:]).astype(np.int64)
            kept = (place < np.array(shape, np.int64)).all(axis=1)
            np.add.at(change, place[kept] @ steps, value[rows][kept] * (sign * (-1.0) ** sum(ends)))

    order = np.argsort(low[:, 0], kind="stable"), np.argsort(high[:, 0], kind="stable")
    starts = [np.searchsorted(v[o, 0], np.arange(sizes[0] + 2)) for v, o in zip((low, high), order, strict=True)]

    def look(x: np.ndarray) -> np.ndarray:
        nonlocal slab, at
        out = np.empty(len(x))
        for b in np.unique(x[:, 0]).tolist():
            if b > at:
                for a in range(at + 1, b + 1):
                    for o, s, sign in zip(order, starts, (1.0, -1.0), strict=True):
                        if s[a] < s[a + 1]:
                            corners(o[s[a]:s[a + 1]], sign)
                slab, at = change.reshape(shape).copy(), b
                for axis in range(len(shape)):
                    np.cumsum(slab, axis=axis, out=slab)
                slab = slab.ravel()
            rows = x[:, 0] == b
            out[rows] = base + slab[x[rows, 1:].astype(np.int64) @ steps]
        return out

    return look


# ---------------------------------------------------------------- search

class Rows:
    """Arrays that grow by blocks, in a file of the task's local folder."""

    def __init__(self, kind: type, width: int = 1) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.kind, self.width, self.file = np.dtype(kind), width, tempfile.TemporaryFile(
            dir=folder if os.path.isdir(folder) else None)

    def add(self, data: bytes) -> None:
        self.file.write(data)

    def array(self) -> np.ndarray:
        """All rows; more than ``IN_MEMORY`` bytes stay in the file."""
        self.file.flush()
        size = self.file.tell()
        self.file.seek(0)
        got = np.frombuffer(self.file.read(), self.kind) if size <= IN_MEMORY else np.memmap(self.file, self.kind, "r")
        self.file.close()
        return got.reshape(-1, self.width) if self.width != 1 else got


def search(train: DataFrame, features: list[str], label: str, key: str, n_draws: int = 100, folds: int = 10,
           seed: int = 42, rounds: tuple[int, int] = (100, 999), fit_rows: int | None = None,
           tasks: int | None = None) -> tuple[Settings, DataFrame]:
    """(best settings, table of draw, cv_mse, n, params): random search with k-fold CV.

    Bins come from all rows. Each (draw, fold) model is fitted on ALL labelled rows of the other folds and
    judged by the mean squared error over all rows of its fold; ``cv_mse`` is the mean over the folds, as in
    the reference. Ties go to the first draw. Only a caller that gives ``fit_rows`` fits on about that many
    rows, drawn by a hash of ``key``.

    A task gets the rows of a fold's models as binned blocks (a byte a feature and the label), keeps them in
    files of its local folder and grows one model after the other in passes over them; the cells of the fold
    are predicted tree by tree, so no model is held. Its memory is a part of the rows and the sums of a level.
    """
    spark = train.sparkSession
    maps = draws(n_draws, seed, rounds)
    width = len(features)
    labelled = train.where(F.col(label).isNotNull() & ~F.isnan(label))
    binning = fit_binning(labelled, features)
    judged = _stored(cells(labelled, binning, label, key, folds), "cells")
    fitted = labelled
    if fit_rows is not None and (n := labelled.count()) > fit_rows:
        fitted = labelled.where(F.pmod(F.xxhash64(F.lit("search"), F.col(key).cast("string")), F.lit(1 << 30))
                                < F.lit(int(fit_rows / n * (1 << 30))))
    blocks = _stored(binned(fitted, binning, label, key, folds, SENT_ROWS), "binned")

    # groups of draws of about equal work: a task fits one group's models of one fold
    parallel = tasks or 4 * spark.sparkContext.defaultParallelism
    groups: list[list[int]] = [[] for _ in range(max(1, min(n_draws, -(-parallel // folds))))]
    for k in sorted(range(n_draws), key=lambda k: -maps[k].rounds * maps[k].depth):
        min(groups, key=lambda g: sum(maps[j].rounds * maps[j].depth for j in g)).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def opened() -> list[Rows]:
            return [Rows(np.uint8, width), Rows(float), Rows(np.uint8, width), Rows(float), Rows(float), Rows(float)]

        def done() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            x, y, seen, n, mean, spread = (r.array() for r in held)
            x, seen = x.reshape(-1, width), seen.reshape(-1, width)
            if not len(n):
                return
            base, out, rows = base_value(y), [], sum(n[p].sum() for p in parts(len(n)))
            for k in groups[now[1]]:
                at = in_file((len(n),), float)
                for p in parts(len(n)):
                    at[p] = base
                for tree in grown(x, y, maps[k], now[0]):
                    for p in parts(len(n)):
                        at[p] += tree.value[tree.leaves(seen[p])]
                out.append(sum((n[p] * (spread[p] + (at[p] - mean[p]) ** 2)).sum() for p in parts(len(n))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups[now[1]], pa.int32()), pa.array([now[0]] * len(out), pa.int32()),
                 pa.array(out, pa.float64()), pa.array([round(rows)] * len(out), pa.int64())],
                names=["draw", "fold", "sse", "n"])

        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if now != (key_ := tuple(keys[a].tolist())):
                    yield from done()
                    now, held = key_, opened()
                for x, y, n, mean, spread in zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns[2:]), strict=True):
                    for r, v in zip(held, (x, y, b"", b"", b"", b"") if y is not None else (b"", b"", x, n, mean, spread),
                                    strict=True):
                        r.add(v)
        yield from done()

    none = F.lit(None).cast("binary")
    part = F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1)))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda v: v != F.col("source")))
    rows = (blocks.withColumnRenamed("fold", "source").withColumn("fold", other).withColumn("part", part)
            .select("fold", "part", "source", "block", "x", "y", none.alias("n"), none.alias("mean"), none.alias("spread")))
    seen = _packed_cells(judged).withColumn("part", part).select(
        "fold", "part", F.col("fold").alias("source"), "block", "x", none.alias("y"), "n", "mean", "spread")
    pairs = (rows.unionAll(seen)
             .repartitionById(folds * len(groups), (F.col("fold") * len(groups) + F.col("part")).cast("int"))
             .sortWithinPartitions("fold", "part", "source", "block").drop("source", "block"))
    errors = _stored(pairs.mapInArrow(run, "draw int, fold int, sse double, n long"), "search")
    table = (errors.groupBy("draw", "fold").agg((F.sum("sse") / F.sum("n")).alias("mse"), F.sum("n").alias("n"))
             .groupBy("draw").agg(F.avg("mse").alias("cv_mse"), F.sum("n").alias("n")))
    params = spark.createDataFrame([(k, {a: str(b) for a, b in asdict(s).items()}) for k, s in enumerate(maps)],
                                   "draw int, params map<string,string>")
    table = table.join(params, "draw")
    best = table.orderBy("cv_mse", "draw").first()
    return (maps[best["draw"]] if best else Settings()), table


def _packed_cells(held: DataFrame) -> DataFrame:
    """Cells of a fold in blocks of at most ``SENT_ROWS``, their columns as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            folds = batch.column(0).to_numpy()
            for f in np.unique(folds).tolist():
                own = batch.filter(pa.array(folds == f))
                for a in range(0, own.num_rows, SENT_ROWS):
                    some, number = own.slice(a, SENT_ROWS), number + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f], pa.int32()), pa.array([number], pa.int64()),
                         pa.array([b"".join(some.column(1).to_pylist())], pa.binary()),
                         *(pa.array([some.column(k).to_numpy().tobytes()], pa.binary()) for k in (2, 3, 4))],
                        names=["fold", "block", "x", "n", "mean", "spread"])

    return held.mapInArrow(run, "fold int, block long, x binary, n binary, mean binary, spread binary")
