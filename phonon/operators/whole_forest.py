"""A random forest on all rows (J15), its trees dealt to tasks.

Trees of the reference's forest have no depth bound and grow to about as many leaves as there are different
rows, so a forest on a whole table is larger than the table and is never held. ``transform`` deals the trees to
tasks; a task keeps the binned rows in files of its local folder and grows a tree level by level, with the rows
of a node side by side, and the rows to be predicted go down the tree with them. A leaf gives its mean to
the rows that end in it. Memory of a task is a part of the rows and the sums of some nodes.

Split points, bootstrap weights (Poisson, one a row and tree) and gains are those of Spark's trainer, on all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonon.session import ship_package

from . import boosting as BO
from .whole_gbt import flat_rows

GROUP_NODES = 1024
PLAIN = BO.Settings(l2=0.0)


class Level:
    """Rows of the nodes of one level, node by node: binned rows and further columns, in files if they are many."""

    def __init__(self, rows: int, width: int, kinds: list[type]) -> None:
        self.columns = [BO.in_file((rows, width), np.uint8), *(BO.in_file((rows,), k) for k in kinds)]
        self.ends = np.zeros(1, np.int64)

    def take(self, a: int, b: int) -> list[np.ndarray]:
        return [c[a:b] for c in self.columns]

    def put(self, at: int, values: list[np.ndarray]) -> None:
        for c, v in zip(self.columns, values, strict=True):
            c[at:at + len(v)] = v


def _groups(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of nodes of at most ``most`` rows and GROUP_NODES nodes; a larger node is alone."""
    a, nodes = 0, len(ends) - 1
    while a < nodes:
        b = min(int(np.searchsorted(ends, ends[a] + most, side="right")) - 1, a + GROUP_NODES, nodes)
        yield a, max(b, a + 1)
        a = max(b, a + 1)


def _deal(now: Level, after: Level, a: int, b: int, first: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> None:
    """Move the rows of nodes ``a`` to ``b`` to their children; ``first``: the left child, -1 for a leaf."""
    base = int(after.ends[-1])
    children = 2 * int((first >= 0).sum())
    low = first[first >= 0].min() if children else 0
    counts = np.zeros(children, np.int64)

    def split(p: slice) -> tuple[list[np.ndarray], np.ndarray]:
        values = now.take(p.start, p.stop)
        node = np.searchsorted(now.ends[a:b + 1], np.arange(p.start, p.stop), side="right") - 1
        rows = np.flatnonzero(first[node] >= 0)
        node = node[rows]
        side = values[0][rows, feature[node]] > cut[node]
        return [v[rows] for v in values], (first[node] - low + side).astype(np.uint16)

    start, end = int(now.ends[a]), int(now.ends[b])
    pieces = [slice(start + p.start, start + p.stop) for p in BO.parts(end - start)]
    if not children:
        return
    if len(pieces) > 1:
        for p in pieces:
            counts += np.bincount(split(p)[1], minlength=children)
        at = base + np.cumsum([0, *counts[:-1]])
    for p in pieces:
        values, child = split(p)
        own = np.bincount(child, minlength=children)
        if len(pieces) == 1:
            counts, at = own, base + np.cumsum([0, *own[:-1]])
        order = np.argsort(child, kind="stable")
        edges = np.cumsum([0, *own])
        if len(pieces) == 1:
            after.put(base, [v[order] for v in values])
            continue
        for k in range(children):
            after.put(int(at[k]), [v[order[edges[k]:edges[k + 1]]] for v in values])
        at = at + own
    after.ends = np.concatenate((after.ends, base + np.cumsum(counts)))


def tree_means(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seen: np.ndarray, depth: int, out: np.ndarray) -> None:
    """Grow one tree on the rows with their weights and add to ``out`` what it predicts for the rows ``seen``."""
    width = x.shape[1]
    some = [np.flatnonzero(weight[p]) + p.start for p in BO.parts(len(x))]
    n = sum(len(r) for r in some)
    if not n:
        return
    now, after = (Level(n, width, [float, np.uint8]) for _ in range(2))
    asked, later = (Level(len(seen), width, [np.int64]) for _ in range(2))
    at = 0
    for rows in some:
        now.put(at, [x[rows], y[rows], weight[rows]])
        at += len(rows)
    base = float(sum((y[r] * weight[r]).sum() for r in some) / sum(int(weight[r].sum()) for r in some))
    now.ends = np.array([0, n])
    for p in BO.parts(len(seen)):
        asked.put(p.start, [seen[p], np.arange(p.start, p.stop)])
    asked.ends = np.array([0, len(seen)])
    columns = np.ones(width, bool)
    for level in range(depth + 1):
        for lv in (after, later):
            lv.ends = np.zeros(1, np.int64)
        made = 0
        for a, b in _groups(now.ends, BO.PART_ROWS):
            sums = np.zeros((2, b - a, width, BO.BINS))
            start = int(now.ends[a])
            for p in BO.parts(int(now.ends[b]) - start):
                px, py, w = now.take(start + p.start, start + p.stop)
                node = np.searchsorted(now.ends[a:b + 1], np.arange(start + p.start, start + p.stop), side="right") - 1
                w = w.astype(float)
                sums += BO.histograms(px, node, (py - base) * w, b - a, w)
            g, h = sums[0][:, 0].sum(axis=1), sums[1][:, 0].sum(axis=1)
            gain, feature, cut = BO.best_splits(sums, PLAIN, columns)
            good = (gain > 1e-12 * (1.0 + g * g / h)) if level < depth else np.zeros(b - a, bool)
            first = np.where(good, 2 * (made + np.cumsum(good) - 1), -1)
            made += int(good.sum())
            mean, first_seen = base + g / h, int(asked.ends[a])
            for p in BO.parts(int(asked.ends[b]) - first_seen):
                lo, hi = first_seen + p.start, first_seen + p.stop
                node = np.searchsorted(asked.ends[a:b + 1], np.arange(lo, hi), side="right") - 1
                done = ~good[node]
                out[asked.columns[1][lo:hi][done]] += mean[node[done]]
            _deal(now, after, a, b, first, feature, cut)
            _deal(asked, later, a, b, first, feature, cut)
        if not made:
            return
        now, after, asked, later = after, now, later, asked


def poisson_weights(n: int, seed: int, tree: int, bootstrap: bool) -> np.ndarray:
    out = BO.in_file((n,), np.uint8)
    for number, p in enumerate(BO.parts(n)):
        out[p] = np.random.default_rng([seed, tree, number]).poisson(1.0, p.stop - p.start) if bootstrap else 1
    return out


class WholeForestModel:
    """A forest given by its rows; ``transform`` grows it (see above)."""

    def __init__(self, regressor: RandomForestRegressor, blocks: DataFrame, binning: BO.Binning) -> None:
        self.regressor, self.blocks, self.binning = regressor, blocks, binning

    def transform(self, df: DataFrame) -> DataFrame:
        r, binning = self.regressor, self.binning
        width, trees, depth = len(binning.features), r.getNumTrees(), r.getMaxDepth()
        seed, bootstrap = r.getSeed(), r.getBootstrap()
        tasks = min(trees, 4 * df.sparkSession.sparkContext.defaultParallelism)

        @F.pandas_udf("binary")
        def place(some: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in some:
                x = binning.apply(list(np.stack(v.to_list()).T)) if len(v) else []
                yield pd.Series([row.tobytes() for row in x], dtype=object)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                for a in range(0, batch.num_rows, BO.SENT_ROWS):
                    number += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int64()),
                         pa.array([b"".join(batch.column(0).slice(a, BO.SENT_ROWS).to_pylist())], pa.binary())],
                        names=["block", "x"])

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, held, numbers, sizes = None, [BO.Rows(np.uint8, width), BO.Rows(float), BO.Rows(np.uint8, width)], [], []
            for batch in batches:
                for task, block, xb, yb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    mine = task
                    if yb is None:
                        held[2].add(xb)
                        numbers.append(block)
                        sizes.append(len(xb) // width)
                    else:
                        held[0].add(xb)
                        held[1].add(yb)
            if mine is None:
                return
            x, y, seen = (h.array() for h in held)
            x, seen = x.reshape(-1, width), seen.reshape(-1, width)
            out = BO.in_file((len(seen),), float)
            for tree in range(mine, trees, tasks):
                tree_means(x, y, poisson_weights(len(y), seed, tree, bootstrap), seen, depth, out)
            at = 0
            for block, size in zip(numbers, sizes, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([None], pa.binary()),
                     pa.array([out[at:at + size].tobytes()], pa.binary())], names=["block", "x", "v"])
                at += size

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, total = b"", np.zeros(0)

            def done() -> Iterator[pa.RecordBatch]:
                if x:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[a:a + width] for a in range(0, len(x), width)], pa.binary()),
                         pa.array(total / trees, pa.float64())], names=["_place", "prediction"])

            for batch in batches:
                for xb, vb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if xb is not None:
                        yield from done()
                        x, total = xb, np.zeros(len(xb) // width)
                    else:
                        total = total + np.frombuffer(vb)
            yield from done()

        ship_package(df.sparkSession)
        placed = df.withColumn("_place", place(vector_to_array(r.getFeaturesCol())))
        asked = BO._stored(placed.select("_place").distinct().mapInArrow(pack, "block long, x binary"), "asked")
        task = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
        none = F.lit(None).cast("binary")
        rows = (self.blocks.select(task.alias("task"), "block", "x", "y")
                .unionAll(asked.select(task.alias("task"), "block", "x", none.alias("y")))
                .repartitionById(tasks, "task").sortWithinPartitions("task", F.col("y").isNull(), "block"))
        sums = BO._stored(rows.mapInArrow(grow, "block long, x binary, v binary"), "forest")
        means = (sums.unionAll(asked.select("block", "x", none.alias("v"))).repartition("block")
                 .sortWithinPartitions("block", F.col("x").isNull()).select("x", "v")
                 .mapInArrow(add, "_place binary, prediction double"))
        return placed.join(BO._stored(means, "means"), "_place").drop("_place")


class WholeForest(Estimator):
    """A ``RandomForestRegressor`` (all features a split) on all rows."""

    def __init__(self, regressor: RandomForestRegressor) -> None:
        super().__init__()
        if regressor.getFeatureSubsetStrategy() != "all":
            raise ValueError("every split looks at all features")
        self.regressor = regressor

    def _fit(self, df: DataFrame) -> WholeForestModel:
        flat, binning = flat_rows(df, self.regressor)
        blocks = BO.binned(flat.withColumn("_key", F.lit(0)), binning, "y", "_key", 1, BO.SENT_ROWS)
        return WholeForestModel(self.regressor, BO._stored(blocks, "binned"), binning)
