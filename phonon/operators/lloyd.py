"""K-means for every (k, seed) pair at once: batched Lloyd iterations.

The centres of all pairs that still move go to every task (their number is
fixed by the pairs and their size is checked); a task compares its rows with
all of them by one matrix product per slice and returns sums per centre. So an
iteration is ONE pass over the rows, whatever the number of seeds and of k. The
metrics of the chosen model of every k come from two more passes, again for all
k together: per-cluster sums, then the silhouette they imply.

Seeding is k-means++ on at most about ``seed_rows`` rows, drawn by a hash of
the row (a stated bound); every iteration, cost and metric covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonon.session import ship_package

ROWS = 2048
MAX_CENTRE_BYTES = 64 << 20
Pair = tuple[int, int]


def _vectors(df: DataFrame, features: str) -> DataFrame:
    col = F.col(f"`{features}`")
    array = col if df.schema[features].dataType.typeName() == "array" else vector_to_array(col)
    return df.select(F.transform(array, lambda v: v.cast("double")).alias("v")).where("v IS NOT NULL")


def _packed(vectors: DataFrame) -> DataFrame:
    """Blocks of at most ``ROWS`` vectors as bytes: passes read these without taking rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary())],
                                             names=["rows", "x"])

    return vectors.mapInArrow(run, "rows int, x binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_columns == 2:                       # packed
            for n, x in zip(*batch.columns, strict=True):
                yield np.frombuffer(x.as_buffer(), float).reshape(n.as_py(), -1)
            continue
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _summed(vectors: DataFrame, sums: Callable[[np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums over all rows of what ``sums`` gives for a block, by key: per task, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for x in _blocks(batches):
            for k, v in sums(x).items():
                total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            names=["key", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(v)
                total[k] = total[k] + got if k in total else got
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            names=["key", "v"])

    shape = "key int, v binary"
    rows = vectors.mapInArrow(run, shape).repartition("key").mapInArrow(add, shape).collect()   # a row a key
    return {r["key"]: np.frombuffer(r["v"]) for r in rows}


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    d = (x * x).sum(axis=1)[:, None] - 2.0 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.maximum(d, 0.0)


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ centres from the rows ``x`` (fewer if there are fewer different rows)."""
    rng = np.random.default_rng([seed, k])
    chosen = [int(rng.integers(len(x)))]
    nearest = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and nearest.sum() > 0:
        at = int(np.searchsorted(np.cumsum(nearest), rng.random() * nearest.sum(), side="right"))
        chosen.append(min(at, len(x) - 1))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def seeds(vectors: DataFrame, pairs: list[Pair], seed_rows: int = 10_000) -> dict[Pair, np.ndarray]:
    """Starting centres of every pair."""
    n = vectors.count()
    if not n:
        return {}
    share = min(1.0, seed_rows / n)
    drawn = vectors if share == 1.0 else vectors.where(
        F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = sorted(tuple(r["v"]) for r in drawn.collect())      # at most about seed_rows; the order is fixed
    x = np.asarray(rows if rows else [vectors.first()["v"]], float)
    return {p: plus_plus(x, *p) for p in pairs}


def lloyd(vectors: DataFrame, start: dict[Pair, np.ndarray], max_iter: int = 300, tol: float = 1e-4
          ) -> tuple[dict[Pair, tuple[float, np.ndarray]], int]:
    """({pair: (cost, centres)}, passes): all pairs to rest, or ``max_iter`` iterations.

    A pair rests when no centre moves by more than ``tol``. A centre without rows stays.
    """
    centres = {p: c.copy() for p, c in start.items()}
    if sum(c.nbytes for c in centres.values()) > MAX_CENTRE_BYTES:
        raise ValueError("centres too large to ship: fewer pairs at once")
    moving, passes = list(centres), 0
    names = list(centres)

    def step(active: list[Pair], last: bool) -> dict[int, np.ndarray]:
        stacked = np.concatenate([centres[p] for p in active])
        edges = np.cumsum([0, *(len(centres[p]) for p in active)])
        keys = [names.index(p) for p in active]

        half = (stacked * stacked).sum(axis=1) / 2
        size = len(stacked)

        def sums(x: np.ndarray) -> dict[int, np.ndarray]:
            # centres down, rows across: comparing a pair's few centres runs along the rows
            d = _distances(x, stacked).T if last else half[:, None] - stacked @ x.T
            out, place = {}, np.arange(len(x))
            hot = None if last else np.zeros((size, len(x)))
            for key, a, b in zip(keys, edges[:-1], edges[1:], strict=True):
                near = d[a:b].argmin(axis=0) + a
                if last:
                    out[key] = np.array([d[near, place].sum()])
                else:
                    hot[near, place] = 1.0
            if last:
                return out
            count, total = hot.sum(axis=1), hot @ x
            for key, a, b in zip(keys, edges[:-1], edges[1:], strict=True):
                out[key] = np.concatenate((count[a:b], total[a:b].ravel()))
            return out

        return _summed(vectors, sums)

    while moving and passes < max_iter:
        got, passes = step(moving, False), passes + 1
        still = []
        for p in moving:
            k, d = centres[p].shape
            v = got[names.index(p)]
            n, total = v[:k, None], v[k:].reshape(k, d)
            new = np.where(n > 0, total / np.maximum(n, 1.0), centres[p])
            if ((new - centres[p]) ** 2).sum(axis=1).max() > tol * tol:
                still.append(p)
            centres[p] = new
        moving = still
    cost = step(names, True)
    return {p: (float(cost[k][0]), centres[p]) for k, p in enumerate(names)}, passes + 1


def best_of_seeds(df: DataFrame, features: str, k_values: list[int], seed: int = 42, restarts: int = 10,
                  max_iter: int = 300) -> dict[int, tuple[float, np.ndarray]]:
    """{k: (cost, centres)} of the cheapest of ``restarts`` seeds (the first on ties), all in shared passes."""
    ship_package(df.sparkSession)
    vectors = _vectors(df, features)
    start = seeds(vectors, [(k, seed + r) for k in k_values for r in range(restarts)])
    if not start:
        return {}
    packed = _packed(vectors).cache()
    try:
        fitted, _ = lloyd(packed, start, max_iter)
    finally:
        packed.unpersist()
    return {k: min((fitted[k, seed + r] for r in range(restarts)), key=lambda f: f[0]) for k in k_values}


def sweep_metrics(df: DataFrame, features: str, models: dict[int, np.ndarray]) -> dict[int, dict[str, float | None]]:
    """{k: Inertia, Silhouette (squared Euclidean), Calinski-Harabasz, Davies-Bouldin} in two passes."""
    vectors = _packed(_vectors(df, features)).cache()
    keys = list(models)

    def first(x: np.ndarray) -> dict[int, np.ndarray]:
        out, square = {}, (x * x).sum(axis=1)
        for i, k in enumerate(keys):
            d = _distances(x, models[k])
            near = d.argmin(axis=1)
            own = d[np.arange(len(x)), near]
            hot = np.zeros((len(models[k]), len(x)))
            hot[near, np.arange(len(x))] = 1.0
            out[i] = np.concatenate((hot.sum(axis=1), hot @ square, hot @ own, hot @ np.sqrt(own), (hot @ x).ravel()))
        return out

    sums = {}
    for i, v in _summed(vectors, first).items():
        c = len(models[keys[i]])
        sums[keys[i]] = (*v[:4 * c].reshape(4, c), v[4 * c:].reshape(c, -1))

    def second(x: np.ndarray) -> dict[int, np.ndarray]:
        out, square = {}, (x * x).sum(axis=1)[:, None]
        rows = np.arange(len(x))
        for i, k in enumerate(keys):
            n, q, _, _, total = sums[k]
            near = _distances(x, models[k]).argmin(axis=1)
            full = np.maximum(n, 1.0)
            mean = square - 2.0 * x @ (total / full[:, None]).T + q / full
            mean[:, n == 0] = np.inf
            a = mean[rows, near] * n[near] / np.maximum(n[near] - 1.0, 1.0)
            mean[rows, near] = np.inf
            b = mean.min(axis=1)
            top = np.maximum(a, b)
            s = np.where((n[near] > 1) & (top > 0) & np.isfinite(b), (b - a) / np.where(top > 0, top, 1.0), 0.0)
            out[i] = np.array([s.sum()])
        return out

    silhouette = {keys[i]: float(v[0]) for i, v in _summed(vectors, second).items()} if sums else {}
    vectors.unpersist()
    out = {}
    for k, (n, _, w, r, total) in sums.items():
        held = n > 0
        n, w, r, total = n[held], w[held], r[held], total[held]
        c, rows, inertia = len(n), float(n.sum()), float(w.sum())
        means, spread = total / n[:, None], r / n
        between = float((n * ((means - total.sum(axis=0) / rows) ** 2).sum(axis=1)).sum())
        apart = np.sqrt(_distances(means, means))
        worst = [max((spread[i] + spread[j]) / apart[i, j] if apart[i, j] > 0 else math.inf
                     for j in range(c) if j != i) for i in range(c)] if c > 1 else []
        out[k] = {"Inertia": inertia, "Silhouette": silhouette[k] / rows if c > 1 else None,
                  "Calinski-Harabasz": (between / (c - 1)) / (inertia / (rows - c))
                  if c > 1 and rows > c and inertia > 0 else None,
                  "Davies-Bouldin": float(np.mean(worst)) if worst else None}
    return out


class CentreModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Nearest-centre labels; a stage that saves and loads with its pipeline."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector or array column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "label column", TypeConverters.toString)
    centres = Param(Params._dummy(), "centres", "cluster centres", TypeConverters.toListListFloat)
    trainingCost = Param(Params._dummy(), "trainingCost", "sum of squared distances", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", predictionCol: str = "cluster_label",
                 centres: list | None = None, trainingCost: float = 0.0) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="cluster_label")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.asarray(c) for c in self.getOrDefault(self.centres)]

    def _transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        table = np.asarray(self.getOrDefault(self.centres), float)
        features = self.getOrDefault(self.featuresCol)
        col = F.col(f"`{features}`")
        array = col if df.schema[features].dataType.typeName() == "array" else vector_to_array(col)

        @F.pandas_udf("int")
        def label(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                out = np.full(len(part), -1)
                whole = part.notna().to_numpy()
                for at in range(0, len(part), ROWS):
                    rows = np.flatnonzero(whole[at:at + ROWS]) + at
                    if len(rows):
                        out[rows] = _distances(np.stack(part.iloc[rows].to_list()), table).argmin(axis=1)
                yield pd.Series(out).astype("Int32").where(pd.Series(whole))

        return df.withColumn(self.getOrDefault(self.predictionCol), label(array))
