"""Attribution tables (J25, J29): exact path-dependent tree attributions.

The fitted ensemble is read from its saved node table (cover, threshold,
children, leaf value, tree weight) and turned into the boxes of its leaves,
which are broadcast: their number is fixed by rounds and depth. Each Arrow
batch of rows is explained in numpy, all rows at once, without a shuffle; the
output is the long table (key, feature, phi) plus per-row base values, so
summaries are plain aggregates. For every row, the base value plus the sum of
its attributions equals the model prediction.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def tree_tables(spark, tree_model) -> tuple[list[dict], float]:
    """Node arrays per tree and the ensemble's output scale (1/T for a forest)."""
    path = scratch_path(spark, f"shap/{uuid.uuid4().hex}")
    tree_model.write().save(path)
    data = spark.read.parquet(os.path.join(path, "data"))
    cls = type(tree_model).__name__
    if "treeID" in data.columns:
        nodes = data.select("treeID", "nodeData.*").collect()
        meta = spark.read.parquet(os.path.join(path, "treesMetadata")).collect()
        weights = {r[0]: float(r[2]) for r in meta}
    else:
        nodes = data.select(F.lit(0).alias("treeID"), "*").collect()
        weights = {0: 1.0}
    scale = 1.0 / len(weights) if "RandomForest" in cls else 1.0
    trees = []
    for tid in sorted(weights):
        rows = sorted((r for r in nodes if r.treeID == tid), key=lambda r: r.id)
        n = len(rows)
        t = {"left": np.full(n, -1), "right": np.full(n, -1), "feature": np.full(n, -1),
             "threshold": np.zeros(n), "value": np.zeros(n), "cover": np.zeros(n),
             "weight": weights[tid] * scale}
        for r in rows:
            t["left"][r.id], t["right"][r.id] = r.leftChild, r.rightChild
            t["value"][r.id] = r.prediction
            t["cover"][r.id] = float(r.impurityStats[0]) if r.impurityStats else float(r.rawCount)
            if r.leftChild >= 0:
                if r.split.numCategories != -1:
                    raise ValueError("categorical splits are not supported")
                t["feature"][r.id] = r.split.featureIndex
                t["threshold"][r.id] = r.split.leftCategoriesOrThreshold[0]
        trees.append({k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in t.items()})
    return trees, scale


def leaf_boxes(t: dict) -> list[dict]:
    """Every leaf of a tree as the box its path cuts out.

    ``features`` of the path (each once), ``low`` / ``high`` the open-closed
    interval it leaves to each of them, ``share`` the product of the cover
    ratios at the splits on each, ``value`` the weighted leaf value.
    """
    out = []
    stack = [(0, {})]          # node, feature -> (low, high, share)
    while stack:
        node, box = stack.pop()
        if t["left"][node] < 0:
            names = sorted(box)
            out.append({"features": names, "low": [box[f][0] for f in names],
                        "high": [box[f][1] for f in names], "share": [box[f][2] for f in names],
                        "value": t["value"][node] * t["weight"]})
            continue
        f, cutoff = t["feature"][node], t["threshold"][node]
        low, high, share = box.get(f, (-np.inf, np.inf, 1.0))
        for child, interval in ((t["left"][node], (low, min(high, cutoff))),
                                (t["right"][node], (max(low, cutoff), high))):
            ratio = t["cover"][child] / t["cover"][node]
            stack.append((child, {**box, f: (*interval, share * ratio)}))
    return out


def batch_shap(x: np.ndarray, leaves: list[dict]) -> np.ndarray:
    """Attributions of every row of ``x`` for a list of leaf boxes.

    A leaf is a game on the m features of its path: a coalition S is worth
    value * prod_{j in S} o_j * prod_{j not in S} z_j, with o_j = 1 where the
    row lies in the box along j, and z_j the cover share. Feature k's Shapley
    value is value * (o_k - z_k) * sum_s |s|! (m - 1 - |s|)! / m! * c_s, with c_s
    the coefficients of prod_{j != k} (z_j + o_j T). All rows of the batch are
    done at once; the loops run over leaves and path features only.
    """
    phi = np.zeros_like(x)
    for leaf in leaves:
        names, m = leaf["features"], len(leaf["features"])
        if not m:
            continue
        z = leaf["share"]
        inside = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float)
                  for f, lo, hi in zip(names, leaf["low"], leaf["high"], strict=True)]
        weight = [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
        for k in range(m):
            coef = [np.full(len(x), leaf["value"])]
            for j in range(m):
                if j == k:
                    continue
                up = [c * inside[j] for c in coef]
                coef = [c * z[j] for c in coef] + [0.0]
                coef = [coef[0]] + [c + u for c, u in zip(coef[1:], up, strict=True)]
            total = sum(w * c for w, c in zip(weight, coef, strict=True))
            phi[:, names[k]] += (inside[k] - z[k]) * total
    return phi


MOST_CELLS = 4096


def shap_tables(t: dict, width: int) -> tuple[list[int], list[np.ndarray], np.ndarray] | None:
    """(features, their cut points, attributions): the attributions of a tree depend only on the
    interval between its cut points that each feature lies in. None if that makes too many cells."""
    cuts: dict[int, set] = {}
    for f, left, cut in zip(t["feature"], t["left"], t["threshold"], strict=True):
        if left >= 0:
            cuts.setdefault(f, set()).add(cut)
    names = sorted(cuts)
    edges = [np.array(sorted(cuts[f])) for f in names]
    if math.prod(len(e) + 1 for e in edges) > MOST_CELLS:
        return None
    x = np.zeros((math.prod(len(e) + 1 for e in edges), width))
    for f, v in zip(names, np.meshgrid(*[np.append(e, np.inf) for e in edges], indexing="ij"), strict=True):
        x[:, f] = v.ravel()                           # an interval's upper end lies in it
    return names, edges, batch_shap(x, leaf_boxes(t))[:, names]


def tabled_shap(x: np.ndarray, tables: list[tuple], leaves: list[dict]) -> np.ndarray:
    """``batch_shap`` of trees given as tables (``shap_tables``) and of others given by their leaves."""
    phi = batch_shap(x, leaves)
    for names, edges, table in tables:
        cell = np.zeros(len(x), np.int64)
        for f, e in zip(names, edges, strict=True):
            cell = cell * (len(e) + 1) + np.searchsorted(e, x[:, f], side="left")
        if names:
            phi[:, names] += table[cell]
    return phi


def batch_interactions(x: np.ndarray, leaves: list[dict]) -> np.ndarray:
    """(rows, features, features): Shapley interaction values of the leaf games, off the diagonal.

    For two features of a leaf's path the value is half of leaf value * (o_i - z_i) * (o_j - z_j) *
    sum_s |s|! (m - 2 - |s|)! / (m - 1)! * c_s, with c_s the coefficients of the other features'
    product; each pair is split evenly over both orders.
    """
    out = np.zeros((len(x), x.shape[1], x.shape[1]))
    for leaf in leaves:
        names, m = leaf["features"], len(leaf["features"])
        if m < 2:
            continue
        z = leaf["share"]
        inside = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float)
                  for f, lo, hi in zip(names, leaf["low"], leaf["high"], strict=True)]
        weight = [math.factorial(s) * math.factorial(m - 2 - s) / (2 * math.factorial(m - 1)) for s in range(m - 1)]
        for i in range(m):
            for j in range(i):
                coef = [np.full(len(x), leaf["value"])]
                for k in range(m):
                    if k in (i, j):
                        continue
                    up = [c * inside[k] for c in coef]
                    coef = [c * z[k] for c in coef] + [0.0]
                    coef = [coef[0]] + [c + u for c, u in zip(coef[1:], up, strict=True)]
                both = (inside[i] - z[i]) * (inside[j] - z[j]) * sum(w * c for w, c in zip(weight, coef, strict=True))
                out[:, names[i], names[j]] += both
                out[:, names[j], names[i]] += both
    return out


def expected_value(trees) -> float:
    """Cover-weighted mean leaf value, summed over weighted trees."""
    total = 0.0
    for t in trees:
        leaves = [i for i, l in enumerate(t["left"]) if l < 0]
        total += t["weight"] * sum(t["cover"][i] * t["value"][i] for i in leaves) / t["cover"][0]
    return total


def _tree_blocks(trees: list[dict], most: int) -> list[list[dict]]:
    """Trees in blocks of about ``most`` leaves, so that no broadcast grows with the ensemble."""
    blocks, block, leaves = [], [], 0
    for t in trees:
        block.append(t)
        leaves += sum(n < 0 for n in t["left"])
        if leaves >= most:
            blocks, block, leaves = [*blocks, block], [], 0
    return blocks + [block] if block or not blocks else blocks


def _explained(model: PipelineModel, df: DataFrame, key: str, width: int, rows_of, schema: str,
               by: list[str], block_leaves: int, tables_of=None) -> tuple[DataFrame, list[dict]]:
    """Rows that ``rows_of(x, tables, leaves)`` gives for every row of ``df``, summed over the blocks of leaves.

    ``tables_of`` makes the table of a tree, or None; trees without one are given by their leaves.
    """
    spark = df.sparkSession
    tree_model = model.stages[-1]
    trees, _ = tree_tables(spark, tree_model)
    prep = PipelineModel(stages=model.stages[:-1])
    vec = prep.transform(df).select(F.col(key).cast("string").alias("key"),
                                    vector_to_array(tree_model.getFeaturesCol()).alias("x"))

    def part(block: list[dict]) -> DataFrame:
        made = [tables_of(t) if tables_of else None for t in block]
        tables = [m for m in made if m is not None]
        leaves = [leaf for t, m in zip(block, made, strict=True) if m is None for leaf in leaf_boxes(t)]
        held = spark.sparkContext.broadcast((tables, leaves))          # about block_leaves leaves

        def explain(batches):
            for pdf in batches:
                for a in range(0, len(pdf), 2000):
                    rows = pdf.iloc[a:a + 2000]
                    made = rows_of(np.stack(rows["x"].to_numpy()), *held.value)
                    yield pd.DataFrame({"key": np.repeat(rows["key"].to_numpy(), width), **made})

        return vec.mapInPandas(explain, "key string, " + schema)

    out = None
    blocks = _tree_blocks(trees, block_leaves)
    for block in blocks:
        out = part(block) if out is None else out.unionByName(part(block))
    if len(blocks) > 1:                                       # parts of one row meet once
        out = out.groupBy("key", *by).agg(F.sum("phi").alias("phi"))
    return out, trees


def shap_values(model: PipelineModel, df: DataFrame, key: str, features: list[str],
                block_leaves: int = 50_000) -> DataFrame:
    """(key, feature, phi) for every row and feature, plus (key, '__base__', base).

    ``key`` names a row. The leaves are shipped in blocks; each block is one map, whose parts are
    added up.
    """
    def rows_of(x, tables, leaves):
        return {"feature": features * len(x), "phi": tabled_shap(x, tables, leaves).ravel()}

    out, trees = _explained(model, df, key, len(features), rows_of, "feature string, phi double", ["feature"],
                            block_leaves, lambda t: shap_tables(t, len(features)))
    base = F.lit(float(expected_value(trees)))
    return out.unionByName(df.select(F.col(key).cast("string").alias("key"), F.lit("__base__").alias("feature"),
                                     base.alias("phi")))


def shap_interactions(model: PipelineModel, df: DataFrame, key: str, features: list[str],
                      block_leaves: int = 50_000) -> DataFrame:
    """(key, feature, partner, phi): interaction values of every row and pair, both orders. A feature's own
    value (partner = feature) is its attribution less its interactions, so a feature's values add up to it."""
    d = len(features)

    def rows_of(x, _, leaves):
        own, pairs = batch_shap(x, leaves), batch_interactions(x, leaves)
        pairs[:, np.arange(d), np.arange(d)] = own - pairs.sum(axis=2)
        return {"feature": [f for f in features for _ in features] * len(x),
                "partner": features * d * len(x), "phi": pairs.ravel()}

    return _explained(model, df, key, d * d, rows_of, "feature string, partner string, phi double",
                      ["feature", "partner"], block_leaves)[0]


def strongest_partners(phi: DataFrame) -> DataFrame:
    """For every feature its partner with the largest mean |interaction| (first name on ties), which
    colours its dependence table."""
    mean = phi.where("feature <> partner").groupBy("feature", "partner").agg(F.avg(F.abs("phi")).alias("strength"))
    best = F.min_by(F.struct("partner", "strength"), F.struct((-F.col("strength")).alias("s"), F.col("partner").alias("p")))
    return mean.groupBy("feature").agg(best.alias("b")).select("feature", "b.partner", "b.strength")


def mean_abs_shap(phi: DataFrame, top: int | None = None) -> DataFrame:
    """J25 summary: mean |phi| per feature, largest first (name breaks ties);
    only the ``top`` first if given."""
    out = (phi.where(F.col("feature") != "__base__").groupBy("feature")
           .agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
           .orderBy(F.col("mean_abs_shap").desc(), "feature"))
    return out.limit(top) if top else out


def dependence(phi: DataFrame, df: DataFrame, key: str, feature: str) -> DataFrame:
    """(feature value, its attribution) per row for one feature."""
    vals = df.select(F.col(key).cast("string").alias("key"), F.col(feature).alias("value"))
    return phi.where(F.col("feature") == feature).join(vals, "key").select("key", "value", "phi")


def write_report(model: PipelineModel, pred: DataFrame, test: DataFrame, key: str,
                 features: list[str], prefix: str) -> None:
    """The tables behind one model's report, written under one prefix."""
    from .train import feature_importance, parity_table, residual_histogram
    parity_table(pred, "label", "prediction").write.mode("overwrite").parquet(f"{prefix}/parity")
    residual_histogram(pred, "label", "prediction").write.mode("overwrite").parquet(f"{prefix}/residuals")
    phi = shap_values(model, test, key, features)
    phi.write.mode("overwrite").parquet(f"{prefix}/shap_values")
    stored = test.sparkSession.read.parquet(f"{prefix}/shap_values")
    mean_abs_shap(stored).write.mode("overwrite").parquet(f"{prefix}/shap_summary")
    if hasattr(model.stages[-1], "featureImportances"):
        feature_importance(model, features).write.mode("overwrite").parquet(f"{prefix}/importance")
