"""Reduction and clustering (J7-J14, J28) on ``pyspark.ml``.

Cluster-quality metrics are computed from per-cluster sums (k rows of d
numbers, like a fitted KMeans model), so every metric is O(n k d) and no
pair of points is ever formed: inertia and Calinski-Harabasz from sums of
squares; Davies-Bouldin from each point's distance to its own centroid; the
silhouette in Spark's squared-Euclidean form (Spark's own evaluator), where
the mean squared distance from x to cluster C is |x|^2 - 2 x.S_C/n_C + Q_C/n_C.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lloyd import CentreModel, best_of_seeds, sweep_metrics


# ---------------------------------------------------------------- vectors


def as_vector(df: DataFrame, cols: list[str] | str, out: str = "features") -> DataFrame:
    """A vector column from numeric columns, or from one array column."""
    if isinstance(cols, str):
        return df.withColumn(out, array_to_vector(F.transform(cols, lambda x: x.cast("double"))))
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


# ---------------------------------------------------------------- metrics on given labels

def cluster_sums(df: DataFrame, label: str, vec: str, max_clusters: int = 10_000) -> list:
    """Per cluster: n, centroid, sum of squared norms (k small rows, from Spark's
    vector summary); more than ``max_clusters`` labels is an error."""
    from pyspark.ml.stat import Summarizer
    d = df.select(label, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_x"))
    rows = d.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_x")).alias("c"),
        F.sum(F.aggregate(vector_to_array("_x"), F.lit(0.0), lambda a, x: a + x * x)).alias("q")
    ).limit(max_clusters + 1).collect()
    if len(rows) > max_clusters:
        raise ValueError(f"{label} has more than {max_clusters} clusters")
    return [(r[label], r["n"], r["c"].toArray().tolist(), r["q"]) for r in rows]


def cluster_metrics(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Inertia, Calinski-Harabasz, Davies-Bouldin and squared-Euclidean
    silhouette of given labels, as one row."""
    sums = cluster_sums(df, label, vec)
    k = len(sums)
    n_tot = sum(s[1] for s in sums)
    dim = len(sums[0][2]) if sums else 0
    cents = {c: v for c, _, v, _ in sums}
    x = F.transform(vec, lambda v: v.cast("double"))
    # distance to own centroid (for Davies-Bouldin and inertia): the k centroids join as arrays
    kind = df.schema[label].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(c, [float(v) for v in cv]) for c, cv in cents.items()],
                                            f"`{label}` {kind}, _c array<double>")
    d2 = F.aggregate(F.zip_with(x, "_c", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t)
    per_point = df.join(F.broadcast(table), label).select(F.col(label), d2.alias("_d2"))
    per_cluster = per_point.groupBy(label).agg(F.avg(F.sqrt("_d2")).alias("s"),
                                               F.sum("_d2").alias("w")).collect()
    scatter = {r[label]: r["s"] for r in per_cluster}
    inertia = sum(r["w"] for r in per_cluster)
    glob = [sum(s[1] * s[2][i] for s in sums) / n_tot for i in range(dim)]
    ssb = sum(n * sum((cents[c][i] - glob[i]) ** 2 for i in range(dim)) for c, n, _, _ in sums)
    ch = (ssb / (k - 1)) / (inertia / (n_tot - k)) if k > 1 and n_tot > k and inertia > 0 else None
    dbs = []
    for ci in cents:
        worst = 0.0
        for cj in cents:
            if ci == cj:
                continue
            dij = math.sqrt(sum((cents[ci][t] - cents[cj][t]) ** 2 for t in range(dim)))
            worst = max(worst, (scatter[ci] + scatter[cj]) / dij if dij > 0 else float("inf"))
        dbs.append(worst)
    db = sum(dbs) / len(dbs) if k > 1 else None
    # silhouette: Spark's evaluator computes exactly the squared-Euclidean
    # form from per-cluster sums, natively
    from pyspark.ml.evaluation import ClusteringEvaluator
    vecs = df.select(array_to_vector(x).alias("_v"), F.col(label).cast("double").alias("_l"))
    sil = ClusteringEvaluator(featuresCol="_v", predictionCol="_l", metricName="silhouette",
                              distanceMeasure="squaredEuclidean").evaluate(vecs) if k > 1 else None
    spark = df.sparkSession
    return spark.createDataFrame(
        [(k, float(inertia), ch, db, sil)],
        "k int, inertia double, calinski_harabasz double, davies_bouldin double, silhouette double")


# ---------------------------------------------------------------- fits

def fit_kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 42,
               restarts: int = 10, max_iter: int = 300) -> CentreModel:
    """KMeans with several seeds, all in shared passes; the fit with the lowest cost wins."""
    cost, centres = best_of_seeds(df, features, [k], seed, restarts, max_iter)[k]
    return CentreModel(featuresCol=features, predictionCol="cluster_label", centres=centres.tolist(),
                       trainingCost=cost)


def components_for_variance(df: DataFrame, features: str, variance: float = 0.95) -> int:
    """Smallest k whose cumulative explained variance reaches ``variance``."""
    dim = len(df.select(features).first()[0])
    ev = PCA(k=dim, inputCol=features, outputCol="_pca").fit(df).explainedVariance.toArray()
    total = 0.0
    for i, v in enumerate(ev):
        total += v
        if total >= variance - 1e-12:
            return i + 1
    return dim


def fit_cluster_pipeline(df: DataFrame, feature_cols: list[str], k: int,
                         variance: float = 0.95, seed: int = 42, restarts: int = 10,
                         log: bool = True) -> PipelineModel:
    """log1p -> mean imputation -> scale -> PCA -> KMeans as ONE
    PipelineModel, so training and scoring apply the same steps (N5).

    ``log=False`` leaves the first step out. A value at or below -1 has no
    log1p and counts as missing.
    """
    each = ", ".join(
        f"CASE WHEN CAST(`{c}` AS DOUBLE) > -1 THEN log1p(CAST(`{c}` AS DOUBLE)) END AS `_log_{i}`" if log
        else f"CAST(`{c}` AS DOUBLE) AS `_log_{i}`" for i, c in enumerate(feature_cols))
    logs = SQLTransformer(statement=f"SELECT *, {each} FROM __THIS__")
    names = [f"_log_{i}" for i in range(len(feature_cols))]
    filled = [f"_fill_{i}" for i in range(len(feature_cols))]
    logged = logs.transform(df)
    imputer = Imputer(strategy="mean", inputCols=names, outputCols=filled).fit(logged)
    assembler = VectorAssembler(inputCols=filled, outputCol="_raw")
    assembled = assembler.transform(imputer.transform(logged))
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(assembled)
    scaled = scaler.transform(assembled)
    n_comp = components_for_variance(scaled, "_scaled", variance)
    pca = PCA(k=n_comp, inputCol="_scaled", outputCol="pca_features").fit(scaled)
    # the passes over the reduced rows keep them packed; nothing of the wide table is held
    km = fit_kmeans(pca.transform(scaled), k, "pca_features", seed, restarts)
    return PipelineModel(stages=[logs, imputer, assembler, scaler, pca, km])


def add_cluster_label(df: DataFrame, model: PipelineModel | None, feature_cols: list[str]) -> DataFrame:
    """Fill absent feature columns with 0, apply the fitted pipeline, append
    ``cluster_label``. Without a model the frame is returned unchanged."""
    if model is None:
        return df
    extra = [c for c in df.columns if c not in feature_cols]
    aligned = df.select(*extra, *[F.col(f"`{c}`") if c in df.columns else
                                  F.lit(0.0).alias(c) for c in feature_cols])
    out = model.transform(aligned)
    helpers = [f"{p}_{i}" for p in ("_log", "_fill") for i in range(len(feature_cols))]
    return out.drop("_raw", "_scaled", "pca_features", *helpers)


def k_sweep(df: DataFrame, features: str, k_values: list[int], seed: int = 42,
            restarts: int = 10) -> DataFrame:
    """Per k, inertia, silhouette, Calinski-Harabasz and Davies-Bouldin
    as a long table (k, metric, value). Every iteration is one pass for all k
    and seeds; the metrics of all k take two more."""
    fitted = best_of_seeds(df, features, k_values, seed, restarts)
    metrics = sweep_metrics(df, features, {k: c for k, (_, c) in fitted.items()})
    return df.sparkSession.createDataFrame(
        [(k, name, value) for k in k_values for name, value in metrics.get(k, {}).items()],
        "k int, metric string, value double")


def scatter_coordinates(df: DataFrame, vec: str, keep: list[str], components: int = 3) -> DataFrame:
    """``keep`` and the first principal components (pc1, ...) of the scaled vectors of ``vec``."""
    raw = as_vector(df, vec, "_raw")
    scaled = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True).fit(raw).transform(raw)
    pcs = vector_to_array("_pc")
    out = PCA(k=components, inputCol="_scaled", outputCol="_pc").fit(scaled).transform(scaled)
    return out.select(*keep, *[pcs[i].alias(f"pc{i + 1}") for i in range(components)])


def choose_k(silhouette_k: int | None, elbow_k: int | None) -> int:
    """The smaller of the silhouette k and the elbow k; at least 2."""
    cands = [k for k in (silhouette_k, elbow_k) if k is not None]
    if not cands or min(cands) <= 1:
        raise ValueError(f"no usable k from silhouette={silhouette_k}, elbow={elbow_k}")
    return min(cands)


# ---------------------------------------------------------------- k choice as table jobs

# Fixed value: the metric for which a lower value is better.
LOWER_BETTER = ("Davies-Bouldin",)


def composite_k(metrics: DataFrame, series: list[str], k: str = "k", metric: str = "metric",
                value: str = "value", lower_better: tuple = LOWER_BETTER,
                invert: tuple = ()) -> DataFrame:
    """J12 per series: each metric divided by its max over k (when the max is
    positive), 'lower is better' metrics as 1 - x, averaged per k; the k with
    the highest composite wins (smallest k on ties). Inertia is not inverted
    unless listed in ``invert`` (as in the reference)."""
    mx = F.max(value).over(Window.partitionBy(*series, metric))
    norm = F.when(mx > 0, F.col(value) / mx).otherwise(F.col(value))
    flip = list(lower_better) + list(invert)
    scored = metrics.withColumn("_s", F.when(F.col(metric).isin(flip), 1 - norm).otherwise(norm))
    comp = scored.groupBy(*series, k).agg(F.avg("_s").alias("composite"))
    return comp.groupBy(*series).agg(
        F.min_by(k, F.struct((-F.col("composite")).alias("_c"), F.col(k).alias("_k"))).alias("best_k"),
        F.max("composite").alias("best_composite"))


def knee_point(df: DataFrame, series: list[str], x: str, y: str, sensitivity: float = 1.0) -> DataFrame:
    """J13 per series: the knee of a convex decreasing curve (Kneedle).

    Normalise x and y to [0, 1] per series; the difference curve is
    (1 - y_n[i]) - (1 - x_n[n-1-i]); local maxima / minima use both
    neighbours (ends compare with themselves); a maximum sets the threshold
    y_d[max] - S / (n - 1), a later minimum resets it to 0; the knee is x at
    the last maximum before the first point whose successor falls below the
    threshold. Every step is a window over one series.
    """
    w = Window.partitionBy(*series).orderBy(x)
    wall = Window.partitionBy(*series)
    pts = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
           .withColumn("_i", F.row_number().over(w) - 1)
           .withColumn("_n", F.count(F.lit(1)).over(wall))
           .withColumn("_xn", F.try_divide(F.col(x) - F.min(x).over(wall), F.max(x).over(wall) - F.min(x).over(wall)))
           .withColumn("_yn", F.try_divide(F.col(y) - F.min(y).over(wall), F.max(y).over(wall) - F.min(y).over(wall))))
    mirror = pts.select(*series, (F.col("_n") - 1 - F.col("_i")).alias("_i"), F.col("_xn").alias("_xm"))
    t = pts.join(mirror, on=series + ["_i"], how="inner")
    t = t.withColumn("_yd", (1 - F.col("_yn")) - (1 - F.col("_xm")))
    wi = Window.partitionBy(*series).orderBy("_i")
    prev, nxt = F.lag("_yd", 1).over(wi), F.lead("_yd", 1).over(wi)
    t = t.withColumns({
        "_max": (prev.isNull() | (F.col("_yd") >= prev)) & (nxt.isNull() | (F.col("_yd") >= nxt)),
        "_min": (prev.isNull() | (F.col("_yd") <= prev)) & (nxt.isNull() | (F.col("_yd") <= nxt)),
        "_next": nxt})
    upto = wi.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({
        "_last_max": F.max(F.when(F.col("_max"), F.col("_i"))).over(upto),
        "_last_min": F.max(F.when(F.col("_min"), F.col("_i"))).over(upto)})
    tmx = t.where(F.col("_max")).select(*series, F.col("_i").alias("_last_max"),
                                        (F.col("_yd") - sensitivity / (F.col("_n") - 1)).alias("_tmx"),
                                        F.col(x).alias("_knee_x"))
    t = t.join(tmx, on=series + ["_last_max"], how="left")
    thr = F.when(F.col("_last_min") >= F.col("_last_max"), F.lit(0.0)).otherwise(F.col("_tmx"))
    hit = t.where(F.col("_last_max").isNotNull() & (F.col("_i") < F.col("_n") - 1)
                  & (F.col("_next") < thr))
    knees = hit.groupBy(*series).agg(F.min_by("_knee_x", F.col("_i")).alias("knee"))
    return df.select(*series).distinct().join(knees, on=series, how="left")
