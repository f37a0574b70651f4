"""Normality tests per column over all its rows: Shapiro-Wilk and Kolmogorov-Smirnov.

W compares the sorted values with the normal scores of their ranks. All values
of all columns are sorted once by ranges of (column, value, row hash), so a
hot value is spread over many tasks; positions are the rows of the earlier
ranges plus the place in the own range. The normal score is a column
expression of the rank, and W needs only a few sums and the four outermost
values per column. The p-value follows Royston's published approximation (AS
R94), which covers 3 to 5000 values; beyond that W is given and the p-value
is NULL. Jarque-Bera and Kolmogorov-Smirnov have a p-value at every size.
"""

from __future__ import annotations

import math
import uuid
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .explore import to_long

_N = NormalDist()
MOST_FOR_P = 5000

# Polynomial coefficients of Royston's approximation (AS R94).
C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
C6 = [-0.4803, -0.082676, 0.0030302]
G = [-2.273, 0.459]

# Acklam's published rational approximation of the normal quantile.
QA = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
QB = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01, 1.0]
QC = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
QD = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00, 1.0]


# Hart's rational approximation of the normal distribution function, as published by
# West (2005), and where its tail's continued fraction takes over.
HN = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
      221.213596169931, 220.206867912376]
HD = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
      637.333633378831, 793.826512519948, 440.413735824752]
TAIL, FAR = 7.07106781186547, 37.0
KS_TERMS = 100


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def _horner(c: list[float], x: Column) -> Column:
    out = F.lit(c[0])
    for k in c[1:]:
        out = out * x + F.lit(k)
    return out


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal as a column expression (relative error about 1e-9)."""
    mid = p - 0.5
    centre = _horner(QA, mid * mid) * mid / _horner(QB, mid * mid)
    edge = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(QC, edge) / _horner(QD, edge)
    return F.when(F.least(p, 1 - p) < 0.02425, F.when(p < 0.5, tail).otherwise(-tail)).otherwise(centre)


def normal_cdf(z: Column) -> Column:
    """Distribution function of the standard normal as a column expression (error about 1e-15)."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    tail = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    low = F.when(a > FAR, F.lit(0.0)).when(a < TAIL, e * _horner(HN, a) / _horner(HD, a)).otherwise(
        e / tail / 2.506628274631)
    return F.when(z > 0, 1 - low).otherwise(low)


def kolmogorov_tail(d: Column, n: Column) -> Column:
    """p-value of the distance ``d`` of ``n`` values: Kolmogorov's series at Stephens' scaled distance."""
    root = F.sqrt(n)
    x = (root + 0.12 + 0.11 / root) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(KS_TERMS)),
                        lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * j * j * x * x))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def kolmogorov_smirnov(df: DataFrame, cols: list[str], alpha: float = 0.05, buckets: int = 1 << 16) -> DataFrame:
    """E13 (Kolmogorov-Smirnov form): feature, n, d, p_value, is_normal — one row per column with a
    value, most normal first.

    ``d`` is the largest distance between the column's empirical distribution and the normal one of
    its mean and sample deviation, from the ranks of all values. The p-value is that of a given
    normal distribution, so it is on the large side where, as here, mean and deviation are estimated.
    A constant column, or a single value, has neither.

    Values are counted by buckets of the normal distribution function (their number is fixed). The
    counts bound the distance inside every bucket; only the values of buckets whose bound beats the
    distances already met are ranked, so the result is exact and the table is not sorted.
    """
    spark = df.sparkSession
    values = to_long(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    shape = values.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                                          F.stddev_samp("value").alias("sd")).collect()          # one row per column
    sizes = spark.createDataFrame([tuple(r) for r in shape], "feature string, n long, mean double, sd double")
    scored = (values.join(F.broadcast(sizes.where("sd > 0")), "feature")
              .withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd"))
              .withColumn("u", normal_cdf(F.col("z")))
              .withColumn("bucket", F.least(F.floor(F.col("u") * buckets), F.lit(buckets - 1)).cast("int")))
    # a bucket's own ends are at distances met by its first and last value; no value in it is further than ``most``
    order = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    path = scratch_path(spark, f"ks/{uuid.uuid4().hex}")
    (scored.groupBy("feature", "bucket").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("held"),
                                             F.min("u").alias("low"), F.max("u").alias("high"))
     .withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0)))                # at most ``buckets`` rows
     .write.parquet(path))
    kept = spark.read.schema("feature string, bucket int, n long, held long, low double, high double, before long"
                             ).parquet(path)
    below, upto = F.col("before") / F.col("n"), (F.col("before") + F.col("held")) / F.col("n")
    kept = kept.withColumns({"met": F.greatest(upto - F.col("high"), F.col("low") - below),
                             "most": F.greatest(upto - F.col("low"), F.col("high") - below)})
    met = kept.groupBy("feature").agg(F.max("met").alias("best"))
    # values of the buckets that may hold a larger distance, equal ones once, ranked inside their bucket
    open_ = (kept.join(met, "feature").where((F.col("most") > F.col("best")) & (F.col("low") < F.col("high")))
             .select("feature", "bucket", "before"))
    inside = Window.partitionBy("feature", "bucket").orderBy("value")
    apart = (scored.join(F.broadcast(open_), ["feature", "bucket"])
             .groupBy("feature", "bucket", "value").agg(F.max("n").alias("n"), F.max("u").alias("u"),
                                                        F.max("before").alias("before"), F.count(F.lit(1)).alias("held"))
             .withColumn("upto", F.sum("held").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
             .select("feature", F.greatest(F.col("upto") / F.col("n") - F.col("u"),
                                           F.col("u") - (F.col("upto") - F.col("held")) / F.col("n")).alias("d")))
    worst = met.withColumnRenamed("best", "d").unionByName(apart).groupBy("feature").agg(F.max("d").alias("d"))
    out = (sizes.select("feature", "n").join(worst, "feature", "left")
           .withColumn("p_value", F.when(F.col("d").isNotNull(), kolmogorov_tail(F.col("d"), F.col("n")))))
    return out.withColumn("is_normal", F.col("p_value") >= alpha).orderBy(
        F.col("p_value").desc_nulls_last(), "d", "feature")


def w_statistic(n: int, mm: float, mx: float, ends: list[float], scores: list[float], ss: float) -> float:
    """W from n, sum of squared scores, sum of score x value, the outermost two
    values and scores at either end, and the sum of squares about the mean."""
    if n < 3 or not ss > 0:
        return float("nan")
    if n == 3:
        return min(0.5 * (ends[3] - ends[0]) ** 2 / ss, 1.0)
    u = 1.0 / math.sqrt(n)
    an = scores[3] / math.sqrt(mm) + _poly(C1, u)
    if n > 5:
        an1 = scores[2] / math.sqrt(mm) + _poly(C2, u)
        phi = (mm - 2 * scores[3] ** 2 - 2 * scores[2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
        inner = mx - scores[3] * (ends[3] - ends[0]) - scores[2] * (ends[2] - ends[1])
        top = inner / math.sqrt(phi) + an * (ends[3] - ends[0]) + an1 * (ends[2] - ends[1])
    else:
        phi = (mm - 2 * scores[3] ** 2) / (1 - 2 * an ** 2)
        inner = mx - scores[3] * (ends[3] - ends[0])
        top = inner / math.sqrt(phi) + an * (ends[3] - ends[0])
    return min(top * top / ss, 1.0)


def w_pvalue(w: float, n: int) -> float | None:
    """Royston's p-value of W; None beyond 5000 values, NaN where W is undefined."""
    if w != w:
        return float("nan")
    if n > MOST_FOR_P:
        return None
    if n == 3:
        return max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    if w >= 1.0:
        return 1.0
    if n <= 11:
        gamma = _poly(G, n)
        if gamma - math.log(1 - w) <= 0:
            return 1.0
        y, mu, sigma = -math.log(gamma - math.log(1 - w)), _poly(C3, n), math.exp(_poly(C4, n))
    else:
        ln_n = math.log(n)
        y, mu, sigma = math.log(1 - w), _poly(C5, ln_n), math.exp(_poly(C6, ln_n))
    return 1 - _N.cdf((y - mu) / sigma)


def ranked(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, rank, n): every value with its 1-based rank in its column.

    Ties have equal values, so their order does not matter; the row hash only
    spreads them over the ranges.
    """
    spark = df.sparkSession
    long = to_long(df.select(*cols, F.xxhash64(*cols).alias("_h")), cols, ids=["_h"])
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    path = scratch_path(spark, f"ranks/{uuid.uuid4().hex}")
    # the id holds the number of the range in its high bits, the place in it in the low 33
    (long.repartitionByRange("feature", "value", "_h").sortWithinPartitions("feature", "value", "_h")
     .select("feature", "value", F.monotonically_increasing_id().alias("at")).write.parquet(path))
    rows = spark.read.schema("feature string, value double, at long").parquet(path)
    part = F.shiftright("at", 33)
    counts = rows.groupBy("feature", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).collect()   # ranges, not rows
    starts, total = [], {}
    for r in sorted(counts, key=lambda r: (r["feature"], r["part"])):
        starts.append((r["feature"], r["part"], total.get(r["feature"], 0) - r["first"]))
        total[r["feature"]] = total.get(r["feature"], 0) + r["n"]
    shift = spark.createDataFrame(starts, "feature string, part long, shift long")
    sizes = spark.createDataFrame(list(total.items()), "feature string, n long")
    return (rows.withColumn("part", part).join(F.broadcast(shift), ["feature", "part"])
            .join(F.broadcast(sizes), "feature")
            .select("feature", "value", (F.col("at") + F.col("shift") + 1).alias("rank"), "n"))


def shapiro_by_feature(df: DataFrame, cols: list[str], alpha: float = 0.05) -> DataFrame:
    """E13 (Shapiro form): feature, n, w, p_value, is_normal — one row per column
    with a value, most normal first (F6)."""
    r = ranked(df, cols).withColumn("m", normal_quantile((F.col("rank") - 0.375) / (F.col("n") + 0.25)))
    # values about the column's middle value keep the sums short of cancellation
    at = [F.col("rank") == 1, F.col("rank") == 2, F.col("rank") == F.col("n") - 1,
          F.col("rank") == F.col("n")]
    rows = r.groupBy("feature").agg(
        F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.covar_pop("m", "value").alias("cov"), F.sum("m").alias("ms"), F.avg("value").alias("mean"),
        F.var_pop("value").alias("var"),
        *[F.max(F.when(c, F.col("value"))).alias(f"x{i}") for i, c in enumerate(at)],
        *[F.max(F.when(c, F.col("m"))).alias(f"m{i}") for i, c in enumerate(at)]).collect()
    out = []
    for f in rows:                           # one row per column
        n = f["n"]
        w = w_statistic(n, f["mm"], f["cov"] * n + f["ms"] * f["mean"],
                        [f[f"x{i}"] for i in range(4)], [f[f"m{i}"] for i in range(4)], f["var"] * n)
        p = w_pvalue(w, n)
        out.append((f["feature"], n, w, p, None if p is None else bool(p >= alpha)))
    made = df.sparkSession.createDataFrame(
        out, "feature string, n long, w double, p_value double, is_normal boolean")
    return made.orderBy(F.col("p_value").desc_nulls_last(), F.col("w").desc_nulls_last(), "feature")


def by_p_value(tests: DataFrame, statistic: str) -> DataFrame:
    """a table of tests (one row per column of the data) with its ``place``: highest p-value first, then
    the lower statistic, then the name; missing p-values last."""
    order = Window.orderBy(F.col("p_value").desc_nulls_last(), statistic, "feature")
    return tests.withColumn("place", F.row_number().over(order).cast("long"))
