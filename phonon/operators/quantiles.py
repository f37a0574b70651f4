"""Exact quantiles without holding a group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, which does not survive a group of billions of rows.
Here each wanted rank is found by narrowing: a pass counts the values of
the current bracket [lo, hi] in ``buckets`` equal-width buckets (a
partial/final aggregate, so only bucket counts are shuffled), and the
bracket moves to the bucket that holds the rank, tightened to that bucket's
own min and max. When a bracket holds a single value, or at most
``final_rows`` values, the rank is read off directly (a window over at most
``final_rows`` rows). Each pass shrinks a bracket by about ``buckets``
times, so 100 TB needs three or four passes. The interpolation is the
linear one of pandas, DuckDB ``quantile_cont`` and Spark ``percentile``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _attach(data: DataFrame, brackets: DataFrame, g: list[str], grouped: bool,
            cols: tuple = ("_lo", "_hi")) -> DataFrame:
    """Give each value its bracket: a join on the group keys, or, for one
    group, a literal CASE over its few brackets (distinct brackets are
    disjoint, so a value falls in at most one; no join, no cross product)."""
    if grouped:
        return data.join(brackets, on=g, how="inner")
    rows = brackets.collect()  # at most two brackets per wanted probability
    if not rows:
        return data.where(F.lit(False)).withColumns({c: F.lit(None).cast("double") for c in cols})
    out = data
    inside = lambda r: F.col("_v").between(F.lit(r["_lo"]), F.lit(r["_hi"]))
    for c in cols:
        e = None
        for r in rows:
            e = F.when(inside(r), F.lit(r[c])) if e is None else e.when(inside(r), F.lit(r[c]))
        out = out.withColumn(c, e)
    return out.where(F.col("_lo").isNotNull())


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float],
                    group_cols: list[str] = (), buckets: int = 1024,
                    final_rows: int = 1_000_000,
                    names: list[str] | None = None) -> DataFrame:
    """One row per group with a column per probability (default names q_<p>)."""
    ensure_checkpoint_dir(df.sparkSession)
    names = names or [f"q_{str(p).replace('.', '_')}" for p in probs]
    v = F.col(value_col).cast("double")
    # without groups, a constant key column stands in for the group (it is
    # only grouped on; brackets are attached without a join, see _attach)
    g = list(group_cols) or ["_g0"]
    src = df if group_cols else df.withColumn("_g0", F.lit(0))
    data = src.select(*g, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    stats = data.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"),
                                 F.max("_v").alias("_hi"))
    # wanted ranks (0-based) per group: floor and ceil of (n - 1) * p
    pos = [((F.col("_n") - 1) * F.lit(float(p))) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(h).cast("long"), F.ceil(h).cast("long")) for h in pos])))
    state = stats.select(*g, F.explode(ranks).alias("_k"), "_lo", "_hi",
                         F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_cnt"))
    # no group above the direct-ranking bound: rank each group at once in
    # one window (bounded by final_rows rows per group), keep wanted ranks
    largest = stats.agg(F.max("_n")).first()[0] or 0
    if largest <= final_rows:
        w = Window.partitionBy(*g).orderBy("_v")
        ranked = (data.withColumn("_rk", F.row_number().over(w) - 1)
                  .withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(*g))))
        want = None
        for p in probs:
            h = (F.col("_cnt") - 1) * F.lit(float(p))
            c = (F.col("_rk") == F.floor(h)) | (F.col("_rk") == F.ceil(h))
            want = c if want is None else want | c
        values = ranked.where(want).select(*g, F.col("_rk").cast("long").alias("_k"),
                                           F.col("_v").alias("_val"))
        return _interpolate(df, stats, values, probs, names, g, group_cols)
    state = state.checkpoint()
    turn = 0
    while True:      # a bracket shrinks to one bucket's range each pass, so this ends
        open_ = state.where((F.col("_lo") < F.col("_hi")) & (F.col("_cnt") > final_rows))
        if open_.limit(1).count() == 0:
            break
        brackets = open_.select(*g, "_lo", "_hi").distinct()
        width = F.col("_hi") - F.col("_lo")
        # equal widths, then widths that grow from the low end, then from the high end, in turn:
        # values spread over many orders of magnitude are cut apart as fast as even ones
        u = F.least(F.lit(1.0), (F.col("_v") - F.col("_lo")) / width)
        grown = lambda x: F.log2(1 + x * 2.0 ** 1000) / 1000
        place = (u, grown(u), 1 - grown(1 - u))[turn % 3]
        turn += 1
        bucket = F.greatest(F.lit(0), F.least(F.floor(place * buckets), F.lit(buckets - 1))).cast("int")
        hist = _attach(data, brackets, g, bool(group_cols))
        hist = (hist.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
                .groupBy(*g, "_lo", "_hi", bucket.alias("_b"))
                .agg(F.count(F.lit(1)).alias("_nb"), F.min("_v").alias("_bmin"),
                     F.max("_v").alias("_bmax")))
        w = Window.partitionBy(*g, "_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        moved = (open_.join(hist, on=g + ["_lo", "_hi"], how="inner")
                 .withColumn("_cum", F.sum("_nb").over(w))
                 .where((F.col("_below") + F.col("_cum") - F.col("_nb") <= F.col("_k"))
                        & (F.col("_k") < F.col("_below") + F.col("_cum")))
                 .select(*g, "_k", F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"),
                         (F.col("_below") + F.col("_cum") - F.col("_nb")).alias("_below"),
                         F.col("_nb").alias("_cnt")))
        done = state.where(~((F.col("_lo") < F.col("_hi")) & (F.col("_cnt") > final_rows)))
        state = done.unionByName(moved).checkpoint()
    # read off each rank: a single-valued bracket is its value; else rank inside it
    single = state.where(F.col("_lo") == F.col("_hi")).select(*g, "_k", F.col("_lo").alias("_val"))
    multi = state.where(F.col("_lo") < F.col("_hi"))
    brackets = multi.select(*g, "_lo", "_hi", "_below").distinct()
    wr = Window.partitionBy(*g, "_lo", "_hi").orderBy("_v")
    inside = (_attach(data, brackets, g, bool(group_cols), ("_lo", "_hi", "_below"))
              .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
              .withColumn("_rk", F.row_number().over(wr) - 1 + F.col("_below")))
    picked = (multi.join(inside, on=g + ["_lo", "_hi", "_below"], how="inner")
              .where(F.col("_rk") == F.col("_k")).select(*g, "_k", F.col("_v").alias("_val")))
    values = single.unionByName(picked)
    return _interpolate(df, stats, values, probs, names, g, group_cols)


def _interpolate(df, stats, values, probs, names, g, group_cols) -> DataFrame:
    """Linear interpolation between the values at floor/ceil of (n - 1) p."""
    if not group_cols:
        # one group: the few rank values and the count are scalars
        got = {r["_k"]: r["_val"] for r in values.collect()}
        n = stats.first()
        row = []
        for p in probs:
            if n is None or not n["_n"]:
                row.append(None)
                continue
            h = (n["_n"] - 1) * float(p)
            lo_k, hi_k = math.floor(h), math.ceil(h)
            lo_v, hi_v = got[lo_k], got[hi_k]
            row.append(lo_v + (hi_v - lo_v) * (h - lo_k))
        schema = ", ".join(f"`{nm}` double" for nm in names)
        return df.sparkSession.createDataFrame([tuple(row)], schema)
    at = stats.select(*g, "_n")
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        at = at.withColumns({f"_kl{i}": F.floor(h).cast("long"), f"_kh{i}": F.ceil(h).cast("long"),
                             f"_fr{i}": h - F.floor(h)})
    wide = values.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_val")))
                                  .alias("_m"))
    out = at.join(wide, on=g, how="left")
    cols = []
    for i, name in enumerate(names):
        lo_v = F.element_at("_m", F.col(f"_kl{i}"))
        hi_v = F.element_at("_m", F.col(f"_kh{i}"))
        cols.append((lo_v + (hi_v - lo_v) * F.col(f"_fr{i}")).alias(name))
    return out.select(*list(group_cols), *cols)


def exact_median(df: DataFrame, value_col: str, group_cols: list[str] = ()) -> DataFrame:
    return exact_quantiles(df, value_col, [0.5], group_cols, names=["median"])
