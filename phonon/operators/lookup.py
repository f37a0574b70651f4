"""Best-match lookup in a candidate table.

Per request row: among candidates with the same formula and the requested
space group, the one with the lowest energy; if there is none, the
lowest-energy candidate of the formula; NULLs if the formula is unknown.

Instead of joining every request to every candidate of its formula (a
quadratic pair table for a popular formula), the candidates are first
reduced to the best one per (formula, group) and per formula. Both are
top-1 windows with a partial group limit before the shuffle, so a formula
holding a third of all candidates shrinks to one row per map task first. Each
request then meets at most one candidate per tier through two left
equi-joins, and the output has exactly one row per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir



def best_candidates(candidates: DataFrame, keys: list[str], energy_col: str,
                    tie_break: list[str]) -> DataFrame:
    """One row per ``keys``: the lowest-energy candidate (NULL energies last,
    ``tie_break`` columns decide equal energies).

    ``row_number() = 1`` plans a partial group limit before the exchange,
    so a key holding a third of all candidates leaves each map task as a
    single row.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(energy_col).asc_nulls_last(),
                                          *[F.col(c).asc_nulls_last() for c in tie_break])
    return candidates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def best_match(requests: DataFrame, candidates: DataFrame, *, formula_col: str,
               wanted_col: str | None, group_col: str, energy_col: str,
               tie_break: list[str], payload: dict[str, Column | str],
               match_col: str | None = None) -> DataFrame:
    """Attach the best candidate's ``payload`` (output name -> candidate column).

    ``match_col`` (optional) names a boolean: the chosen candidate's group
    equals the wanted one (NULL when nothing matched the formula).
    One pass over the candidates gives the best per (formula, group); the
    best per formula is then taken from that much smaller table. Both are
    joined by equi-joins; adaptive execution broadcasts them when small.
    """
    order_cols = [energy_col] + [c for c in tie_break if c != energy_col]
    cand = candidates.select(
        F.col(formula_col).alias("_f"), F.col(group_col).alias("_g"),
        *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in payload.items()],
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)])
    order = [f"_o{i}" for i in range(len(order_cols))]
    fields = list(payload) + ["_g"]
    # materialised once (reliable checkpoint in the shared folder): both
    # tiers read it, so the candidates are scanned once
    ensure_checkpoint_dir(candidates.sparkSession)
    by_group = best_candidates(cand, ["_f", "_g"], order[0], order[1:]).checkpoint()
    by_formula = best_candidates(by_group, ["_f"], order[0], order[1:])
    anyc = by_formula.select(F.col("_f").alias("_fa"), *[F.col(c).alias(f"_a_{c}") for c in fields])
    out = requests.join(anyc, requests[formula_col] == F.col("_fa"), "left")
    if wanted_col is not None:
        hits = by_group.select(F.col("_f").alias("_fh"), *[F.col(c).alias(f"_h_{c}") for c in fields])
        out = out.join(hits, (out[formula_col] == F.col("_fh"))
                       & (out[wanted_col].cast("long") == F.col("_h__g").cast("long")), "left")
        hit = F.col("_fh").isNotNull()
        chosen = {c: F.when(hit, F.col(f"_h_{c}")).otherwise(F.col(f"_a_{c}")) for c in fields}
    else:
        chosen = {c: F.col(f"_a_{c}") for c in fields}
    cols = {k: chosen[k] for k in payload}
    if match_col:
        want = F.col(wanted_col) if wanted_col else F.lit(None)
        cols[match_col] = F.when(F.col("_fa").isNotNull(),
                                 F.coalesce(want.cast("long") == chosen["_g"].cast("long"), F.lit(False)))
    helper = ["_fa", "_fh"] + [f"_a_{c}" for c in fields] + [f"_h_{c}" for c in fields]
    return out.withColumns(cols).drop(*helper)
