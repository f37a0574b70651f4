"""End-to-end jobs (I4, I5, J26, J30): featurise, build the feature table, train, score.

Each job is one lazy plan per output table; the only driver-side values are
fitted parameters (means, lambdas, model coefficients).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chemistry import classify_material, classify_spacegroup, explode_composition
from ..operators import composition as CO
from ..operators import lookup as LK
from ..operators import merge as M
from ..operators import prepare as PR
from ..operators import shape as SH
from ..operators import train as TR
from ..sources.tables import read_or_compute

# Atomic mass unit in g, times 1e24 (A^3 -> cm^3): g/cm^3 factor.
AMU_G_PER_CM3 = 1.66054


def det3(m: Column) -> Column:
    """Determinant of a 3x3 matrix given as array<array<double>>."""
    a = lambda i, j: m[i][j]
    return (a(0, 0) * (a(1, 1) * a(2, 2) - a(1, 2) * a(2, 1))
            - a(0, 1) * (a(1, 0) * a(2, 2) - a(1, 2) * a(2, 0))
            + a(0, 2) * (a(1, 0) * a(2, 1) - a(1, 1) * a(2, 0)))


def structure_density(lattice: Column, mass: Column) -> Column:
    """I4: density (g/cm^3) = total site mass (amu) / |cell volume| (A^3) x 1.66054.

    A malformed lattice (not 3x3, NULL or zero volume) gives NULL.
    """
    ok = (F.size(lattice) == 3) & F.forall(lattice, lambda r: F.size(r) == 3)
    vol = F.abs(det3(lattice))
    return F.when(ok & (vol > 0), mass / vol * AMU_G_PER_CM3)


def structure_densities(atoms: DataFrame, lattices: DataFrame, key: str, element_mass: DataFrame,
                        lattice_col: str = "lattice", element_col: str = "element",
                        mass_col: str = "mass") -> DataFrame:
    """I4 over atoms: (key, density) from one row per site and one lattice per key.

    Site masses are summed per structure (partial aggregate); a structure with
    a site of unknown mass, or without a usable lattice, has a NULL density.
    """
    sites = atoms.join(element_mass.select(element_col, F.col(mass_col).alias("_m")), element_col, "left")
    mass = sites.groupBy(key).agg(
        F.when(F.count("_m") == F.count(F.lit(1)), F.sum("_m")).alias("_mass"))
    return lattices.join(mass, key, "left").select(
        key, structure_density(F.col(lattice_col), F.col("_mass")).alias("density"))


def featurize(df: DataFrame, element_props: DataFrame, stat_props: list[str],
              orbital_cols: dict[str, str] | None = None, composition_col: str = "formula",
              mp_candidates: DataFrame | None = None, mp_tie: list[str] = (),
              mp_payload: dict | None = None,
              jarvis_candidates: DataFrame | None = None, jarvis_tie: list[str] = (),
              jarvis_payload: dict | None = None) -> DataFrame:
    """The reference's featurisation as one plan.

    B3 strip names -> B10 space group renamed first (N3) -> composition
    features computed once per DISTINCT formula and joined back (H6, I0) ->
    B4 sanitise names -> best-match lookups (D2, D3) when candidate tables
    are given -> chemistry class (H3) -> crystal system from the user space
    group, else from the mean element space group if present (H4) ->
    density (B5).
    """
    df = SH.strip_column_names(df)
    if composition_col not in df.columns:
        raise ValueError(f"composition column {composition_col!r} not in {df.columns}")
    df = SH.normalize_space_group(df)
    formulas = df.select(F.col(composition_col).alias("_formula")).where(F.col("_formula").isNotNull()) \
        .distinct()
    comp = explode_composition(formulas, "_formula", ["_formula"])
    feats = CO.composition_features(comp, element_props, stat_props, orbital_cols, id_col="_formula",
                                    naming="magpie")
    # the class depends on the formula only: computed once per distinct formula
    feats = feats.withColumn("chemistry", classify_material("_formula"))
    out = df.join(feats, df[composition_col] == feats["_formula"], "left").drop("_formula")
    out = out.withColumn("chemistry", F.coalesce("chemistry", F.lit("Unknown")))
    out = SH.sanitize_column_names(out)
    if mp_candidates is not None and mp_payload:
        out = LK.best_match(out, mp_candidates, formula_col=composition_col,
                            wanted_col="user_space_group_number" if "user_space_group_number" in out.columns else None,
                            group_col="space_group_number", energy_col="energy_above_hull",
                            tie_break=list(mp_tie), payload=mp_payload, match_col="mp_spacegroup_match_user")
    if jarvis_candidates is not None and jarvis_payload:
        out = LK.best_match(out, jarvis_candidates, formula_col=composition_col,
                            wanted_col="user_space_group_number" if "user_space_group_number" in out.columns else None,
                            group_col="spacegroup_number", energy_col="formation_energy_peratom",
                            tie_break=list(jarvis_tie), payload=jarvis_payload)
    if "user_space_group_number" in out.columns:
        out = out.withColumn("crystal_structure", classify_spacegroup("user_space_group_number"))
    elif "MagpieData_mean_SpaceGroupNumber" in out.columns:
        out = out.withColumn("crystal_structure", classify_spacegroup("MagpieData_mean_SpaceGroupNumber"))
    else:
        out = out.withColumn("crystal_structure", F.lit("Unknown"))
    out = SH.first_non_null(out, ["mp_density", "jarvis_density"], "density")
    if "crystal_system" in out.columns:
        out = out.withColumn("crystal_system", F.col("crystal_system").cast("string"))
    return out


def build_feature_table(spark: SparkSession, path: str, sources: list[DataFrame], tie_break: list,
                        featurize_kwargs: dict) -> DataFrame:
    """J30 (entry 1): merge -> clean/impute -> featurise -> stored table."""
    def compute():
        merged = M.merge_measurements(sources, tie_break=tie_break)
        return featurize(M.impute_and_clean(merged), **featurize_kwargs)
    return read_or_compute(spark, path, compute)


def run_pipeline(features: DataFrame, target: str, key: str, model_path: str | None = None,
                 trainer=None) -> tuple:
    """J30 (entry 2): prepare, split, fit, evaluate, optionally save.

    Missing values are left to the pipeline's imputer, which is fitted on the
    training rows and saved with the model. Returns (PipelineModel, metrics
    DataFrame, feature names).
    """
    data, cols = PR.prepare_for_modeling(features, target, exclude=PR.NON_FEATURES + [key],
                                         carry=[key], impute=False)
    train, test = PR.split_train_test(data, key)
    model, metrics, _ = TR.train_and_evaluate(trainer or TR.boosted_trees(), train, test, cols, target)
    if model_path:
        TR.save_model(model, model_path)
    return model, metrics, cols


def score_csv(spark: SparkSession, model_path: str, csv_path: str, schema: str, features: list[str],
              out_path: str, featurize_fn=None, required: list[str] = ("formula", "temperature"),
              raw_target: bool = False) -> DataFrame:
    """J26 (script): read CSV -> validate (C5) -> featurise -> align -> impute
    (the model's medians) -> predict -> inverse log -> round -> CSV.

    The space group is read as text and checked before it becomes a number,
    so that text in it is an error and not a missing value.
    """
    from ..sources.tables import read_csv, write_csv
    typed = T.StructType.fromDDL(schema)
    names = [f.name for f in typed.fields]
    group = next((a for a in SH.SPACE_GROUP_ALIASES if a in [n.strip() for n in names]), None)
    fields = [T.StructField(f.name, T.StringType() if f.name.strip() == group else f.dataType)
              for f in typed.fields]
    df = SH.strip_column_names(read_csv(spark, csv_path, T.StructType(fields)))
    summary, offenders = SH.validate_input(df, list(required), group)
    bad = summary.first().n_invalid or 0
    if bad:
        raise ValueError(f"{bad} rows have an invalid space group, e.g. {offenders.take(5)}")
    if featurize_fn is not None:
        df = featurize_fn(df)
    scored = TR.score_batch(TR.load_model(model_path), df, features, raw_target=raw_target)
    write_csv(scored, out_path)
    return scored
