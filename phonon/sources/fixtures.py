"""Stand-in inputs built from the driver tables by expressions only.

The reference reads three measurement sources, two materials databases and
an element-property table that are not available here. Each function below
derives a table of the same shape from the TPC-H-like driver tables, with
plain column expressions, so every registered query reads whole tables and
its work grows with them. The oracle SQL in ``plans.catalog`` repeats the
same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chemistry import ELEMENT_SYMBOLS
from .tables import read_table

# Own choice: one or two formulas per material class and per case of the
# grammar (fractional amount, group, group without multiplier, repeated
# element, text that is no formula, unknown symbol, NULL).
FORMULAS = [
    "W", "Kr", "ZnFe2O4", "LaCoO3", "Li0.5CoO2", "CdS", "Ag2Se", "GeTe", "KI", "CuBr2",
    "TaN", "WC", "TiB2", "InAs", "ZrSb2", "LiH", "NbTi", "Al2(SO4)3", "Zn(OH)(NO3)", "CH3CH2",
    "not-a-formula", "Xx2", None,
]


def formula_of_part(key: Column) -> Column:
    """'P<k % 200>': a compact synthetic formula id per part key."""
    return F.concat(F.lit("P"), (key % 200).cast("string"))


def temperature_text(li_orderkey: Column, li_quantity: Column, li_linenumber: Column) -> Column:
    """Whole quantity with ' C', 'K', ' F' or no unit; 'room temperature' every 11th order."""
    unit = (F.when(li_linenumber % 4 == 0, F.lit(" C"))
            .when(li_linenumber % 4 == 1, F.lit("K"))
            .when(li_linenumber % 4 == 2, F.lit(" F"))
            .otherwise(F.lit("")))
    return (F.when(li_orderkey % 11 == 0, F.lit("room temperature"))
            .otherwise(F.concat(li_quantity.cast("bigint").cast("string"), unit)))


def measurement_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        formula_of_part(F.col("l_partkey")).alias("formula"),
        temperature_text(F.col("l_orderkey"), F.col("l_quantity"),
                         F.col("l_linenumber")).alias("temperature_text"),
        F.when(F.col("l_orderkey") % 13 != 0, F.col("l_extendedprice")).alias("value"),
        "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_suppkey")


TIE_COLS = ["l_orderkey", "l_linenumber", "l_suppkey"]


def measurement_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three raw sources with the reference's differing column names.

    lineitem rows with return flag A, N, R play sources 1, 2, 3; source 3
    is a long (property, value, phase) table.
    """
    base = measurement_base(spark, sf_dir)
    s1 = base.where(F.col("l_returnflag") == "A").select(
        "formula", F.col("value").alias("k_expt"),
        F.col("temperature_text").alias("k_condition"), *TIE_COLS)
    s2 = base.where(F.col("l_returnflag") == "N").select(
        F.col("formula").alias("composition"), F.col("temperature_text").alias("temperature"),
        F.col("value").alias("kappa"), *TIE_COLS)
    prop = (F.when(F.col("l_linenumber") == 7, F.lit("Viscosity, Pa*s"))
            .when(F.col("l_linestatus") == "O", F.lit("Thermal conductivity, W/m/K"))
            .otherwise(F.lit("Mass density, kg/m3")))
    phase = (F.when(F.col("l_suppkey") % 5 == 0, F.lit("Liquid"))
             .when(F.col("l_suppkey") % 5 == 1, F.lit(None).cast("string"))
             .when(F.col("l_suppkey") % 5 == 2, F.lit("Crystal 1"))
             .otherwise(F.lit("crystalline SOLID")))
    s3 = base.where(F.col("l_returnflag") == "R").select(
        "formula", F.col("temperature_text").alias("temperature"),
        prop.alias("property"), "value", phase.alias("phase"), *TIE_COLS)
    return s1, s2, s3


def formula_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, formula): the list entry at p_partkey modulo its length."""
    part = read_table(spark, sf_dir, "part")
    arr = F.array(*[F.lit(f).cast("string") for f in FORMULAS])
    return part.select("p_partkey",
                       F.element_at(arr, (F.col("p_partkey") % len(FORMULAS) + 1).cast("int"))
                       .alias("formula"))


PART_ROWS = 250_000


def composition_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, element, amount): order = compound, part = element, quantity = amount.

    Repeated (order, part) pairs are summed, as a formula writing an element
    twice is.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("element"), "l_quantity")
    # partitioned by composition id once: the element sum, the window and the per-composition aggregate
    # downstream all reuse this exchange; its parts hold about the same number of rows at every size
    parts = max(spark.sparkContext.defaultParallelism, -(-li.count() // PART_ROWS))
    return (li.repartition(parts, "row_id").groupBy("row_id", "element")
            .agg(F.sum("l_quantity").alias("amount")))


def element_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-property table (element, size, price, s/p/d/f valence counts).

    part plays the element table: p_size and p_retailprice (in cents, so
    whole numbers) are two properties, and four valence counts are residues
    of p_size. Every property is NULL when p_partkey % 17 = 0.
    """
    part = read_table(spark, sf_dir, "part")
    keep = F.col("p_partkey") % 17 != 0
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("element"),
        F.when(keep, size.cast("double")).alias("size"),
        F.when(keep, F.round(F.col("p_retailprice") * 100)).alias("price"),
        F.when(keep, (size % 3).cast("double")).alias("s_valence"),
        F.when(keep, (size % 7).cast("double")).alias("p_valence"),
        F.when(keep, (size % 11).cast("double")).alias("d_valence"),
        F.when(keep, (size % 15).cast("double")).alias("f_valence"))


def symbol_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-property table keyed by symbol, from every part row: the parts
    with key = i (mod 118) give the largest value of each property to symbol i."""
    cols = ["size", "price", "s_valence", "p_valence", "d_valence", "f_valence"]
    n = len(ELEMENT_SYMBOLS)
    table = element_properties(spark, sf_dir).groupBy((F.col("element") % n).alias("element")).agg(
        *[F.max(c).alias(c) for c in cols])
    symbols = F.array(*[F.lit(s) for s in ELEMENT_SYMBOLS])
    return table.select(F.element_at(symbols, (F.col("element") + 1).cast("int")).alias("element"), *cols)


ELEMENT_STAT_PROPS = ["size", "price"]
ELEMENT_ORBITALS = {"s": "s_valence", "p": "p_valence", "d": "d_valence", "f": "f_valence"}


def mp_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup requests: part rows, formula by key, wanted space group = p_size."""
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", formula_of_part(F.col("p_partkey")).alias("formula"),
        F.col("p_size").alias("user_space_group_number"))


def mp_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate table 1 from lineitem: space group = l_suppkey % 50,
    energy = l_extendedprice (NULL when l_linenumber = 7)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        formula_of_part(F.col("l_partkey")).alias("formula"),
        (F.col("l_suppkey") % 50).alias("space_group_number"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("energy_above_hull"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("material_id"),
        F.col("l_quantity").alias("density"), F.col("l_tax").alias("volume"),
        F.col("l_discount").alias("band_gap"), (F.col("l_linestatus") == "F").alias("is_metal"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax", "l_discount",
        "l_linestatus")


MP_TIE = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax", "l_discount",
          "l_linestatus"]


def jarvis_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup requests: supplier rows, formula by 7 * key, wanted group = s_nationkey."""
    return read_table(spark, sf_dir, "supplier").select(
        "s_suppkey", formula_of_part(F.col("s_suppkey") * 7).alias("formula"),
        F.col("s_nationkey").alias("user_space_group_number"))


def jarvis_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate table 2 from lineitem: spacegroup = l_orderkey % 25,
    formation energy = l_extendedprice / 1000 (NULL when l_linenumber = 3), a
    diagonal lattice and two site masses per candidate."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        formula_of_part(F.col("l_partkey")).alias("formula"),
        (F.col("l_orderkey") % 25).alias("spacegroup_number"),
        F.col("l_quantity").alias("bulk_modulus_vrh"), F.col("l_tax").alias("shear_modulus_vrh"),
        F.col("l_discount").alias("optb88vdw_bandgap"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 1000)
        .alias("formation_energy_peratom"),
        F.col("l_suppkey").cast("double").alias("debye_temp"),
        F.array(F.array(F.col("l_quantity"), F.lit(0.0), F.lit(0.0)),
                F.array(F.lit(0.0), F.col("l_quantity"), F.lit(0.0)),
                F.array(F.lit(0.0), F.lit(0.0), 1 + F.col("l_tax"))).alias("lattice"),
        F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity")).alias("site_masses"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax", "l_discount",
        "l_extendedprice")


JARVIS_TIE = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax", "l_discount",
              "l_extendedprice"]


FEATURE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "const_one",
                "near_const", "mostly_null", "qty_copy"]


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric feature matrix from lineitem plus four awkward columns: a
    constant, a nearly constant one, a mostly NULL one and a linear copy."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.lit(1.0).alias("const_one"),
        (F.lit(1.0) + F.when(F.col("l_orderkey") % 1000 == 0, F.lit(1e-7)).otherwise(F.lit(0.0)))
        .alias("near_const"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).alias("mostly_null"),
        (F.col("l_quantity") * 2 + 1).alias("qty_copy"))


def daily_event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, day, n, total): one point per event type and day."""
    ev = read_table(spark, sf_dir, "events")
    return ev.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


MODEL_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def modelling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to learn l_extendedprice from line and part attributes.

    ``row_key`` identifies a row for hashing (split, folds, permutations).
    """
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    return li.join(part, "l_partkey", "left").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("row_key"),
        *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES], "l_extendedprice")


def featurize_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to featurise: part rows with a real formula, a temperature and a
    user space group under one of its accepted spellings (' space_group')."""
    f = formula_strings(spark, sf_dir)
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return f.join(part, "p_partkey").select(
        "p_partkey", "formula", (F.col("p_size") * 10).cast("double").alias("temperature"),
        F.col("p_size").alias(" space_group"))


def symbol_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate table 1 keyed by real formulas: the list entry at l_orderkey modulo its length."""
    arr = F.array(*[F.lit(f).cast("string") for f in FORMULAS])
    c = mp_candidates(spark, sf_dir)
    return c.withColumn("formula", F.element_at(arr, (F.col("l_orderkey") % len(FORMULAS) + 1).cast("int")))
