"""Scalar expressions: temperature, property names, chemistry classes, formulas."""

import math

import pytest
from pyspark.sql import functions as F

from phonon.functions.chemistry import (classify_material, classify_property, classify_spacegroup,
                                        explode_composition, formula_is_valid)
from phonon.functions.temperature import parse_temperature


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr("v").alias("r")).first().r


# the six cases of the reference's unit test, plus quirks of the first-number rule
@pytest.mark.parametrize("text,kelvin", [
    ("100 C", 373.15), ("250K", 250.0), ("20", 20.0), ("32 F", 273.15),
    ("room temperature", 298.15), (None, None),
    ("1e3", 1.0), ("1,000 K", 1.0), ("Ambient", 298.15), ("25 °C", 298.15),
    ("-10 c", 263.15), ("hot", None), ("5 cm", 278.15),
])
def test_parse_temperature(spark, text, kelvin):
    got = _one(spark, parse_temperature, text)
    if kelvin is None:
        assert got is None
    else:
        assert math.isclose(got, kelvin, rel_tol=1e-12)


def test_parse_temperature_numeric_column(spark):
    df = spark.createDataFrame([(300.0,), (None,)], "v double")
    got = [r.r for r in df.select(parse_temperature("v", df.schema["v"].dataType).alias("r")).collect()]
    assert got == [300.0, None]


@pytest.mark.parametrize("name,label", [
    ("Thermal conductivity, W/m/K", "thermalconductivity"), ("Mass density, kg/m3", "density"),
    ("Viscosity", None), (None, None)])
def test_classify_property(spark, name, label):
    assert _one(spark, classify_property, name) == label


@pytest.mark.parametrize("formula,cls", [
    ("Si", "Elemental"), ("C", "Elemental"), ("SiO2", "Oxide"), ("Fe2O3", "Oxide"),
    ("Bi2Te3", "Chalcogenide"), ("SnSe", "Chalcogenide"), ("NaCl", "Halide"), ("GaN", "Nitride"),
    ("AlN", "Nitride"), ("SiC", "Carbide"), ("BAs", "Boride"), ("CoSb3", "Pnictide"),
    ("LiH", "Hydride"), ("HfNiSn", "Intermetallic/Alloy"), ("not a formula", "Unknown"),
    ("Xx2", "Unknown"), (None, "Unknown"), ("SrTiO3", "Oxide")])
def test_classify_material(spark, formula, cls):
    assert _one(spark, classify_material, formula) == cls


@pytest.mark.parametrize("sg,system", [
    (None, "Unknown"), (0, "Unknown"), (1, "Triclinic"), (2.9, "Triclinic"), (3, "Monoclinic"),
    (15, "Monoclinic"), (16, "Orthorhombic"), (74, "Orthorhombic"), (75, "Tetragonal"),
    (142, "Tetragonal"), (143, "Trigonal"), (167, "Trigonal"), (168, "Hexagonal"),
    (194, "Hexagonal"), (195, "Cubic"), (230, "Cubic"), (231, "Unknown")])
def test_classify_spacegroup(spark, sg, system):
    assert _one(spark, classify_spacegroup, None if sg is None else float(sg), "v double") == system


def test_explode_composition_sums_repeats(spark):
    df = spark.createDataFrame([(1, "CH3COOH"), (2, "SiO2"), (3, "bad"), (4, "Al2.5O")],
                               "id int, f string")
    rows = {(r.id, r.element): r.amount for r in explode_composition(df, "f", ["id"]).collect()}
    assert rows == {(1, "C"): 2.0, (1, "H"): 4.0, (1, "O"): 2.0, (2, "Si"): 1.0, (2, "O"): 2.0,
                    (4, "Al"): 2.5, (4, "O"): 1.0}
    valid = [r.v for r in df.select(formula_is_valid("f").alias("v")).orderBy("id").collect()]
    assert valid == [True, True, False, True]


def test_formula_groups_one_level(spark):
    df = spark.createDataFrame([(1, "Mg3(PO4)2"), (2, "Ca(OH)2"), (3, "Cu(NO3)2"), (4, "K((O)2)"),
                                (5, "(SiO2)"), (6, "Fe2(SO4)3")], "id int, f string")
    rows = {(r.id, r.element): r.amount for r in explode_composition(df, "f", ["id"]).collect()}
    assert rows == {(1, "Mg"): 3.0, (1, "P"): 2.0, (1, "O"): 8.0,
                    (2, "Ca"): 1.0, (2, "O"): 2.0, (2, "H"): 2.0,
                    (3, "Cu"): 1.0, (3, "N"): 2.0, (3, "O"): 6.0,
                    (5, "Si"): 1.0, (5, "O"): 2.0,
                    (6, "Fe"): 2.0, (6, "S"): 3.0, (6, "O"): 12.0}
    cls = {r.id: r.c for r in df.select("id", classify_material("f").alias("c")).collect()}
    assert cls[1] == "Oxide" and cls[2] == "Oxide" and cls[4] == "Unknown" and cls[5] == "Oxide"
