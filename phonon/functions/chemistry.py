"""H2-H4, H6: property names, formula parsing and classes as column expressions.

A formula is parsed by regular expressions into (element, amount) tokens;
the composition table is then an ``explode`` plus a group-sum, never a
Python object per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 118 element symbols of the periodic table, by atomic number.
ELEMENT_SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn "
    "Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce "
    "Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn "
    "Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl "
    "Mc Lv Ts Og"
).split()

# One token: an element symbol and an optional amount ("Si", "O2", "Te3", "O2.5").
FORMULA_TOKEN = r"([A-Z][a-z]?)([0-9]+\.?[0-9]*|\.[0-9]+)?"
# One level of parentheses: "(PO4)2" -> group body and optional multiplier.
_AMOUNT = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
FORMULA_GROUP = r"\(((?:[A-Z][a-z]?" + _AMOUNT + r"?)+)\)(" + _AMOUNT + r"?)"
FORMULA_FULL_GROUPED = (r"^(?:[A-Z][a-z]?" + _AMOUNT + r"?|\((?:[A-Z][a-z]?" + _AMOUNT + r"?)+\)"
                        + _AMOUNT + r"?)+$")

# Material classes, tested in this order on the element set.
CHALCOGENS = ["S", "Se", "Te"]
HALOGENS = ["F", "Cl", "Br", "I"]
PNICTOGENS = ["P", "As", "Sb", "Bi"]

# Space-group number ranges of the seven crystal systems.
CRYSTAL_SYSTEMS = [
    (1, 2, "Triclinic"),
    (3, 15, "Monoclinic"),
    (16, 74, "Orthorhombic"),
    (75, 142, "Tetragonal"),
    (143, 167, "Trigonal"),
    (168, 194, "Hexagonal"),
    (195, 230, "Cubic"),
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify_property(c: Column | str) -> Column:
    """H2: long-table property name to 'thermalconductivity', 'density' or NULL."""
    s = F.lower(_col(c))
    return (F.when(s.contains("thermal conductivity"), F.lit("thermalconductivity"))
            .when(s.contains("density"), F.lit("density")))


def _amount(text: Column) -> Column:
    return F.when(text == "", F.lit(1.0)).otherwise(text.cast("double"))


def formula_tokens(c: Column | str) -> Column:
    """array<struct<element, amount>> of a formula, one level of groups expanded.

    Tokens outside parentheses keep their amount; tokens inside "(...)n" are
    multiplied by n. Repeated elements are not summed here.
    """
    f = _col(c)
    outside = F.regexp_replace(f, FORMULA_GROUP, "")
    flat = F.zip_with(F.regexp_extract_all(outside, F.lit(FORMULA_TOKEN), 1),
                      F.regexp_extract_all(outside, F.lit(FORMULA_TOKEN), 2),
                      lambda e, a: F.struct(e.alias("element"), _amount(a).alias("amount")))
    groups = F.zip_with(F.regexp_extract_all(f, F.lit(FORMULA_GROUP), 1),
                        F.regexp_extract_all(f, F.lit(FORMULA_GROUP), 2),
                        lambda body, mult: F.transform(
                            F.zip_with(F.regexp_extract_all(body, F.lit(FORMULA_TOKEN), 1),
                                       F.regexp_extract_all(body, F.lit(FORMULA_TOKEN), 2),
                                       lambda e, a: F.struct(e.alias("element"), _amount(a).alias("amount"))),
                            lambda t: F.struct(t["element"].alias("element"),
                                               (t["amount"] * _amount(mult)).alias("amount"))))
    return F.concat(flat, F.flatten(groups))


def formula_is_valid(c: Column | str) -> Column:
    """True when the whole text is element tokens (optionally in one level of
    parentheses with a multiplier) of known symbols.

    The symbols are checked on a flat token scan (parentheses are skipped by
    the token pattern), which yields the same element set as the grouped
    parse and is far cheaper.
    """
    f = _col(c)
    symbols = F.array(*[F.lit(s) for s in ELEMENT_SYMBOLS])
    return (f.isNotNull() & f.rlike(FORMULA_FULL_GROUPED)
            & F.forall(F.regexp_extract_all(f, F.lit(FORMULA_TOKEN), 1),
                       lambda e: F.array_contains(symbols, e)))


def formula_elements(c: Column | str) -> Column:
    """Distinct element symbols of a valid formula; NULL for an invalid one."""
    f = _col(c)
    return F.when(formula_is_valid(f),
                  F.array_distinct(F.regexp_extract_all(f, F.lit(FORMULA_TOKEN), 1)))


def classify_material(c: Column | str) -> Column:
    """H3: chemistry class from the element set; invalid formula -> 'Unknown'.

    The element list is computed once and bound to a lambda variable (a
    one-element ``transform``), so the class chain does not re-parse the
    formula in every branch.
    """
    def chain(els):
        def has_any(xs):
            return F.arrays_overlap(els, F.array(*[F.lit(x) for x in xs]))

        return (F.when(els.isNull(), F.lit("Unknown"))
                .when(F.size(els) == 1, F.lit("Elemental"))
                .when(F.array_contains(els, "O"), F.lit("Oxide"))
                .when(has_any(CHALCOGENS), F.lit("Chalcogenide"))
                .when(has_any(HALOGENS), F.lit("Halide"))
                .when(F.array_contains(els, "N"), F.lit("Nitride"))
                .when(F.array_contains(els, "C"), F.lit("Carbide"))
                .when(F.array_contains(els, "B"), F.lit("Boride"))
                .when(has_any(PNICTOGENS), F.lit("Pnictide"))
                .when(F.array_contains(els, "H"), F.lit("Hydride"))
                .otherwise(F.lit("Intermetallic/Alloy")))

    return F.element_at(F.transform(F.array(formula_elements(c)), chain), 1)


def classify_spacegroup(c: Column | str) -> Column:
    """H4: crystal system from a space-group number (truncated); else 'Unknown'."""
    n = _col(c).try_cast("double").try_cast("int")
    out = None
    for lo, hi, name in CRYSTAL_SYSTEMS:
        cond = n.between(lo, hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("Unknown"))


def rejected_formulas(df: DataFrame, formula_col: str) -> DataFrame:
    """H6: (formula, n) of the texts that are no formula, which give no composition rows."""
    f = F.col(formula_col)
    return (df.where(f.isNotNull() & ~formula_is_valid(f)).groupBy(f.alias("formula"))
            .agg(F.count(F.lit(1)).alias("n")))


def explode_composition(df: DataFrame, formula_col: str, id_cols: list[str]) -> DataFrame:
    """H6: (ids..., element, amount) rows of each valid formula.

    An empty amount is 1; a group "(...)n" multiplies its members by n; an
    element written twice is summed. Invalid formulas give no rows here;
    ``rejected_formulas`` lists them.
    """
    f = F.col(formula_col)
    exploded = (df.where(formula_is_valid(f))
                .select(*id_cols, F.explode(formula_tokens(f)).alias("t"))
                .select(*id_cols, F.col("t.element").alias("element"), F.col("t.amount").alias("amount")))
    return exploded.groupBy(*id_cols, "element").agg(F.sum("amount").alias("amount"))
