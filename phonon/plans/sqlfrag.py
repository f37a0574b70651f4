"""ANSI SQL fragments for the DuckDB oracle.

They restate, in SQL, the fixture expressions of ``sources.fixtures`` and the
column functions of ``functions``, so each registered Spark query has an
independent SQL twin.
"""

from __future__ import annotations

# Fixed values, written out a second time so that the twin does not depend on
# the code under test.
TEMPERATURE_PATTERN = r"([-+]?[0-9]*\.?[0-9]+)\s*°?\s*([ckf])?"
ELEMENT_SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn "
    "Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce "
    "Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn "
    "Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl "
    "Mc Lv Ts Og").split()
CRYSTAL_SYSTEMS = [(1, 2, "Triclinic"), (3, 15, "Monoclinic"), (16, 74, "Orthorhombic"),
                   (75, 142, "Tetragonal"), (143, 167, "Trigonal"), (168, 194, "Hexagonal"),
                   (195, 230, "Cubic")]
FORMULA_TOKEN = r"([A-Z][a-z]?)([0-9]+\.?[0-9]*|\.[0-9]+)?"
FORMULA_GROUP = (r"\(((?:[A-Z][a-z]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)?)+)\)"
                 r"((?:[0-9]+\.?[0-9]*|\.[0-9]+)?)")
FORMULA_FULL_GROUPED = (r"^(?:[A-Z][a-z]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)?"
                        r"|\((?:[A-Z][a-z]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)?)+\)"
                        r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)?)+$")
FORMULAS = [
    "W", "Kr", "ZnFe2O4", "LaCoO3", "Li0.5CoO2", "CdS", "Ag2Se", "GeTe", "KI", "CuBr2",
    "TaN", "WC", "TiB2", "InAs", "ZrSb2", "LiH", "NbTi", "Al2(SO4)3", "Zn(OH)(NO3)", "CH3CH2",
    "not-a-formula", "Xx2", None,
]


def parse_temperature(expr: str) -> str:
    t = f"lower({expr})"
    num = f"regexp_extract({t}, '{TEMPERATURE_PATTERN}', 1)"
    unit = f"regexp_extract({t}, '{TEMPERATURE_PATTERN}', 2)"
    n = f"CAST({num} AS DOUBLE)"
    return (f"(CASE WHEN {num} <> '' THEN (CASE {unit} WHEN 'c' THEN {n} + CAST(273.15 AS DOUBLE) "
            f"WHEN 'f' THEN ({n} - 32) * 5 / 9 + CAST(273.15 AS DOUBLE) ELSE {n} END) "
            f"WHEN {t} LIKE '%room%' OR {t} LIKE '%ambient%' THEN CAST(298.15 AS DOUBLE) END)")


def formula_of_part(key: str) -> str:
    return f"('P' || CAST({key} % 200 AS VARCHAR))"


def temperature_text(ok: str = "l_orderkey", q: str = "l_quantity", ln: str = "l_linenumber") -> str:
    return (f"(CASE WHEN {ok} % 11 = 0 THEN 'room temperature' ELSE "
            f"CAST(CAST({q} AS BIGINT) AS VARCHAR) || "
            f"(CASE {ln} % 4 WHEN 0 THEN ' C' WHEN 1 THEN 'K' WHEN 2 THEN ' F' ELSE '' END) END)")


MEASUREMENT_BASE = f"""
base AS (
  SELECT {formula_of_part('l_partkey')} AS formula,
         {temperature_text()} AS temperature_text,
         CASE WHEN l_orderkey % 13 <> 0 THEN l_extendedprice END AS value,
         l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_suppkey
  FROM lineitem)"""


def classify_property(expr: str) -> str:
    return (f"(CASE WHEN lower({expr}) LIKE '%thermal conductivity%' THEN 'thermalconductivity' "
            f"WHEN lower({expr}) LIKE '%density%' THEN 'density' END)")


SOURCE_RANK = ("(CASE source WHEN 'citrine' THEN 0 WHEN 'ucsb' THEN 1 "
               "WHEN 'nist_thermoml' THEN 2 ELSE 3 END)")

MERGE_CTES = MEASUREMENT_BASE + f""",
s1 AS (SELECT formula, temperature_text AS t, value AS thermal_conductivity, 'citrine' AS source,
              l_orderkey, l_linenumber, l_suppkey
       FROM base WHERE l_returnflag = 'A' AND value IS NOT NULL),
s2 AS (SELECT formula, temperature_text AS t, value AS thermal_conductivity, 'ucsb' AS source,
              l_orderkey, l_linenumber, l_suppkey
       FROM base WHERE l_returnflag = 'N'),
long_raw AS (
  SELECT formula, temperature_text AS t, value, l_orderkey, l_linenumber, l_suppkey,
         CASE WHEN l_linenumber = 7 THEN 'Viscosity, Pa*s'
              WHEN l_linestatus = 'O' THEN 'Thermal conductivity, W/m/K'
              ELSE 'Mass density, kg/m3' END AS property,
         CASE l_suppkey % 5 WHEN 0 THEN 'Liquid' WHEN 1 THEN NULL WHEN 2 THEN 'Crystal 1'
              ELSE 'crystalline SOLID' END AS phase
  FROM base WHERE l_returnflag = 'R'),
long_f AS (
  SELECT formula, t, value, l_orderkey, l_linenumber, l_suppkey, {classify_property('property')} AS prop
  FROM long_raw WHERE coalesce(lower(phase) LIKE '%crystal%', false)),
long_ranked AS (
  SELECT formula, t, prop, value,
         row_number() OVER (PARTITION BY formula, t, prop
                            ORDER BY l_orderkey, l_linenumber, l_suppkey, value) AS rn
  FROM long_f
  WHERE prop IS NOT NULL AND value IS NOT NULL AND formula IS NOT NULL AND t IS NOT NULL),
s3 AS (
  SELECT formula, t,
         max(CASE WHEN prop = 'thermalconductivity' THEN value END) AS thermal_conductivity,
         'nist_thermoml' AS source,
         CAST(NULL AS BIGINT) AS l_orderkey, CAST(NULL AS INTEGER) AS l_linenumber,
         CAST(NULL AS BIGINT) AS l_suppkey
  FROM long_ranked WHERE rn = 1 GROUP BY formula, t),
unioned AS (
  SELECT formula, {parse_temperature('t')} AS temperature, thermal_conductivity, source,
         l_orderkey, l_linenumber, l_suppkey
  FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) x),
deduped AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY formula, temperature
                                 ORDER BY {SOURCE_RANK}, l_orderkey NULLS LAST,
                                          l_linenumber NULLS LAST, l_suppkey NULLS LAST,
                                          thermal_conductivity NULLS LAST) AS rn
    FROM unioned) y WHERE rn = 1),
merged AS (
  SELECT formula, temperature, avg(thermal_conductivity) AS thermal_conductivity,
         string_agg(DISTINCT source, ',' ORDER BY source) AS source
  FROM deduped
  WHERE formula IS NOT NULL AND temperature IS NOT NULL AND thermal_conductivity IS NOT NULL
  GROUP BY formula, temperature)"""


def formula_strings() -> str:
    items = ", ".join("NULL" if f is None else f"'{f}'" for f in FORMULAS)
    return (f"formulas AS (SELECT p_partkey, "
            f"list_extract([{items}], CAST(p_partkey % {len(FORMULAS)} AS INTEGER) + 1) AS formula "
            f"FROM part)")


def formula_valid(expr: str) -> str:
    syms = ", ".join(f"'{s}'" for s in ELEMENT_SYMBOLS)
    return (f"({expr} IS NOT NULL AND regexp_full_match({expr}, '{FORMULA_FULL_GROUPED}') AND "
            f"list_has_all([{syms}], regexp_extract_all({expr}, '{FORMULA_TOKEN}', 1)))")


def formula_elements(expr: str) -> str:
    return (f"(CASE WHEN {formula_valid(expr)} THEN "
            f"list_distinct(regexp_extract_all({expr}, '{FORMULA_TOKEN}', 1)) END)")


def classify_spacegroup(expr: str) -> str:
    n = f"TRY_CAST(trunc(TRY_CAST({expr} AS DOUBLE)) AS INTEGER)"
    whens = " ".join(f"WHEN {n} BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in CRYSTAL_SYSTEMS)
    return f"(CASE {whens} ELSE 'Unknown' END)"


ELEMENT_PROPS = """
props_raw AS (
  SELECT p_partkey AS element,
         CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size AS DOUBLE) END AS size,
         CASE WHEN p_partkey % 17 <> 0 THEN round(p_retailprice * 100) END AS price,
         CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size % 3 AS DOUBLE) END AS s_valence,
         CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size % 7 AS DOUBLE) END AS p_valence,
         CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size % 11 AS DOUBLE) END AS d_valence,
         CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size % 15 AS DOUBLE) END AS f_valence
  FROM part),
prop_means AS (
  SELECT avg(size) AS m_size, avg(price) AS m_price, avg(s_valence) AS m_s, avg(p_valence) AS m_p,
         avg(d_valence) AS m_d, avg(f_valence) AS m_f FROM props_raw),
props AS (
  SELECT element, coalesce(size, m_size) AS size, coalesce(price, m_price) AS price,
         coalesce(s_valence, m_s) AS s_valence, coalesce(p_valence, m_p) AS p_valence,
         coalesce(d_valence, m_d) AS d_valence, coalesce(f_valence, m_f) AS f_valence
  FROM props_raw, prop_means)"""

COMPOSITION = """
comp AS (SELECT l_orderkey AS row_id, l_partkey AS element, sum(l_quantity) AS amount
         FROM lineitem GROUP BY l_orderkey, l_partkey)"""


def composition_features_sql(digits: int = 6) -> str:
    r = lambda e: f"round({e}, {digits})"
    stats = []
    for p in ["size", "price"]:
        stats += [f"{r(f'min({p})')} AS minimum_{p}", f"{r(f'max({p})')} AS maximum_{p}",
                  f"{r(f'max({p}) - min({p})')} AS range_{p}",
                  f"{r(f's_{p} / q')} AS mean_{p}",
                  f"{r(f'sum(amount * abs({p} * q - s_{p})) / (q * q)')} AS avg_dev_{p}",
                  f"{r(f'min(CASE WHEN amount = mq THEN {p} END)')} AS mode_{p}"]
    norms = [f"{r('CAST(n AS DOUBLE)')} AS norm_0"] + [
        f"{r(f'pow(sum(pow(amount, {p}.0)), 1.0 / {p}) / q')} AS norm_{p}" for p in [2, 3, 5, 7, 10]]
    orbs = ["s", "p", "d", "f"]
    val = [f"{r(f'v_{o} / q')} AS avg_{o}_valence_electrons" for o in orbs]
    tot = " + ".join(f"v_{o}" for o in orbs)
    val += [f"{r(f'CASE WHEN ({tot}) <> 0 THEN v_{o} / ({tot}) END')} AS frac_{o}_valence_electrons"
            for o in orbs]
    sums = ", ".join([f"sum(amount * {p}) AS s_{p}" for p in ["size", "price"]] +
                     [f"sum(amount * {o}_valence) AS v_{o}" for o in orbs])
    return f"""WITH {COMPOSITION.strip()}, {ELEMENT_PROPS.strip()},
j AS (SELECT c.row_id, c.amount, p.* FROM comp c LEFT JOIN props p ON c.element = p.element
      WHERE c.amount > 0),
tot AS (SELECT row_id, sum(amount) AS q, max(amount) AS mq, count(*) AS n, {sums}
        FROM j GROUP BY row_id)
SELECT j.row_id, {', '.join(stats + norms + val)}
FROM j JOIN tot ON j.row_id = tot.row_id
GROUP BY j.row_id, q, mq, n, s_size, s_price, v_s, v_p, v_d, v_f"""


FEATURE_MATRIX = """
fm AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity, l_extendedprice,
              l_discount, l_tax, CAST(1.0 AS DOUBLE) AS const_one,
              CAST(1.0 AS DOUBLE) + CASE WHEN l_orderkey % 1000 = 0 THEN CAST(1e-7 AS DOUBLE)
                                         ELSE CAST(0.0 AS DOUBLE) END AS near_const,
              CASE WHEN l_linenumber = 1 THEN l_quantity END AS mostly_null,
              l_quantity * 2 + 1 AS qty_copy
       FROM lineitem)"""

DAILY_EVENTS = """
daily AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS total
          FROM events GROUP BY event_type, CAST(ts AS DATE))"""


def formula_composition_sql() -> str:
    """H6 twin: outside tokens plus group tokens times the group multiplier."""
    amt = lambda e: f"CAST(coalesce(nullif({e}, ''), '1') AS DOUBLE)"
    return f"""WITH {formula_strings()},
ok AS (SELECT p_partkey, formula FROM formulas WHERE {formula_valid('formula')}),
outside AS (SELECT p_partkey, regexp_replace(formula, '{FORMULA_GROUP}', '', 'g') AS rest FROM ok),
ot AS (SELECT p_partkey, unnest(regexp_extract_all(rest, '{FORMULA_TOKEN}', 1)) AS element,
              unnest(regexp_extract_all(rest, '{FORMULA_TOKEN}', 2)) AS a, '' AS m FROM outside),
grp AS (SELECT p_partkey, unnest(regexp_extract_all(formula, '{FORMULA_GROUP}', 1)) AS body,
               unnest(regexp_extract_all(formula, '{FORMULA_GROUP}', 2)) AS m FROM ok),
gt AS (SELECT p_partkey, unnest(regexp_extract_all(body, '{FORMULA_TOKEN}', 1)) AS element,
              unnest(regexp_extract_all(body, '{FORMULA_TOKEN}', 2)) AS a, m FROM grp),
tok AS (SELECT * FROM ot UNION ALL SELECT * FROM gt)
SELECT p_partkey, element, sum({amt('a')} * {amt('m')}) AS amount
FROM tok WHERE element <> '' GROUP BY p_partkey, element"""


def featurized_sql(digits: int = 6) -> str:
    """I5 twin: part rows -> composition features per distinct formula (symbol
    element table, mean-imputed) -> tiered lookup in candidates keyed by
    formula -> chemistry and crystal classes -> density."""
    r = lambda e: f"round({e}, {digits})"
    syms = ", ".join(f"'{s}'" for s in ELEMENT_SYMBOLS)
    fl = ", ".join("NULL" if f is None else f"'{f}'" for f in FORMULAS)
    amt = lambda e: f"CAST(coalesce(nullif({e}, ''), '1') AS DOUBLE)"
    props = ["size", "price"]
    orbs = ["s", "p", "d", "f"]
    stats = []
    for p in props:
        stats += [f"{r(f'min({p})')} AS MagpieData_minimum_{p}", f"{r(f'max({p})')} AS MagpieData_maximum_{p}",
                  f"{r(f'max({p}) - min({p})')} AS MagpieData_range_{p}",
                  f"{r(f's_{p} / q')} AS MagpieData_mean_{p}",
                  f"{r(f'sum(amount * abs({p} * q - s_{p})) / (q * q)')} AS MagpieData_avg_dev_{p}",
                  f"{r(f'min(CASE WHEN amount = mq THEN {p} END)')} AS MagpieData_mode_{p}"]
    norms = [f'{r("CAST(n AS DOUBLE)")} AS "0-norm"'] + [
        f'{r(f"pow(sum(pow(amount, {k}.0)), 1.0 / {k}) / q")} AS "{k}-norm"' for k in [2, 3, 5, 7, 10]]
    tot = " + ".join(f"v_{o}" for o in orbs)
    val = [f"{r(f'v_{o} / q')} AS avg_{o}_valence_electrons" for o in orbs]
    val += [f"{r(f'CASE WHEN ({tot}) <> 0 THEN v_{o} / ({tot}) END')} AS frac_{o}_valence_electrons"
            for o in orbs]
    sums = ", ".join([f"sum(amount * {p}) AS s_{p}" for p in props] +
                     [f"sum(amount * {o}_valence) AS v_{o}" for o in orbs])
    feat_cols = [c.split(" AS ")[-1] for c in stats + norms + val]
    raw = ELEMENT_PROPS.strip()
    raw_only = raw[:raw.index("prop_means AS")].rstrip().rstrip(",")
    means_props = raw[raw.index("prop_means AS"):].replace(
        "avg(d_valence) AS m_d, avg(f_valence) AS m_f FROM props_raw",
        "avg(d_valence) AS m_d, avg(f_valence) AS m_f FROM sym").replace(
        "FROM props_raw, prop_means", "FROM sym, prop_means")
    return f"""WITH {raw_only},
sym AS (SELECT list_extract([{syms}], CAST(element % {len(ELEMENT_SYMBOLS)} AS INTEGER) + 1) AS element,
               max(size) AS size, max(price) AS price, max(s_valence) AS s_valence, max(p_valence) AS p_valence,
               max(d_valence) AS d_valence, max(f_valence) AS f_valence
        FROM props_raw GROUP BY element % {len(ELEMENT_SYMBOLS)}),
{means_props},
rq AS (SELECT p_partkey, list_extract([{fl}], CAST(p_partkey % {len(FORMULAS)} AS INTEGER) + 1) AS formula,
              CAST(p_size * 10 AS DOUBLE) AS temperature, CAST(p_size AS DOUBLE) AS user_space_group_number
       FROM part),
ok AS (SELECT DISTINCT formula FROM rq WHERE {formula_valid('formula')}),
outside AS (SELECT formula, regexp_replace(formula, '{FORMULA_GROUP}', '', 'g') AS rest FROM ok),
ot AS (SELECT formula, unnest(regexp_extract_all(rest, '{FORMULA_TOKEN}', 1)) AS element,
              unnest(regexp_extract_all(rest, '{FORMULA_TOKEN}', 2)) AS a, '' AS m FROM outside),
grp AS (SELECT formula, unnest(regexp_extract_all(formula, '{FORMULA_GROUP}', 1)) AS body,
               unnest(regexp_extract_all(formula, '{FORMULA_GROUP}', 2)) AS m FROM ok),
gt AS (SELECT formula, unnest(regexp_extract_all(body, '{FORMULA_TOKEN}', 1)) AS element,
              unnest(regexp_extract_all(body, '{FORMULA_TOKEN}', 2)) AS a, m FROM grp),
comp AS (SELECT formula, element, sum({amt('a')} * {amt('m')}) AS amount
         FROM (SELECT * FROM ot UNION ALL SELECT * FROM gt) t WHERE element <> '' GROUP BY formula, element),
j AS (SELECT c.formula, c.amount, p.* EXCLUDE (element) FROM comp c LEFT JOIN props p ON c.element = p.element
      WHERE c.amount > 0),
tot AS (SELECT formula, sum(amount) AS q, max(amount) AS mq, count(*) AS n, {sums} FROM j GROUP BY formula),
feats AS (SELECT j.formula, {', '.join(stats + norms + val)}
          FROM j JOIN tot ON j.formula = tot.formula
          GROUP BY j.formula, q, mq, n, s_size, s_price, v_s, v_p, v_d, v_f),
cand AS (SELECT list_extract([{fl}], CAST(l_orderkey % {len(FORMULAS)} AS INTEGER) + 1) AS cformula,
                l_suppkey % 50 AS sg, CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS energy,
                CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
                CAST(l_suppkey AS VARCHAR) AS material_id,
                l_quantity, l_tax, l_discount, l_linestatus, l_orderkey, l_linenumber, l_suppkey FROM lineitem),
pairs AS (
  SELECT r.p_partkey, c.*, row_number() OVER (
           PARTITION BY r.p_partkey
           ORDER BY coalesce(c.sg = r.user_space_group_number, false) DESC, c.energy NULLS LAST,
                    c.l_orderkey, c.l_linenumber, c.l_suppkey, c.l_quantity, c.l_tax,
                    c.l_discount, c.l_linestatus) AS rn
  FROM rq r LEFT JOIN cand c ON r.formula = c.cformula),
mp AS (SELECT p_partkey, cformula AS mp_formula, material_id, l_quantity AS mp_density, l_tax AS mp_volume,
              l_discount AS mp_band_gap, l_linestatus = 'F' AS mp_is_metal, energy AS mp_energy_above_hull,
              CASE WHEN cformula IS NULL THEN NULL ELSE {classify_spacegroup('sg')} END AS crystal_system,
              sg AS mp_spacegroup_number, sg
       FROM pairs WHERE rn = 1)
SELECT rq.p_partkey, rq.formula, rq.temperature, rq.user_space_group_number,
       {', '.join('f.' + c.strip('"') if not c.startswith('"') else 'f.' + c for c in feat_cols)},
       mp.mp_formula, mp.material_id, {r('mp.mp_density')} AS mp_density, {r('mp.mp_volume')} AS mp_volume,
       {r('mp.mp_band_gap')} AS mp_band_gap, mp.mp_is_metal,
       {r('mp.mp_energy_above_hull')} AS mp_energy_above_hull, mp.crystal_system, mp.mp_spacegroup_number,
       CASE WHEN mp.mp_formula IS NOT NULL THEN coalesce(mp.sg = rq.user_space_group_number, false) END
         AS mp_spacegroup_match_user,
       {_chemistry_case('rq.formula')} AS chemistry,
       {classify_spacegroup('rq.user_space_group_number')} AS crystal_structure,
       {r('mp.mp_density')} AS density
FROM rq LEFT JOIN feats f ON rq.formula = f.formula LEFT JOIN mp ON rq.p_partkey = mp.p_partkey"""


def _chemistry_case(expr: str) -> str:
    els = formula_elements(expr)
    return f"""(CASE WHEN {els} IS NULL THEN 'Unknown'
       WHEN len({els}) = 1 THEN 'Elemental'
       WHEN list_contains({els}, 'O') THEN 'Oxide'
       WHEN list_has_any({els}, ['S', 'Se', 'Te']) THEN 'Chalcogenide'
       WHEN list_has_any({els}, ['F', 'Cl', 'Br', 'I']) THEN 'Halide'
       WHEN list_contains({els}, 'N') THEN 'Nitride'
       WHEN list_contains({els}, 'C') THEN 'Carbide'
       WHEN list_contains({els}, 'B') THEN 'Boride'
       WHEN list_has_any({els}, ['P', 'As', 'Sb', 'Bi']) THEN 'Pnictide'
       WHEN list_contains({els}, 'H') THEN 'Hydride'
       ELSE 'Intermetallic/Alloy' END)"""
