"""Secret scan with a randomness test battery (operator 6), DataFrame functions only.

Base kinds are patterns (``assign``, ``access``, ``hex``); their matches are
leftmost and non-overlapping per kind, and short ones are dropped after
matching. The battery adds kind ``random``: runs of token characters that
touch no base span and look drawn uniformly from the alphabet of their
inferred encoding.

The battery, for each candidate of n characters over an alphabet of A codes:
* chi-squared test of the code counts against uniformity (upper tail, by the
  cube-root normal form),
* runs test of the codes above and below the middle of the alphabet,
* lag-1 serial correlation of the codes,
combined by their least p-value (Sidak's form). Structured strings give p near
0, random ones a near uniform p. False discoveries are controlled per stratum of
encoding and length class over the whole corpus: the cut is the smallest, from 0
on, at which the p-values accepted show no structured strings, that is, at no bound up
to one half do those below it exceed what those above it tell for random strings by more than
``fdr`` of all, beyond chance. A stratum with few strings is judged together with the
neighbouring length classes. The strata's histograms are one small grouped count.

Work per document is expressions over the row; nothing is shuffled but the
histogram. Positions are code points, ends exclusive.

Defined results: null text is empty and has no spans; null and repeated ids are
kept, row by row; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonon.llm.common import fresh, store

# Fixed values of the base patterns; group 1 is the value of an assignment.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"        # runs are maximal, so short ones need not be matched at all
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS = 6, 20

# Candidates of the battery: runs with a digit; one in front of the run would be part of it.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
ENCODINGS = (   # name, what the body must match, what it must hold, alphabet in code order
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", ("[0-9]", "[A-Fa-f]"), "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", ("[2-7]", "[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", ("[0-9]", "[A-Za-z]"),
     "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+$", ("[0-9]", "[A-Z]", "[a-z]"),
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", ("[0-9]", "[A-Z]", "[a-z]"),
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
FOLDED = ("hex", "base36")     # encodings in either case
MIN_BITS = 80.0
# Cuts tried and bounds of the histogram; structured strings crowd below the first ones.
EDGES = (0.0, 0.001, 0.01, *(b / 20 for b in range(1, 20)))
CHANCE = 0.005                 # an excess of low p-values less likely than this is not chance
SMALL = 20                     # a stratum with fewer candidates borrows from its neighbours
MAX_CLASS = 6                  # length classes: 20-31, 32-47, 48-63, 64-95, ... characters
SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"
CAND = "array<struct<start:bigint,stop:bigint,enc:string,class:int,p:double>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value`` (evaluated once)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prefix_sums(array: str) -> str:
    """SQL for the inclusive prefix sums of a non-empty bigint array, in blocks of 64."""
    add = "0L, (s, y) -> s + y)"
    blocks = (f"transform(sequence(0, (size(a) - 1) div 64), "
              f"q -> aggregate(slice(a, cast(q * 64 + 1 as int), 64), {add})")
    inner = _let("slice(a, cast(q * 64 + 1 as int), 64)", "b",
                 f"transform(b, (y, i) -> off + aggregate(slice(b, 1, i + 1), {add})")
    offsets = f"transform(t, (y, q) -> aggregate(slice(t, 1, q), {add})"
    return _let(array, "a", _let(blocks, "t", _let(
        offsets, "o", f"flatten(transform(o, (off, q) -> {inner}))")))


def _found(text: str, pattern: str, group: int) -> str:
    """SQL: array of (start, stop, value of ``group``) of all matches, empty if there is none."""
    lit = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    zipped = (f"zip_with(split({text}, {lit}, -1), regexp_extract_all({text}, {lit}, 0), "
              f"(p, m) -> named_struct('gap', cast(length(p) as bigint), "
              f"'len', cast(length(m) as bigint)))")
    ends = _prefix_sums("transform(z, x -> x.gap + coalesce(x.len, 0L))")
    spans = (f"zip_with(filter(zip_with(z, {ends}, (x, e) -> named_struct("
             f"'start', e - x.len, 'stop', e)), x -> x.start IS NOT NULL), "
             f"regexp_extract_all({text}, {lit}, {group}), "
             f"(x, v) -> named_struct('start', x.start, 'stop', x.stop, 'value', v))")
    none = "cast(array() as array<struct<start:bigint,stop:bigint,value:string>>)"
    return f"CASE WHEN {text} RLIKE {lit} THEN {_let(zipped, 'z', spans)} ELSE {none} END"


def _normal_tail(z: str) -> str:
    """SQL: upper tail of the standard normal (logistic form, error below 2e-4)."""
    return f"(1 / (1 + exp(least(700D, 1.5976 * ({z}) + 0.070566 * power(({z}), 3)))))"


def _battery(body: str, alphabet: str, folded: bool) -> str:
    """SQL: combined p-value of a candidate's characters."""
    size = len(alphabet)
    shown = f"lower({body})" if folded else body
    codes = (f"transform(split({shown}, ''), c -> cast(instr('{alphabet}', c) - 1 as double))")
    middle = (size - 1) / 2
    chi = (f"(aggregate(transform(array_distinct(v), d -> power(size(filter(v, c -> c = d)), 2)), "
           f"0D, (s, y) -> s + y) * {size}D / n - n)")
    df = f"{size - 1}D"
    # cube root of chi-squared per degree of freedom is near normal
    p_chi = _normal_tail(f"(power(greatest({chi}, 0D) / {df}, 1D/3) - (1 - 2 / (9 * {df}))) "
                         f"/ sqrt(2 / (9 * {df}))")
    runs = ("(1D + aggregate(zip_with(slice(v, 2, size(v) - 1), slice(v, 1, size(v) - 1), "
            f"(x, y) -> CASE WHEN (x > {middle}) <> (y > {middle}) THEN 1D ELSE 0D END), "
            "0D, (s, y) -> s + y))")
    high = f"cast(size(filter(v, c -> c > {middle})) as double)"
    p_runs = _let(
        f"named_struct('r', {runs}, 'a', {high}, 'b', n - {high})", "u",
        "CASE WHEN u.a = 0 OR u.b = 0 THEN 0D ELSE "
        + _let("2 * u.a * u.b", "w", "2 * " + _normal_tail(
            "abs(u.r - (w / n + 1)) / sqrt(greatest(w * (w - n) / (n * n * (n - 1)), 1e-9D))")) + " END")
    serial = _let(
        "aggregate(v, 0D, (s, y) -> s + y) / n", "mean",
        _let("named_struct('c', aggregate(zip_with(slice(v, 2, size(v) - 1), "
             "slice(v, 1, size(v) - 1), (x, y) -> (x - mean) * (y - mean)), 0D, (s, y) -> s + y), "
             "'d', aggregate(v, 0D, (s, y) -> s + (y - mean) * (y - mean)))", "g",
             "CASE WHEN g.d = 0 THEN 0D ELSE 2 * " + _normal_tail(
                 "abs(g.c / g.d + 1 / n) * sqrt(n)") + " END"))
    return _let(codes, "v", _let("cast(size(v) as double)", "n",
                                 f"1 - power(1 - least(1D, {p_chi}, {p_runs}, {serial}), 3)"))


def _encoding(value: str) -> str:
    """SQL: (enc, p) of a candidate, null where no encoding fits."""
    body = f"regexp_replace({value}, '=+$', '')"
    cases = []
    for name, shape, needs, alphabet in ENCODINGS:
        fits = " AND ".join([f"w RLIKE '{shape}'"] + [f"w RLIKE '{need}'" for need in needs])
        bits = len(alphabet).bit_length() - 1
        cases.append(f"WHEN {fits} THEN CASE WHEN length(w) * {bits} >= {MIN_BITS} THEN "
                     f"named_struct('enc', '{name}', 'p', "
                     f"{_battery('w', alphabet, name in FOLDED)}) END")
    return _let(body, "w", "CASE " + " ".join(cases) + " END")


def scan(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, str, str]:
    """``docs`` with the base spans and the tested candidates of every text.

    Returns the frame and the names of the added columns: text (null as
    empty), base spans, candidates.
    """
    text, base, cands = fresh(docs, "text", "base", "cands")
    short = F.coalesce(F.col(text_col), F.lit(""))
    assign = (f"transform(filter({_found(text, ASSIGN, 1)}, x -> length(x.value) >= {MIN_VALUE}), "
              "x -> named_struct('start', x.start, 'rank', 0, 'stop', x.stop, 'kind', 'assign'))")
    access = (f"transform(filter({_found(text, ACCESS, 0)}, x -> x.stop - x.start >= {MIN_ACCESS}),"
              " x -> named_struct('start', x.start, 'rank', 1, 'stop', x.stop, 'kind', 'access'))")
    hexes = (f"transform({_found(text, HEX, 0)}, x -> named_struct('start', x.start, 'rank', 2, "
             "'stop', x.stop, 'kind', 'hex'))")
    tested = (f"transform({_found(text, CANDIDATE, 0)}, x -> named_struct('start', x.start, "
              f"'stop', x.stop, 'e', {_encoding('x.value')}))")
    free = _let(base, "bb", f"filter({tested}, x -> x.e IS NOT NULL AND NOT exists(bb, "
                            "b -> b.start < x.stop AND x.start < b.stop))")
    klass = (f"least({MAX_CLASS}, cast(floor(2 * log2((x.stop - x.start) / 16D)) as int))")
    out = docs.withColumn(text, short).withColumn(
        base, F.expr(f"array_sort(concat({assign}, {access}, {hexes}))").cast(SPAN))
    out = out.withColumn(cands, F.expr(
        f"transform({free}, x -> named_struct('start', x.start, 'stop', x.stop, 'enc', x.e.enc, "
        f"'class', {klass}, 'p', x.e.p))").cast(CAND))
    return out, text, base, cands


def _at_least(k: int, n: int, q: float) -> float:
    """Probability of ``k`` or more among ``n`` draws of probability ``q``."""
    if n * q * (1 - q) > 1000:
        return 0.5 * math.erfc((k - 0.5 - n * q) / math.sqrt(2 * n * q * (1 - q)))
    total, ways = 0.0, math.lgamma(n + 1)
    for i in range(k, n + 1):
        term = math.exp(ways - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                        + i * math.log(q) + (n - i) * math.log1p(-q))
        total += term
        if i > n * q and term < 1e-12 * total:
            break
    return total


def least_accepted(counts: list[int], fdr: float) -> float | None:
    """Least edge from which on the counts by ``EDGES`` look random; None if nothing is left."""
    for k, e in enumerate(EDGES):
        accepted = sum(counts[k:])
        if not accepted:
            return None
        for j in range(k + 1, len(EDGES)):
            bound = EDGES[j]
            if bound > max(0.5, e):
                continue
            low = sum(counts[k:j])
            q = (bound - e) / (1 - e)
            structured = low - (accepted - low) * q / (1 - q)
            if structured > fdr * accepted + 1e-9 and _at_least(low, accepted, q) < CHANCE:
                break
        else:
            return e
    return None


def cuts(scanned: DataFrame, cands: str, fdr: float = 0.05) -> dict[tuple[str, int], float]:
    """Least p-value accepted in each stratum, from the corpus-wide histogram."""
    edges = "array(" + ", ".join(f"{e!r}D" for e in EDGES) + ")"
    c = scanned.select(F.explode(cands).alias("c")).select(
        "c.enc", "c.class", F.expr(f"greatest(0, size(filter({edges}, e -> e <= c.p)) - 1)"
                                   ).alias("bin"))
    rows = c.groupBy("enc", "class", "bin").agg(F.count("*").alias("n")).collect()
    strata: dict[tuple[str, int], list[int]] = {}
    for r in rows:       # at most encodings x length classes x bins
        strata.setdefault((r["enc"], r["class"]), [0] * len(EDGES))[int(r["bin"])] = r["n"]
    out = {}
    for (enc, klass), own in strata.items():
        counts, reach = own, 0
        while sum(counts) < SMALL and reach < MAX_CLASS:
            reach += 1
            for near in (klass - reach, klass + reach):
                more = strata.get((enc, near), [0] * len(EDGES))
                counts = [x + y for x, y in zip(counts, more, strict=True)]
        cut = least_accepted(counts, fdr)
        if cut is not None:
            out[enc, klass] = cut
    return out


def _all_spans(base: str, cands: str, accept: dict[tuple[str, int], float]) -> str:
    """SQL: base spans and accepted candidates, sorted."""
    if not accept:
        return base
    tests = " OR ".join(f"(c.enc = '{enc}' AND c.class = {k} AND c.p >= {t!r}D)"
                        for (enc, k), t in sorted(accept.items()))
    extra = (f"transform(filter({cands}, c -> {tests}), c -> named_struct('start', c.start, "
             "'rank', 3, 'stop', c.stop, 'kind', 'random'))")
    return f"array_sort(concat({base}, cast({extra} as {SPAN})))"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 fdr: float = 0.05) -> DataFrame:
    """(doc_id, base, spans) per row: arrays of (start, rank, stop, kind). Texts are read once."""
    found, _, base, cands = scan(docs.select(F.col(id_col).alias("doc_id"),
                                             F.col(text_col).alias("text")))
    kept = store(found.select("doc_id", F.col(base).alias("base"), F.col(cands).alias("cands")),
                 "secrets")
    accept = cuts(kept, "cands", fdr)
    return kept.select("doc_id", "base", F.expr(_all_spans("base", "cands", accept)).alias("spans"))


def joined(spans: str) -> F.Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.stop)),"
                  " ',')")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]",
           fdr: float = 0.05) -> DataFrame:
    """``docs`` with every span of every text replaced by ``mask`` (overlapping spans once)."""
    found, text, base, cands = scan(docs, text_col)
    accept = cuts(found.select(cands), cands, fdr)
    spans = fresh(found, "spans")[0]
    found = found.withColumn(spans, F.expr(_all_spans(base, cands, accept)))
    # overlapping spans become one
    last = "element_at(acc, -1)"
    heads = (f"aggregate({spans}, cast(array() as array<struct<start:bigint,stop:bigint>>), "
             f"(acc, x) -> CASE WHEN size(acc) > 0 AND x.start < {last}.stop THEN concat(slice(acc, "
             f"1, size(acc) - 1), array(named_struct('start', {last}.start, 'stop', greatest("
             f"{last}.stop, x.stop)))) ELSE concat(acc, array(named_struct('start', x.start, "
             "'stop', x.stop))) END)")
    gaps = (f"concat(transform(g, (x, i) -> concat(substring({text}, cast(CASE WHEN i = 0 THEN 1 "
            "ELSE g[i - 1].stop + 1 END as int), cast(x.start - CASE WHEN i = 0 THEN 0L ELSE "
            f"g[i - 1].stop END as int)), '{mask}')), array(substring({text}, "
            "cast(element_at(g, -1).stop + 1 as int))))")
    clean = F.expr(f"CASE WHEN size({spans}) = 0 THEN `{text_col}` ELSE "
                   + _let(heads, "g", f"array_join({gaps}, '')") + " END")
    return found.withColumn(text_col, clean).select(*docs.columns)
