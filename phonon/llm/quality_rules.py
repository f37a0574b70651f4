"""Quality rules as a learned decision list (operator 11), DataFrame functions only.

Sequential covering: a rule is a conjunction of thresholds on statistics of the
text. It is grown on two thirds of the labelled rows, condition by condition by
the gain in information about low quality, pruned on the other third, and kept
while it is precise there; the rows it covers are set aside and the next rule
is grown. The ordered rules become one Spark conditional expression
(``DecisionList.expression``) that names the first rule that holds.

How it runs
-----------
* Statistics are expressions of one row: no shuffle. Words are split once. A
  repeated window of three words is looked for in two steps: if the windows'
  hashes are all distinct there is none; else (hash, place) pairs are sorted
  and the words under windows with an equal neighbour are counted, so a text
  of n words costs n log n whatever it repeats.
* The statistics of all documents are stored once, as small rows; labels meet
  them in one join. The fit reads at most about ``fit_rows`` labelled rows of
  each class (a stated bound, drawn by a hash of the id), as bins between
  candidate thresholds (percentiles of both classes).
* Each step of the covering is one aggregate over these bins, whose result
  (statistics x bins x classes counts) has a fixed size. Only that and the
  rules reach the driver.

Defined results: a null text has no words and fails the base rule, like every
text of fewer than 50 words. Texts are read whole, however long. Null ids get a
verdict but no label; contradictory or null labels are not learned from;
repeated rows are judged alike. Without labels of both classes there is no
rule, and only the base rule drops. Ties between thresholds go to the one that
covers fewer rows. Empty tables give empty results. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonon.llm.common import store

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
# Fixed values of the base rule
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50                # percent of words in repeated windows
WINDOW = 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts..., base_failed) and further counts of every whole text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    trimmed = F.btrim("t", F.lit(BLANKS))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    words = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>"))
                            .otherwise(F.split(trimmed, BLANK_RUN)))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    windows = F.when(F.size("words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])))
    counted = words.select(
        "doc_id", "words", lines.alias("lines"), windows.alias("windows"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("t", F.lit("[!?]")).cast("long").alias("n_calls"))
    # windows that occur again: pairs of hash and place in order, kept beside an equal neighbour
    again = F.coalesce(F.size(F.array_distinct("windows")) < F.size("windows"), F.lit(False))
    sizes = counted.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_upper", "n_digits", "n_calls",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.when(again, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
               ).alias("pairs"))
    beside = sizes.withColumn("places", F.sort_array(F.transform(F.filter(
        "pairs", lambda x, k: x["h"].eqNullSafe(F.get("pairs", k - 1)["h"])
        | x["h"].eqNullSafe(F.get("pairs", k + 1)["h"])), lambda x: x["i"])))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"),
                                i.alias("last")), lambda acc: acc["n"])
    done = beside.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return done.select("doc_id", *COUNTS, "n_upper", "n_digits", "n_calls", "n_lines", "n_distinct",
                       failed.alias("base_failed"))


def shares() -> dict[str, Column]:
    """What rules may look at, as expressions of ``statistics``."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "calls_per_word": F.col("n_calls") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "words_per_line": F.col("n_words") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct") / words,
    }


@dataclass(frozen=True)
class Condition:
    """``name`` at least (or, if ``below``, less than) ``value``."""

    name: str
    below: bool
    value: float

    def column(self) -> Column:
        x = shares()[self.name]
        return x < F.lit(self.value) if self.below else x >= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.name} {'<' if self.below else '>='} {self.value:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds decides."""

    rules: list[list[Condition]] = field(default_factory=list)

    def expression(self) -> Column:
        """The first rule that holds, as text; null if none does."""
        out = None
        for rule in self.rules:
            holds = rule[0].column()
            for c in rule[1:]:
                holds = holds & c.column()
            name = F.lit(" and ".join(map(str, rule)))
            out = F.when(holds, name) if out is None else out.when(holds, name)
        return F.lit(None).cast("string") if out is None else out


def foil_gain(p: int, n: int, p0: int, n0: int) -> float:
    """Bits won on the covered positives by going from (p0, n0) to (p, n) covered rows."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def best_condition(counts: dict[tuple[int, int, int], int], edges: list[list[float]]
                   ) -> tuple[float, int, bool, int] | None:
    """(gain, statistic, below, bin) of the best threshold, from counts by (statistic, bin, class)."""
    best = None
    for f, cuts in enumerate(edges):
        per = [[counts.get((f, b, y), 0) for b in range(len(cuts) + 1)] for y in (0, 1)]
        n0, p0 = sum(per[0]), sum(per[1])
        if not p0:
            continue
        n, p = n0, p0
        for b in range(1, len(cuts) + 1):
            n, p = n - per[0][b - 1], p - per[1][b - 1]          # at least bin b
            for below, (cn, cp) in ((False, (n, p)), (True, (n0 - n, p0 - p))):
                found = (foil_gain(cp, cn, p0, n0), -(cp + cn), f, below, b)
                if found[0] > 1e-9 and (best is None or found[:2] > best[:2]):
                    best = found
    return None if best is None else (best[0], *best[2:])


def fit_rules(labelled: DataFrame, label_col: str = "low", fit_rows: int = 50_000, cuts: int = 64,
              most_rules: int = 20, most_conditions: int = 4, least_precision: float = 0.95,
              least_covered: int = 3) -> DecisionList:
    """Decision list for ``label_col`` (1: low quality, 0: good) from rows of ``statistics``.

    At most about ``fit_rows`` rows of each class are read, drawn by a hash of the id. A rule is kept
    while at least ``least_precision`` of the held-back rows it covers, and ``least_covered`` of
    them, are of low quality.
    """
    names = list(shares())
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(label_col).cast("int").alias("y"), F.xxhash64("doc_id", F.lit(3)).alias("h"),
        F.array(*shares().values()).alias("v"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return DecisionList()
    draw = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("y") == 1, min(1.0, fit_rows / sizes[1])).otherwise(min(1.0, fit_rows / sizes[0]))
    sample = rows.where(draw < share)
    at = F.array(*[F.lit((k + 0.5) / cuts) for k in range(cuts)])
    found = sample.groupBy("y").agg(*[F.percentile_approx(F.col("v")[k], at, 10_000).alias(f"e{k}")
                                      for k in range(len(names))]).collect()
    edges = [sorted({float(x) for r in found for x in r[f"e{k}"]}) for k in range(len(names))]

    def bin_of(k: int) -> Column:
        return F.size(F.filter(F.array(*[F.lit(e) for e in edges[k]]), lambda e: e <= F.col("v")[k]))

    table = store(sample.select("y", (F.pmod(F.shiftright("h", 32), F.lit(3)) < 2).alias("grow"),
                                F.array(*[bin_of(k) for k in range(len(names))]).alias("b")), "rule-rows")

    def holds(c: tuple[int, bool, int]) -> Column:
        f, below, b = c
        return F.col("b")[f] < b if below else F.col("b")[f] >= b

    def all_of(conditions: list) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & holds(c)
        return out

    rules: list[list[tuple[int, bool, int]]] = []
    left = table
    while len(rules) < most_rules:
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < most_conditions:
            got = (left.where(F.col("grow") & all_of(rule)).select("y", F.posexplode("b").alias("f", "bin"))
                   .groupBy("f", "bin", "y").agg(F.count("*").alias("n")).collect())
            counts = {(r["f"], r["bin"], r["y"]): r["n"] for r in got}
            if not any(y == 0 for _, _, y in counts):
                break
            best = best_condition(counts, edges)
            if best is None:
                break
            rule.append(best[1:])
        if not rule:
            break
        held = left.where(~F.col("grow")).agg(*[
            F.coalesce(F.sum(F.when(all_of(rule[:k]) & (F.col("y") == y), 1)), F.lit(0)).alias(f"n{k}_{y}")
            for k in range(1, len(rule) + 1) for y in (0, 1)]).first()
        worth = []
        for k in range(1, len(rule) + 1):
            n, p = held[f"n{k}_0"], held[f"n{k}_1"]
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        _, k, p, n = max(worth)
        if p < least_covered or p < least_precision * (p + n):
            break
        rules.append(rule[:-k])
        left = left.where(~all_of(rules[-1]))
    return DecisionList([[Condition(names[f], below, edges[f][b - 1]) for f, below, b in rule] for rule in rules])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", **settings) -> DataFrame:
    """(doc_id, counts..., base_failed, kept, rule) of every document; ``labels`` has (doc_id, quality 0
    or 1). ``rule`` names the learned rule that holds, also where the base rule has failed."""
    stats = store(statistics(docs, id_col, text_col), "rule-stats")
    known = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("q"))
             .where("doc_id IS NOT NULL AND q IN (0, 1)").groupBy("doc_id")
             .agg(F.min("q").alias("q"), F.max("q").alias("most")).where("q = most"))
    labelled = (stats.where("NOT base_failed").join(known, "doc_id")
                .select(*stats.columns, (F.lit(1) - F.col("q")).alias("low")))
    rules = fit_rules(labelled, **settings)
    rule = rules.expression()          # one conditional expression over the stored statistics
    return stats.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & rule.isNull()).alias("kept"),
                        rule.alias("rule"))
