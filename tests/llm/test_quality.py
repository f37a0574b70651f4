"""Quality rules: counts against brute force, the covering against planted rules."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from phonon.llm import quality_rules as qr
from phonon.llm import queries
from tests.llm.corpus_cases import SCHEMA, none, odd, odd_rows  # noqa: F401

COLUMNS = ["doc_id", *qr.COUNTS, "base_failed", "kept", "rule"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    under = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    n, repeated = len(words), len(under)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated,
            n < 50 or 100 * repeated > 50 * n)


def texts(seed):
    rng = np.random.default_rng(seed)
    pool = ["a", "b", "c", "A\u00c9", "x#", "|", "\U0001F600", "w" * 30]
    out = []
    for _ in range(120):
        words = rng.choice(pool[:int(rng.integers(1, len(pool) + 1))], int(rng.integers(0, 90)))
        out.append("".join(w + str(rng.choice([" ", "  ", "\n", "\n\n", "\t", "\x0b\x0c\r"])) for w in words))
    return [*out, " lead", "\n\n", "\x1c a \x85 b\xa0c \u2003", "a b c a b c", "a a a a", "a a a", "a b", "x" * 100_000,
            "long " * 30_000, " ".join(f"w{i}" for i in range(30_000)) + " w1 w2 w3"]


def test_counts_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(0))] + [(None, None), (7, None), (None, "a b c"), (7, "x")]
    got = qr.statistics(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select(
        *COLUMNS[:-2]).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute(t)) for i, t in rows)


def test_whole_table_and_planted_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_quality_rules"](spark, folder)
    assert got.columns == COLUMNS
    rows = {r.doc_id: r for r in got.collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert {i: tuple(r)[1:7] for i, r in rows.items()} == {d.doc_id: brute(d.text) for d in docs}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(labels[i], r.kept) for i, r in rows.items() if i in labels and not r.base_failed]
    low = [kept for q, kept in judged if q == 0]
    good = [kept for q, kept in judged if q == 1]
    assert sum(good) >= 0.99 * len(good) and sum(low) <= 0.4 * len(low)
    assert all(r.kept == (not r.base_failed and r.rule is None) for r in rows.values())


def labelled(spark, n, low, seed=0):
    """Rows of statistics with a label by ``low(symbols, calls, words)``."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words, symbols, calls = (int(v) for v in (rng.integers(50, 300), rng.integers(0, 100), rng.integers(0, 100)))
        rows.append((i, words, 5 * words, symbols, 0, 0, 3, 0, calls, 4, words, low(symbols / words, calls / words, words)))
    return spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                 "n_repeat_words long, n_upper long, n_digits long, n_calls long, n_lines long, "
                                 "n_distinct long, low int")


def test_covering_finds_planted_conjunctions(spark):
    def low(symbols, calls, words):
        return int((symbols > 0.5 and calls > 0.3) or words < 70)

    rules = qr.fit_rules(labelled(spark, 4000, low))
    assert 2 <= len(rules.rules) <= 6 and all(len(r) <= 4 for r in rules.rules)
    fresh = labelled(spark, 2000, low, seed=1).select("low", rules.expression().alias("rule")).collect()
    assert np.mean([r.low == (r.rule is not None) for r in fresh]) > 0.97
    assert {c.name for r in rules.rules for c in r} <= {"symbols_per_word", "calls_per_word", "words"}


def test_pruning_refuses_noise(spark):
    rng = np.random.default_rng(2)
    assert qr.fit_rules(labelled(spark, 1500, lambda *_: int(rng.integers(2)))).rules == []


def test_first_rule_decides_and_text_is_readable(spark):
    a, b = qr.Condition("words", True, 70.0), qr.Condition("symbols_per_word", False, 0.5)
    rows = labelled(spark, 300, lambda *_: 0)
    got = rows.select("n_words", "n_symbols", qr.DecisionList([[a], [b, a], [b]]).expression().alias("r")).collect()
    for r in got:
        want = "words < 70" if r.n_words < 70 else "symbols_per_word >= 0.5" if r.n_symbols >= 0.5 * r.n_words else None
        assert r.r == want


def test_best_condition_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, width = 60, 3
        bins, y = rng.integers(0, 6, (n, width)), rng.integers(0, 2, n)
        counts = Counter((f, int(b[f]), int(c)) for b, c in zip(bins, y, strict=True) for f in range(width))
        got = qr.best_condition(counts, [[0.0] * 5] * width)
        p0, n0 = int(y.sum()), int(n - y.sum())
        best = max((qr.foil_gain(int(y[m].sum()), int((1 - y[m]).sum()), p0, n0)
                    for f in range(width) for b in range(1, 6) for m in (bins[:, f] >= b, bins[:, f] < b)), default=0)
        assert math.isclose(got[0] if got else 0.0, max(best, 0.0), abs_tol=1e-9)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 0), (1, 1, 0), (None, 0, 0), (2, None, 0), (3, 5, 0)]])
def test_odd_rows_and_labels(spark, odd, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clash = odd.selectExpr("*", "1 AS kept", "2 AS words", "3 AS n_words", "4 AS `a.b`")
    got = qr.judge(clash, marks).collect()
    assert Counter(tuple(r) for r in got) == Counter(
        (i, *(c := brute(t)), not c[-1], None) for i, t, *_ in odd_rows())


def test_empty_table(spark, none):
    marks = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert qr.judge(none, marks).count() == 0
