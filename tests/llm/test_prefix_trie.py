"""The conversation trie against a brute-force trie in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonon.llm import prefix_trie as pt
from phonon.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, borrow=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, digest(role, text), (role, text)))
    convs = {c: [t[-1] for t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrow else 0
        new = convs.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
        for d in range(len(new) + 1):
            members[tuple(new[:d])].append(c)
        ends[tuple(new)].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        saved[key] = sum(saved[k] for k in children[key]) + (
            (len(members[key]) - 1) * len(key[-1][1]) if key else 0)
    return sorted((min(m), len(key), min(members[key[:-1]]) if key else -1, len(m), len(children[key]),
                   leaves[key], saved[key],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest())
                  for key, m in members.items())


def held(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if v is None and i == 2 else v for i, v in enumerate(r)) for r in df.collect())


def query(spark, rows, **sizes):
    c = F.col("c")
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return held(pt.prefix_trie(df, base=c - c % 100, borrowed=F.crc32(c.cast("string")) % 6, **sizes))


def random_rows(seed, convs, words=3, longest=9):
    rng = np.random.default_rng(seed)
    return [(int(c), t, ("user", "assistant")[t % 2], "wxyz"[int(rng.integers(words))] * int(rng.integers(1, 3)))
            for c in rng.choice(400, convs, replace=False) for t in range(int(rng.integers(1, longest)))]


@pytest.mark.parametrize(("seed", "convs", "sizes"), [
    (0, 150, {}), (1, 150, {"block": 16, "span": 8}), (2, 300, {"block": 7, "span": 3}), (3, 1, {}), (4, 12, {"block": 2, "span": 2})])
def test_trie_matches_brute_force(spark, seed, convs, sizes):
    rows = random_rows(seed, convs)
    assert query(spark, rows, **sizes) == brute(rows)


def test_query_matches_brute_force_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in table.collect()]
    got = held(queries.QUERIES["op13_prefix_trie"](spark, folder))
    assert got == brute(rows) and len(got) > 40


def test_odd_rows(spark):
    rows = random_rows(5, 60)
    rows += [(None, 0, "user", "x"), (7, None, None, None), (7, None, "user", "x"), (8, 3, "", "y" * 100_000),
             (-5, 0, "user", "w"), (-105, 0, "user", "w"), (-5, 1, None, "w"), (500, 0, "a", "bc"), (501, 0, "ab", "c"),
             (2**40, 0, "user", "w"), (2**40 + 1, 5, "user", "\U0001F600")]
    rows += rows[:5] + rows[-3:]                               # repeated rows
    rows += [(9, 2, "user", t) for t in ("q", "p", "r")]       # ties
    assert query(spark, rows, block=32) == brute(rows)
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS c", "2 AS d", "3 AS `a.b`")
    assert held(pt.prefix_trie(clash)) == brute(rows, borrow=False)
    assert query(spark, []) == [] == query(spark, [(None, 1, "a", "b")])


def test_hot_conversation_and_hot_prefix(spark):
    """A third of the rows in one conversation, equal rows among them; a third in copies of one."""
    rows = [(1000, k // 3, "user", "abc"[k % 2]) for k in range(900)]
    rows += [(c, t, "user", "same") for c in range(2000, 2300) for t in range(3)]
    rows += random_rows(6, 100)
    assert query(spark, rows, block=64, span=50) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_list_ranking_of_scattered_lists(spark, n):
    """Successors without any locality: coins do the work."""
    order = np.random.default_rng(n).permutation(n)
    rows = [(int(a), int(b) if b is not None else None) for a, b in zip(order, [*order[1:], None], strict=True)]
    got = pt.rank(spark.createDataFrame(rows, "a long, s long"), block=max(1, n // 20)).collect()
    assert sorted((r.pos, r.a) for r in got) == list(enumerate(order.tolist()))


def test_member_lists_longer_than_a_chunk(spark):
    rows = [(c, 0, "user", "hello") for c in range(10_000, 30_000, 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert held(pt.prefix_trie(df)) == brute(rows, borrow=False)
