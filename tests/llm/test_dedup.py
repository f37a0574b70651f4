"""Exact and near dedup, and embedding near-dedup, against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from phonon.llm import cap_filters, minhash
from phonon.llm.common import connected_components
from phonon.llm.exact_dedup import Trie, exact_dedup, exact_groups, shared_prefix
from phonon.llm.shingles import counted
from tests.llm.corpus_cases import SCHEMA, none, odd, odd_rows, words  # noqa: F401


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", r[1] or "")].append(r)
    out = Counter()
    for g in groups.values():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for k, r in enumerate(sorted(g, key=lambda r: r is not best)):
            out[(r[0], best[0], len(g), k == 0)] += 1
    return out


def found_exact(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


def test_exact_groups_on_odd_rows(odd):
    assert found_exact(exact_groups(odd)) == brute_exact(odd_rows())
    assert exact_dedup(odd).columns == odd.columns
    kept = Counter(r.doc_id for r in exact_dedup(odd).collect())
    assert kept == Counter(i for (i, _, _, k), n in brute_exact(odd_rows()).items() if k
                           for _ in range(n))


def test_exact_spills_by_subtree_and_windows(spark):
    rng = random.Random(1)
    pool = [words(rng, 30) for _ in range(60)]
    rows = [(i, rng.choice(pool) + " " * rng.randint(0, 2), "en", "s", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_exact(rows)
    small = exact_groups(docs, window_rows=20, trie_bytes=2500)
    assert found_exact(small) == want
    assert {r.doc_id for r in exact_dedup(docs, window_rows=20, trie_bytes=2500).collect()} == {
        i for i, _, _, k in want if k}


def test_exact_empty_and_extra_columns(spark, none):
    assert exact_groups(none).count() == 0
    assert exact_dedup(none).count() == 0
    more = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr(
        "*", "1 AS kept", "2 AS sha", "'x' AS keep_id", "array(1) AS members", "3 AS row")
    assert found_exact(exact_groups(more)) == brute_exact(odd_rows())
    assert exact_dedup(more).columns == more.columns


def test_trie():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    trie, seen = Trie(), {}
    for k in keys:
        slot = trie.insert(k)
        if k in seen:
            assert slot is seen[k]
        else:
            assert not slot
            slot.append(k)
            seen[k] = slot
    assert sorted(s[0] for s in trie.walk()) == sorted(seen)
    assert trie.terminals == len(seen)
    gone = trie.drop(ord("a"))
    assert {s[0] for s in trie.walk(gone)} == {k for k in seen if k[:1] == b"a"}
    assert shared_prefix(b"abcd", b"xxabcz", 2) == 3


def brute_near(rows, idf, threshold=0.8):
    sets = []
    at, codes, n = counted([r[1] for r in rows])
    weight = idf[(codes >> np.uint64(44)).astype(int)].astype(float)
    for k in range(len(rows)):
        m = at == k
        sets.append(dict(zip(codes[m].tolist(), (n[m] * weight[m]).tolist(), strict=True)))
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if not a or not b:
                continue
            low = sum(min(w, b[c]) for c, w in a.items() if c in b)
            if low / (sum(a.values()) + sum(b.values()) - low) >= threshold - 1e-9:
                parent[minhash._find(parent, i)] = minhash._find(parent, j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[minhash._find(parent, i)].append(r[0])
    out = Counter()
    for i, r in enumerate(rows):
        ids = [x for x in least[minhash._find(parent, i)] if x is not None]
        own = min(ids) if ids and sets[i] else r[0]
        out[(r[0], own)] += 1
    return out


@pytest.fixture(scope="module")
def clusters(spark):
    """Near copies of several strengths, chains, shared passages, short texts."""
    rng = random.Random(5)
    rows, passage = [], words(rng, 60)
    for _ in range(12):
        base = words(rng, rng.choice([6, 40, 120])).split()
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    rows += [(len(rows) + i, words(rng, 30) + " " + passage, "en", "s", 1) for i in range(20)]
    rows += [(10_000 + i, t, "en", "s", 1) for i, t in enumerate(
        ["a b", "A, b!", "a b c", "one two three four five", "One two three four five."])]
    return rows + odd_rows()


def test_near_classes_match_brute_force(spark, clusters):
    docs = spark.createDataFrame(clusters, SCHEMA).repartition(3)
    s = minhash.Settings(bands=30, rows=3)       # misses have a negligible chance here
    want = brute_near(clusters, minhash.shingle_weights(docs, "text", s))
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_classes(docs, settings=s).collect())
    assert got == want
    # blocks of a few rows give the same classes
    tiny = minhash.Settings(bands=30, rows=3, block_rows=3)
    assert Counter((r.doc_id, r.class_id)
                   for r in minhash.near_classes(docs, settings=tiny).collect()) == want


def test_near_dedup_keeps_one_of_each_class_and_clean_documents(spark):
    rng = random.Random(8)
    clean = [(i, words(rng, 80), "en", "s", 1) for i in range(30)]
    copies = [(100 + i, clean[i][1] + " tail", "en", "s", 1) for i in range(10)]
    docs = spark.createDataFrame(clean + copies, SCHEMA)
    assert {r.doc_id for r in minhash.near_dedup(docs).collect()} == set(range(30))


def test_a_large_group_of_near_copies_stays_together(spark):
    rng = random.Random(9)
    base = words(rng, 100).split()
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(100)] = words(rng, 1)
        rows.append((i, " ".join(copy), "en", "s", 1))
    got = minhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.class_id for r in got} == {0}


def test_near_empty(none):
    assert minhash.near_classes(none).count() == 0


def test_samples_agree_as_often_as_the_similarity():
    s = minhash.Settings(bands=400, rows=1)
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2)
    wa, wb = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    wa[:10], wb[50:] = 1e-6, 1e-6
    at = np.repeat([0, 1], 60)
    _, keys = minhash.sampler(s)(at, np.concatenate((codes, codes)),
                                 np.concatenate((wa, wb)).astype(np.float32))
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((keys[0] == keys[1]).mean() - want) < 0.08


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [
        (1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want


def vector_rows():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(25):
        base = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((base + rng.normal(size=24) * 0.12).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[3]], [0.0] * 24, None, [], [1.0, None] * 12,
             [float("nan")] * 24, [float("inf")] * 24, rows[5][:12], [1e300] * 24, [1.0] * 24]
    out = [(i, v, i % 3) for i, v in enumerate(rows)]
    return out + [(None, rows[0], 1), (2, rows[0], 1)]


def brute_vectors(rows):
    ok = [cap_filters._usable(r[1]) for r in rows]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))
    for i in range(n):
        for j in range(i):
            if ok[i] is None or ok[j] is None or len(ok[i]) != len(ok[j]):
                continue
            a, b = (v / np.abs(v).max() for v in (ok[i], ok[j]))
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[i] += 1
                links[j] += 1
                parent[minhash._find(parent, i)] = minhash._find(parent, j)
    least = defaultdict(list)
    for i in range(n):
        least[minhash._find(parent, i)].append(rows[i][0])
    out = Counter()
    for i in range(n):
        ids = [x for x in least[minhash._find(parent, i)] if x is not None]
        own = rows[i][0] if ok[i] is None else (min(ids) if ids else None)
        out[(rows[i][0], links[i], own)] += 1
    return out


@pytest.mark.parametrize("block_rows", [1024, 3])
def test_vectors_match_brute_force(spark, block_rows):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    s = cap_filters.Settings(shared=30.0, block_rows=block_rows)
    got = Counter((r.vec_id, r.n_links, r.component_id)
                  for r in cap_filters.near_vectors(df, settings=s).collect())
    assert got == brute_vectors(rows)


def test_vectors_empty_and_recall(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cap_filters.near_vectors(none).count() == 0
    # pairs exactly at the threshold, with the settings of the query
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        z = rng.normal(size=64)
        z -= (z @ x) * x
        y = 0.951 * x + np.sqrt(1 - 0.951**2) * z / np.linalg.norm(z)
        rows += [(2 * i, x.tolist()), (2 * i + 1, y.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cap_filters.near_vectors(df).where("n_links > 0").count()
    assert got >= 0.98 * len(rows)


def test_decode_lists_every_passing_direction():
    s = cap_filters.Settings(codes=3)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    who, names = cap_filters.decode(x, 2.0, 9, s)
    count = 0
    for c in range(3):
        rotation, (a, b) = cap_filters._code(10, 9, c, s.seed)
        dirs = np.concatenate((np.repeat(a, 9, 0), np.tile(b, (9, 1))), axis=1)
        count += int(((x @ rotation) @ dirs.T >= 2.0 / np.sqrt(10)).sum())
    assert len(names) == count and len(set(zip(who.tolist(), names.tolist(), strict=True))) == count


def pairs_at(cosine, dim, n):
    rng = np.random.default_rng(dim)
    x, z = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [3, 8, 16, 64])
@pytest.mark.parametrize("n", [10**3, 10**6, 10**7, 10**8])
def test_pairs_share_filters_at_every_size_and_dimension(n, dim):
    s = cap_filters.Settings()
    t, size = cap_filters.design(n, dim, s)
    lists = []
    for side in pairs_at(s.threshold, dim, 100):
        who, names = cap_filters.decode(side, t, size, s)
        lists.append(list(zip(who.tolist(), names.tolist(), strict=True)))
    shared = Counter(k for k, _ in set(lists[0]) & set(lists[1]))
    assert sum(shared.values()) >= 0.85 * s.shared * 100
    assert len(shared) >= 95
    assert len(lists[0]) < 150 * 100


@pytest.mark.parametrize("shared, fewest, block_rows", [(0.01, 10**6, 7), (4.0, 12, 16)])
def test_vectors_with_few_filters_are_compared_with_all(spark, shared, fewest, block_rows):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    s = cap_filters.Settings(shared=shared, fewest=fewest, block_rows=block_rows)
    got = Counter((r.vec_id, r.n_links, r.component_id)
                  for r in cap_filters.near_vectors(df, settings=s).collect())
    want = brute_vectors(rows)
    assert got == want if fewest > 1000 else sum((got & want).values()) >= 0.9 * len(rows)


def test_vectors_of_few_dimensions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=1 + i % 3).tolist(), 0) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    s = cap_filters.Settings(shared=30.0)
    got = Counter((r.vec_id, r.n_links, r.component_id)
                  for r in cap_filters.near_vectors(df, settings=s).collect())
    assert got == brute_vectors(rows)


def test_near_dedup_judges_rows_not_ids(spark):
    rng = random.Random(8)
    base, lone, third = (words(rng, 60) for _ in range(3))
    near, other = base + " tail", third + " tail"
    rows = [(1, base, "en", "s", 1), (7, near, "en", "s", 2), (7, lone, "en", "s", 3),
            (7, lone, "en", "s", 4), (9, near + " x", "en", "s", 5),
            (None, third, "en", "s", 6), (None, other, "en", "s", 7), (None, other + " x", "en", "s", 8),
            (None, words(rng, 50), "en", "s", 9), (None, None, "en", "s", 10), (7, "", "en", "s", 11)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(r.n_chars for r in minhash.near_dedup(docs).collect())
    assert len(set(got) & {6, 7, 8}) == 1
    assert [n for n in got if n not in (6, 7, 8)] == [1, 3, 9, 10, 11]
    assert minhash.near_dedup(docs).columns == docs.columns
    again = spark.createDataFrame(rows[::-1], SCHEMA).repartition(2)
    assert sorted(r.n_chars for r in minhash.near_dedup(again).collect()) == got


def test_near_classes_keep_one_row_of_each_class(spark):
    rng = random.Random(11)
    base, third, lone = (words(rng, 60) for _ in range(3))
    rows = [(1, base, "en", "s", 1), (1, base + " tail", "en", "s", 1), (1, base, "en", "s", 1),   # one id, one class
            (5, base + " other", "en", "s", 1), (5, lone, "en", "s", 1),
            (None, third, "en", "s", 1), (None, third + " x", "en", "s", 1), (None, third + " y", "en", "s", 1),
            (None, None, "en", "s", 1), (None, "", "en", "s", 1)]
    got = minhash.near_classes(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    kept = Counter((r.doc_id, r.class_id) for r in got if r.kept)
    # null ids: one of the three near copies, and both rows without a shingle
    assert kept == {(1, 1): 1, (5, 5): 1, (None, None): 3} and len(got) == len(rows)
    assert Counter(r.class_id for r in got) == {1: 4, 5: 1, None: 5}


def test_near_columns_with_odd_names(spark):
    rng = random.Random(12)
    base = words(rng, 60)
    rows = [(7, base), (7, base + " tail"), (7, words(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS `a.b`", "2 AS kept", "3 AS node", "4 AS class", "5 AS row")
    out = minhash.near_dedup(docs)
    assert out.columns == docs.columns and out.count() == 2
    assert minhash.near_classes(docs).count() == 3
