"""Registered corpus queries against their SQL twins, and the pipeline against brute force."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from phonon.llm import langid, minhash, queries, secret_scan
from tests.llm.corpus_cases import SCHEMA, none, odd, odd_rows  # noqa: F401
from tests.llm.test_dedup import brute_exact, brute_near
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(cur.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_covers_its_whole_table(spark, name):
    table = {"op7": "embeddings", "op8": "pages", "op12": "embeddings", "op13": "conversations"}.get(name.split("_")[0], "documents")
    if table == "conversations":
        return                      # nodes, not rows: held against brute force in test_prefix_trie
    key = {"embeddings": "vec_id", "pages": "page_id"}.get(table, "doc_id")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    got = queries.QUERIES[name](spark, SF)
    assert {r[0] for r in got.select(key).collect()} == {r[0] for r in rows.select(key).collect()}


def brute(spark, rows):
    """Ids and texts after the four filtering stages, computed in plain Python."""
    model = langid.fit_documents(spark.createDataFrame(rows, SCHEMA))
    kept = []
    for r in rows:
        lang, _, strange = model.judge(r[1])
        if lang != "und" and not strange:
            kept.append(r)
    owners = Counter(i for (i, _, _, k), n in brute_exact(kept).items() if k for _ in range(n))
    groups = defaultdict(list)
    for r in kept:
        groups[re.sub(r"[\x20\x09-\x0d]", "", r[1])].append(r)
    kept = [min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert Counter(r[0] for r in kept) == owners
    idf = minhash.shingle_weights(spark.createDataFrame(kept, SCHEMA), "text", minhash.Settings())
    classes = brute_near(kept, idf)
    kept = [r for r in kept if classes[(r[0], r[0])]]
    masked = secret_scan.redact(spark.createDataFrame(kept, SCHEMA)).collect()
    return [(r.doc_id, r.text) for r in masked]


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(
        *corpus_pipeline.COLUMNS).collect()]
    rows = docs + [(10_000 + (i or 0), t, y, s, n) if i is not None else (None, t, y, s, n)
                   for i, t, y, s, n in odd_rows()]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = brute(spark, rows)
    assert len(want) < len(rows) and all(text for _, text in want)
    check_packing(want, got, lambda text: t.encode(text, add_special_tokens=False).ids, 2048)
    assert not any(np.isnan(r.length) for r in got)


def test_stages_keep_clean_documents_and_columns(spark):
    clean = spark.read.parquet(f"{SF}/documents.parquet")
    extra = clean.selectExpr("*", "1 AS kept", "2 AS node")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == corpus_pipeline.COLUMNS, name
    kept = corpus_pipeline.language_id(spark, clean, SF).count()
    assert kept == clean.where("text rlike '[a-zA-Z]'").count()


def test_pipeline_of_nothing(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.mark.parametrize("labels", [2, 4, 20])
def test_language_stage_drops_unlearned_languages_and_gibberish(spark, labels):
    rng = np.random.default_rng(labels)
    pools = [["".join(rng.choice(list("bdgklmnprst"), 1)) + "".join(rng.choice(list("aeiou"), 1))
              + "".join(rng.choice(list("lmnrs"), 1)) for _ in range(12)] for _ in range(labels)]

    def text(pool, n):
        return " ".join("".join(rng.choice(pool, rng.integers(1, 3))) for _ in range(n))

    rows = [(i, text(pools[i % labels], int(rng.integers(4, 60))), f"l{i % labels:02d}", "s", 1)
            for i in range(100 * labels)]
    other = ["zhuq", "xwef", "jyqo", "vchi", "qwx"]
    bad = [(10**6 + i, text(other, 40), None, "s", 1) for i in range(20)]
    bad += [(2 * 10**6 + i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 400)), None, "s", 1)
            for i in range(20)]
    docs = spark.createDataFrame(rows + bad, SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert sum(r[0] in kept for r in rows) >= 0.995 * len(rows)
    assert not kept & {r[0] for r in bad}
