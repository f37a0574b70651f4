"""Packing, BPE codec and token store against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from phonon.llm import bpe, token_store
from phonon.llm.packing import best_fit, cut, pack
from phonon.llm.tokens import ChunkEncoder, encoder
from tests.llm.corpus_cases import none, odd, odd_rows  # noqa: F401

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def strange(n, seed=0):
    rng = random.Random(seed)
    parts = ["a", "b", "é", " ", "\n", ".", "'", "s", "'s", "'re", "1", "2", "!", "-", "\t", " ",
             "漢", "ß", "ve", " 're", "_", "  ", "Б", " a", "<|endoftext|>", "😀", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_chunked_encoding_is_the_library_s(library):
    enc = encoder(JSON)
    texts = strange(4000) + [r[1] or "" for r in odd_rows()]
    assert [np.frombuffer(p, "<u4").tolist() for p in enc.encode(texts)] == [library(t) for t in texts]
    forgetful = ChunkEncoder(enc._library, limit=5)
    assert all(np.frombuffer(forgetful.encode([t])[0], "<u4").tolist() == library(t)
               for t in texts[:300])


def test_best_fit():
    rng = random.Random(1)
    for _ in range(50):
        sizes = np.asarray([rng.randint(1, 64) for _ in range(rng.randint(0, 60))], np.int64)
        where, place, fills = best_fit(sizes, 64)
        for b in range(len(fills)):
            spans = sorted((int(p), int(p + n)) for p, n, w in zip(place, sizes, where, strict=True) if w == b)
            assert spans[0][0] == 0 and spans[-1][1] == fills[b] <= 64
            assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(8, 4) == [(0, 4), (4, 4)] and cut(3, 4) == [(0, 3)]


def check_packing(rows, got, library, capacity):
    want = Counter()
    for i, text, *_ in rows:
        ids = np.asarray([*library(text), 0], "<u4")
        for k, (s, n) in enumerate(cut(len(ids), capacity)):
            want[(i, k, s, n, zlib.crc32(ids[s:s + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_odd_rows(odd, none, library):
    got = pack(odd.selectExpr("*", "1 AS bin", "2 AS place"), JSON).collect()
    check_packing(odd_rows(), got, library, 2048)
    assert pack(none, JSON).count() == 0


def test_pack_many_partitions_near_the_bound(spark, library):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "of", "and"]) for _ in range(rng.randint(1, 90))))
            for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    # windows of a handful of pieces: right, and the merge rounds help
    small = pack(docs, JSON, capacity=128, slack=2, fan_in=3, window=20).collect()
    least = -(-sum(r.length for r in small) // 128)
    assert check_packing(rows, small, library, 128) <= 1.06 * least
    # windows of hundreds of pieces: as good as best-fit over all pieces at once
    docs = docs.coalesce(3)
    got = pack(docs, JSON, capacity=128, slack=2, fan_in=2).collect()
    alone = best_fit(np.asarray([r.length for r in got]), 128)[2]
    assert check_packing(rows, got, library, 128) <= len(alone) + 1
    ids = pack(docs, JSON, with_ids=True).select("length", "ids").collect()
    assert all(len(r.ids) == 4 * r.length for r in ids)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_bpe_is_the_library_s(reference):
    made, enc = bpe.codec(RANKS, public_tokenizers.PATTERN)
    texts = strange(3000, 2) + ["ab" * 5000 + "qzx" * 3000, "".join(map(chr, range(1, 700)))] + [
        r[1] or "" for r in odd_rows()]
    packed = enc.encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [
        reference.encode_ordinary(t) for t in texts]
    assert [made.decode(p) for p in packed] == [t.encode() for t in texts]


def test_bpe_backtracks(reference):
    made, _ = bpe.codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(5)
    for _ in range(3000):
        data = "".join(rng.choice("thereinationsABq") for _ in range(rng.randint(1, 30)))
        assert made.encode_match(data.encode()) == made.ranks.get(data.encode()) and True or \
            made.encode_match(data.encode()) == reference.encode_ordinary(data)


def test_bpe_frames(odd, none, reference):
    done = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS,
                      public_tokenizers.PATTERN).collect()
    want = Counter((i, tuple(reference.encode_ordinary(t or "")), (t or "").encode())
                   for i, t, *_ in odd_rows())
    assert Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), bytes(r.decoded))
                   for r in done) == want
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(-2**62, 2**62, n))
        h = token_store.PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    index = token_store.ShardIndex(token_store.index_bytes(
        np.asarray([0, 5, 5, 9]), 1, np.asarray([3, 1, 2, 4])))
    assert [x.tolist() for x in index.find(np.asarray([5, 9]))] == [[1, 3], [2, 1]]
    absent = index.find(np.arange(100, 4000))[0]
    assert (absent >= 0).sum() == 0


def test_store_round_trip(spark, odd, none, library):
    folder = token_store.write_store(odd.repartition(5), JSON)
    got = token_store.read_store(spark, folder, with_ids=True, read_bytes=64).collect()
    want = Counter((i, tuple([*library(t), 0])) for i, t, *_ in odd_rows())
    assert Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    keys = spark.createDataFrame([(2,), (6,), (77,), (2,), (None,)], "doc_id long")
    found = Counter((r.key, hashlib.md5(bytes(r.ids)).hexdigest())
                    for r in token_store.lookup(keys, folder).collect())
    assert found == Counter((i, hashlib.md5(np.asarray([*library(t), 0], "<u4").tobytes()).hexdigest())
                            for i, t, *_ in odd_rows() if i in (2, 6))
    assert token_store.read_store(spark, token_store.write_store(none, JSON)).count() == 0


def test_hot_keys_are_spread_over_shards_and_found_whole(spark):
    """A third of the rows without an id, a third with one id, equal texts among both."""
    rows = [(None, f"none {k % 7}") for k in range(300)] + [(5, f"five {k % 4}") for k in range(300)]
    rows += [(k, f"text {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS i", "2 AS n", "3 AS `a.b`")
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = token_store.write_store(docs.repartition(4), path, shard_bytes=2000)
    shards = token_store.manifest(spark, folder)
    assert len(shards) > 10 and max(m["n_docs"] for m in shards) < 200
    assert sum(m["min_key"] is not None and m["min_key"] <= 5 <= m["max_key"] for m in shards) > 2
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True

    def packed(text):
        return np.asarray([*t.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()

    got = token_store.read_store(spark, folder, with_ids=True).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, packed(x)) for i, x in rows)
    ordered = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered[:-1])]).tolist()
    keys = spark.createDataFrame([(5,), (7,), (299,), (1000,), (-1,), (None,)], "doc_id long")
    found = Counter((r[0], bytes(r[1])) for r in token_store.lookup(keys, folder).collect())
    assert found == Counter((i, packed(x)) for i, x in rows if i in (5, 7, 299))
