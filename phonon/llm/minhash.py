"""Near-duplicate detection by consistent weighted sampling (operator 2).

Texts are multisets of five-word shingles with TF-IDF weights. Improved
consistent weighted sampling draws the same sample from two texts with a
probability equal to their weighted Jaccard similarity; samples are banded, and
texts that agree on a band are compared by their exact weighted Jaccard
similarity. Texts at ``threshold`` or more are linked; classes are the
connected components.

Weights. A shingle's weight is its count times idf = 1 + gain * ln(1 + N / (1 +
df)) / ln(1 + N), so between 1 and 1 + gain. The damped form is deliberate: with a
plain logarithm, what a large group of near copies shares would count for next
to nothing against each copy's own changes, and the group would fall apart. df
is counted over all texts, whole, in a fixed space of 2^20 hashed features (as
hashed TF-IDF does); similarities use the full 64-bit shingles.

How it runs
-----------
1. Document frequencies: one map with compressed per-task sums, one small sum.
   The vector has a fixed size and is broadcast.
2. Signatures: one map. Texts with equal shingle multisets are one node (partial
   aggregate), so exact copies, however many, go on as one.
3. Each bucket of a band gets a leader, drawn by hash, and its nodes are
   compared with it: linear in the bucket. Adaptive execution splits a leader
   that many nodes meet.
4. A bucket whose nodes are then in one component is done. In the others every
   pair of nodes of different components is compared, inside tasks: buckets go
   in blocks of bounded rows and bytes, every pair of blocks to one task, shared
   features as a matrix product. Only a spanning forest of the links leaves a
   task. No pair list of a bucket is ever written.
5. Connected components of the links.

Defined results: null, empty and wordless texts link with nothing; fewer than
five words are one shingle; repeated rows and equal texts share a class; the
class id is the least document id of the class (null ids come last); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from phonon.llm.common import connected_components, fresh, store, text_batches
from phonon.llm.shingles import U64, counted, scramble, shingle

BITS = 20
FEATURES = 1 << BITS
BLOCK = 1 << 14
NO_ID = (1 << 63) - 1          # stands for a null id while nodes are compared
TABLE = 1 << 16


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    width: int = 5
    bands: int = 14
    rows: int = 5
    gain: float = 0.25
    block_rows: int = 1024
    block_bytes: int = 4 << 20
    seed: int = 2


def _quantiles() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of Gamma(2, 1), their logarithms and uniforms at the middles of TABLE equal shares."""
    u = (np.arange(TABLE) + 0.5) / TABLE
    x = np.sqrt(2 * u) + u                     # start of Newton's method for 1 - (1 + x) exp(-x) = u
    for _ in range(60):
        f = 1 - (1 + x) * np.exp(-x) - u
        x = np.maximum(x - f / np.maximum(x * np.exp(-x), 1e-300), x / 4)
    return x.astype(np.float32), np.log(x).astype(np.float32), u.astype(np.float32)


def _texts(batch: pa.RecordBatch, column: int, most_rows: int = 256, most_bytes: int = 1 << 20):
    """Slices (start, texts) of a batch with bounded rows and bytes."""
    texts = batch.column(column).to_pylist()
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= most_rows or held + len(t or "") > most_bytes):
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield start, texts[start:]


def shingle_weights(docs: DataFrame, text_col: str, s: Settings) -> np.ndarray:
    """idf of every hashed feature, from all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for _, texts in _texts(batch, 0):
                at, codes, _ = counted(texts, s.width)
                total += np.bincount((codes >> U64(64 - BITS)).astype(np.int64), minlength=FEATURES)
                n += len(np.unique(at))
        blocks, packed = [-1], [zlib.compress(np.asarray([n], np.int64).tobytes())]
        for b in range(0, FEATURES, BLOCK):
            part = total[b:b + BLOCK]
            if part.any():
                blocks.append(b)
                packed.append(zlib.compress(part.tobytes(), 1))
        yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int64()),
                                          "counts": pa.array(packed, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(c), np.int64)
                sums[b] = sums[b] + got if b in sums else got
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(list(sums), pa.int64()),
            "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    shape = "block long, counts binary"
    rows = (docs.select(text_col).mapInArrow(run, shape).repartition("block")
            .mapInArrow(add, shape).collect())          # FEATURES counts in all, whatever the input
    df, n = np.zeros(FEATURES, np.int64), 0
    for r in rows:
        got = np.frombuffer(r["counts"], np.int64)
        if r["block"] < 0:
            n += int(got[0])
        else:
            df[r["block"]:r["block"] + BLOCK] += got
    full = np.log1p(n / (1.0 + df)) / np.log1p(max(n, 1))
    return (1.0 + s.gain * np.minimum(full, 1.0)).astype(np.float32)


def sampler(s: Settings):
    """Function (text number, hash, weight) -> (distinct text numbers, band keys)."""
    gamma, log_gamma, uniform = _quantiles()
    inverse = 1 / gamma
    odd = scramble(np.arange(1, s.bands * s.rows + 1, dtype=U64) + U64(s.seed << 32)) | U64(1)

    def run(at: np.ndarray, codes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        log_w = np.log(weight).astype(np.float32)
        keys = np.zeros((len(first), s.bands), U64)
        for band in range(s.bands):
            key = np.full(len(first), band + 1, U64)
            for k in range(band * s.rows, (band + 1) * s.rows):
                x = codes * odd[k]
                x ^= x >> U64(29)
                r = (x >> U64(48)).view(np.int64)
                beta = uniform[((x >> U64(32)) & U64(TABLE - 1)).view(np.int64)]
                step = np.floor(log_w * inverse[r] + beta)
                # logarithm of the sampled exponential clock; its bits name the sample
                clock = log_gamma[((x >> U64(16)) & U64(TABLE - 1)).view(np.int64)] \
                    - gamma[r] * (step - beta + 1)
                least = np.minimum.reduceat(clock, first)
                key = scramble(key * U64(0x9E3779B97F4A7C15) + least.view(np.uint32).astype(U64))
            keys[:, band] = key
        return at[first], keys.view(np.int64)

    return run


def signatures(docs: DataFrame, id_col: str, text_col: str, idf, s: Settings) -> DataFrame:
    """(doc_id, a, b, keys): 128-bit name of the shingle multiset (null without words), band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, weights = sampler(s), idf.value
        for batch in batches:
            for start, texts in _texts(batch, 1):
                ids = batch.column(0).slice(start, len(texts))
                at, codes, n = counted(texts, s.width)
                names = np.zeros((2, len(texts)), np.int64)
                keys: list = [None] * len(texts)
                has = np.zeros(len(texts), bool)
                if len(at):
                    w = weights[(codes >> U64(64 - BITS)).astype(np.int64)] * n.astype(np.float32)
                    who, got = sample(at, codes, w)
                    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                    for j in (0, 1):
                        mixed = scramble(codes + n.astype(U64) * U64(0xB5297A4D2C1B3C6F + 2 * j))
                        names[j, who] = np.add.reduceat(scramble(mixed + U64(j)), first).view(np.int64)
                    has[who] = True
                    for i, row in zip(who.tolist(), got, strict=True):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(names[0], mask=~has), pa.array(names[1], mask=~has),
                     pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "a", "b", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(
        run, "doc_id long, a long, b long, keys array<bigint>")


def features(texts: list[str], idf: np.ndarray, width: int):
    """(text number, feature, weight): a shingle seen n times is n features of its idf, so the
    weighted Jaccard similarity is the weight shared over the weight of the union."""
    at, codes = shingle(texts, width)
    order = np.lexsort((codes, at))
    at, codes = at[order], codes[order]
    weight = idf[(codes >> U64(64 - BITS)).astype(np.int64)].astype(np.float64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (codes[1:] != codes[:-1]))) if len(at) else \
        np.zeros(0, bool)
    run = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return at, scramble(codes + run.astype(U64) * U64(0x632BE59BD9B4E019)), weight


def similarities(texts: list[str], left: np.ndarray, right: np.ndarray, idf: np.ndarray,
                 width: int) -> np.ndarray:
    """Weighted Jaccard similarity of the pairs (left[i], right[i]) of text numbers."""
    at, code, weight = features(texts, idf, width)
    edge = np.searchsorted(at, np.arange(len(texts) + 1))
    whole = np.bincount(at, weight, minlength=len(texts))
    sets = []
    for i in range(len(texts)):
        part = slice(edge[i], edge[i + 1])
        order = np.argsort(code[part])
        sets.append((code[part][order], weight[part][order]))
    out = np.zeros(len(left))
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        (ca, wa), (cb, _) = sets[i], sets[j]
        if len(ca) > len(cb):
            (ca, wa), (cb, _) = sets[j], sets[i]
        if not len(ca):
            continue
        pos = np.minimum(np.searchsorted(cb, ca), len(cb) - 1)
        shared = wa[cb[pos] == ca].sum()
        out[k] = shared / (whole[i] + whole[j] - shared)
    return out


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def block_links(texts: list[str], comps: list, sides: np.ndarray | None, idf: np.ndarray,
                s: Settings) -> list[tuple[int, int]]:
    """Spanning forest of the links between nodes of different components.

    ``sides`` tells the two blocks of a pair of blocks apart: only pairs
    across are compared then (each block has a task of its own).
    """
    at, code, weight = features(texts, idf, s.width)
    n = len(texts)
    whole = np.bincount(at, weight, minlength=n)
    _, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    at, inverse, weight = at[shared], inverse[shared], weight[shared]
    column = np.zeros(len(times), np.int64)
    used = np.unique(inverse)
    column[used] = np.arange(len(used))
    inverse = column[inverse]
    overlap = np.zeros((n, n), np.float32)
    order = np.argsort(inverse, kind="stable")
    at, inverse, weight = at[order], inverse[order], weight[order]
    for a in range(0, len(used), 4096):
        lo, hi = np.searchsorted(inverse, [a, a + 4096])
        x = np.zeros((n, min(4096, len(used) - a)), np.float32)
        x[at[lo:hi], inverse[lo:hi] - a] = np.sqrt(weight[lo:hi])
        overlap += x @ x.T
    union = whole[:, None] + whole[None, :] - overlap
    near = np.triu(overlap >= (s.threshold - 1e-4) * union, 1)
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    names = {c: k for k, c in enumerate(dict.fromkeys(comps))}
    group = np.asarray([names[c] for c in comps])
    near &= group[:, None] != group[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return []
    parent, out = list(range(len(names))), []
    exact = similarities(texts, i, j, idf, s.width) if len(i) <= 4096 else None
    for k, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = _find(parent, int(group[p])), _find(parent, int(group[q]))
        if a == b:
            continue
        sim = exact[k] if exact is not None else similarities(
            [texts[p], texts[q]], np.asarray([0]), np.asarray([1]), idf, s.width)[0]
        if sim >= s.threshold - 1e-9:
            parent[a] = b
            out.append((p, q))
    return out


NODE = "struct<id:bigint,a:bigint,b:bigint>"


def _names(texts: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, a, b) of the texts with a shingle: 128-bit names of their shingle multisets."""
    at, codes, n = counted(texts, width)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    a, b = (np.add.reduceat(scramble(scramble(
        codes + n.astype(U64) * U64(0xB5297A4D2C1B3C6F + 2 * j)) + U64(j)), first
        ).view(np.int64) for j in (0, 1))
    return at[first], a, b


def _classed(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(doc_id, a, b, class, leads) per row of ``docs``: the class is its least node; one row of each
    class leads, a row of that node."""
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(shingle_weights(docs, text_col, s))
    sig = store(signatures(docs, id_col, text_col, idf, s).withColumn("row", F.monotonically_increasing_id()),
                "signatures")
    node = F.struct("id", "a", "b").alias("node")
    # of equal multisets the least id is the node's, and the first of its rows stands for it
    nodes = sig.where("a IS NOT NULL").groupBy("a", "b", "keys").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "row")).alias("m")).select(
        "a", "b", "keys", "m.id", F.col("m.row").alias("first"))
    buckets = nodes.select(node, F.explode("keys").alias("key"))
    leaders = buckets.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node")
                                       )["node"].alias("leader")).where("n > 1")
    members = store(buckets.join(leaders.select("key", "leader"), "key"), "members")

    # texts of the nodes that share a bucket
    wanted = members.select("node").distinct()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _texts(batch, 1):
                who, a, b = _names(texts, s.width)
                rows = batch.slice(start, len(texts)).take(pa.array(who))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(a), pa.array(b), rows.column(1)],
                    names=["id", "a", "b", "text"])

    ids = wanted.select(F.col("node.id").alias("id")).distinct()
    found = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                        F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    found = found.mapInArrow(named, "id long, a long, b long, text string")
    found = found.select(node, F.col("text")).dropDuplicates(["node"])
    texts = store(found.join(wanted, "node", "left_semi"), "texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                rows = batch.slice(a, 128)
                pool: dict[str, int] = {}
                left, right = ([pool.setdefault(t, len(pool)) for t in rows.column(c).to_pylist()]
                               for c in (2, 3))
                sim = similarities(list(pool), np.asarray(left), np.asarray(right), weights, s.width)
                keep = pa.array(sim >= s.threshold - 1e-9)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).filter(keep), rows.column(1).filter(keep)], names=["a", "b"])

    pairs = members.where("node <> leader").select("node", "leader").distinct()
    with_texts = (pairs.join(texts.withColumnRenamed("text", "t1"), "node")
                  .join(texts.select(F.col("node").alias("leader"), F.col("text").alias("t2")),
                        "leader").select("node", "leader", "t1", "t2"))
    stars = store(with_texts.mapInArrow(compare, f"a {NODE}, b {NODE}"), "stars")
    comps = connected_components(stars)

    # buckets that still hold more than one component
    placed = members.join(comps, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("comp"))
    placed = placed.join(texts.select("node", F.length("text").alias("size")), "node")
    open_ = placed.groupBy("key").agg(
        F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("n"),
        F.sum("size").alias("bytes")).where("c1 <> c2").select(
        "key", F.greatest(F.ceil(F.col("n") / s.block_rows), F.ceil(F.col("bytes") / s.block_bytes)
                          ).cast("int").alias("blocks"))
    todo = placed.join(open_, "key").withColumn(
        "mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # every pair of blocks once: block x meets block y in the task (min, max)
    todo = todo.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "comp")
    todo = todo.join(texts, "node").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        schema = None
        held: list[tuple] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if len({h[1] for h in held}) > 1:
                links = block_links([h[3] for h in held], [h[1] for h in held],
                                    np.asarray([h[2] for h in held]) if last[1] != last[2] else None,
                                    weights, s)
                if links:
                    yield pa.RecordBatch.from_pydict({
                        "a": pa.array([held[i][0] for i, _ in links], schema),
                        "b": pa.array([held[j][0] for _, j in links], schema)})
            held.clear()

        for batch in batches:
            schema = batch.schema.field(4).type
            cols = [batch.column(c).to_pylist() for c in range(7)]
            for key, x, y, side, who, comp, text in zip(*cols, strict=True):
                if (key, x, y) != last:
                    yield from flush()
                    last = (key, x, y)
                held.append((who, tuple(comp.values()), side, text))
        yield from flush()

    more = store(todo.select("key", "x", "y", "side", "node", "comp", "text").mapInArrow(
        blocks, f"a {NODE}, b {NODE}"), "links")
    if not more.isEmpty():
        comps = connected_components(stars.unionByName(more))
    ends = comps.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"),
                        F.col("component").alias("class"))
    alone = nodes.select("a", "b", node.alias("own"), "first")
    classes = store(alone.join(ends, ["a", "b"], "left").select(
        "a", "b", F.coalesce("class", "own").alias("class"),
        F.when(F.coalesce("class", "own") == F.col("own"), F.col("first")).alias("first")), "classes")
    return sig.select("doc_id", "a", "b", "row").join(classes, ["a", "b"], "left").select(
        "doc_id", "a", "b", "class", F.col("row").eqNullSafe(F.col("first")).alias("leads"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 settings: Settings | None = None) -> DataFrame:
    """(doc_id, class_id, kept), one row per row of ``docs``."""
    rows = _classed(docs, id_col, text_col, settings or Settings())
    class_id = F.when(F.col("a").isNull(), F.col("doc_id")).otherwise(
        F.when(F.col("class.id") != NO_ID, F.col("class.id")))
    return rows.select("doc_id", class_id.alias("class_id"),
                       (F.col("a").isNull() | F.col("leads")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               settings: Settings | None = None) -> DataFrame:
    """One row of ``docs`` of each class, all columns kept: the least document id (null last).

    Rows are judged one by one. Ids whose rows all stay or all go are settled by
    id; only the rows of the others are named by their shingles again. Rows equal in id
    and shingles go by the order of text and other columns. Rows without a shingle stay.
    """
    s = settings or Settings()
    own = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "a", "b")
    rows = _classed(docs, id_col, text_col, s).groupBy(
        "doc_id", "a", "b", (F.col("a").isNull() | (own == F.col("class"))).alias("stays")).agg(
        F.count("*").alias("n"))
    rows = store(rows, "row-verdicts")
    ids = store(rows.groupBy("doc_id").agg(
        F.max("stays").alias("some"), F.min("stays").alias("all"),
        F.max(F.col("stays") & F.col("a").isNotNull() & (F.col("n") > 1)).alias("ties")).where(
        "NOT all OR ties"), "row-ids")
    given, a, b, place = fresh(docs, "given", "a", "b", "place")
    docs = docs.withColumn(given, F.col(id_col).cast("long"))

    def of(which: DataFrame) -> F.Column:
        return docs[given].eqNullSafe(which["doc_id"])

    settled = docs.join(ids, of(ids), "left_anti").drop(given)
    open_ = store(ids.where("some"), "open-ids")
    if open_.isEmpty():
        return settled
    found = docs.join(open_, of(open_), "left_semi")
    at = found.columns.index(text_col)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _texts(batch, at):
                who, x, y = _names(texts, s.width)
                part = batch.slice(start, len(texts))
                cols = []
                for name in (x, y):
                    full, none = np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
                    full[who], none[who] = name, False
                    cols.append(pa.array(full, mask=none))
                yield pa.RecordBatch.from_arrays([*part.columns, *cols],
                                                 names=[*part.schema.names, a, b])

    schema = StructType([*found.schema.fields, StructField(a, LongType()), StructField(b, LongType())])
    # columns travel by position: a name with a dot would be read as a path
    plain = found.toDF(*[f"c{k}" for k in range(len(found.columns))])
    found = plain.mapInArrow(named, StructType(
        [StructField(n, f.dataType) for n, f in zip(plain.columns, found.schema.fields, strict=True)]
        + schema.fields[-2:])).toDF(*found.columns, a, b)
    stay = rows.where("stays").select(*(F.col(c).alias(f"__stay_{c}") for c in ("doc_id", "a", "b")))
    found = found.join(stay, F.col(given).eqNullSafe(F.col("__stay_doc_id"))
                       & F.col(a).eqNullSafe(F.col("__stay_a"))
                       & F.col(b).eqNullSafe(F.col("__stay_b")), "left_semi")
    order = [F.col(f"`{text_col}`")] + [F.col(f"`{c}`") for c, kind in found.dtypes if "map<" not in kind]
    first = F.row_number().over(Window.partitionBy(given, a, b).orderBy(*order))
    bare = found.where(F.col(a).isNull())
    one = found.where(F.col(a).isNotNull()).withColumn(place, first).where(F.col(place) == 1)
    return settled.unionByName(bare.unionByName(one.drop(place)).drop(given, a, b))
