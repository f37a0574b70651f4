"""Embedding near-duplicates by spherical-cap filters (operator 7).

A filter is a direction; a vector passes it when its cosine to the direction is
at least a cap height. Directions are random product codes: after a random
rotation the space is two blocks, each with a small random codebook, and every
pair of codewords is a direction. A vector's passing directions are listed by
decoding the blocks (a codeword is kept only if the best of the other block
can still lift it over the height), without visiting all directions. Vectors
that pass a common filter are compared by cosine in double precision.

Cap height and codebook size follow from the number of distinct vectors and
their dimension, by the exact shares of the sphere: the height keeps the expected
chance companions per filter constant (and lower, so more, where the caps would become
too small to hold a pair at the threshold), the size the expected filters that a pair
at the threshold shares. ``codes`` independent rotations even out the differences
between vectors; below six dimensions a code is one block. Vectors that still pass fewer than
``fewest`` filters are compared with all vectors, in blocks. The other pairs at the
threshold are missed in about 1 % of cases, closer ones in less.

How it runs
-----------
1. Equal vectors are one node with a count (partial aggregate): a vector that
   fills a third of the table is one row.
2. Nodes are expanded to their filters; filters with one node are dropped
   before any vector is shipped.
3. Each filter's nodes are compared inside tasks by matrix products, in blocks of
   bounded rows (pairs of blocks for a large filter). A pair counts in the
   least filter it shares, so it counts once. Vectors with too few filters go in blocks of their
   own against blocks of all the others. A task emits a link count per node
   and a spanning forest, never the pairs.
4. Connected components of the forests; counts and components go back to the rows.

The direct link counts of a dense cluster of different vectors need every
pair of it to be compared; that part of the work grows with the square of
such a cluster, spread over its pairs of blocks.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing (0 links, their own component, kept); only
vectors of one dimension are compared; null ids sort last; repeated rows link
with each other like equal vectors; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonon.llm.common import connected_components, store
from phonon.llm.shingles import U64, scramble

NO_ID = (1 << 63) - 1
PRODUCT = 6                    # from this dimension on the codes are products of two blocks
FEW = (1 << 63) - 1            # filter of the vectors that pass too few
REST = FEW - 1                 # those against the others


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    codes: int = 32             # independent rotations
    companions: float = 8.0     # chance companions of a vector in a filter
    most_passing: float = 0.0062  # share of the directions that a vector passes, at most
    least_share: float = 0.125  # of a vector's filters, those that a vector at the threshold passes too
    fewest: int = 3             # vectors with fewer filters are compared with all others
    shared: float = 11.0        # filters that a pair at the threshold shares, on average
    block_rows: int = 1024
    seed: int = 7


@functools.lru_cache(maxsize=64)
def _angles(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(angles, share of the sphere within each angle of a direction), from two dimensions on."""
    phi = np.linspace(0, math.pi, 40_001)
    f = np.sin(phi) ** (dim - 2) if dim > 2 else np.ones(len(phi))
    c = np.concatenate(([0.0], np.cumsum((f[1:] + f[:-1]) / 2)))
    return phi, c / c[-1]


def one_passes(dim: int, height: np.ndarray | float) -> np.ndarray:
    """Share of the directions whose cosine to a vector is at least ``height``."""
    height = np.asarray(height, np.float64)
    if dim == 1:
        return np.where(height > 1, 0.0, np.where(height > -1, 0.5, 1.0))
    return np.interp(np.arccos(np.clip(height, -1, 1)), *_angles(dim))


def both_pass(dim: int, height: float, cosine: float) -> float:
    """Share of the directions that both vectors of a pair at ``cosine`` pass."""
    if dim == 1:
        return float(one_passes(1, height))
    phi, share = _angles(dim)
    edges = np.linspace(0, math.acos(height), 4001)
    a = (edges[1:] + edges[:-1]) / 2
    # at angle a to the first vector, the rest of the direction is uniform in one dimension less
    need = (height - cosine * np.cos(a)) / (math.sqrt(1 - cosine * cosine) * np.sin(a))
    return float(np.diff(np.interp(edges, phi, share)) @ one_passes(dim - 1, need))


@functools.lru_cache(maxsize=64)
def design(n: int, dim: int, s: Settings) -> tuple[float, int]:
    """(cap height in units of 1 / sqrt(dimension), codewords per block) for ``n`` vectors.

    A direction of a randomly rotated code is uniform on the sphere, so the expected
    shared filters of a pair are the number of directions times ``both_pass``.
    """
    want = min(s.most_passing, s.companions / max(n, 1))
    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        one = float(one_passes(dim, mid))
        narrow = one < want or both_pass(dim, mid, s.threshold) < s.least_share * one
        low, high = (low, mid) if narrow else (mid, high)
    each = s.shared / (s.codes * both_pass(dim, low, s.threshold))
    size = max(8, math.ceil(math.sqrt(each))) if dim >= PRODUCT else math.ceil(each)
    return low * math.sqrt(dim), size


@functools.lru_cache(maxsize=64)
def _code(dim: int, size: int, number: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rotation, codebooks of the two blocks) of one code."""
    rng = np.random.default_rng([seed, dim, size, number])
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    books, split = [], dim - dim // 2
    if dim < PRODUCT:
        book = rng.normal(size=(size, dim))
        return rotation, [book / np.linalg.norm(book, axis=1, keepdims=True), np.zeros((1, 0))]
    for width in (split, dim - split):
        book = rng.normal(size=(size, width))
        norm = np.linalg.norm(book, axis=1, keepdims=True)
        books.append(book / np.where(norm > 0, norm, 1) / math.sqrt(2))
    return rotation, books


def decode(unit: np.ndarray, t: float, size: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(vector number, filter) of every direction that each unit vector passes."""
    dim = unit.shape[1]
    height = t / math.sqrt(dim)
    who, names = [], []
    for c in range(s.codes):
        rotation, (first, second) = _code(dim, size, c, s.seed)
        turned = unit @ rotation
        a = turned[:, :first.shape[1]] @ first.T
        b = turned[:, first.shape[1]:] @ second.T
        row, i = np.nonzero(a >= height - b.max(axis=1, keepdims=True))
        hit, j = np.nonzero(a[row, i][:, None] + b[row] >= height)
        who.append(row[hit])
        label = (i[hit].astype(U64) * U64(size) + j.astype(U64)) * U64(s.codes) + U64(c)
        names.append(scramble(label * U64(4099) + U64(dim)).view(np.int64))
    return np.concatenate(who), np.concatenate(names)


def _usable(v: list | None) -> np.ndarray | None:
    if not v or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64) + 0.0          # no negative zero
    return a if np.isfinite(a).all() and a.any() else None


def _unit(packed: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(p, np.float64) for p in packed])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, embedding) -> (id, a, b, vec): 128-bit name and raw doubles, null if unusable."""
    for batch in batches:
        a, b, out = [], [], []
        for v in batch.column(1).to_pylist():
            got = _usable(v)
            if got is None:
                a.append(None), b.append(None), out.append(None)
                continue
            raw = got.tobytes()
            name = hashlib.blake2b(raw, digest_size=16).digest()
            a.append(int.from_bytes(name[:8], "little", signed=True))
            b.append(int.from_bytes(name[8:], "little", signed=True))
            out.append(raw)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
             pa.array(out, pa.binary())], names=["vec_id", "a", "b", "vec"])


def _filters(count: int, s: Settings):
    """(id, a, b, n, vec) -> the same with the sorted filters of the vector, FEW last if they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                vecs = rows.column(4).to_pylist()
                lists: list = [None] * len(vecs)
                for dim in {len(v) for v in vecs}:
                    at = [k for k, v in enumerate(vecs) if len(v) == dim]
                    t, size = design(count, dim // 8, s)
                    who, name = decode(_unit([vecs[k] for k in at]), t, size, s)
                    order = np.lexsort((name, who))
                    who, name = who[order], name[order]
                    edge = np.searchsorted(who, np.arange(len(at) + 1))
                    for p, k in enumerate(at):
                        lists[k] = name[edge[p]:edge[p + 1]]
                        if len(lists[k]) < s.fewest:
                            lists[k] = np.append(lists[k], FEW)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(lists, pa.list_(pa.int64()))],
                    names=[*rows.schema.names, "filters"])

    return run


def compare(here: int, units: np.ndarray, counts: np.ndarray, filters: list[np.ndarray],
            sides: np.ndarray | None, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each node counted in filter ``here``, spanning forest of the near pairs).

    ``sides`` tells the two blocks of a pair of blocks apart: only pairs across are compared.
    """
    n = len(units)
    near = units @ units.T >= threshold
    np.fill_diagonal(near, False)
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    if not near.any():
        return np.zeros(n, np.int64), []
    # pairs that share a lesser filter are counted there
    flat = np.concatenate(filters)
    who = np.repeat(np.arange(n), [len(f) for f in filters])
    less = flat < here
    names, inverse, times = np.unique(flat[less], return_inverse=True, return_counts=True)
    common = times[inverse] > 1
    who, inverse = who[less][common], inverse[common]
    _, inverse = np.unique(inverse, return_inverse=True)
    width = int(inverse.max()) + 1 if len(inverse) else 0
    earlier = np.zeros((n, n), bool)
    order = np.argsort(inverse, kind="stable")
    who, inverse = who[order], inverse[order]
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(inverse, [a, a + 4096])
        x = np.zeros((n, min(4096, width - a)), np.float32)
        x[who[lo:hi], inverse[lo:hi] - a] = 1
        earlier |= x @ x.T > 0
    links = (near & ~earlier).astype(np.int64) @ counts
    # breadth first over the near pairs
    forest, open_ = [], np.ones(n, bool)
    for root in range(n):
        if not open_[root]:
            continue
        open_[root] = False
        front = np.asarray([root])
        while len(front):
            found = near[front].any(axis=0) & open_
            front = np.flatnonzero(found)
            open_[front] = False
            forest.extend((root, int(k)) for k in front)
    return links, forest


NODE = "struct<id:bigint,a:bigint,b:bigint>"


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 settings: Settings | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    s = settings or Settings()
    rows = store(vectors.select(F.col(id_col).cast("long").alias("i"),
                                F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(
        _packed, "vec_id long, a long, b long, vec binary"), "vectors")
    nodes = store(rows.where("a IS NOT NULL").groupBy("a", "b", "vec").agg(
        F.min(F.coalesce("vec_id", F.lit(NO_ID))).alias("id"), F.count("*").alias("n")),
        "vector-nodes").select("id", "a", "b", "n", "vec")
    count = nodes.count()
    listed = store(nodes.mapInArrow(
        _filters(count, s),
        "id long, a long, b long, n long, vec binary, filters array<bigint>"), "cap-filters")
    node = F.struct("id", "a", "b").alias("node")
    passing = listed.select(node, F.explode("filters").alias("filter"))
    full = passing.groupBy("filter").agg(F.count("*").alias("m")).where("m > 1").select(
        "filter", F.ceil(F.col("m") / s.block_rows).cast("int").alias("blocks"))
    todo = passing.join(full, "filter").withColumn(
        "mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    todo = todo.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "filter", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), "node")
    few = F.element_at("filters", -1) == FEW
    fews = listed.where(few).count()
    if fews:
        # every block of the few meets every block of the others
        x, y = -(-fews // s.block_rows), -(-count // s.block_rows)
        own = F.pmod(F.xxhash64("node"), F.when(few, x).otherwise(y)).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.when(few, y).otherwise(x) - 1))
        wide = listed.select(node, few.alias("few"), "filters").withColumn("own", own).withColumn(
            "met", met).select(F.lit(REST).alias("filter"),
                               F.when(few, F.col("own")).otherwise(F.col("met")).alias("x"),
                               (F.when(few, F.col("met")).otherwise(F.col("own")) + x).alias("y"),
                               (~few).cast("int").alias("side"), "node")
        todo = todo.unionByName(wide)
    todo = todo.join(listed.select(node, "n", "vec", "filters"), "node").select(
        "filter", "x", "y", "side", "node", "n", "vec", "filters")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        held: list[tuple] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for dim in {len(h[3]) for h in held}:
                part = [h for h in held if len(h[3]) == dim]
                if len(part) < 2:
                    continue
                links, forest = compare(
                    last[0], _unit([h[3] for h in part]), np.asarray([h[2] for h in part]),
                    [np.asarray(h[4], np.int64) for h in part],
                    np.asarray([h[0] for h in part]) if last[1] != last[2] else None, s.threshold)
                out.extend((part[k][1], None, int(v)) for k, v in enumerate(links) if v)
                out.extend((part[i][1], part[j][1], 0) for i, j in forest)
            held.clear()
            if out:
                a, b, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, schema), "b": pa.array(b, schema),
                                                  "links": pa.array(v, pa.int64())})

        for batch in batches:
            schema = batch.schema.field(4).type
            cols = [batch.column(c).to_pylist() for c in range(8)]
            for key, x, y, side, who, n, vec, names in zip(*cols, strict=True):
                if (key, x, y) != last:
                    if last is not None:
                        yield from flush()
                    last = (key, x, y)
                held.append((side, who, n, vec, names))
        if last is not None:
            yield from flush()

    made = store(todo.repartition("filter", "x", "y").sortWithinPartitions("filter", "x", "y")
                 .mapInArrow(blocks, f"a {NODE}, b {NODE}, links long"), "cap-links")
    comps = connected_components(made.where("b IS NOT NULL").select("a", "b"))
    direct = made.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    known = store(nodes.select(node, "n").join(
        direct.withColumnRenamed("a", "node"), "node", "left").join(comps, "node", "left").select(
        "node.a", "node.b", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "node")["id"].alias("least")), "vector-classes")
    out = rows.select("vec_id", "a", "b").join(known, ["a", "b"], "left")
    component = F.when(F.col("a").isNull(), F.col("vec_id")).otherwise(
        F.when(F.col("least") != NO_ID, F.col("least")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))
