"""Permuted columns in packed blocks of rows.

Every trial moves the values of one column by its own permutation of the row numbers. Rows travel
in blocks of consecutive numbers: a task takes its rows' numbers back through each permutation and
sends every block the values its rows take, in the order of the numbers they come from. The block
takes its own numbers forward and knows from them which value belongs to which row, so only the
values travel, without numbers or the rows' other columns. Trees see no more of a value than the interval
between their cut points, so for them it travels as that interval's number, and the block scores
all trials from tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS, LEAST_ROWS = 1 << 17, 1 << 12
MOST_BYTES = 64 << 20                 # of rows that a block gives when it gives all rows of all trials
SLICE = 4096
MOST_DEPTH = 3                        # a tree has 7 splits at most


# ---------------------------------------------------------------- permutations of numbers

def grid(n: int) -> tuple[int, int]:
    """Sides of the grid just over n that a Feistel network works on."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, max(1, -(-n // a))


def round_tables(spark: SparkSession, n: int, keys: list[Column], rounds: int = 4) -> np.ndarray:
    """(keys, rounds, half) what each round of ``train.feistel`` adds for each half: sqrt(n) numbers a round."""
    a, b = grid(n)
    row = F.transform(F.array(*keys), lambda key: F.array(*[
        F.pmod(F.xxhash64("id", key, F.lit(r)), F.lit((a, b)[r % 2])).cast("int") for r in range(2 * rounds)]))
    got = spark.range(0, max(a, b), numPartitions=1).select(F.flatten(row).alias("t")).toArrow().column("t")
    flat = np.concatenate([c.flatten().to_numpy() for c in got.chunks])
    return np.ascontiguousarray(flat.reshape(max(a, b), len(keys), 2 * rounds).transpose(1, 2, 0)).astype(np.int64)


def moved(v: np.ndarray, n: int, table: np.ndarray, back: bool = False) -> np.ndarray:
    """The numbers that ``train.feistel`` maps ``v`` to, or comes ``back`` from."""
    a, b = grid(n)

    def once(v: np.ndarray) -> np.ndarray:
        y = v // a
        x = v - y * a
        for r in range(len(table) - 1, -1, -1) if back else range(len(table)):
            half, other, side = (y, x, b) if r % 2 else (x, y, a)
            step = table[r][other]
            if back:
                half -= step
                np.add(half, side, out=step)
            else:
                half += step
                np.subtract(half, side, out=step)
            # of the two only one is in 0 .. side - 1, the other is larger, or negative and so larger unsigned
            np.minimum(half.view(np.uint64), step.view(np.uint64), out=half.view(np.uint64))
        return y * a + x

    out = np.concatenate([once(v[at:at + SLICE]) for at in range(0, len(v), SLICE)])
    while len(beyond := np.flatnonzero(out >= n)):
        out[beyond] = once(out[beyond])
    return out


# ---------------------------------------------------------------- trees as tables

class TreeTables:
    """An ensemble of trees of at most MOST_DEPTH levels of splits as tables.

    ``cuts`` has the cut points of each feature; a value's code is the number of them below it. A tree's splits
    are the bits of a number, set where the row goes right: ``bits[feature][tree][code]`` has those of the
    feature's splits, ``leaves[tree]`` the weighted leaf of every number.
    """

    def __init__(self, trees: list[dict], width: int):
        splits = [[k for k, left in enumerate(t["left"]) if left >= 0] for t in trees]
        self.cuts = [np.array(sorted({t["threshold"][k] for t, s in zip(trees, splits, strict=True) for k in s
                                      if t["feature"][k] == f}), float) for f in range(width)]
        self.bits = [np.zeros((len(trees), len(c) + 1), np.uint8) for c in self.cuts]
        self.leaves = []
        for i, (t, nodes) in enumerate(zip(trees, splits, strict=True)):
            bit = {k: 1 << j for j, k in enumerate(nodes)}
            for k in nodes:
                f = t["feature"][k]
                self.bits[f][i, np.searchsorted(self.cuts[f], t["threshold"][k]) + 1:] |= bit[k]
            self.leaves.append(np.zeros(1 << len(nodes)))
            for number in range(1 << len(nodes)):
                k = 0
                while t["left"][k] >= 0:
                    k = t["right"][k] if number & bit[k] else t["left"][k]
                self.leaves[i][number] = t["value"][k] * t["weight"]
        self.code = np.min_scalar_type(max(map(len, self.cuts)))
        # by feature and tree: (code, what the tree gives more from this code on than below it), by number
        self.jumps = [[[(c, leaves[np.arange(len(leaves)) | own[c]] - leaves[np.arange(len(leaves)) | own[c - 1]])
                        for c in np.flatnonzero(np.diff(own)) + 1] for own, leaves in zip(bits, self.leaves, strict=True)]
                      for bits in self.bits]

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], side="left").astype(self.code) for f, c in enumerate(self.cuts)]

    def errors(self, own: list[np.ndarray], label: np.ndarray, values: Callable[[int, int], np.ndarray],
               repeats: int) -> np.ndarray:
        """Sums of squared errors of all trials of a block; ``values(f, r)`` are those moved to its rows.

        A row's prediction at every code of a feature is that at code 0 and the sum of the jumps up to the code.
        """
        total = np.zeros(len(own) * repeats)
        new = [[values(f, r) for r in range(repeats)] for f in range(len(own))]
        for at in range(0, len(label), SLICE):
            y = label[at:at + SLICE]
            numbers = np.zeros((len(self.leaves), len(y)), np.uint8)
            for bits, codes in zip(self.bits, own, strict=True):
                numbers |= bits.take(codes[at:at + SLICE].astype(np.intp), axis=1)
            for f, jumps in enumerate(self.jumps):
                at_code = np.zeros((len(self.cuts[f]) + 1, len(y)))
                for number, leaves, steps, bits in zip(numbers, self.leaves, jumps, self.bits[f], strict=True):
                    others = (number & ~bits[-1]).astype(np.intp)         # beyond all cuts all of its bits are set
                    at_code[0] += leaves[others]
                    for c, step in steps:
                        at_code[c] += step[others]
                np.cumsum(at_code, axis=0, out=at_code)
                for r in range(repeats):
                    error = y - at_code.ravel().take(new[f][r][at:at + SLICE].astype(np.intp) * len(y) + np.arange(len(y)))
                    total[f * repeats + r] += error @ error
        return total


# ---------------------------------------------------------------- the exchange

def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(first number, features, labels) of runs of consecutive row numbers, at most about BLOCK_ROWS long."""
    def cut(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        i = t.column("_i").to_numpy()
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(i), width)
        edges = [0, *(np.flatnonzero(np.diff(i) != 1) + 1).tolist(), len(i)]
        for lo, hi in zip(edges, edges[1:]):
            yield int(i[lo]), x[lo:hi], t.column("label").slice(lo, hi - lo)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= BLOCK_ROWS:
            yield from cut(held)
            held, n = [], 0
    if held:
        yield from cut(held)


def trials(rows: DataFrame, n: int, width: int, keys: list[list[Column]], tables: TreeTables | None) -> DataFrame:
    """All trials of ``rows`` (dense numbers ``_i``, array ``x`` of ``width`` doubles, ``label``).

    ``keys`` has a feature's keys, one a repeat; trials are numbered through, a feature's repeats together. With
    ``tables``: (trial, sse) per block, over the rows with a label. Without: (trial, x, label) for every row of
    every trial.
    """
    spark, repeats = rows.sparkSession, len(keys[0])
    count = width * repeats
    size = min(BLOCK_ROWS, max(LEAST_ROWS, -(-n // (4 * spark.sparkContext.defaultParallelism))))
    if tables is None:
        size = min(size, max(1, MOST_BYTES // (8 * (width + 2) * count)))
    blocks = max(1, -(-n // size))
    code = np.dtype(float) if tables is None else tables.code
    held = spark.sparkContext.broadcast((round_tables(spark, n, [k for ks in keys for k in ks]), tables))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, tables = held.value
        for start, x, label in _runs(batches, width):
            values = [np.ascontiguousarray(c) for c in x.T] if tables is None else tables.codes(x)
            out = []
            known = label.is_valid().to_numpy()
            label = label.fill_null(0.0).to_numpy()
            for b in range(start // size, (start + len(x) - 1) // size + 1):      # the rows as they are
                part = slice(max(0, b * size - start), (b + 1) * size - start)
                out.append((b, start + part.start, len(label[part]), b"".join(
                    [label[part].tobytes(), known[part].tobytes(), *(v[part].tobytes() for v in values)])))
            sent, ends = [], np.zeros((count, blocks + 1), np.int64)
            numbers = np.arange(start, start + len(x))
            for t in range(count):
                to = moved(numbers, n, steps[t], back=True) // size
                to = to.astype(np.uint16) if blocks < 1 << 16 else to
                sent.append(values[t // repeats][np.argsort(to, kind="stable")])
                np.cumsum(np.bincount(to, minlength=blocks), out=ends[t, 1:])
            for b in range(blocks):
                parts = [v[lo:hi].tobytes() for v, lo, hi in zip(sent, ends[:, b], ends[:, b + 1], strict=True)]
                if any(parts):
                    lengths = (ends[:, b + 1] - ends[:, b]).astype(np.int32)
                    out.append((b, start, 0, lengths.tobytes() + b"".join(parts)))
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(
                    zip(*out[at:at + 256], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                    names=["block", "start", "rows", "data"])

    def take(table: pa.Table) -> pa.Table:
        steps, tables = held.value
        block = table.column("block")[0].as_py()
        order = np.lexsort((-table.column("rows").to_numpy(), table.column("start").to_numpy()))
        got = table.take(pa.array(order))
        own, sent = [], []
        for rows_here, data in zip(got.column("rows").to_pylist(), got.column("data").to_pylist(), strict=True):
            if rows_here:
                at, parts = 0, []
                for kind in (np.dtype(float), np.dtype(bool), *[code] * width):
                    parts.append(np.frombuffer(data, kind, rows_here, at))
                    at += rows_here * kind.itemsize
                own.append(parts)
            else:
                ends = np.cumsum([0, *np.frombuffer(data, np.int32, count)])
                sent.append((ends, np.frombuffer(data, code, ends[-1], 4 * count)))
        label, known, *values = (np.concatenate(c) for c in zip(*own, strict=True))
        numbers = block * size + np.arange(len(label))

        def value(f: int, r: int) -> np.ndarray:
            t = f * repeats + r
            out = np.empty(len(label), code)
            out[np.argsort(moved(numbers, n, steps[t]))] = np.concatenate([v[e[t]:e[t + 1]] for e, v in sent])
            return out

        if tables is not None:
            sse = tables.errors([v[known] for v in values], label[known], lambda f, r: value(f, r)[known], repeats)
            return pa.table({"trial": pa.array(range(count), pa.int32()), "sse": sse})
        x = np.empty((count, len(label), width))
        for t in range(count):
            x[t] = np.stack(values, axis=1)
            x[t, :, t // repeats] = value(*divmod(t, repeats))
        return pa.table({
            "trial": pa.array(np.repeat(np.arange(count, dtype=np.int32), len(label))),
            "x": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), pa.array(x.ravel())),
            "label": pa.array(np.tile(label, count), mask=np.tile(~known, count))})

    sent = rows.select("_i", "x", "label").mapInArrow(send, "block long, start long, rows int, data binary")
    return sent.repartition(blocks, "block").groupBy("block").applyInArrow(
        take, "trial int, sse double" if tables is not None else "trial int, x array<double>, label double")
