"""Helpers shared by the corpus operators: stored tables, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonon.session import scratch_path

# Rows per stored file are left to the writer; a stored table is read back
# with its exact schema, so no inference job runs.


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage).

    The folder comes from ``spark.checkpoint.dir``; a lost executor costs
    nothing because the files are on shared storage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that clash with no column of ``df`` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        new = f"__{name}"
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        out.append(new)
    return out


_KEPT: dict[str, dict] = {}


def kept_in_worker(owner: str) -> dict:
    """What a Python worker keeps between the tasks of one operator (tokenizers, memories).

    Workers outlive stages. When a task of another operator begins, what the
    earlier one kept is let go, so that a job of many stages needs no more
    memory than its largest stage.
    """
    if owner not in _KEPT:
        for other in _KEPT.values():
            other.clear()
        _KEPT.clear()
        _KEPT[owner] = {}
        release_memory()
    return _KEPT[owner]


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let rows that hold whole texts travel in small Arrow batches, on both sides of the pipe.

    Spark's default of 10,000 rows is 30 MB of ordinary documents a batch, and several times that
    while it is built. A session that sets its own number keeps it.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(rows))


def release_memory(collect: bool = True) -> None:
    """Give freed memory of this worker back to the machine."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):      # another C library
        pass


def arrow_slices(batch: pa.RecordBatch, column: int | pa.Array, most_rows: int = 4000,
                 most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded rows and bytes of the strings or binaries of ``column``, a
    position or the values themselves (a longer value is a part of its own)."""
    values = batch.column(column) if isinstance(column, int) else column
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and (k - start >= most_rows or held + n > most_bytes):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_map(df: DataFrame, column: str, run: Callable[[list], list], added: list[T.StructField],
              owner: str) -> DataFrame:
    """``df`` and the columns ``added``, computed by ``run`` from the values of ``column``.

    ``run`` gets the values of a slice and returns one Arrow array for each
    added column. Rows travel as Arrow slices of bounded rows and bytes;
    columns go by position, so their names never matter.
    """
    names = df.columns
    plain = [f"c{k}" for k in range(len(names))]
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, df.schema, strict=True)]
                          + [T.StructField(f"a{k}", f.dataType) for k, f in enumerate(added)])
    at = names.index(column)
    labels = [f.name for f in schema]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker(owner)
        for batch in batches:
            for part in arrow_slices(batch, at):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *run(part.column(at).to_pylist())], names=labels)
        release_memory()

    return df.toDF(*plain).mapInArrow(each, schema).toDF(*names, *[f.name for f in added])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable, for every node of ``edges`` (a, b).

    Alternating large-star / small-star rounds on the edge table; every round
    is a few shuffles of id pairs, written to the shared folder. The number of
    rounds grows with the logarithm of the component size. Neighbour lists are
    never collected: a hub costs one row of a partially aggregated minimum and
    a join that adaptive execution can split.
    """
    cur = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = store(cur, "cc0")
    mark = None
    for rnd in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store(large.where("a <> b").distinct(), f"cc-large{rnd}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))))
        cur = store(small.where("a <> b").distinct(), f"cc{rnd + 1}")
        now = cur.agg(F.count("*").alias("n"),
                      F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]):
            break
        mark = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    # settled: every edge is (node, root)
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
