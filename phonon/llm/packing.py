"""Best-fit packing by hierarchical residual packing (operator 1).

Documents become token sequences of at most ``capacity`` ids. A document is
its ids plus an end id; only a document longer than the capacity is cut, into
full pieces with the remainder as the first piece.

How it runs
-----------
1. Each scan task encodes its texts and best-fit packs its pieces (longest
   first, each into the fullest bin that still holds it). The pieces, with
   their bin and place in it, are stored; full-length pieces are bins of
   their own.
2. Bins within ``slack`` of the capacity are done. The others become items of
   their fill, and rounds of a merge tree pack them again: the tasks' leftovers
   meet in groups of ``fan_in`` tasks, then groups of groups. No group gets
   more than about ``group_items`` items, and a bin that stayed as it was in two
   rounds is done too, so a level shrinks even where nothing fits together.
3. The rounds give small (child bin, parent bin, place) tables. They are
   composed, and one join on the bin id gives every piece its sequence.

Only ids, lengths and checksums travel; token ids only with ``with_ids``. With
windows of hundreds of pieces and more the result is that of one best-fit over
all pieces, to within a few sequences; windows of a dozen pieces cost a few per cent.

Defined results: a null text is empty and becomes the end id alone; null and
repeated ids are packed like others (a row is a document); an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonon.llm.common import arrow_slices, release_memory, store, text_batches
from phonon.llm.tokens import END_ID, encoder

CAPACITY = 2048
ROUND_SHIFT = 32        # a bin id: task or group (high bits), round, running number
TASK_SHIFT = 37


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, place in the bin, fill of each bin).

    Open bins are kept in one stack per free room; a bit mask of the rooms in
    use gives the tightest one that holds an item.
    """
    n = len(sizes)
    where, place, fills = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    order = np.argsort(-np.asarray(sizes), kind="stable")
    for k in order.tolist():
        size = int(sizes[k])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        where[k], place[k] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            rooms[left].append(b)
            mask |= 1 << left
    return where, place, np.asarray(fills, np.int64)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full pieces, the remainder first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, head if head and s == 0 else capacity) for s in starts]


def pieces_of(tokenizer_path: str, capacity: int, window: int, with_ids: bool):
    """Scan-side map: (id, text) -> packed pieces of a window of ``window`` pieces."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        base, made = TaskContext.get().partitionId() << TASK_SHIFT, 0
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            doc, piece, start, length, crc, ids = zip(*held, strict=True)
            where, place, fills = best_fit(np.asarray(length), capacity)
            for a in range(0, len(held), 20_000):
                part = slice(a, a + 20_000)
                cols = {"doc_id": pa.array(doc[part], pa.int64()),
                        "piece": pa.array(piece[part], pa.int32()),
                        "start": pa.array(start[part], pa.int64()),
                        "length": pa.array(length[part], pa.int64()),
                        "ids_crc32": pa.array(crc[part], pa.int64()),
                        "bin": pa.array(base + made + where[part]),
                        "place": pa.array(place[part]),
                        "fill": pa.array(fills[where[part]])}
                if with_ids:
                    cols["ids"] = pa.array(ids[part], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)
            made += len(fills)
            held.clear()

        for batch in batches:
            for rows in arrow_slices(batch, 1, most_bytes=3 << 20):
                for ident, packed in zip(rows.column(0).to_pylist(), enc.encode(rows.column(1)),
                                         strict=True):
                    packed += end
                    view = memoryview(packed)
                    for k, (s, n) in enumerate(cut(len(packed) // 4, capacity)):
                        part = view[4 * s:4 * (s + n)]
                        held.append((ident, k, s, n, zlib.crc32(part),
                                     bytes(part) if with_ids else None))
                if len(held) >= window:
                    yield from flush()
            release_memory(collect=False)
        if held:
            yield from flush()
        release_memory()

    return run


def merge_group(capacity: int, rnd: int):
    """One group of a merge round: best-fit its underfull bins as items."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin", kind="stable")
        fill = rows["fill"].to_numpy()
        where, place, fills = best_fit(fill, capacity)
        children = np.bincount(where, minlength=len(fills))
        fresh = (int(key[0]) << TASK_SHIFT) + (rnd << ROUND_SHIFT) + where
        alone = children[where] == 1
        return pd.DataFrame({
            "bin": rows["bin"].to_numpy(),
            "parent": np.where(alone, rows["bin"].to_numpy(), fresh),
            "place": place, "fill": fills[where], "part": int(key[0]),
            "age": np.where(alone, rows["age"].to_numpy() + 1, 0)})

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, slack: int = 8, fan_in: int = 8, group_items: int = 200_000,
         window: int = 100_000, with_ids: bool = False, max_rounds: int = 31) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    text_batches(docs.sparkSession)
    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, bin long, "
              "place long, fill long" + (", ids binary" if with_ids else ""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pieces = store(rows.mapInArrow(pieces_of(tokenizer_path, capacity, window, with_ids), schema),
                   "pieces")
    under = F.col("fill") < capacity - slack
    todo = pieces.where(under & (F.col("place") == 0)).select(
        "bin", "fill", F.shiftright("bin", TASK_SHIFT).cast("int").alias("part"),
        F.lit(0).alias("age"))
    size = todo.agg(F.count("*").alias("n"), F.max("part").alias("p")).first()
    left, groups = size["n"], (size["p"] or 0) + 1
    moved: DataFrame | None = None          # (bin of a piece, sequence so far, place in it)
    for rnd in range(1, max_rounds + 1):
        if left < 2:
            break
        fewer = max(-(-groups // fan_in), -(-left // group_items))
        fewer = min(fewer, groups) if groups > 1 else 1
        step = todo.withColumn(
            "part", F.floor(F.col("part") * fewer / groups).cast("int")).groupBy("part")
        step = store(step.applyInPandas(
            merge_group(capacity, rnd),
            "bin long, parent long, place long, fill long, part int, age int"), f"merge{rnd}")
        link = step.where("bin <> parent").select("bin", "parent", "place")
        if moved is None:
            moved = link
        else:
            nxt = link.select(F.col("bin").alias("parent"), F.col("parent").alias("up"),
                              F.col("place").alias("by"))
            moved = moved.join(nxt, "parent", "left").select(
                "bin", F.coalesce("up", "parent").alias("parent"),
                (F.col("place") + F.coalesce("by", F.lit(0))).alias("place")).unionByName(link)
        if fewer == 1:
            break
        todo = step.where(under & (F.col("place") == 0) & (F.col("age") < 2)).select(
            F.col("parent").alias("bin"), "fill", "part", "age")
        left, groups = todo.count(), fewer
    out = pieces
    if moved is not None:
        up = moved.select("bin", F.col("parent"), F.col("place").alias("by"))
        out = pieces.join(up, "bin", "left")
    else:
        out = pieces.withColumns({"parent": F.lit(None).cast("long"), "by": F.lit(0)})
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("parent", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("by", F.lit(0))).cast("long").alias("offset"),
        *(["ids"] if with_ids else []))
