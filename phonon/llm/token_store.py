"""Token-id files with a minimal perfect hash index (operator 4).

Layout of a store (a folder on shared storage):

* ``<shard>.ids``  raw payload: little-endian unsigned ids of the shard's
  documents, one after the other in ascending key order, each document closed
  by the end id; 16 bits an id where the vocabulary fits, else 32.
* ``<shard>.idx``  index, numpy arrays: the id width, the sorted keys (null keys first),
  the payload offset of every record, and a minimal perfect hash from key to
  slot. A slot stores a 32-bit fingerprint of its key, the key's first record
  and its number of records (more than one only for repeated keys).
* ``manifest``     Parquet: shard, file stem, key range, numbers of records
  and ids. Only files named there count; a lost or repeated task leaves at
  most an unnamed file behind.

Writing sorts the documents by key (range partitions of about equal bytes), encodes and
writes one shard per task. Null keys and a key of many records are spread over as many
shards as they need. The hash is built level by level: keys alone in their place
of a bit array are settled there, the others go to the next level; a slot is
the rank of the key's bit. A lookup costs a fixed expected number of probes, a
fingerprint comparison and one range read.

Defined results: null text is empty (the end id alone); rows with a null key
are stored first and cannot be looked up; repeated keys keep all their records;
an empty table gives an empty store; texts are encoded whole, however long; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonon.llm.common import arrow_slices
from phonon.llm.tokens import END_ID, encoder
from phonon.session import scratch_path

ROW_BYTES = 32                    # what a row weighs besides its text when shards are sized
MANIFEST = ("shard int, stem string, min_key long, max_key long, n_null long, n_docs long, "
            "n_ids long")
U64 = np.uint64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of the keys under a seed (a bijection for each seed)."""
    x = keys.astype(np.int64).view(U64) + U64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000_003) >> U64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: levels of bit arrays and their ranks."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> None:
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.7) -> PerfectHash:
        left, sizes, bits = np.asarray(keys, np.int64), [], []
        while len(left):
            size = -(-max(64, int(gamma * len(left))) // 64) * 64
            at = (mix(left, len(sizes)) % U64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        words = np.packbits(flat, bitorder="little").view(np.uint64) if len(flat) else np.zeros(0, U64)
        ones = np.bitwise_count(words).astype(np.int64)
        return cls(np.asarray(sizes, np.int64), words, np.cumsum(ones) - ones)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level holds its bit (the key is surely absent)."""
        keys = np.asarray(keys, np.int64)
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = (mix(keys[todo], level) % U64(size)).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1))).astype(np.int64)
            out[todo[hit]] = (self.ranks[at >> 6] + below)[hit]
            todo, base = todo[~hit], base + size
        return out


def index_bytes(keys: np.ndarray, n_null: int, lengths: np.ndarray, width: int = 4) -> bytes:
    """Serialised index of a shard whose records have these keys (nulls first, as 0) and lengths."""
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    distinct, first, run = np.unique(keys[n_null:], return_index=True, return_counts=True)
    hashed = PerfectHash.build(distinct)
    slot = hashed.slots(distinct)
    prints = np.zeros(len(distinct), np.uint32)
    records, runs = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    prints[slot], records[slot], runs[slot] = fingerprints(distinct), first + n_null, run
    buf = io.BytesIO()
    np.savez(buf, width=np.int64(width), keys=keys, n_null=np.int64(n_null), offsets=offsets, sizes=hashed.sizes,
             words=hashed.words, ranks=hashed.ranks, prints=prints, records=records, runs=runs)
    return buf.getvalue()


class ShardIndex:
    """Keyed access to one shard: record numbers by perfect hash, offsets by record."""

    def __init__(self, data: bytes) -> None:
        z = np.load(io.BytesIO(data))
        self.keys, self.n_null, self.offsets = z["keys"], int(z["n_null"]), z["offsets"]
        self.width = int(z["width"])
        self.hash = PerfectHash(z["sizes"], z["words"], z["ranks"])
        self.prints, self.records, self.runs = z["prints"], z["records"], z["runs"]

    def read(self, payload: pa.NativeFile, first: int, last: int) -> tuple[int, memoryview]:
        """(payload offset, packed 32-bit ids) of records ``first`` to ``last`` - 1."""
        lo, hi = int(self.offsets[first]), int(self.offsets[last])
        raw = payload.read_at((hi - lo) * self.width, lo * self.width)
        ids = np.frombuffer(raw, f"<u{self.width}").astype("<u4", copy=False)
        return lo, memoryview(ids.tobytes())

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first record, number of records) of each key; -1 and 0 where it is not stored."""
        keys = np.asarray(keys, np.int64)
        slot = self.hash.slots(keys)
        safe = np.maximum(slot, 0)
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        ok = (slot >= 0) & (self.prints[safe] == fingerprints(keys))
        return np.where(ok, self.records[safe], -1), np.where(ok, self.runs[safe], 0)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write_shard(folder: str, tokenizer_path: str, width: int):
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (store, root) = encoder(tokenizer_path), _open(folder)
        shard = TaskContext.get().partitionId()
        stem = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        keys: list[np.ndarray] = []
        lengths: list[int] = []
        n_null = 0
        out = None
        for batch in batches:
            if out is None:
                out = store.open_output_stream(f"{root}/{stem}.ids")
            for rows in arrow_slices(batch, 1):
                col = rows.column(0)
                n_null += col.null_count
                keys.append(col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                packed = [p + end for p in enc.encode(rows.column(1))]
                lengths.extend(len(p) // 4 for p in packed)
                ids = np.frombuffer(b"".join(packed), "<u4")
                out.write(ids.astype(f"<u{width}", copy=False).tobytes())
        if out is None:
            return
        out.close()
        every = np.concatenate(keys)
        with store.open_output_stream(f"{root}/{stem}.idx") as f:
            f.write(index_bytes(every, n_null, np.asarray(lengths, np.int64), width))
        real = every[n_null:]
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "stem": [stem],
            "min_key": pa.array([int(real[0]) if len(real) else None], pa.int64()),
            "max_key": pa.array([int(real[-1]) if len(real) else None], pa.int64()),
            "n_null": pa.array([n_null], pa.int64()), "n_docs": pa.array([len(every)], pa.int64()),
            "n_ids": pa.array([int(sum(lengths))], pa.int64())})

    return run


def write_store(docs: DataFrame, tokenizer_path: str, folder: str | None = None,
                id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20) -> str:
    """Encode and write ``docs`` in ascending key order; returns the store's folder. A shard holds about
    ``shard_bytes`` of text (and row overhead), whatever the table's size and keys."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    folder = folder or scratch_path(spark, f"llm-token-store-{uuid.uuid4().hex}")
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("i"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + ROW_BYTES).alias("n")).first()["n"] or 0
    # the text's hash and the row number split a key that holds many rows over several shards
    order = [F.col("i"), F.xxhash64("t"), F.col("n")]
    shards = (rows.withColumn("n", F.monotonically_increasing_id())
              .repartitionByRange(max(1, -(-size // shard_bytes)), *order)
              .sortWithinPartitions(*order).select("i", "t")
              .mapInArrow(_write_shard(folder, tokenizer_path, width), MANIFEST))
    shards.write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> list[dict]:
    """One entry per shard in key order, with the number of ids before it (``base``)."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("shard").collect()
    out, base = [], 0
    for r in rows:
        out.append({**r.asDict(), "base": base})
        base += r["n_ids"]
    return out


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    known = manifest(spark, folder)
    made = spark.createDataFrame([(m["shard"], m["stem"], m["base"]) for m in known],
                                 "shard int, stem string, base long")
    return made.repartition(max(1, len(known)), "shard")


def read_store(spark: SparkSession, folder: str, with_ids: bool = False,
               read_bytes: int = 8 << 20) -> DataFrame:
    """Every record from the files: (doc_id, start, n_tokens, ids_crc32[, ids]).

    Each key goes through the perfect hash and its fingerprint; ``start`` counts
    the ids of all records before it in the whole store.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['stem']}.idx") as f:
                    index = ShardIndex(f.read())
                offsets, n = index.offsets, len(index.offsets) - 1
                record, runs = index.find(index.keys[index.n_null:])
                at = np.arange(index.n_null, n)
                if ((at < record) | (at >= record + runs)).any():
                    raise ValueError(f"index of {row['stem']} does not find its own keys")
                with store.open_input_file(f"{root}/{row['stem']}.ids") as f:
                    a = 0
                    while a < n:
                        b = int(np.searchsorted(offsets, offsets[a] + read_bytes // 4, "right")) - 1
                        b = min(max(b, a + 1), n)
                        lo, view = index.read(f, a, b)
                        parts = [view[4 * (int(offsets[k]) - lo):4 * (int(offsets[k + 1]) - lo)]
                                 for k in range(a, b)]
                        mask = np.arange(a, b) < index.n_null
                        cols = {"doc_id": pa.array(index.keys[a:b], mask=mask),
                                "start": pa.array(row["base"] + offsets[a:b]),
                                "n_tokens": pa.array(np.diff(offsets[a:b + 1])),
                                "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
                        if with_ids:
                            cols["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
                        yield pa.RecordBatch.from_pydict(cols)
                        a = b

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (
        ", ids binary" if with_ids else "")
    return _shards(spark, folder).mapInArrow(run, schema)


def lookup(keys: DataFrame, folder: str, key_col: str = "doc_id") -> DataFrame:
    """(key, ids binary) of the stored records of each distinct key of ``keys``."""
    spark = keys.sparkSession
    known = [m for m in manifest(spark, folder) if m["max_key"] is not None]
    lows, highs = (np.asarray([m[end] for m in known], np.int64) for end in ("min_key", "max_key"))
    stems = [m["stem"] for m in known]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            # a key with many records goes on in the shards behind its first one
            first, end = np.searchsorted(highs, k, "left"), np.searchsorted(lows, k, "right")
            runs = np.maximum(end - first, 0)
            at = np.repeat(first, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.repeat(k, runs)), "at": pa.array(at)})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        index, last = None, -1
        for batch in batches:
            got_keys, got_ids = [], []
            for at in np.unique(batch.column(1)):
                keys_here = batch.filter(pa.compute.equal(batch.column(1), at)).column(0).to_numpy()
                if at != last:
                    with store.open_input_file(f"{root}/{stems[at]}.idx") as f:
                        index, last = ShardIndex(f.read()), at
                record, runs = index.find(keys_here)
                with store.open_input_file(f"{root}/{stems[at]}.ids") as f:
                    for key, r, c in zip(keys_here.tolist(), record.tolist(), runs.tolist(),
                                         strict=True):
                        for k in range(r, r + c):
                            got_keys.append(key)
                            got_ids.append(bytes(index.read(f, k, k + 1)[1]))
            yield pa.RecordBatch.from_pydict({"key": pa.array(got_keys, pa.int64()),
                                              "ids": pa.array(got_ids, pa.binary())})

    distinct = keys.select(F.col(key_col).cast("long").alias("key")).where("key IS NOT NULL").distinct()
    return (distinct.mapInArrow(place, "key long, at long").repartition("at")
            .sortWithinPartitions("at").mapInArrow(fetch, "key long, ids binary"))
