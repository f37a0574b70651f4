"""Exact dedup with Patricia-trie owners (operator 10).

Two texts are equal when they are identical after deleting the characters
space and U+0009..U+000D. Of equal texts the row with the most code points in
the original text, then the smallest id, owns the group.

How it runs
-----------
1. Every scan task inserts its normalised byte strings into a Patricia trie
   and emits one row per distinct text of a window (bounded rows and bytes),
   with the ids it stands for. A text that fills a third of the corpus so
   reaches the shuffle as one row per window.
2. Those rows are shuffled by (length, content hash). Each task inserts the
   full byte strings into a trie; a terminal node holds the best candidate
   seen (most code points, smallest id) and the group size. Equality is
   decided by the bytes in the trie, never by the hash alone.
3. When a trie outgrows its memory budget its largest subtree is spilled: its
   terminals, and every later row under the same first byte, are written out
   and go through another round with eight times the partitions.
4. Owners and members are small rows (digests and ids, no texts); they meet
   in one join on the digest and the members are expanded after it.

Defined results: null text counts as empty; null ids sort last and group like
others; of fully tied rows (same id, same text) exactly one is kept; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonon.llm.common import arrow_slices, kept_in_worker, release_memory, store, text_batches

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

# One distinct text of a window of a scan task. ``row`` is carried only when whole rows are wanted.
LOCAL = (
    "norm_len long, hash long, text binary, sha binary, cls int, size long, best_chars long, "
    "best_id long, owner_lid long, owner_pos int, lid long, members array<bigint>")
# kind m: members of a local group; o: owner of a text; s: spilled, to be done again.
KIND = T.StructField("kind", T.StringType())


# Owner slots: digest, length, hash, class, size, code points, id, window, place, carried row and bytes.
ROW, CARRIED = 9, 10


class Rows:
    """Carried rows as positions in Arrow arrays; rows given up are compacted away."""

    def __init__(self) -> None:
        self.parts: list[pa.Array] = []
        self.live = 0

    def add(self, rows: pa.Array) -> int:
        self.parts.append(rows)
        return len(self.parts) - 1

    def take(self, places: list[tuple[int, int]]) -> pa.Array:
        """The rows at (part, position), in that order."""
        starts, at = [], 0
        for p in self.parts:
            starts.append(at)
            at += len(p)
        got = pa.chunked_array(self.parts).take(pa.array([starts[a] + b for a, b in places], pa.int64()))
        return got.combine_chunks() if got.num_chunks != 1 else got.chunk(0)

    def compact(self, slots: Iterator[list], least: int = 4096) -> None:
        """Keep only the rows that ``slots`` stand for, once most of the held ones are others."""
        if sum(map(len, self.parts)) <= 2 * self.live + least:
            return
        kept = [s for s in slots if s[ROW] is not None]
        self.parts = [self.take([s[ROW] for s in kept])] if kept else []
        for k, s in enumerate(kept):
            s[ROW] = (0, k)


class Trie:
    """Compressed radix trie over byte strings; ``insert`` returns the terminal's slot."""

    __slots__ = ("root", "held", "terminals")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]     # label, children by first byte, slot
        self.held = 0
        self.terminals = 0

    def insert(self, key: bytes) -> list:
        node, pos, end = self.root, 0, len(key)
        while pos < end:
            child = node[1].get(key[pos])
            if child is None:
                leaf = [key[pos:], {}, []]
                node[1][key[pos]] = leaf
                self.held += end - pos + 300
                self.terminals += 1
                return leaf[2]
            label = child[0]
            if key.startswith(label, pos):
                node, pos = child, pos + len(label)
                continue
            cut = shared_prefix(label, key, pos)
            upper = [label[:cut], {label[cut]: child}, None]
            child[0] = label[cut:]
            node[1][key[pos]] = upper
            self.held += 200
            node, pos = upper, pos + cut
        if node[2] is None:
            node[2] = []
            self.terminals += 1
        return node[2]

    def walk(self, node: list | None = None) -> Iterator[tuple[bytes, list]]:
        """(key, slot) of all terminals at or below ``node``, a child of the root or the root
        itself (explicit stack: keys can be deep). Keys are put together from their labels."""
        stack = [(node or self.root, b"")]
        while stack:
            (label, children, slot), above = stack.pop()
            key = above + label
            if slot is not None:
                yield key, slot
            stack.extend([(c, key) for c in children.values()])

    def slots(self, node: list | None = None) -> Iterator[list]:
        stack = [node or self.root]
        while stack:
            _, children, slot = stack.pop()
            if slot is not None:
                yield slot
            stack.extend(children.values())

    def weight(self, node: list) -> int:
        """Bytes held at or below ``node``, with what slots of owner rounds carry."""
        total, stack = 0, [node]
        while stack:
            label, children, slot = stack.pop()
            total += len(label) + 300 + (slot[CARRIED] if slot and len(slot) > CARRIED else 0)
            stack.extend(children.values())
        return total

    def drop(self, first: int) -> list | None:
        node = self.root[1].pop(first, None)
        if node is not None:
            self.held -= self.weight(node)
            self.terminals -= sum(1 for _ in self.slots(node))
        return node


def shared_prefix(label: bytes, key: bytes, pos: int) -> int:
    """Length of the common prefix of ``label`` and ``key[pos:]`` by halving."""
    low, high = 0, min(len(label), len(key) - pos)
    while low < high:
        mid = (low + high + 1) // 2
        if key[pos + low:pos + mid] == label[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def better(chars: int, ident: int | None, than_chars: int, than_id: int | None) -> bool:
    """Most code points first, then the smallest id (null last)."""
    if chars != than_chars:
        return chars > than_chars
    return ident is not None and (than_id is None or ident < than_id)


ARROW = [("norm_len", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()),
         ("sha", pa.binary()), ("cls", pa.int32()), ("size", pa.int64()),
         ("best_chars", pa.int64()), ("best_id", pa.int64()), ("owner_lid", pa.int64()),
         ("owner_pos", pa.int32()), ("lid", pa.int64()), ("members", pa.list_(pa.int64()))]


def _batch(rows: list[tuple], schema: pa.Schema, carried: pa.Array | None = None) -> pa.RecordBatch:
    fields = list(schema)[:len(schema) - 1] if carried is not None else list(schema)
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    made = [pa.array(c, type=f.type) for c, f in zip(cols, fields, strict=True)]
    return pa.RecordBatch.from_arrays(made + ([carried] if carried is not None else []), schema=schema)


def local_groups(window_bytes: int, window_rows: int, carry: bool):
    """Scan-side combine: (id, text bytes, code points[, row]) -> one row per distinct text of a
    window. With ``carry`` the best row travels whole and the text is taken from it later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("exact_dedup")
        base = TaskContext.get().partitionId() << 33
        trie, rows, seen, lid, schema = Trie(), Rows(), 0, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            # slot: best chars, best id, best position, members, place of the best row
            nonlocal lid
            out, places, held = [], [], 0
            for norm, (chars, ident, at, members, place) in trie.walk():
                sha = hashlib.sha256(norm).digest()
                mine = base + lid
                lid += 1
                out.append((len(norm), int.from_bytes(sha[:8], "little", signed=True),
                            None if carry else norm, sha, 0, len(members), chars, ident, mine, at, mine,
                            None if carry else members))
                places.append(place)
                held += len(norm)
                if held > 8 << 20 or len(out) >= 4000:
                    yield _batch(out, schema, rows.take(places) if carry else None)
                    out, places, held = [], [], 0
            if out:
                yield _batch(out, schema, rows.take(places) if carry else None)

        for batch in batches:
            if schema is None:
                more = [("row", batch.schema.field(3).type)] if carry else []
                schema = pa.schema(ARROW + more)
            for part in arrow_slices(batch, 1):
                held = rows.add(part.column(3)) if carry else 0
                for k, (ident, text, chars) in enumerate(zip(
                        part.column(0).to_pylist(), part.column(1).to_pylist(),
                        part.column(2).to_pylist(), strict=True)):
                    slot = trie.insert(text.translate(None, BLANKS))
                    seen += 1
                    if not slot:
                        slot.extend((chars, ident, 0, [ident], (held, k)))
                    else:
                        if better(chars, ident, slot[0], slot[1]):
                            slot[0], slot[1], slot[2], slot[4] = chars, ident, len(slot[3]), (held, k)
                        slot[3].append(ident)
                if trie.held > window_bytes or seen >= window_rows:
                    yield from flush()
                    trie, rows, seen = Trie(), Rows(), 0
        if seen:
            yield from flush()
        del trie, rows
        release_memory()

    return run


def owner_round(trie_bytes: int, text_at: int | None):
    """Insert the texts of a (length, hash) partition; emit members, owners and spilled rows.

    ``text_at`` is the place of the text inside carried rows (None: rows are not carried).
    """
    carry = text_at is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("exact_dedup")
        trie, rows, spilled, classes, schema = Trie(), Rows(), set(), {}, None
        out: list[tuple] = []
        places: list[tuple[int, int]] = []

        def owner(key: bytes, slot: list, kind: str) -> None:
            sha, length, hashed, cls, size, chars, ident, lid, pos, place, _ = slot
            out.append((kind, length, hashed, key if kind == "s" and not carry else None, sha, cls,
                        size, chars, ident, lid, pos, None, None))
            places.append(place)

        def drain(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) > least:
                yield _batch(out, schema, rows.take(places) if carry else None)
                out.clear()
                places.clear()

        for batch in batches:
            if schema is None:
                more = [("row", batch.schema.field(12).type)] if carry else []
                schema = pa.schema([("kind", pa.string())] + ARROW + more)
            texts = batch.column(2) if not carry else pc.struct_field(batch.column(12), [text_at])
            at = 0
            for part in arrow_slices(batch, texts):
                own = texts.slice(at, part.num_rows).to_pylist()
                at += part.num_rows
                if carry:
                    own = [(t or "").encode().translate(None, BLANKS) for t in own]
                held = rows.add(part.column(12)) if carry else 0
                cols = [part.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11)]
                for k, (text, length, hashed, sha, cls, size, chars, ident, o_lid, o_pos, lid,
                        members) in enumerate(zip(own, *cols, strict=True)):
                    first = text[0] if text else -1
                    if first in spilled:
                        out.append(("s", length, hashed, None if carry else text, sha, cls, size,
                                    chars, ident, o_lid, o_pos, lid, members))
                        places.append((held, k))
                        continue
                    slot = trie.insert(text)
                    if not slot:
                        n = classes.get(sha, 0)      # texts of one digest, told apart by their bytes
                        classes[sha] = n + 1
                        slot.extend((sha, length, hashed, max(cls, n), 0, -1, None, 0, 0, None, 0))
                        rows.live += carry
                    if slot[4] == 0 or better(chars, ident, slot[5], slot[6]):
                        slot[5], slot[6], slot[7], slot[8] = chars, ident, o_lid, o_pos
                        if carry:
                            slot[ROW] = (held, k)
                            trie.held += len(text) + 200 - slot[CARRIED]
                            slot[CARRIED] = len(text) + 200
                    slot[4] += size
                    if members is not None:
                        out.append(("m", length, hashed, None, sha, slot[3], 0, 0, None, 0, o_pos, lid,
                                    members))
                        places.append(None)
                    while trie.held > trie_bytes and trie.terminals > 1 and trie.root[1]:
                        big = max(trie.root[1], key=lambda b: trie.weight(trie.root[1][b]))
                        spilled.add(big)
                        for key, gone in trie.walk(trie.drop(big)):
                            rows.live -= carry
                            owner(key, gone, "s")
                            yield from drain(2000)
                yield from drain(0)
                if carry:
                    rows.compact(trie.slots())
        for key, slot in trie.walk():
            owner(key, slot, "o")
            yield from drain(2000)
        yield from drain(0)
        del trie, rows
        release_memory()

    return run


def _rounds(docs: DataFrame, id_col: str, text_col: str, carry: bool, window_bytes: int,
            window_rows: int, trie_bytes: int, max_rounds: int) -> DataFrame:
    """Member and owner rows of all rounds, stored in the shared folder."""
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = [F.col(id_col).cast("long").alias("i"), text.cast("binary").alias("t"),
            F.length(text).cast("long").alias("c")]
    fields = list(T.StructType.fromDDL(LOCAL).fields)
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
        fields.append(T.StructField("row", docs.schema))
    local = docs.select(*cols).mapInArrow(local_groups(window_bytes, window_rows, carry),
                                          T.StructType(fields))
    todo, parts = local.repartition("norm_len", "hash"), []
    for rnd in range(max_rounds):
        done = todo.mapInArrow(owner_round(trie_bytes, docs.columns.index(text_col) if carry else None),
                               T.StructType([KIND, *fields]))
        done = store(done, f"owners{rnd}")
        parts.append(done.where("kind <> 's'"))
        again = done.where("kind = 's'").drop("kind")
        if again.isEmpty():
            break
        wide = 8 ** (rnd + 1) * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        todo = again.repartition(min(wide, 100_000), "norm_len", "hash")
    else:
        raise RuntimeError("a partition's texts still outgrow the trie budget; raise trie_bytes")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 window_bytes: int = 24 << 20, window_rows: int = 20_000,
                 trie_bytes: int = 128 << 20, max_rounds: int = 8) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    rows = _rounds(docs, id_col, text_col, False, window_bytes, window_rows, trie_bytes, max_rounds)
    owners = rows.where("kind = 'o'").select(
        "sha", "cls", F.col("best_id").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("owner_lid").alias("keep_lid"), F.col("owner_pos").alias("keep_pos"))
    members = rows.where("kind = 'm'").select("sha", "cls", "lid", "members")
    at = members.join(owners, ["sha", "cls"]).select(
        "*", F.posexplode("members").alias("pos", "doc_id"))
    return at.select("doc_id", "keep_id", "group_size",
                     ((F.col("lid") == F.col("keep_lid")) & (F.col("pos") == F.col("keep_pos"))
                      ).alias("kept"),
                     F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                window_bytes: int = 24 << 20, window_rows: int = 20_000,
                trie_bytes: int = 128 << 20, max_rounds: int = 8) -> DataFrame:
    """Rows of ``docs`` that own their text, all columns kept (they travel with the candidates)."""
    rows = _rounds(docs, id_col, text_col, True, window_bytes, window_rows, trie_bytes, max_rounds)
    return rows.where("kind = 'o'").select("row.*")
