"""Conversation prefix trie with subtree sums by the Euler-tour technique (operator 13).

The nodes of the trie are the distinct sequences of first d turns (role, text)
of all conversations, from the empty sequence on. Conversations that begin with
a node's sequence are its members. For every node the operator gives its
members, children, the childless nodes below it and the code points that a
store of prefixes would save in its subtree.

How it runs
-----------
1. ``sequences``: turns are sorted by ranges of (conversation, turn), each
   partition gives its turns a place and a polynomial prefix hash (two bases
   modulo 2**61 - 1, over 120 bits of SHA-256 of each turn), and what a
   conversation brings along from earlier partitions is added from one row a
   partition. A conversation of any length so spreads over many tasks.
2. ``rebuild``: a conversation may begin with the first turns of another one;
   prefix hashes are moved to their new depth by one multiplication.
3. Nodes are groups of equal (depth, hash): partial counts and minima, so a
   prefix that a third of all rows share costs a row a task.
4. ``tour``: enter and exit arcs of every node, each pointing to the next arc
   of the tour. Siblings are neighbours in a sort by (parent, node); the rows
   at partition edges are linked from two rows a partition.
5. ``rank``: list ranking by contraction. Blocks of neighbouring arcs shorten
   the runs inside them to their first arc; where that gains little, arcs drawn
   by a coin absorb their successors. What is left is written each round, until
   one arc stands for the whole tour; the rounds are then undone in turn.
6. ``running``: prefix sums over arc positions, in blocks, then over blocks. A
   subtree's sum is the difference between its exit and its enter arc.
7. The members that end at a node are listed in sorted chunks by many tasks,
   then hashed in order as a stream: a chunk is one row of ``CHUNK`` bytes.

Defined results: rows without a conversation id belong to none and are left
out. A null role or text counts as empty. Turns go by number, null first, ties
by a digest of role and text; equal rows are equal turns, each counts. An empty
table has no node. Texts are read whole, however long. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonon.llm.common import kept_in_worker, store
from phonon.session import ship_package

P = (1 << 61) - 1
BASES = (0x1B2C3D4E5F60718 | 1, 0x0F1E2D3C4B5A697 | 1)
HEAD = 5                          # most turns that a conversation borrows
BLOCK = 1 << 15                   # arcs contracted at once, and left for the last block
SPAN = 1 << 14                    # positions summed in one window
CHUNK = 8 << 10                   # bytes of listed members in a row
EMPTY = hashlib.sha256(b"").hexdigest()


def _rows(cols: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


# ---- turns in order, with prefix hashes ----------------------------------------------------------

SEQUENCE = ["kind", "pid", "c", "pos", "p1", "p2", "q1", "q2", "chars"]


def _local_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (c, t1, t2, chars) -> place and prefix hash (p; q without the turn itself) counted from
    the first turn of the conversation in this partition. Kinds 1 and 2 end the first and last run."""
    kept_in_worker("prefix_trie")
    pid, kinds = TaskContext.get().partitionId(), [pa.int64()] * len(SEQUENCE)
    b1, b2 = BASES
    cur, runs, k, a1, a2, w1, w2 = None, 0, 0, 0, 0, 1, 1
    edges: list[list] = []
    for batch in batches:
        out: list[list] = []
        for c, t1, t2, chars in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if c != cur or not runs:
                if runs == 1:
                    edges.append([1, pid, cur, k, a1, a2, 0, 0, 0])
                cur, runs, k, a1, a2, w1, w2 = c, runs + 1, 0, 0, 0, 1, 1
            q1, q2, k = a1, a2, k + 1
            w1, w2 = w1 * b1 % P, w2 * b2 % P
            a1, a2 = (a1 + t1 * w1) % P, (a2 + t2 * w2) % P
            out.append([0, pid, c, k, a1, a2, q1, q2, chars])
        if out:
            yield _rows(list(zip(*out, strict=True)), kinds, SEQUENCE)
    if runs == 1:
        edges.append([1, pid, cur, k, a1, a2, 0, 0, 0])
    if runs:
        edges.append([2, pid, cur, k, a1, a2, 0, 0, 0])
        yield _rows(list(zip(*edges, strict=True)), kinds, SEQUENCE)


def _carried(edges: list) -> dict[int, tuple[int, int, int, int]]:
    """{partition: (conversation, turns, hashes)} that its first run continues, from its edge rows."""
    out, held = {}, None
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        before = held[1:] if held is not None and held[0] == first["c"] else (0, 0, 0)
        if before[0]:
            out[first["pid"]] = (first["c"], *before)
        if first["c"] == last["c"]:
            n, p1, p2 = before
            held = (last["c"], n + last["pos"], (p1 + pow(BASES[0], n, P) * last["p1"]) % P,
                    (p2 + pow(BASES[1], n, P) * last["p2"]) % P)
        else:
            held = (last["c"], last["pos"], last["p1"], last["p2"])
    return out


def sequences(turns: DataFrame) -> DataFrame:
    """(c, pos, p1, p2, q1, q2, chars) of turns (c, turn, role, text): place from 1, prefix hashes with
    and without the turn, code points of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    keys = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("n")]
    rows = (turns.where("c IS NOT NULL")
            .select("c", "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"),
                    F.monotonically_increasing_id().alias("n"))       # spreads equal rows; results do not show it
            .withColumns({"t1": F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"),
                          "t2": F.conv(F.substring("digest", 16, 15), 16, 10).cast("long")}).drop("digest"))
    local = (rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("c", "t1", "t2", "chars")
             .mapInArrow(_local_prefixes, ", ".join(f"{c} long" for c in SEQUENCE)))
    local = store(local, "trie-turns")
    carried = _carried(local.where("kind > 0").orderBy("pid", "kind").collect())    # two rows a partition

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(1, 9)]
            if carried:
                got = [c.to_pylist() for c in cols]
                pid, conv, pos = got[0], got[1], got[2]
                for i, (p, c) in enumerate(zip(pid, conv, strict=True)):
                    if p in carried and carried[p][0] == c:
                        _, n, *before = carried[p]
                        pos[i] += n
                        for j in range(2):
                            up = pow(BASES[j], n, P)
                            got[3 + j][i] = (before[j] + up * got[3 + j][i]) % P
                            got[5 + j][i] = (before[j] + up * got[5 + j][i]) % P
                cols = [pa.array(c, pa.int64()) for c in got]
            yield pa.RecordBatch.from_arrays(cols[1:], names=SEQUENCE[2:])

    return local.where("kind = 0").mapInArrow(join_up, ", ".join(f"{c} long" for c in SEQUENCE[2:]))


# ---- conversations that begin with turns of another one -------------------------------------------

def rebuild(seq: DataFrame, base: Column, borrowed: Column) -> DataFrame:
    """(c, d, h1, h2, q1, q2, chars, is_end): a row for every conversation and depth from 0.

    A rebuilt conversation is the first ``borrowed`` (at most HEAD) turns of conversation ``base``
    (all if fewer, none if there is none), then its own turns after its first ``borrowed``; both
    are expressions of the conversation's id ``c``.
    """
    lent = seq.withColumn("b", borrowed.cast("int"))
    info = lent.groupBy("c").agg(
        F.max("pos").alias("len"), F.first("b").alias("b"),
        *[F.max(F.when(F.col("pos") == F.col("b"), F.col(f"p{j}"))).alias(f"o{j}") for j in (1, 2)])
    heads = (seq.where(F.col("pos") <= HEAD).groupBy(F.col("c").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "p1", "p2", "q1", "q2", "chars"))).alias("head")))
    last = F.try_element_at("head", F.lit(-1))
    convs = (info.withColumn("base", base).join(heads, "base", "left")
             .withColumn("head", F.filter("head", lambda t: t["pos"] <= F.col("b")))
             .withColumn("k", F.greatest(F.coalesce(F.size("head"), F.lit(0)), F.lit(0)))
             .select("c", "b", "k", "head", (F.col("k") + F.greatest(F.col("len") - F.col("b"), F.lit(0))).alias("m"),
                     *[F.coalesce(f"o{j}", F.lit(0)).alias(f"o{j}") for j in (1, 2)],
                     *[F.coalesce(last[f"p{j}"], F.lit(0)).alias(f"g{j}") for j in (1, 2)]))
    convs = store(convs, "trie-convs")
    names = ["c", "d", "h1", "h2", "q1", "q2", "chars", "is_end"]
    ddl = ", ".join(f"{n} {'boolean' if n == 'is_end' else 'long'}" for n in names)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = [[pow(b, -s, P) for s in range(HEAD + 1)] for b in BASES]
        for batch in batches:
            out = []
            for c, pos, p1, p2, q1, q2, chars, b, k, m, o1, o2, g1, g2 in zip(
                    *(col.to_pylist() for col in batch.columns), strict=True):
                w1, w2, d = back[0][b - k], back[1][b - k], pos - b + k
                out.append((c, d, (g1 + (p1 - o1) * w1) % P, (g2 + (p2 - o2) * w2) % P,
                            (g1 + (q1 - o1) * w1) % P, (g2 + (q2 - o2) * w2) % P, chars, d == m))
            if out:
                yield _rows(list(zip(*out, strict=True)), [pa.int64()] * 7 + [pa.bool_()], names)

    own = (lent.where("pos > b").drop("b").join(convs, "c")
           .select("c", "pos", "p1", "p2", "q1", "q2", "chars", "b", "k", "m", "o1", "o2", "g1", "g2")
           .mapInArrow(moved, ddl))
    zero = F.lit(0).cast("long")
    roots = convs.select("c", zero.alias("d"), *[zero.alias(n) for n in names[2:7]], (F.col("m") == 0).alias("is_end"))
    lead = convs.select("c", "m", F.explode("head").alias("t")).select(
        "c", F.col("t.pos").alias("d"), F.col("t.p1").alias("h1"), F.col("t.p2").alias("h2"), "t.q1", "t.q2",
        "t.chars", (F.col("t.pos") == F.col("m")).alias("is_end"))
    return roots.unionByName(lead).unionByName(own)


# ---- Euler tour ---------------------------------------------------------------------------------------

def _sibling_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (parent, id) -> arcs (kind 0: a, next). The first and last row of the partition come as
    (kind 1 and 2: id, parent), to be linked later."""
    pid = TaskContext.get().partitionId()
    last, started = None, False
    for batch in batches:
        out = []
        for parent, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not started:
                out.append((1, pid, v, parent))
                started = True
            elif parent == last[0]:
                out.append((0, pid, 2 * last[1] + 1, 2 * v))
            else:
                out += [(0, pid, 2 * last[1] + 1, 2 * last[0] + 1), (0, pid, 2 * parent, 2 * v)]
            last = (parent, v)
        if out:
            yield _rows(list(zip(*out, strict=True)), [pa.int32(), pa.int64(), pa.int64(), pa.int64()],
                        ["kind", "pid", "a", "s"])
    if last is not None:
        yield _rows([[2], [pid], [last[1]], [last[0]]], [pa.int32(), pa.int64(), pa.int64(), pa.int64()],
                    ["kind", "pid", "a", "s"])


def tour(nodes: DataFrame) -> DataFrame:
    """(a, s): arcs of the Euler tour and their successors, of nodes (id, parent, n_children).

    Arc 2 id enters a node, arc 2 id + 1 leaves it. The last arc, leaving the root, has none.
    """
    spark = nodes.sparkSession
    made = (nodes.where("parent IS NOT NULL").select("parent", "id")
            .repartitionByRange("parent", "id").sortWithinPartitions("parent", "id")
            .mapInArrow(_sibling_arcs, "kind int, pid long, a long, s long"))
    made = store(made, "trie-siblings")
    edges = made.where("kind > 0").orderBy("pid", "kind").collect()              # two rows a partition
    links, last = [], None
    for e in edges:
        v, parent = e["a"], e["s"]
        if e["kind"] == 2:
            last = (parent, v)
            continue
        if last is not None and last[0] == parent:
            links.append((2 * last[1] + 1, 2 * v))
        else:
            if last is not None:
                links.append((2 * last[1] + 1, 2 * last[0] + 1))
            links.append((2 * parent, 2 * v))
    if last is not None:
        links.append((2 * last[1] + 1, 2 * last[0] + 1))
    leaf = nodes.where("n_children = 0").select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("s"))
    root = nodes.where("parent IS NULL").select((F.col("id") * 2 + 1).alias("a"), F.lit(None).cast("long").alias("s"))
    return (made.where("kind = 0").select("a", "s").unionByName(leaf).unionByName(root)
            .unionByName(spark.createDataFrame(links, "a long, s long")))


def shorten(a: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """(head index, distance from it) of every arc of a block, and (successor, distance) of the
    heads' runs: ``a`` ascending, ``s`` successors (-1: none), ``w`` distances to them."""
    n = len(a)
    at = np.minimum(np.searchsorted(a, s), n - 1)
    inside = (a[at] == s) & (s >= 0)
    head, dist = np.arange(n), np.zeros(n, np.int64)
    head[at[inside]] = np.flatnonzero(inside)
    dist[at[inside]] = w[inside]
    while True:
        up = head[head]
        if (up == head).all():
            break
        dist = dist + dist[head]
        head = up
    tail = np.flatnonzero(~inside)            # a run leaves the block once
    leaves, length = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    leaves[head[tail]], length[head[tail]] = s[tail], dist[tail] + w[tail]
    return head, dist, leaves, length


def _contracted(block: int):
    """Sorted (a, s, w) -> a row for every arc: live (s, w of its run) or gone (s: its head, w: how far
    behind it), a block of neighbouring arcs at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("prefix_trie")
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            a, s, w = (np.concatenate([h[i] for h in held]) for i in range(3))
            head, dist, leaves, length = shorten(a, s, w)
            live = head == np.arange(len(a))
            to = np.where(live, leaves, a[head])
            return pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(to, mask=to < 0), pa.array(np.where(live, length, dist)), pa.array(live)],
                names=["a", "s", "w", "live"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                held.append((part.column(0).to_numpy(), part.column(1).fill_null(-1).to_numpy(),
                             part.column(2).to_numpy()))
                rows += part.num_rows
                if rows >= block:
                    yield flush()
                    held, rows = [], 0
        if held:
            yield flush()

    return run


def _mated(arcs: DataFrame, rnd: int) -> DataFrame:
    """One round of coins: an arc that drew 0 absorbs its successor that drew 1 (same rows as above)."""
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(rnd)), F.lit(2))
    takes = (coin(F.col("a")) == 0) & F.col("s").isNotNull() & (coin(F.col("s")) == 1)
    taker = arcs.where(takes).select(F.col("a").alias("x"), F.col("s").alias("b"), F.col("w").alias("by"))
    drawn = arcs.where(coin(F.col("a")) == 1).select(F.col("a").alias("b"), "s", "w")
    both = drawn.join(taker, "b", "left")
    gone = F.col("x").isNotNull()
    rows = F.when(gone, F.array(
        F.struct(F.col("x").alias("a"), F.col("s"), (F.col("w") + F.col("by")).alias("w"), F.lit(True).alias("live")),
        F.struct(F.col("b").alias("a"), F.col("x").alias("s"), F.col("by").alias("w"), F.lit(False).alias("live")))
    ).otherwise(F.array(F.struct(F.col("b").alias("a"), F.col("s"), F.col("w"), F.lit(True).alias("live"))))
    rest = arcs.where(~takes & (coin(F.col("a")) == 0)).select("a", "s", "w", F.lit(True).alias("live"))
    return both.select(F.explode(rows).alias("r")).select("r.*").unionByName(rest)


def rank(arcs: DataFrame, block: int = BLOCK, max_rounds: int = 200) -> DataFrame:
    """(a, pos): the place of every arc of a linked list (a, s), from 0; s is null at its end."""
    cur = store(arcs.select("a", "s", F.lit(1).cast("long").alias("w")), "trie-arcs")
    n, rounds, drawn = cur.count(), [], False
    while n > 1:
        if len(rounds) >= max_rounds:
            raise RuntimeError(f"list not ranked after {max_rounds} rounds")
        if drawn:
            made = _mated(cur, len(rounds))
        else:
            made = (cur.repartitionByRange(-(-n // block), "a") if n > block else cur.repartition(1)) \
                .sortWithinPartitions("a").mapInArrow(_contracted(block), "a long, s long, w long, live boolean")
        made = store(made, f"trie-round{len(rounds)}")
        rounds.append(made.where("NOT live"))
        cur = made.where("live").drop("live")
        left = cur.count()
        # blocks that gain little are followed by a round of coins, which takes a quarter on average
        drawn = not drawn and left > 0.75 * n and left > block
        n = left
    out = cur.select("a", F.lit(0).cast("long").alias("pos"))
    for k, gone in enumerate(reversed(rounds)):
        known = out.select(F.col("a").alias("s"), F.col("pos").alias("at"))
        out = out.unionByName(gone.join(known, "s").select("a", (F.col("at") + F.col("w")).alias("pos")))
        if k < len(rounds) - 1:
            out = store(out, f"trie-pos{k}")
    return out


def running(rows: DataFrame, n: int, values: list[str], span: int = SPAN) -> DataFrame:
    """``rows`` (pos from 0 to n - 1, ...) with their ``values`` replaced by the sums up to and with them."""
    at = "__span"
    if n <= span:
        w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({v: F.sum(v).over(w) for v in values})
    blocks = rows.withColumn(at, F.expr(f"pos div {span}"))
    w = Window.partitionBy(at).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = blocks.withColumns({v: F.sum(v).over(w) for v in values})
    totals = blocks.groupBy(F.col(at).alias("pos")).agg(*[F.sum(v).alias(v) for v in values])
    before = running(totals, -(-n // span), values, span).select(
        (F.col("pos") + 1).alias(at), *[F.col(v).alias(f"__{v}") for v in values])
    return inside.join(before, at, "left").select(
        *[c for c in rows.columns if c not in values],
        *[(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values])


# ---- members that end at a node ------------------------------------------------------------------------

KEY = ["d", "h1", "h2"]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d, h1, h2, c) -> (d, h1, h2, first c, comma-joined ids) in chunks of CHUNK bytes."""
    key, ids, size = None, [], 0
    for batch in batches:
        out = []
        for *new, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if ids and (new != key or size >= CHUNK):
                out.append((*key, int(ids[0]), ",".join(ids)))
                ids, size = [], 0
            key = new
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield _rows(list(zip(*out, strict=True)), [pa.int64()] * 4 + [pa.string()], [*KEY, "c", "ids"])
    if ids:
        yield _rows([[k] for k in key] + [[int(ids[0])], [",".join(ids)]], [pa.int64()] * 4 + [pa.string()],
                    [*KEY, "c", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks -> (d, h1, h2, hex digest of the chunks joined by commas), as a stream."""
    key, state = None, None
    for batch in batches:
        out = []
        for *new, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if new == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append((*key, state.hexdigest()))
            key, state = new, hashlib.sha256(ids.encode())
        if out:
            yield _rows(list(zip(*out, strict=True)), [pa.int64()] * 3 + [pa.string()], [*KEY, "ends_sha256"])
    if state is not None:
        yield _rows([[k] for k in key] + [[state.hexdigest()]], [pa.int64()] * 3 + [pa.string()],
                    [*KEY, "ends_sha256"])


def member_digests(ends: DataFrame) -> DataFrame:
    """(d, h1, h2, ends_sha256) of (d, h1, h2, c)."""
    chunks = (ends.select(*KEY, "c").repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c")
              .mapInArrow(_chunks, "d long, h1 long, h2 long, c long, ids string"))
    return (chunks.repartition(*KEY).sortWithinPartitions(*KEY, "c")
            .mapInArrow(_hashed, "d long, h1 long, h2 long, ends_sha256 string"))


# ---- the operator -----------------------------------------------------------------------------------------

RESULT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", base: Column | None = None, borrowed: Column | None = None,
                block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (of the parent; root: null),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (of the members that end here).

    ``base`` and ``borrowed`` (expressions of the id ``c``) let conversations begin with another's
    first turns, see ``rebuild``; without them they stay as they are.
    """
    spark: SparkSession = turns.sparkSession
    ship_package(spark)
    named = turns.select(F.col(f"`{conv_col}`").cast("long").alias("c"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                         F.col(f"`{role_col}`").cast("string").alias("role"),
                         F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = store(rebuild(sequences(named), F.col("c") if base is None else base,
                         F.lit(0) if borrowed is None else borrowed), "trie-rows")
    groups = rows.groupBy(*KEY).agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("q1").alias("q1"),
        F.min("q2").alias("q2"), F.min("chars").alias("chars"))
    # ids follow (smallest member, depth): what the tour visits in a row lies close together
    nodes = store(groups.repartitionByRange("conv_id", "d").sortWithinPartitions("conv_id", "d")
                  .withColumn("id", F.monotonically_increasing_id()), "trie-nodes")
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("h1").alias("q1"), F.col("h2").alias("q2"),
                         F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = store(nodes.where("d > 0").select("id", "d", "q1", "q2").join(above, ["d", "q1", "q2"])
                   .select("id", "parent", "parent_conv_id"), "trie-parents")
    children = linked.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = store(nodes.join(linked, "id", "left").join(children, "id", "left")
                  .withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-linked")
    placed = rank(tour(nodes), block)
    n_arcs = 2 * nodes.count()
    worth = nodes.select("id", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                         ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    values = ["n_leaves", "saved_tokens"]
    enters = F.col("a") % 2 == 0
    arcs = (placed.withColumn("id", F.expr("a div 2")).join(worth, "id")
            .select("id", "pos", enters.alias("enters"),
                    *[F.when(enters, F.col(v)).otherwise(0).alias(v) for v in values],
                    *[F.when(enters, F.col(v)).otherwise(0).alias(f"own_{v}") for v in values]))
    sums = running(arcs, n_arcs, values, span).groupBy("id").agg(*[
        F.sum(F.when(F.col("enters"), F.col(f"own_{v}") - F.col(v)).otherwise(F.col(v))).alias(v) for v in values])
    ends = member_digests(rows.where("is_end"))
    return (nodes.join(sums, "id").join(ends, KEY, "left")
            .select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
