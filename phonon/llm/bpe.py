"""Byte-level BPE encoding and decoding over a rank file (operator 3).

Encoding a match of the split pattern: its bytes are read as Latin-1, an
Aho-Corasick automaton over the vocabulary finds the tokens at every place,
and the longest token is taken first (the chain of longest matches is tried as
a whole before any place is looked at again). Two adjacent tokens are compatible when
encoding their joined bytes gives the two tokens back; a chain of compatible
tokens over the whole match is its BPE encoding, and there is only one. So a
place from which no chain goes on is marked dead, the last token is given up
for the next shorter one, and every place is left at most once: linear time,
with the same ids as merging by rank. Compatibility is memoised.

Decoding joins the tokens' bytes.

The work is two maps (text -> ids, ids -> bytes) without a shuffle.

Defined results: null text is empty and gives no ids; null ids are kept; an
empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonon.llm.common import arrow_slices, kept_in_worker
from phonon.llm.tokens import ChunkEncoder
from phonon.session import ship_package

MEMO = 200_000          # remembered pairs and matches; emptied when full


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Textbook BPE of a short byte string: join the adjacent pair of least rank until none is left."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class BytePairCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick
        import regex
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.length = {rank: len(token) for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        # tokens that merging can reach at all, and the longest other one each begins with
        self.automaton = ahocorasick.Automaton()
        reached = {t: r for t, r in self.ranks.items() if merge_by_rank(t, self.ranks) == [r]}
        self.shorter: dict[int, int | None] = {}
        for token, rank in reached.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next((reached[token[:k]] for k in range(len(token) - 1, 0, -1)
                                       if token[:k] in reached), None)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.matches: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Do tokens ``a`` and ``b`` stay as they are when their bytes are encoded together?"""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            known = merge_by_rank(self.tokens[a] + self.tokens[b], self.ranks) == [a, b]
            self.pairs[key] = known
        return known

    def encode_match(self, data: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, length, shorter = data.decode("latin-1"), self.length, self.shorter
        longest, known = self.automaton.iter_long, self.pairs
        # the chain of longest matches, up to the first pair that is not compatible
        chain: list[int] = []
        pos, last = 0, None
        for _, token in longest(text):
            if last is not None and not (known.get(last << 32 | token)
                                         or self.compatible(last, token)):
                break
            chain.append(token)
            pos += length[token]
            last = token
        n, dead = len(text), set()
        token = next(longest(text, pos))[1] if pos < n else None
        while pos < n:
            while token is not None and (pos + length[token] in dead or (
                    chain and not (known.get(chain[-1] << 32 | token)
                                   or self.compatible(chain[-1], token)))):
                token = shorter[token]
            if token is not None:
                chain.append(token)
                pos += length[token]
                token = next(longest(text, pos))[1] if pos < n else None
            else:
                dead.add(pos)
                token = chain.pop()
                pos -= length[token]
                token = shorter[token]
        return chain

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts."""
        matches, out = self.matches, []
        if len(matches) > MEMO:
            matches.clear()
        for text in texts:
            parts = []
            for piece in self.split(text):
                ids = matches.get(piece)
                if ids is None:
                    ids = array("I", self.encode_match(piece.encode())).tobytes()
                    if len(piece) <= 64 and len(matches) <= MEMO:
                        matches[piece] = ids
                parts.append(ids)
            out.append(b"".join(parts))
        return out

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


def codec(path: str, pattern: str) -> tuple[BytePairCodec, ChunkEncoder]:
    """The worker's codec of a rank file (kept between tasks) and its encoder of whole texts."""
    codecs, key = kept_in_worker("bpe"), (path, pattern)
    if key not in codecs:
        made = BytePairCodec(path, pattern)
        codecs[key] = made, ChunkEncoder(made.encode_many, limit=400_000)
    return codecs[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids): packed little-endian unsigned 32-bit ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, enc = codec(path, pattern)
        for batch in batches:
            for rows in arrow_slices(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(enc.encode(rows.column(1)), pa.binary())],
                    names=["doc_id", "ids"])

    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("i"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t")
                       ).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, ids): ``decoded`` holds the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, _ = codec(path, pattern)
        for batch in batches:
            for rows in arrow_slices(batch, 1):
                texts = [made.decode(ids) for ids in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.binary())],
                    names=["doc_id", "ids", "decoded"])

    ship_package(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, ids binary, decoded binary")
