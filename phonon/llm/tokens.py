"""Token ids of whole texts by a published tokenizer file, at corpus speed.

The tokenizer library does the encoding. What makes it fast enough is that its
byte-level pre-tokenizer never lets a token cross certain places: before a
single blank or around a single line feed between two other characters, and
between a letter or digit and the punctuation that ends a chunk. Texts are cut
at those places column-wise, each distinct chunk of a batch is looked up or
encoded once, and a text's ids are the chunks' ids in a row. Texts with any
other white space, or characters outside the blocks listed below, are encoded
whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from phonon.llm.common import kept_in_worker

# A text is cut only if it has none of these: a blank or line feed that does not stand alone
# between other characters, or a character outside printable ASCII, line feed, Latin letters with
# marks, Greek, Cyrillic and some general punctuation.
_WHOLE = (r"  | \n|\n |\n\n|\A[ \n]|[ \n]\z|[^\x20-\x7e\n\x{a1}-\x{ac}\x{ae}-\x{24f}\x{370}-\x{373}"
          r"\x{391}-\x{3a1}\x{3a3}-\x{3c9}\x{400}-\x{481}\x{2010}-\x{2014}\x{2018}-\x{201f}\x{20ac}]")
# A word and the punctuation behind it are cut apart too (an apostrophe may begin a contraction).
_TAIL = r"([\p{L}\p{N}])([!-&(-/:-@\[-`{-~]+)([ \n]|\z)"
_BARE = "\x01"            # marks a chunk without a blank before it
END_ID = 0


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, with a bounded memory of chunks.

    ``library`` encodes a list of texts, each whole, to packed ids. At most
    ``limit`` chunks are remembered.
    """

    def __init__(self, library: Callable[[list[str]], list[bytes]], limit: int = 600_000) -> None:
        self._library = library
        self.limit = limit
        self.chunks: dict[str, bytes] = {}
        self.feed = library(["\n"])[0]

    def _learn(self, new: list[str]) -> None:
        """Chunks are as cut: bare if marked, with their line feed, or after a blank."""
        texts = [c[1:] if c[:1] in ("\n", _BARE) else " " + c for c in new]
        for c, ids in zip(new, self._library(texts), strict=True):
            self.chunks[c] = self.feed + ids if c[:1] == "\n" else ids

    def _cut(self, texts: pa.Array) -> list[bytes]:
        apart = pc.replace_substring_regex(texts, _TAIL, r"\1 " + _BARE + r"\2\3")
        marked = pc.binary_join_element_wise(_BARE, pc.replace_substring(apart, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        got = list(map(self.chunks.get, names))
        if None in got:
            new = [c for c, ids in zip(names, got, strict=True) if ids is None]
            if len(self.chunks) + len(new) > self.limit:
                self.chunks.clear()
                new = names
            self._learn(new)
            got = list(map(self.chunks.__getitem__, names))
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        ids = np.frombuffer(b"".join(got), "<u4")
        at = coded.indices.to_numpy()
        length = sizes[at]
        end = np.cumsum(length)
        source = (np.cumsum(sizes) - sizes)[at] - (end - length)
        flat = ids[np.repeat(source, length) + np.arange(end[-1])]
        last = end[np.cumsum(lists.value_lengths().to_numpy()) - 1].tolist()
        return [flat[a:b].tobytes() for a, b in zip([0, *last[:-1]], last, strict=True)]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of every text (no special tokens, no nulls) as packed bytes."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        whole = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.match_substring_regex(texts, _WHOLE))
        rows = whole.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        at = np.flatnonzero(~rows).tolist()
        if at:
            for k, ids in zip(at, self._cut(texts.filter(pc.invert(whole))), strict=True):
                out[k] = ids
        for k in np.flatnonzero(rows).tolist():      # one at a time: such a text can be very long
            text = texts[k].as_py()
            if text:
                out[k] = self._library([text])[0]
        return out


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a tokenizer file (kept between tasks)."""
    encoders = kept_in_worker("tokens")
    if path not in encoders:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True

        def library(texts: list[str]) -> list[bytes]:
            got = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in got]

        encoders[path] = ChunkEncoder(library)
    return encoders[path]
