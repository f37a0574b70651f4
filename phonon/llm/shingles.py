"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch.

A word is a run of ASCII letters, digits and characters beyond ASCII, in
lower case. A shingle is ``width`` words in a row; a text with fewer words
is one shingle; a text without words has none.
"""

from __future__ import annotations

import numpy as np

from phonon.llm.common import kept_in_worker

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MOST_KEPT = 1 << 22               # powers kept between calls (a longer text makes its own)
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, up to ``size`` at least (the longest are kept)."""
    kept = kept_in_worker("shingles")
    if len(kept.get("powers", ((),))[0]) >= size:
        return kept["powers"]
    out = []
    for base in (BASE, INVERSE):
        p = np.ones(1, U64)
        while len(p) < size:
            p = np.concatenate((p, p * U64(pow(base, len(p), 1 << 64))))
        out.append(p)
    if size <= MOST_KEPT:
        kept["powers"] = out[0], out[1]
    return out[0], out[1]


def shingle(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle of every text, in text order."""
    data = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    edges = np.cumsum([len(d) + 1 for d in data])          # end of each text, its blank included
    size = 1 << max(16, int(len(flat)).bit_length())
    up, down = _powers(size)
    is_word = WORD[flat]
    turn = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).astype(np.int8)))
    starts, ends = turn[0::2], turn[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    total = np.concatenate((np.zeros(1, U64), np.cumsum((flat.astype(U64) + U64(1)) * up[:len(flat)],
                                                        dtype=U64)))
    words = scramble((total[ends] - total[starts]) * down[starts] + U64(1) * (ends - starts).astype(U64))
    text = np.searchsorted(edges, starts, "right")
    per = np.bincount(text, minlength=len(texts))
    n = len(words) - width + 1
    if n > 0:
        code = np.zeros(n, U64)
        for k in range(width):
            code += words[k:k + n] * U64((0xD6E8FEB86659FD93 ** (k + 1)) & (2**64 - 1))
        inside = text[:n] == text[width - 1:]
        at, codes = text[:n][inside], scramble(code[inside])
    else:
        at, codes = np.zeros(0, np.int64), np.zeros(0, U64)
    few = np.flatnonzero((per > 0) & (per < width))
    if len(few):
        first = np.searchsorted(text, few)
        short = []
        for i, a in zip(few.tolist(), first.tolist(), strict=True):
            code = sum(int(w) * ((0xA24BAED4963EE407 ** (k + 1)) & (2**64 - 1))
                       for k, w in enumerate(words[a:a + per[i]].tolist())) + int(per[i])
            short.append(code & (2**64 - 1))
        at = np.concatenate((at, few))
        codes = np.concatenate((codes, scramble(np.asarray(short, U64))))
        order = np.argsort(at, kind="stable")
        at, codes = at[order], codes[order]
    return at.astype(np.int64), codes


def counted(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the distinct shingles of every text, sorted by both."""
    at, codes = shingle(texts, width)
    if not len(at):
        return at, codes, np.zeros(0, np.int64)
    order = np.lexsort((codes, at))
    at, codes = at[order], codes[order]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (codes[1:] != codes[:-1])))
    first = np.flatnonzero(new)
    return at[first], codes[first], np.diff(np.append(first, len(at)))
