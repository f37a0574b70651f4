"""Language identification (operator 9).

Sparse multinomial logistic regression on TF-IDF character n-grams, trained
with follow-the-regularised-leader under an elastic-net penalty, then
temperature calibration.

How it runs
-----------
* Features are hashed counts of the 1- to 3-grams of the lower-cased letters
  (every run of other characters is one blank), times the inverse document
  frequency, scaled to unit length. The feature space has a fixed size.
* Document frequencies cover every labelled training text, whole: one pass of
  per-task sums, then one grouped sum of a fixed number of buckets.
* The fit takes a sample of labelled rows, at most ``rows_per_class`` expected
  per class (a stated bound; chosen by a hash of the text). Each shard of about
  ``shard_rows`` of them runs the per-coordinate FTRL updates over its share, and
  the shard weights are averaged (parameter mixing); a tenth of the sample is kept aside
  for the temperature, the minimum of the calibration loss on a grid.
* The model (buckets x classes, size-checked) is broadcast; scoring is one map.
* A text whose n-grams are rarer in the texts of its best class than those of clean texts of
  its length are (all but LOST of the sample, each text judged by the others) is marked
  ``strange``, whatever the number of classes; its score stays the calibrated probability.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is everything if no row has a label. A null label is not trained on. Ties
between classes go to the first label in sorted order. Empty tables and other
columns, whatever their names, are fine. A null id counts as empty text in the
fold rule. Repeated rows are scored alike. Texts are read whole, however long: n-grams are
counted into a vector of fixed size. Of more labels than ``max_classes`` the most frequent
(ties: first in sorted order) are learned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonon.llm.common import arrow_map, arrow_slices, kept_in_worker, release_memory, text_batches
from phonon.session import ship_package

BITS = 16
SIZE = 1 << BITS
BIAS = SIZE                       # extra coordinate, value 1 in every row
ORDERS = (1, 2, 3)
MAX_MODEL_BYTES = 128 << 20
UNKNOWN = "und"
LENGTHS = (60, 180, 600, 1800)    # length classes by the number of n-grams, three a letter
PIECES = (10, 30, 100, 300)       # clean texts are judged whole and by so many first characters
DEVIATIONS = 5.0
LOST = 0.001                      # share of clean rows lost, at most
LEAST_CLEAN, OWN_CLEAN = 10, 100  # clean values for a cut, and for one of the class's own
GRID = np.exp(np.linspace(np.log(0.02), np.log(20.0), 61))   # temperatures tried


@functools.cache
def _letters() -> np.ndarray:
    """Is-letter flag of every code point."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Dense n-gram counts of a whole text; None if it has no letter."""
    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]                      # one blank after each run of letters
    seq = np.where(letter, cp, 32)[keep].astype(np.uint64)
    seq = np.concatenate((np.array([32], np.uint64), seq, np.array([32], np.uint64)))
    out = np.zeros(SIZE, dtype=np.int64)
    code = np.zeros(len(seq), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = code[:len(seq) - n + 1] * np.uint64(0x110003) + seq[n - 1:]
        if n in ORDERS:
            mixed = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=SIZE)
    return out


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(coordinates, values) of a text: unit-length TF-IDF plus the bias."""
    c = counts(text)
    return None if c is None else weighted(c, idf)


def weighted(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(c)
    v = c[at] * idf[at]
    v /= max(np.sqrt(v @ v), 1e-12)
    return np.append(at, BIAS), np.append(v, 1.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list, labels: list[int], classes: int, alpha: float, beta: float, l1: float,
         l2: float, epochs: int) -> np.ndarray:
    """Weights after ``epochs`` passes of per-coordinate FTRL-proximal updates."""
    z = np.zeros((SIZE + 1, classes))
    g2 = np.zeros((SIZE + 1, classes))

    def weights(at=slice(None)):
        zz, root = z[at], np.sqrt(g2[at])
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - l1, 0.0)
        return -shrunk / ((beta + root) / alpha + l2)

    for _ in range(epochs):
        for (at, v), y in zip(rows, labels, strict=True):
            w = weights(at)
            p = softmax(v @ w)
            p[y] -= 1.0
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / alpha
            z[at] += g - sigma * w
            g2[at] += g * g
    return weights()


@dataclass
class LanguageModel:
    """Fitted model: sorted labels, idf, weights (buckets + bias, classes), temperature."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    holding: np.ndarray | None = None    # (buckets, classes): texts of the class that hold a bucket
    sizes: np.ndarray | None = None      # texts of the class
    most: np.ndarray | None = None       # (classes, length classes): highest strangeness of clean texts

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, unlike all texts of that language)."""
        c = counts(text) if self.labels else None
        if c is None:
            return UNKNOWN, 0.0, True
        f = weighted(c, self.idf)
        p = softmax((f[1] @ self.weights[f[0]]) / self.temperature)
        k = int(np.argmax(p))
        strange = False
        if self.most is not None:
            x, size = strangeness(c, self.holding[:, k], self.sizes[k])
            strange = bool(x > self.most[k, size])
        return self.labels[k], float(p[k]), strange

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def strangeness(c: np.ndarray, holding: np.ndarray, n: float, own: int = 0) -> tuple[float, int]:
    """(how rare a text's n-grams are in the texts of a class, on average; length class).

    It does not depend on the other classes. ``own`` is 1 for a text that is itself counted.
    """
    at = np.flatnonzero(c)
    total = c[at].sum()
    rare = np.log((1.0 + n - own) / (1.0 + np.maximum(holding[at] - own, 0.0)))
    return float(c[at] @ rare / total), int(np.searchsorted(LENGTHS, total, side="right"))


def strangest(values: pd.DataFrame, classes: int) -> np.ndarray:
    """Cut of every class and length class from clean values (k, size, x): mean plus DEVIATIONS
    deviations, or what a share LOST of them exceeds if that is higher; shorter texts at least as high as longer ones; without
    enough values that of all classes, of shorter texts, or none."""
    out = np.full((classes, len(LENGTHS) + 1), np.inf)
    for size in range(len(LENGTHS) + 1):
        every = values.loc[values["size"] == size]
        for k in range(classes):
            x = every.loc[every["k"] == k, "x"].to_numpy()
            x = x if len(x) >= OWN_CLEAN else every["x"].to_numpy()
            if len(x) >= LEAST_CLEAN:
                out[k, size] = max(x.mean() + DEVIATIONS * x.std(),
                                   np.quantile(x, 1 - LOST, method="higher"))
            elif size:
                out[k, size] = out[k, size - 1]
    return np.maximum.accumulate(out[:, ::-1], axis=1)[:, ::-1]


def class_frequencies(rows: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts of each class holding each bucket, texts of each class with a letter) of (text, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("langid")
        df: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in arrow_slices(batch, 0):
                for text, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    c = counts(text)
                    if c is not None:
                        own = df.setdefault(k, np.zeros(SIZE + 1, dtype=np.int64))
                        own[:SIZE] += c > 0
                        own[SIZE] += 1
        for k, own in df.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(np.full(len(at), k)), pa.array(own[at])], names=["bucket", "k", "n"])
        release_memory()

    got = (rows.select("text", F.col("k").cast("int")).mapInArrow(run, "bucket long, k long, n long")
           .groupBy("bucket", "k").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros((SIZE + 1, classes))
    out[got["bucket"].to_numpy(dtype=np.int64), got["k"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    return out[:SIZE], out[SIZE]


def fit(labelled: DataFrame, text_col: str, label_col: str, rows_per_class: int = 3000,
        shard_rows: int = 1500, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0,
        l1: float = 0.02, l2: float = 0.02, max_classes: int = 200) -> LanguageModel:
    """Fit on the rows of ``labelled`` with a label and a letter.

    Counts and document frequencies cover all rows; the weights are fitted on a
    hash sample of about ``rows_per_class`` rows of each class at most, in
    shards of about ``shard_rows``.
    """
    ship_package(labelled.sparkSession)
    text_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("y")
                           ).where("text IS NOT NULL AND y IS NOT NULL")
    per = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n"))
           .orderBy(F.desc("n"), "y").limit(max_classes).collect()}
    labels = sorted(per)
    classes = len(labels)
    if (SIZE + 1) * classes * 8 > MAX_MODEL_BYTES:
        raise ValueError("model too large to broadcast")
    if not labels:
        return LanguageModel([], np.zeros(SIZE), np.zeros((SIZE + 1, 0)), 1.0)
    index = {y: k for k, y in enumerate(labels)}
    cls = F.create_map(*[x for y in labels for x in (F.lit(y), F.lit(index[y]))])
    rows = rows.where(F.col("y").isin(labels))
    holding, sizes = class_frequencies(rows.select("text", cls[F.col("y")].alias("k")), classes)
    df, n = holding.sum(axis=1), sizes.sum()
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    holding = holding.astype(np.float32)

    shards = max(1, round(sum(min(n, rows_per_class) for n in per.values()) / shard_rows))
    draw = F.pmod(F.xxhash64("text", "y", F.lit(9)), F.lit(1 << 30)) / F.lit(1 << 30)
    share = F.create_map(*[x for y in labels for x in (F.lit(y), F.lit(min(1.0, rows_per_class / per[y])))])
    sample = rows.where(draw < share[F.col("y")]).select(
        "text", cls[F.col("y")].alias("k"),
        F.xxhash64("text").alias("h"),
        F.pmod(F.xxhash64("text", F.lit(11)), F.lit(10)).alias("fold"),
        F.pmod(F.xxhash64("text", F.lit(13)), F.lit(shards)).alias("shard"))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "k"])     # a fixed order: a rerun gives the same weights
        feats, ys = [], []
        for text, k in zip(group["text"], group["k"], strict=True):
            f = features(text, idf)
            if f is not None:
                feats.append(f)
                ys.append(int(k))
        w = ftrl(feats, ys, classes, alpha, beta, l1, l2, epochs)
        at, k = np.nonzero(w)
        return pd.DataFrame({"at": at, "k": k, "w": w[at, k]})

    got = (sample.where("fold <> 9").groupBy("shard").applyInPandas(train, "at long, k long, w double")
           .groupBy("at", "k").agg((F.sum("w") / shards).alias("w")).toPandas())
    weights = np.zeros((SIZE + 1, classes))
    weights[got["at"].to_numpy(dtype=np.int64), got["k"].to_numpy(dtype=np.int64)] = got["w"].to_numpy()

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(GRID))
        for batch in batches:
            for text, k in zip(batch["text"], batch["k"], strict=True):
                f = features(text, idf)
                if f is not None:
                    logits = (f[1] @ weights[f[0]])[None, :] / GRID[:, None]
                    total -= np.log(np.maximum(softmax(logits)[:, int(k)], 1e-300))
        yield pd.DataFrame({"t": np.arange(len(GRID)), "loss": total})

    loss = (sample.where("fold = 9").select("text", "k").mapInPandas(losses, "t long, loss double")
            .groupBy("t").agg(F.sum("loss").alias("loss")).orderBy("loss", "t").first())
    temperature = float(GRID[loss["t"]]) if loss and loss["loss"] > 0 else 1.0
    # how strange clean texts are, whole and in part: each held back from the counts it is judged by
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, k, h in zip(batch["text"], batch["k"], batch["h"], strict=True):
                for piece in {text, *(text[:m] for m in PIECES)}:
                    c = counts(piece)
                    if c is not None:
                        x, size = strangeness(c, holding[:, k], sizes[k], own=1)
                        out.append((int(h), int(k), size, x))
            yield pd.DataFrame(out, columns=["h", "k", "size", "x"])

    clean = (sample.select("text", "k", "h").mapInPandas(
        judge, "h long, k long, size long, x double").distinct().toPandas())
    return LanguageModel(labels, idf, weights, temperature, holding, sizes,
                         strangest(clean, classes))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text",
             lang_name: str = "lang_pred", score_name: str = "score",
             strange_name: str = "strange") -> DataFrame:
    """``docs`` with the predicted language, its calibrated probability, and whether the text is
    unlike all texts of that language. Input columns of these names are replaced."""
    ship_package(docs.sparkSession)
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    made = [lang_name, score_name, strange_name]

    def run(texts: list) -> list:
        got = [held.value.judge(t) for t in texts]
        return [pa.array([g[k] for g in got], t)
                for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]

    rows = docs
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in made if c != text_col}:
        rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in clash])
    return arrow_map(rows, text_col, run, [
        T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType()),
        T.StructField(strange_name, T.BooleanType())], "langid")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def fit_documents(docs: DataFrame) -> LanguageModel:
    return fit(docs.where(~held_out()), "text", "lang")
