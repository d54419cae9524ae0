"""Language identification with string kernels.

The kernel of two texts is their number of common character n-grams (orders 1 to 3, presence only), divided by the
geometric mean of their own numbers. Landmark texts give a Nyström map of it; kernel ridge regression, one class
against the rest, is solved on that map, and texts are scored by products of batches of presence vectors with the
landmarks'. n-grams are hashed to a fixed number of slots, so a text of any length is one row of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyforge.llm.common import doc_split, table

ORDERS = (1, 2, 3)
SLOTS = 1 << 14
#: The classifier is fitted on at most this many labelled rows, shared evenly by the languages, of each language those with the smallest hashes of their ids.
FIT_ROWS = 1024
LANDMARKS = 160
RIDGE = 0.05
#: A text with this much of a landmark fits, whichever class it leans to.
NEAR = 0.3
BATCH = 128
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def presence(text: str | None) -> np.ndarray | None:
    """Slots of the n-grams of a text in lower case with all but letters as blanks; None for a text without letters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    blank = np.array([32], np.uint32)
    c = np.concatenate((blank, c[keep], blank[: int(is_letter[-1])]))
    slots = np.zeros(len(ORDERS) * SLOTS, dtype=bool)
    for k, order in enumerate(ORDERS):
        if len(c) < order:
            continue
        h = np.zeros(len(c) - order + 1, dtype=np.uint32)
        for j in range(order):
            h = (h ^ c[j : len(c) - order + 1 + j]) * _MIX[j]
            h ^= h >> np.uint32(15)
        slots[k * SLOTS + (h & np.uint32(SLOTS - 1))] = True
    return slots


class StringKernel:
    """Landmarks, Nyström map and ridge weights in one matrix."""

    def __init__(self, x: np.ndarray, lang: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """x: presence rows of labelled texts, in an order that mixes the languages."""
        self.langs = sorted(set(lang))
        y = (np.array(lang)[:, None] == np.array(self.langs)).astype(np.float64)
        turn = np.argsort([sum(b == a for b in lang[:i]) for i, a in enumerate(lang)], kind="stable")
        marks = x[turn[:landmarks]]
        self.columns = np.flatnonzero(marks.any(axis=0))
        self.marks = marks[:, self.columns].astype(np.float32).T
        self.norms = np.sqrt(marks.sum(axis=1, dtype=np.float64))
        among = self.kernel(marks)
        values, axes = np.linalg.eigh((among + among.T) / 2)
        good = values > values.max() * 1e-6
        to_map = axes[:, good] / np.sqrt(values[good])
        z = np.column_stack([self.kernel(x) @ to_map, np.ones(len(x))])
        penalty = ridge * np.eye(z.shape[1])
        penalty[-1, -1] = 1e-9
        w = np.linalg.solve(z.T @ z + penalty, z.T @ y)
        self.weights, self.bias = to_map @ w[:-1], w[-1]

    def kernel(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.norms)))
        for a in range(0, len(x), BATCH):
            own = np.sqrt(np.maximum(1, x[a : a + BATCH].sum(axis=1, dtype=np.float64)))
            out[a : a + BATCH] = (x[a : a + BATCH, self.columns].astype(np.float32) @ self.marks) / (own[:, None] * self.norms)
        return out

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class index and score, the ridge output of that class clipped to 0..1; ties go to the first class."""
        return self.judge(x)[:2]

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class index, score and fit: the kernel with the nearest landmark, below NEAR times the lead over the second class.

        The outputs of all classes sum to 1 for any text, so the score of the best is never low; the fit is, for texts
        that are like no landmark and lean to no class. Of one class alone the lead is the output.
        """
        kernel = self.kernel(x)
        near = kernel.max(axis=1)
        out = kernel @ self.weights + self.bias
        best = out.argmax(axis=1)
        top = out[np.arange(len(x)), best]
        second = np.sort(out, axis=1)[:, -2] if out.shape[1] > 1 else 0.0
        return best, np.clip(top, 0, 1), np.where(near < NEAR, near * (top - second), near)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> StringKernel | None:
    """Fits the classifier on labelled rows; None if there are none with letters.

    Ranks are made of ids and languages alone; of the chosen rows only fixed-size presence vectors reach the driver.
    """
    keys = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    langs = keys.select("lang").distinct().count()
    if not langs:
        return None
    per_lang = max(1, fit_rows // langs)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    ids = [r.doc_id for r in chosen.collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = zip(b.column(0).to_pylist(), (presence(t.as_py()) for t in b.column(1)), strict=True)
            rows = [(lang, np.packbits(p).tobytes()) for lang, p in found if p is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "bits"])

    texts = docs.where(F.col(id_col).isin(ids) & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # equal vectors of a language count once, so rows that repeat an id do not add up
    got = texts.mapInArrow(run, "lang string, bits binary").distinct().orderBy(F.xxhash64("bits"), "bits", "lang").limit(2 * fit_rows).collect()
    if not got:
        return None
    x = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool) for r in got])
    return StringKernel(x, [r.lang for r in got])


def predict(docs: DataFrame, model: StringKernel | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", fit_out: str | None = None) -> DataFrame:
    """docs with a language and a score added, in columns lang_out and score_out; columns of these names are replaced.

    With fit_out, the fit of the language is added in that column too (see StringKernel.judge). The language is a
    learned one, or 'und' with score and fit 0 for null texts, texts without letters and where nothing was learned. Whole texts are read, a few rows of a batch at a time; ties go to the first language in order.
    """
    more = [score_out] if fit_out is None else [score_out, fit_out]
    docs = docs.drop(lang_out, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                b = batch.slice(a, BATCH)
                found = [(i, p) for i, p in enumerate(map(presence, b.column(text_col).to_pylist())) if p is not None] if model else []
                langs, scores, fits = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
                if found:
                    at = [i for i, _ in found]
                    best, scores[at], fits[at] = model.judge(np.stack([p for _, p in found]))
                    for i, k in zip(at, best, strict=True):
                        langs[i] = model.langs[k]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs), *map(pa.array, (scores, fits)[: len(more)])], names=[*b.schema.names, lang_out, *more])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(lang_out, StringType()), *[StructField(c, DoubleType()) for c in more]]))


def op5_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(doc_split("doc_id", 4) != 2))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (doc_split("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
