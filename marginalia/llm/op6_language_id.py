"""Operator 6: language identification by string kernels.

A text is the set of its letter n-grams of 1 to 4 characters (a blended spectrum, by presence), hashed into FEATURES
places. Its kernel with another text is the number of common places over the geometric mean of their numbers. LANDMARKS
texts give the Nyström features k(x, landmarks) K^(-1/2), on which one-versus-rest kernel ridge regression is solved.
Scoring is batched: presence rows times the landmarks' matrix times the weights.

The classifier alone is fitted on a sample, of at most SAMPLE labelled texts for each language, those of the smallest
hash of id and text; every text is scored, whole. The score is the softmax of the regressions' outputs.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any labelled text all are; rows
with a null label are not learnt from; a null id is in no fold that is held out; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import load, release, tidy

FEATURES = 1 << 14
GRAMS = (1, 2, 3, 4)
#: Labelled texts of each language that the classifier is fitted on, at most; and landmarks in all.
SAMPLE = 600
LANDMARKS = 64
RIDGE = 1e-2
#: Softmax of this many times the outputs.
SHARPNESS = 6.0
UNKNOWN = "und"
#: Characters hashed at once; longer texts go in several turns.
TURN = 1 << 20


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(text: str | None, out: np.ndarray) -> bool:
    """Mark the places of a text's n-grams in out; whether it has letters."""
    some = False
    for lo in range(0, len(text or ""), TURN):
        part = text[max(0, lo - max(GRAMS) + 1) : lo + TURN].lower()
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[points]
        some |= bool(is_letter.any())
        points = np.where(is_letter, points, 32)
        points = points[np.append(True, is_letter[1:] | is_letter[:-1])] + np.uint32(1)  # runs of other characters are one space
        code = np.zeros(len(points) + 1, np.uint32)
        code[1:] = points
        h = np.zeros(len(code), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            h = h[: len(code) - n + 1] * np.uint32(0x9E3779B1) + code[n - 1 :]
            if n in GRAMS:
                mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
                out[mixed >> np.uint32(32 - FEATURES.bit_length() + 1)] = 1
    return some


def rows_of(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(presence matrix, whether each text has letters)."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    some = np.fromiter((presence(t, out[i]) for i, t in enumerate(texts)), bool, len(texts))
    return out, some


@dataclass
class Model:
    """languages, sorted; landmarks: places by landmarks, divided by their roots; weights: landmarks by languages."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each row."""
        k = (rows @ self.landmarks) / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
        y = SHARPNESS * (k @ self.weights + self.offset)
        p = np.exp(y - y.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best].astype(np.float64)


def fit(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nyström features, landmarks taken from the languages in turn."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], np.int64)
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    turn = np.zeros(len(y), np.int64)
    for c in range(len(languages)):
        turn[y == c] = np.arange((y == c).sum())
    chosen = np.lexsort((y, turn))[: max(landmarks, len(languages))]
    unit = rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
    z = unit[chosen].T.astype(np.float32)
    values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = (unit @ z).astype(np.float64) @ root
    weight = 1 / np.bincount(y)[y]  # each language counts the same
    weight *= len(languages) and len(y) / weight.sum()
    target = np.where(np.arange(len(languages)) == y[:, None], 1.0, -1.0)
    mean_x, mean_t = np.average(features, 0, weight), np.average(target, 0, weight)
    x, t = features - mean_x, target - mean_t
    w = np.linalg.solve((x * weight[:, None]).T @ x + ridge * len(y) * np.eye(x.shape[1]) / x.shape[1], (x * weight[:, None]).T @ t)
    return Model(languages, z, root @ w, mean_t - mean_x @ w)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the rows outside the held-out fold; executors send presence bits, 2 KB for each sampled text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(~held_out("doc") & F.col("lang").isNotNull())
    rows = rows.withColumn("draw", F.xxhash64(F.lit("sample"), "doc", "text"))
    place = Window.partitionBy("lang").orderBy("draw")
    # the draws alone are ranked; the texts of those drawn are picked afterwards, ties cut by the same rank
    last = rows.select("lang", "draw").withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample).groupBy("lang").agg(F.max("draw").alias("last"))
    drawn = rows.join(F.broadcast(last), "lang").where("draw <= last").withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample)  # last: a row for each language

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                marks, some = rows_of(pd.Series(part.column("text").to_pylist(), dtype=object))
                packed = np.packbits(marks.astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc").cast(pa.string()), part.column("lang"), pa.array([p.tobytes() if s else None for p, s in zip(packed, some, strict=True)], pa.binary())], names=["doc", "lang", "bits"])

    got = drawn.select("doc", "text", "lang").mapInArrow(tidy(bits), "doc string, lang string, bits binary").where("bits is not null").toArrow().sort_by([("lang", "ascending"), ("doc", "ascending"), ("bits", "ascending")])
    marks = [np.unpackbits(np.frombuffer(b, np.uint8)) for b in got.column("bits").to_pylist()]
    return fit(np.array(marks, np.float32).reshape(-1, FEATURES), got.column("lang").to_pylist())


def predicted(model: Model, text: Column) -> Column:
    """struct<lang_pred, score> of a text column."""
    shared = SparkSession.active().sparkContext.broadcast(model)  # FEATURES x LANDMARKS numbers at most

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            out = []
            for lo in range(0, len(texts), 256):
                part = texts.iloc[lo : lo + 256]
                marks, some = rows_of(part)
                some &= bool(m.languages)
                if some.any():
                    best, p = m.predict(marks)
                    out.append(pd.DataFrame({"lang_pred": np.where(some, np.array(m.languages, object)[best], UNKNOWN), "score": np.where(some, p, 0.0)}))
                else:
                    out.append(pd.DataFrame({"lang_pred": [UNKNOWN] * len(part), "score": [0.0] * len(part)}))
            yield pd.concat(out) if out else pd.DataFrame({"lang_pred": pd.Series([], dtype=str), "score": pd.Series([], dtype=float)})
        texts = part = out = marks = None  # what is still held can't be given back
        release()

    return score(text)


def with_language(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs and the column out: struct<lang_pred, score>."""
    return docs.withColumn(out, predicted(model, F.col(f"`{text_col}`")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = trained(docs)
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
