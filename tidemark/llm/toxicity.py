"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The ratios are of how many labelled documents of either class have an n-gram,
counted by Spark over all labelled rows.  The weights on the scaled n-grams are
fitted in numpy by logistic regression on a bounded sample; scores use whole
texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tidemark.llm.hashing import release
from tidemark.llm.langid import is_held_out, letters
from tidemark.llm.shared import few, ship

#: Code points that are turned into n-grams at a time.
STRIP = 1 << 18
SPACE = np.uint32(32)


@dataclass(frozen=True)
class Settings:
    """What shapes the features and bounds the fit.

    per_class, max_chars: labelled rows of a class in the sample, about, and its code points; texts are whole, and a class has one at least.
    orders: lengths of n-grams, word ends counted; least: n-grams of fewer labelled documents say nothing.
    steps, ridge: of the fit.  threshold: scores from it on are predicted toxic.
    """

    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    least: int = 2
    per_class: int = 3000
    max_chars: int = 8_000_000
    steps: int = 100
    ridge: float = 1e-6
    threshold: float = 0.3
    seed: int = 13


@dataclass
class Model:
    """votes: what an n-gram of each bucket adds; bias: what a text without any has."""

    votes: np.ndarray
    bias: float
    settings: Settings

    def score(self, text: str | None) -> float:
        total, count = 0.0, 0
        for h in grams(text or "", self.settings):
            total += float(self.votes[h].sum(dtype=np.float64))
            count += len(h)
        return float(_expit(self.bias + total / np.sqrt(max(1, count))))


def _expit(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def grams(text: str, settings: Settings) -> Iterator[np.ndarray]:
    """Buckets of all n-grams within the words, word ends marked, letters lower-cased; a strip of the text at a time."""
    letter, longest, shift = letters(), max(settings.orders), np.uint32(32 - settings.bits)
    tail, fresh = np.array([32], np.uint32), 0  # of the tail, so many n-gram ends have been taken
    for at in range(0, len(text), STRIP):
        c = np.frombuffer(text[at : at + STRIP].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[c]
        before = np.r_[tail[-1] != SPACE, is_letter[:-1]]
        s = np.concatenate([tail, np.where(is_letter, c, SPACE)[is_letter | before]])
        if at + STRIP >= len(text) and s[-1] != SPACE:
            s = np.append(s, SPACE)
        spaces = np.r_[0, np.cumsum(s == SPACE)]
        h, found = s * np.uint32(0x9E3779B1), []
        for n in range(2, longest + 1):
            if len(s) < n:
                break
            h = (h[:-1] * np.uint32(0xC2B2AE3D)) ^ (s[n - 1 :] * np.uint32(0x85EBCA77))
            h ^= h >> np.uint32(15)
            if n in settings.orders:
                first = max(0, fresh - n + 1)  # earlier ones ended in the strip before
                inside = spaces[n - 1 : n - 1 + len(h)] == spaces[1 : 1 + len(h)]  # no word end but at the n-gram's own ends
                inside[:first] = False
                found.append((h[inside] * np.uint32(0x2C1B3C6D)) >> shift)
        if found:
            yield np.concatenate(found).astype(np.int64)
        tail = s[-(longest - 1) :]
        fresh = len(tail)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, text, label (0 or 1) of the documents that have a label and aren't held out; of contradicting labels the higher one holds."""
    label = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~is_held_out(F.col("id")))
    return rows.join(few(label, labels), "id")


def document_counts(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """bucket, none, some: in how many texts of label 0 and 1 each n-gram stands; bucket -1 counts the texts themselves."""
    ship(rows.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, met = np.zeros((2, (1 << settings.bits) + 1), np.int64), np.zeros((1 << settings.bits) + 1, bool)
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                met[:] = False
                met[-1] = True
                for h in grams(text or "", settings):
                    met[h] = True
                total[label] += met
        some = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bucket": np.where(some < 1 << settings.bits, some, -1), "none": total[0, some], "some": total[1, some]})

    counted = rows.select("text", "label").mapInPandas(count, "bucket long, none long, some long")
    return counted.groupBy("bucket").agg(F.sum("none").alias("none"), F.sum("some").alias("some"))


def ratios(none: np.ndarray, some: np.ndarray, texts: tuple[int, int], settings: Settings = Settings()) -> np.ndarray:
    """Log of how much more often texts of label 1 have each n-gram than those of label 0; counts are one higher than seen."""
    out = np.log((some + 1) / (texts[1] + 2)) - np.log((none + 1) / (texts[0] + 2))
    out[none + some < settings.least] = 0
    return out


def fit(texts: list[str | None], labels: list[int], ratio: np.ndarray, settings: Settings = Settings()) -> Model:
    """Logistic regression on counts of n-grams, scaled by their ratios and the root of their sum, by gradient steps with momentum."""
    size, row, bucket, value = 1 << settings.bits, [], [], []
    for i, text in enumerate(texts):
        found = list(grams(text or "", settings))
        if found:
            kinds, n = np.unique(np.concatenate(found), return_counts=True)
            scaled = n / np.sqrt(n.sum()) * ratio[kinds]
            some = scaled != 0
            row.append(np.full(some.sum(), i, np.int32))
            bucket.append(kinds[some].astype(np.int32))
            value.append(scaled[some].astype(np.float32))
    if not row:
        return constant(labels, settings)
    r, b, v, y = np.concatenate(row), np.concatenate(bucket), np.concatenate(value), np.array(labels, float)
    rate = 16 / (np.bincount(r, v * v, len(y)).mean() + 1e-9)  # the curvature is a quarter of that at most
    weight, bias = np.full(size, 0.1), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    speed, bias_speed = np.zeros(size), 0.0
    for _ in range(settings.steps):
        off = (_expit(np.bincount(r, v * weight[b], len(y)) + bias) - y) / len(y)
        speed = 0.9 * speed - rate * (np.bincount(b, v * off[r], size) + settings.ridge * weight)
        bias_speed = 0.9 * bias_speed - off.sum()
        weight += speed
        bias += bias_speed
    return Model((weight * ratio).astype(np.float32), bias, settings)


def constant(labels: list[int], settings: Settings) -> Model:
    """Without n-grams to tell texts apart: the part of toxic ones; 0 without labels."""
    part = sum(labels) / max(1, len(labels))
    return Model(np.zeros(1 << settings.bits, np.float32), float(np.log(max(part, 1e-12) / max(1 - part, 1e-12))), settings)


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Ratios from all labelled documents that aren't held out, weights from a sample of them, by a hash of the id."""
    rows = labelled(docs, labels, id_col, text_col, label_col)
    counts = document_counts(rows, settings).toArrow()  # a row a bucket, whatever the corpus
    at, none, some = (counts.column(c).to_numpy() for c in ("bucket", "none", "some"))
    texts = (int(none[at < 0].sum()), int(some[at < 0].sum()))
    table = np.zeros((2, 1 << settings.bits), np.int64)
    table[0, at[at >= 0]], table[1, at[at >= 0]] = none[at >= 0], some[at >= 0]
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(settings.seed)), F.lit(1 << 30)) / float(1 << 30)
    part = F.when(F.col("label") == 1, settings.per_class / max(1, texts[1])).otherwise(settings.per_class / max(1, texts[0]))
    sample = rows.withColumn("drawn", drawn).where(F.col("drawn") < part).withColumn("length", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    upto = F.sum("length").over(W.partitionBy("label").orderBy("drawn", "id", "text").rowsBetween(W.unboundedPreceding, W.currentRow))  # rows of the sample only
    sample = sample.withColumn("upto", upto).where((F.col("upto") <= settings.max_chars // 2) | (F.col("upto") == F.col("length")))
    chosen = sample.select("id", "text", "label").toPandas().sort_values(["id", "label", "text"])
    if not all(texts):
        return constant([0] * min(1, texts[0]) + [1] * min(1, texts[1]), settings)
    return fit(list(chosen["text"]), list(chosen["label"]), ratios(table[0], table[1], texts, settings), settings)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column of scores of whole texts."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number a bucket, whatever the corpus

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([shared.value.score(t) for t in part], dtype=float)
        release()

    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(score, DoubleType())(F.col(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Texts that are null, empty or without letters have the score of no n-grams
    at all.  Where labels are lacking, or all the same, every score is the part of
    toxic labels (0 without any).  Null ids have no label and aren't held out.
    Repeated rows count and are returned each; an empty table gives an empty
    result; other columns are ignored.
    """
    model = learn(docs, labels, settings, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), scored(rows, model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))
