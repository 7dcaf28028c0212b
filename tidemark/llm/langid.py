"""Language identification by averaged hashed subword embeddings and a linear softmax.

The model is trained in numpy by stochastic gradient descent on a bounded sample
of labelled rows; predictions use whole texts.
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
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tidemark.llm.hashing import release
from tidemark.llm.shared import cut, few, ship, spare

#: Code points that are turned into subwords at a time.
STRIP = 1 << 18
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """What bounds and shapes the training.

    per_language: labelled rows in the sample, about, for each language.
    held: every so manieth text is held back for calibration of the model that is fitted to the others.
    batch: texts of a step.
    max_chars: of the sample, the same part for each language; texts are whole, and a language has one at least.
    kept: the part of held-back texts that each of the two measures of rejection keeps at least.
    strange: the part of subwords never met in training that any text may have.
    """

    per_language: int = 1200
    held: int = 4
    max_chars: int = 40_000_000
    buckets: int = 1 << 15
    size: int = 16
    epochs: int = 6
    batch: int = 16
    rate: float = 2.0
    kept: float = 0.9995
    strange: float = 0.1
    seed: int = 7


@dataclass
class Model:
    """labels; votes: what each bucket adds to each label's logit; known: buckets met in training; temperature, threshold and strange from calibration."""

    labels: list[str]
    votes: np.ndarray
    known: np.ndarray
    temperature: float
    threshold: float
    strange: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, its probability, and whether that is enough and the subwords are familiar; und for texts without letters."""
        total, count, met = np.zeros(len(self.labels)), 0, 0
        for h in subwords(text or "", self.votes.shape[0]):
            total += self.votes[h].sum(axis=0, dtype=np.float64)
            count += len(h)
            met += np.count_nonzero(self.known[h])
        if not count or not self.labels:
            return UNKNOWN, 0.0, False
        p = _softmax(total / count / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] >= self.threshold and strangeness(count - met, count) <= self.strange)


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; built once in each worker."""
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


def subwords(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all two- and three-letter pieces of the words, word ends marked, a strip of the text at a time."""
    letter, tail = letters(), np.array([32], np.uint32)
    for at in range(0, len(text), STRIP):
        c = np.frombuffer(text[at : at + STRIP].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[c]
        before = np.r_[tail[-1] != 32, is_letter[:-1]]
        tail = np.concatenate([tail, np.where(is_letter, c, np.uint32(32))[is_letter | before]])
        if at + STRIP >= len(text) and tail[-1] != 32:
            tail = np.append(tail, np.uint32(32))
        if len(tail) > 2:
            two = (tail[:-1] * np.uint32(0x9E3779B1)) ^ (tail[1:] * np.uint32(0x85EBCA77))
            three = (two[:-1] * np.uint32(0xC2B2AE3D)) ^ (tail[2:] * np.uint32(0x27D4EB2F))
            pieces = np.concatenate([two[:-1] if at + STRIP < len(text) else two, three])
            pieces ^= pieces >> np.uint32(15)
            pieces *= np.uint32(0x2C1B3C6D)
            yield (pieces >> np.uint32(17)).astype(np.int64) % buckets
            tail = tail[-2:]


def strangeness(unmet: int, count: int) -> float:
    """The part of subwords that training hasn't met; a few in a short text say little."""
    return unmet / (count + 20)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], settings: Settings = Settings()) -> Model:
    """Fit embeddings and softmax to all texts but every ``held``-th; temperature and thresholds are fitted to these."""
    names = sorted(set(labels))
    bags, targets, sizes = [], [], []
    for text, label in zip(texts, labels, strict=True):
        counts = np.zeros(settings.buckets, np.int64)
        for h in subwords(text or "", settings.buckets):
            counts += np.bincount(h, minlength=settings.buckets)
        ids = np.flatnonzero(counts)
        if len(ids):
            bags.append((ids, (counts[ids] / counts.sum()).astype(np.float32)))
            sizes.append(int(counts.sum()))
            targets.append(names.index(label))
    if not bags:
        return Model([], np.zeros((settings.buckets, 0)), np.zeros(settings.buckets, bool), 1.0, 0.0, 1.0)
    fit = np.array([i for i in range(len(bags)) if i % settings.held or len(bags) == 1])
    held = [i for i in range(len(bags)) if i % settings.held == 0]
    rng, targets = np.random.default_rng(settings.seed), np.array(targets)
    e = (rng.uniform(-1, 1, (settings.buckets, settings.size)) / settings.size).astype(np.float32)
    w = np.zeros((settings.size, len(names)), np.float32)
    steps, done = settings.epochs * -(-len(fit) // settings.batch), 0
    for _ in range(settings.epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), settings.batch):
            some = order[at : at + settings.batch]
            kinds, place = np.unique(np.concatenate([bags[i][0] for i in some]), return_inverse=True)
            x = np.zeros((len(some), len(kinds)), np.float32)
            x[np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some]), place] = np.concatenate([bags[i][1] for i in some])
            rate = settings.rate * (1 - done / steps)
            v = x @ e[kinds]
            g = _softmax(v @ w)
            g[np.arange(len(some)), targets[some]] -= 1
            back = g @ w.T
            w -= rate * (v.T @ g)
            e[kinds] -= rate * (x.T @ back)
            done += 1
    logits = np.array([bags[i][1] @ e[bags[i][0]] @ w for i in held], float)
    truth = targets[held]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-300).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = np.sort(_softmax(logits / temperature).max(axis=1))
    most = int((1 - settings.kept) * len(held))
    known = np.zeros(settings.buckets, bool)
    for i in fit:
        known[bags[i][0]] = True
    strange = np.sort([strangeness(sizes[i] * float(bags[i][1][~known[bags[i][0]]].sum()), sizes[i]) for i in held])
    return Model(names, (e @ w).astype(np.float32), known, temperature, float(sure[most]), max(settings.strange, float(strange[-1 - most])))


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; null ids aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on labelled rows that aren't held out: a sample of about ``per_language`` rows a language, by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & ~is_held_out(F.col("id")))
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("of")), "languages")
    languages = max(1, counts.count())
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(settings.seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(few(counts, counts), "lang").where(drawn < settings.per_language / F.col("of")).drop("of")
    sample = sample.withColumn("drawn", drawn).withColumn("length", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    before = F.sum("length").over(W.partitionBy("lang").orderBy("drawn", "id", "text").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("length")
    sample = sample.withColumn("before", before).where(F.col("before") + F.when(F.col("before") > 0, F.col("length")).otherwise(0) <= settings.max_chars // languages)
    sample = sample.select("id", "text", "lang").toPandas()
    sample = sample.sort_values(["id", "lang", "text"]).sample(frac=1.0, random_state=settings.seed)
    return train(list(sample["text"]), list(sample["lang"]), settings)


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column of (lang, score, accepted) for whole texts."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the corpus
    kind = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in part], columns=["lang", "score", "accepted"])
        release()

    predict.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return pandas_udf(predict, kind)(F.col(text_col))


def identify(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted.

    A null text, or one without letters, is ``und`` with score 0 and not
    accepted; so is every text when no row has a label.  Repeated rows are each
    returned with the same answer.  An empty table gives an empty result; other
    columns are ignored.
    """
    model = learn(docs, settings, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), predicted(rows, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.accepted").alias("accepted"))


def keep_identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents whose language the model accepts, with all their columns; null texts and texts without letters go.

    Repeated rows and rows with a null id are judged each by their text.  With
    no labels nothing is accepted.  An empty table gives an empty result.
    """
    (found,) = spare(docs, "language")
    return docs.withColumn(found, predicted(docs, learn(docs, settings))).where(F.col(found)["accepted"]).select(docs.columns)
