"""Spelling variants: words one edit apart, joined over pivotal bigrams.

Bigrams are ordered by how many words have them, rare ones first.  A word's
prefix are its three first bigrams in that order (and all equal to the third);
two pivots are the disjoint bigrams of the prefix with the least number of words
in sum, chosen by dynamic programming.  One edit spoils one of two disjoint
bigrams at most, so of two words an edit apart the one whose prefix ends earlier
has a pivot that stands in the other's prefix.

Let A be the left pivot and B the right one.  If the edit is right of A, all up to A's end
is the same in both words; if not, all from B's start on is.  So A is
looked up with what precedes it, at the same distance from the start, and B with
what follows it, at the same distance from the end; lengths differ by one at
most.  What the edit may have touched is cut in pieces of three letters, of
which it touches one: keys hold everything but one piece.  Words that share a
key are compared by edit distance.  So a key is shared by words that
differ in three letters or so, and there are few of these, however many words
there are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashing import mix
from tidemark.llm.shared import cut, discard, ship

#: Words have so many letters at least, and occur so often; a form occurs so many times as often as its variant.
LETTERS, OFTEN, TIMES = 7, 2, 10
#: Of all runs' checksums, every so manieth loses a letter.
SPOILED = 31
#: Letters of a piece; kinds of words that a task counts at a time; code points of a text that are read at a time.
PIECE, HELD, STRIP = 3, 400_000, 1 << 22

#: Latin-1 with capitals A-Z lowered, and what isn't a letter as a space; U+00C0 to U+00FF are letters here, signs among them too.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_U = np.uint64


def runs(text: str) -> Iterator[bytes]:
    """The runs of letters of a text in Latin-1, a byte a letter, a stretch of the text at a time."""
    at = 0
    while at < len(text):
        part = text[at : at + STRIP].encode("latin-1", "replace").translate(_TABLE)
        at += STRIP
        while at < len(text) and part[-1:] != b" ":  # a stretch ends between runs
            more = text[at : at + 64].encode("latin-1", "replace").translate(_TABLE)
            end = more.find(b" ")
            part += more if end < 0 else more[: end + 1]
            at += len(more) if end < 0 else end + 1
        yield from part.split()


def spoiled(run: bytes, seed: int) -> bytes:
    """The run without a letter, where its checksum says so; ``seed`` is the checksum of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    at = h % len(run)
    return run if h % SPOILED else run[:at] + run[at + 1 :]


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: Counter[bytes] = Counter()

    def flush() -> pd.DataFrame:
        out = pd.DataFrame({"word": [w.decode("latin-1") for w in found], "n": list(found.values())})
        found.clear()
        return out

    for frame in frames:
        for doc, text in zip(frame["id"], frame["text"], strict=True):
            seed = zlib.crc32(f"{doc or ''}:".encode())
            for run, n in Counter(runs(text or "")).items():
                word = spoiled(run, seed)
                if len(word) >= LETTERS:
                    found[word] += n
            if len(found) >= HELD:
                yield flush()
    if found:
        yield flush()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts and how often they occur, without those that are too short or rare."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of each length: their places in the batch, and their letters as rows of a matrix."""
    words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(words[i] for i in at.tolist()), np.uint8).reshape(-1, n)


def _bigrams(letters: np.ndarray) -> np.ndarray:
    return letters[:, :-1].astype(np.int64) << 8 | letters[:, 1:]


def _bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for _, letters in _by_length(batch):
            total += np.bincount(_bigrams(letters).ravel(), minlength=1 << 16)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])


def prefixes(letters: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which bigrams of each word are in its prefix."""
    order = rank[_bigrams(letters)]
    return order <= np.partition(order, 2, axis=1)[:, 2:3]


def pivots(letters: np.ndarray, prefix: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's two pivots start: disjoint bigrams of its prefix of the least number of words in sum.

    From left to right, the best first pivot so far is kept, and each bigram is tried as the second.
    """
    cost = np.where(prefix, number[_bigrams(letters)], 1 << 50)
    rows = len(letters)
    least, where = np.full(rows, 1 << 60), np.zeros(rows, np.int64)
    best, left, right = np.full(rows, 1 << 61), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for at in range(2, cost.shape[1]):
        better = cost[:, at - 2] < least
        least, where = np.where(better, cost[:, at - 2], least), np.where(better, at - 2, where)
        better = least + cost[:, at] < best
        best, left, right = np.where(better, least + cost[:, at], best), np.where(better, where, left), np.where(better, at, right)
    return left, right


def _heads(letters: np.ndarray) -> np.ndarray:
    """Hashes of each word's first 0, 1, 2 ... letters."""
    out = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    for i in range(letters.shape[1]):
        out[:, i + 1] = mix(out[:, i] * _U(257) + letters[:, i] + _U(1))
    return out


def _keys(head: np.ndarray, tail: np.ndarray, word: np.ndarray, gram: np.ndarray, size: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words (rows of head and tail) with bigrams at ``gram``, for partners of ``size`` letters; and the word of each.

    The letters after a bigram are the partner's in pieces; each key has all but one of these.
    """
    own = head.shape[1] - 1
    after = size - gram - 2  # letters of the partner behind the bigram
    ok = after >= 0
    word, gram, after = word[ok], gram[ok], after[ok]
    keys, of = [], []
    for piece in range(max(1, -(-int(after.max(initial=0)) // PIECE))):
        here = np.flatnonzero(piece < np.maximum(1, -(-after // PIECE)))
        w, upto = word[here], gram[here] + 2 + PIECE * piece
        rest = np.maximum(after[here] - PIECE * (piece + 1), 0)
        fits = upto + rest <= own
        w, upto, rest, g = w[fits], upto[fits], rest[fits], gram[here][fits]
        place = ((g * 64 + piece) * 2 + side).astype(np.uint64) * _U(1 << 20) + _U(size)
        keys.append(mix(head[w, upto] + mix(tail[w, rest] * _U(0x9E3779B97F4A7C15) + place)))
        of.append(w)
    return (np.concatenate(keys), np.concatenate(of)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def index_keys(letters: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bigrams of the words' prefixes, as left and as right pivots of others would look them up."""
    n = letters.shape[1]
    word, gram = np.nonzero(prefix)
    head, tail = _heads(letters), _heads(letters[:, ::-1])
    left, right = _keys(head, tail, word, gram, n, 0), _keys(tail, head, word, n - 2 - gram, n, 1)
    return np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])


def pivot_keys(letters: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words' pivots, for partners as long, a letter shorter or longer."""
    n, every = letters.shape[1], np.arange(len(letters))
    head, tail = _heads(letters), _heads(letters[:, ::-1])
    found = [part for size in (n - 1, n, n + 1) for part in (_keys(head, tail, every, left, size, 0), _keys(tail, head, every, n - 2 - right, size, 1))]
    return np.concatenate([k for k, _ in found]), np.concatenate([w for _, w in found])


def near_words(words: DataFrame) -> DataFrame:
    """word, near, n: both directions of all pairs of ``words`` (word, n) one edit apart, n being the near word's."""
    spark = words.sparkSession
    ship(spark)
    only = words.select("word")
    counts = only.mapInArrow(_bigram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # pairs of letters, 65,536 at most
    number = np.zeros(1 << 16, np.int64)
    number[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    rank = np.empty(1 << 16, np.int64)
    rank[np.lexsort((np.arange(1 << 16), number))] = np.arange(1 << 16)
    shared = spark.sparkContext.broadcast((number, rank))

    def keyed(look_up: bool):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, rank = shared.value
            for batch in batches:
                for at, letters in _by_length(batch):
                    prefix = prefixes(letters, rank)
                    keys, of = pivot_keys(letters, *pivots(letters, prefix, number)) if look_up else index_keys(letters, prefix)
                    rows = batch.take(pa.array(at[of]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), rows.column("word"), rows.column("n")], names=["key", "word", "n"])

        return words.select("word", "n").mapInArrow(make, "key long, word string, n long")

    asked = keyed(True).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    there = keyed(False).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = asked.join(there, "key").where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("n"))))
    return met.select(both.alias("p")).select("p.*").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: where following ``forms`` (word, form) from each word ends.

    A form is ten times as frequent as its word, so chains have some twenty
    words at most; each round doubles how far a word has come.
    """
    now = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = cut(now.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        discard(now)
        now = step
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word of all texts: word, n, n_near, form, form_n, root.

    Words are runs of Latin letters of seven letters at least that occur twice
    at least, capitals A-Z lowered; some runs lose a letter first, by a checksum
    of the document's id and the run.  Near words differ by one letter inserted,
    deleted or replaced; the form is the most frequent of them (the first in
    code-point order of equally frequent ones), if it is ten times as frequent
    as the word.  Null texts have no words, null ids count as empty text.
    Repeated rows count each.  An empty table gives an empty result; other
    columns are ignored.
    """
    words = cut(vocabulary(docs, id_col, text_col), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("top"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("top.near").alias("form"), (-F.col("top.less")).alias("form_n"))
    holds = F.col("form_n") >= TIMES * F.col("n")
    found = cut(found.withColumn("form", F.when(holds, F.col("form"))).withColumn("form_n", F.when(holds, F.col("form_n"))), "variants")
    roots = last_forms(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
