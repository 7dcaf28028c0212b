"""Exact duplicate removal by a 128-bit content hash with a byte comparison inside groups.

DataFrame functions only: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import WHITE, cut, few, numbered, spare


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when identical without ASCII white space.  The row with most
    code points in its original text stays, on ties the one with the smallest id.
    Null texts count as empty, so all null, empty and blank texts are one group.
    Rows with the same id and text are told apart by nothing: each is returned,
    and each is marked as its kept id is; null ids come last.  An empty table gives an empty result;
    other columns of the table are ignored.

    Hashes of all rows are grouped first.  Where hashes that occur more than
    once are few, their list is sent to the texts, and no text is moved but the
    smallest and largest of each such hash, found in each task first; beyond,
    texts are dealt by hash.  If the two differ, the hash has a collision and
    its rows are grouped by whole text.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(source.select("doc_id", *_digests(F.col("text"))), "exact")
    return _resolve(rows, _collisions(rows, source), source).drop("best")


def _digests(text: Column) -> list[Column]:
    """Code points, 128-bit hash and SHA-256 of a text."""
    t = normalised(text)
    return [F.char_length(F.coalesce(text, F.lit(""))).alias("n_points"), F.unhex(F.md5(t)).alias("h"), F.unhex(F.sha2(t, 256)).alias("sha")]


def _collisions(rows: DataFrame, source: DataFrame) -> DataFrame:
    """The hashes that stand for different texts."""
    several = cut(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    again = source.select(normalised(F.col("text")).alias("t")).select("t", F.unhex(F.md5("t")).alias("h"))
    ends = again.join(few(several, several), "h", "left_semi").groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    return cut(ends.where("low <> high").select("h"), "collisions")


def _resolve(rows: DataFrame, mixed: DataFrame, source: DataFrame) -> DataFrame:
    """Groups of rows by hash, and by whole text for the hashes in ``mixed``; ``best`` is the row that stays, null in groups of one.

    ``rows`` may have a column row, which then tells rows with the same id apart.
    """
    if mixed.isEmpty():
        keyed = rows.withColumn("sub", F.lit(""))
    else:
        texts = source.select("doc_id", normalised(F.col("text")).alias("t")).select("doc_id", "t", F.unhex(F.md5("t")).alias("h"))
        texts = texts.join(mixed, "h", "left_semi").select("h", "doc_id", F.col("t").alias("sub"), F.unhex(F.sha2("t", 256)).alias("sha")).distinct()
        same = [F.col("r.h") == F.col("x.h"), F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")), F.col("r.sha") == F.col("x.sha")]
        keyed = rows.alias("r").join(texts.alias("x"), same, "left").select("r.*", F.coalesce("x.sub", F.lit("")).alias("sub"))
    row = [c for c in ("row",) if c in rows.columns]
    order = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("none"), "doc_id", *row)
    best = keyed.groupBy("h", "sub").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).where("group_size > 1")
    best = cut(best, "exact-groups")
    found = keyed.join(few(best, best), ["h", "sub"], "left")
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return found.select(
        *row,
        "best",
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("n_points").cast("long").alias("n_points"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: the longest, then the smallest id, null ids last; of repeated rows one.

    Null, empty and blank texts are one group.  An empty table gives an empty result.
    """
    (row,) = spare(docs, "row")
    whole = numbered(docs, row)
    source = whole.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(source.select("row", "doc_id", *_digests(F.col("text"))), "exact")
    found = _resolve(rows, _collisions(rows, source), source)
    gone = cut(found.where("best IS NOT NULL AND row <> best.row").select(F.col("row").alias(row)), "exact-gone")
    return whole.join(few(gone, gone), row, "left_anti").select(docs.columns)
