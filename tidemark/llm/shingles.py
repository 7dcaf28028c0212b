"""Jaccard similarity of word shingles: banded minima find pairs that fingerprints miss, texts decide.

Two texts of similarity s have equal minima in a band of five with probability
s**5, so one of 25 bands meets at 0.8 with probability 0.99995.  All that meet in
a band are compared, by way of the first of them: those that it links are one
component already, and only pairs of different components are compared after.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tidemark.llm.hashing import mix, release
from tidemark.llm.shared import connected_components, cut, few

#: Shingles whose minima are made together.
STRIP = 1 << 12
#: Pairs of a key from which its nodes meet over rare shingles instead of all with all.
CROWD = 1024
_U = np.uint64


@dataclass(frozen=True)
class Alike:
    """width: words in a shingle; least: similarity from which texts are linked; bands of so many minima each."""

    width: int = 5
    least: float = 0.8
    bands: int = 25
    minima: int = 5
    seed: int = 42


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, of all its words where they are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as in simhash
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    count = max(1, len(words) - width + 1)
    h = np.zeros(count, np.uint64)
    for i in range(min(width, len(words))):
        h = mix(h * _U(0x9E3779B97F4A7C15) + w[i : i + count])
    return np.unique(h)


def majority(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles: the bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STRIP):
        ones += np.unpackbits(hashes[at : at + STRIP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


def band_keys(hashes: np.ndarray, rule: Alike) -> np.ndarray:
    """A key for each band: texts with equal keys are compared."""
    rng = np.random.default_rng(rule.seed)
    turn, odd = (rng.integers(0, 1 << 63, (rule.bands * rule.minima, 1), dtype=np.uint64) for _ in range(2))
    least = np.full(rule.bands * rule.minima, ~_U(0))
    for at in range(0, len(hashes), STRIP):
        np.minimum(least, ((hashes[at : at + STRIP] ^ turn) * (odd | _U(1))).min(axis=1), out=least)
    key = np.arange(rule.bands, dtype=np.uint64)
    for part in least.reshape(rule.bands, rule.minima).T:
        key = mix(key * _U(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


def sketch(text: Column, rule: Alike) -> Column:
    """(digest, size, fp, keys) of a text's shingles; the digest has 128 bits, fp is their SimHash, 0 without words."""
    kind = StructType([StructField("digest", BinaryType()), StructField("size", LongType()), StructField("fp", LongType()), StructField("keys", ArrayType(LongType()))])

    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, rule.width) for t in texts]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"digest": digest, "size": [len(s) for s in sets], "fp": fp, "keys": [band_keys(s, rule) if len(s) else [] for s in sets]})
        release()

    sketches.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return pandas_udf(sketches, kind)(text)


def similar_links(pairs: DataFrame, texts: DataFrame, rule: Alike) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts (node, text) are alike."""

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            firsts = {a: shingles(x, rule.width) for a, x in f.drop_duplicates("a")[["a", "x"]].itertuples(index=False)}
            keep = [similarity(firsts[a], shingles(y, rule.width)) >= rule.least for a, y in zip(f["a"], f["y"], strict=True)]
            yield f.loc[keep, ["a", "b"]]
        release()

    wanted = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct())
    wanted = cut(wanted.distinct(), "similar-wanted")
    known = texts.join(few(wanted, wanted), "node", "left_semi")
    a, b = known.select(F.col("node").alias("a"), F.col("text").alias("x")), known.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInPandas(verified, "a long, b long")


def rare_pairs(nodes: DataFrame, texts: DataFrame, rule: Alike) -> DataFrame:
    """Pairs (a, b) of nodes (node, own) of different ``own`` that may be alike: all that are, by what their sets begin with.

    Of sets in the order of how many nodes have a shingle, rare ones first, two
    that are alike share one of their first n - least * n + 1; what a text has by
    itself comes first there, so texts that share a passage only don't meet.
    Nor do those of which too few shingles are left behind the first common one.
    """
    kind = StructType([StructField("size", LongType()), StructField("all", ArrayType(LongType()))])

    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [shingles(t, rule.width) for t in part]
            yield pd.DataFrame({"size": [len(s) for s in found], "all": [s.view(np.int64) for s in found]})
        release()

    sets.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    held = texts.join(few(nodes, nodes), "node").select("node", "own", pandas_udf(sets, kind)(F.col("text")).alias("s"))
    rows = cut(held.select("node", "own", "s.size", F.explode("s.all").alias("shingle")), "rare-shingles")
    often = cut(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "rare-counts")
    known = rows.join(few(often, often), "shingle", "left")
    place = F.row_number().over(W.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "shingle"))
    first = known.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(rule.least * F.col("size") - 1e-9) + 1)
    first = cut(first.where("n > 1").select("shingle", "node", "own", "size", (F.col("size") - F.col("place") + 1).alias("rest")), "rare-first")
    other = first.toDF("shingle", "b", "its", "n", "most")
    fits = F.least("rest", "most") * (1 + rule.least) >= rule.least * (F.col("size") + F.col("n")) - 1e-9  # what both can have in common from here on
    return first.join(other, "shingle").where((F.col("node") < F.col("b")) & (F.col("own") != F.col("its")) & fits).select(F.col("node").alias("a"), "b").distinct()


def similar_components(distinct: DataFrame, texts: DataFrame, rule: Alike, proposed: DataFrame | None = None) -> DataFrame:
    """(node, component) of nodes that are linked; ``distinct`` has node, size and keys, ``texts`` node and text; ``proposed`` are more pairs (a, b) to compare.

    All that meet in a key are compared with its first node.  What that leaves
    apart meets all others of its key where these are few; nodes of crowded keys
    meet over the rarest of their shingles (see rare_pairs).
    """
    keyed = distinct.select("node", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut(keyed.join(shared, "key"), "similar-members")
    led = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    led = cut((led if proposed is None else led.unionByName(proposed)).distinct(), "similar-pairs")
    wanted = members.select("node").unionByName(led.select(F.col("a").alias("node"))).unionByName(led.select(F.col("b").alias("node"))).distinct()
    wanted = cut(wanted, "similar-nodes")
    texts = cut(texts.join(few(wanted, wanted), "node", "left_semi"), "similar-texts")
    links = cut(similar_links(led, texts, rule), "similar-links")
    found = cut(connected_components(links), "similar-components")
    left = members.where("node <> leader").drop("leader").join(found.toDF("node", "own"), "node", "left").withColumn("own", F.coalesce("own", "node"))
    left = cut(left.select("key", "node", "size", "own"), "similar-left")  # leaders have been compared with all of their keys
    parts = left.groupBy("key", "own").agg(F.count("*").alias("n")).groupBy("key")
    mixed = cut(parts.agg(F.max_by("own", "n").alias("main"), F.sum("n").alias("total"), F.max("n").alias("most")).where("total > most"), "similar-mixed")
    left = cut(left.join(mixed.select("key", "main", (F.expr("(total - most) * total") > CROWD).alias("crowd")), "key"), "similar-left")
    apart = left.where("NOT crowd AND own <> main").select("key", F.col("node").alias("a"), F.col("size").alias("m"), F.col("own").alias("c"))
    fits = F.least("m", "size") >= rule.least * F.greatest("m", "size")
    crossed = apart.join(left.where("NOT crowd"), "key").where((F.col("c") != F.col("own")) & fits)
    crossed = crossed.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    crowded = left.where("crowd").select("node", "own").distinct()
    crossed = cut(crossed.unionByName(rare_pairs(cut(crowded, "similar-crowded"), texts, rule)).distinct(), "similar-pairs")
    return connected_components(links.unionByName(similar_links(crossed, texts, rule)))
