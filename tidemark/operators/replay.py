"""Results frozen with a tree of digests, and replays that name what differs.

Rows are dealt to ranges of a hash of their key, some thousands each; a range's
digest is that of its rows' digests in order, and every 256 ranges, and so on,
become one, up to the root.  The tree is stored with the rows' digests.  A replay
makes the same tree over new rows, goes down from the root only where nodes
differ, and compares rows in the ranges that it comes to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import beside, cut, few

#: Rows of a range, about; levels of hash bits that become one node.
RANGE_ROWS, STEP = 4096, 8


def row_digest(columns: list[str]) -> Column:
    """A digest of a row's values as text, nulls told apart."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def _leaves(df: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """keys, place (the range) and digest of each row."""
    place = F.shiftrightunsigned(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys)), 64 - bits) if bits else F.lit(0).cast("long")
    return df.select(*keys, place.alias("place"), row_digest(df.columns).alias("digest"))


def _tree(leaves: DataFrame, bits: int) -> DataFrame:
    """level (bits of the place), place and digest of every node that has rows."""
    joined = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256)  # noqa: E731  a range's rows, or 256 nodes at most
    level, found = bits, []
    now = leaves.select("place", F.col("digest").alias("d")).groupBy("place").agg(joined().alias("digest"))
    while True:
        now = cut(now, "nodes")
        found.append(now.withColumn("level", F.lit(level)))
        if not level:
            break
        step = min(STEP, level)
        d = F.concat(F.lpad(F.col("place").cast("string"), 20, "0"), F.lit(":"), "digest").alias("d")
        now = now.select(F.shiftrightunsigned("place", step).alias("place"), d).groupBy("place").agg(joined().alias("digest"))
        level -= step
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("level", "place", "digest")


def freeze(df: DataFrame, keys: list[str], path: str) -> str:
    """Write rows' digests and their tree below ``path``, which must be new; the root's digest.

    Equal keys may have several rows.  An empty table has a root of its own.
    """
    spark, n = df.sparkSession, df.count()
    bits = min(48, max(0, (-(-n // RANGE_ROWS) - 1).bit_length()))
    leaves = cut(_leaves(df, keys, bits), "leaves")
    leaves.write.parquet(f"{path}/rows")
    nodes = _tree(leaves, bits)
    nodes.write.parquet(f"{path}/nodes")
    root = _root(nodes)
    spark.createDataFrame([(root, n, bits, sorted(df.columns), keys)], "root string, rows long, bits int, columns array<string>, keys array<string>").coalesce(1).write.parquet(f"{path}/manifest")
    return root


def _root(nodes: DataFrame) -> str:
    found = nodes.where("level = 0").first()
    return found["digest"] if found else "empty"


@dataclass
class Replay:
    """Both roots, whether they are equal, and what differs: state (changed, lost, added), range, its level's bits, and the keys."""

    frozen: str
    now: str
    differences: DataFrame
    ranges: DataFrame

    @property
    def reproduced(self) -> bool:
        return self.frozen == self.now

    def first_range(self) -> int | None:
        """The first range that differs."""
        found = self.ranges.agg(F.min("place").alias("place")).first()
        return found["place"]


def replay(df: DataFrame, path: str) -> Replay:
    """Compare a table with what was frozen below ``path``.

    The stored tree is first held against its own rows' digests, so a store that
    was tampered with is refused.  A key is lost or added if it has no rows on
    one side, changed if its rows differ.
    """
    spark = df.sparkSession
    manifest = spark.read.parquet(f"{path}/manifest").first()
    keys, bits = list(manifest["keys"]), manifest["bits"]
    if sorted(df.columns) != list(manifest["columns"]):
        raise ValueError(f"columns differ: {sorted(df.columns)} now, {manifest['columns']} frozen")
    rows, stored = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/nodes")
    again = _tree(rows, bits)
    if _root(again) != manifest["root"] or _root(stored) != manifest["root"]:
        raise ValueError("the frozen rows or nodes are not those of the manifest")
    leaves = cut(_leaves(df, keys, bits), "leaves")
    now = _tree(leaves, bits)
    level, last, differ = 0, 0, None
    while True:
        a, b = stored.where(F.col("level") == level).select("place", F.col("digest").alias("was")), now.where(F.col("level") == level).select("place", F.col("digest").alias("is"))
        both = a.join(b, "place", "full").where(~F.col("was").eqNullSafe(F.col("is")))
        if differ is not None:
            both = both.join(few(differ.withColumnRenamed("place", "up"), differ), F.shiftrightunsigned("place", level - last) == F.col("up"), "left_semi")
        differ = cut(both.select("place"), "differ")
        if level == bits or differ.isEmpty():
            break
        last, level = level, level + _step_down(bits, level)
    there, here = rows.join(few(differ, differ), "place", "left_semi"), leaves.join(few(differ, differ), "place", "left_semi")
    own = lambda x, name: x.groupBy(*keys, "place").agg(F.array_sort(F.collect_list("digest")).alias(name))  # noqa: E731  a key's rows
    was, is_ = own(there, "was"), own(here, "is")
    left = beside(was, is_, [*keys, "place"], "left").select(*keys, "place", F.when(F.col("is").isNull(), "lost").when(F.col("was") != F.col("is"), "changed").alias("state"))
    right = beside(is_, was.withColumn("seen", F.lit(True)).drop("was"), [*keys, "place"], "left").where("seen IS NULL").select(*keys, "place", F.lit("added").alias("state"))
    found = left.where("state IS NOT NULL").unionByName(right).withColumnRenamed("place", "range")
    return Replay(manifest["root"], _root(now), found, differ)


def _step_down(bits: int, level: int) -> int:
    """How many bits the next level below has more; levels are 0, the rest, then whole steps from the leaves up."""
    rest = bits % STEP or STEP
    return min(bits, rest) if level == 0 else STEP
