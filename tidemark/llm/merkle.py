"""A manifest of a table as a Merkle tree whose versions share what they don't change.

The rows of a group are its leaves, in order.  Every two consecutive nodes become
one, until a group has one node, its subroot; the groups' subroots become the
root likewise.  Leaves are ranked by a range partitioning and dealt in aligned
blocks of 256; a block is a subtree of eight levels, and the blocks' tops are the
leaves of the next tier, so that no task holds more than a block, whatever the
size of a group.

A changed leaf makes a version of the tree: the nodes above it are copied, all
others are those of the tree itself.  Versions of a block start in its task; the
nodes that they need above it are the same for all leaves of the block, so each
block is given them once and its versions go on by themselves: however many
there are, none waits for or stands beside those of other blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, few, ship

#: Levels of a block; a block has two to that power leaves at most.
BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCK = "of string, block long, total long, nodes array<string>"


def joined(*digests: str) -> str:
    """The digest of inputs one after the other."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


@dataclass
class Subtree:
    """Nodes of a block by level, leaves first."""

    levels: list[list[str]]

    @classmethod
    def over(cls, leaves: list[str], height: int | None = None) -> Subtree:
        """The tree over leaves, of a given height, or up to one node."""
        levels = [list(leaves)]
        while len(levels) <= height if height is not None else len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([joined(*below[i : i + 2]) for i in range(0, len(below), 2)])
        return cls(levels)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[str]:
        """For each level from the leaves: the other node of the run, R before its digest if it stands to the right, L if to the left; - if there is none."""
        out = []
        for level in self.levels[:-1]:
            other = at ^ 1
            out.append(("R" if other > at else "L") + level[other] if other < len(level) else "-")
            at >>= 1
        return out


@dataclass
class Version:
    """A tree with one leaf changed: the copied nodes; all others are the base's."""

    base: Subtree
    at: int
    copied: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, base: Subtree, at: int, leaf: str) -> Version:
        return cls(base, at, climbed(leaf, base.siblings(at)))

    def node(self, level: int, at: int) -> str:
        return self.copied[level] if self.at >> level == at else self.base.levels[level][at]


def climbed(leaf: str, siblings: Sequence[str]) -> list[str]:
    """The nodes from a leaf to the top, by the siblings on the way (see Subtree.siblings)."""
    out = [leaf]
    for s in siblings:
        out.append(joined(out[-1]) if s == "-" else joined(s[1:], out[-1]) if s[0] == "L" else joined(out[-1], s[1:]))
    return out


def proof(siblings: Sequence[str]) -> str:
    """The digest of a leaf's siblings from the leaf to the root."""
    return joined(*(s[1:] for s in siblings))


def leaf(fields: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields: - for a null, else the number of UTF-8 bytes, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A string that is never null: nulls come first, then values by their UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``of`` as their group get ``at``, their place in it from 0, and ``total``, its size.

    Rows are range-partitioned by group and order and numbered there; a group's
    partitions are then told how many of its rows come before them, so a group
    may have any part of all rows.
    """
    keys = ["of", *order]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("of", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row a partition and group in it
    before = F.sum("n").over(W.partitionBy("of").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    parts = cut(parts.select("of", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy("of")).alias("total")), "parts")
    return placed.join(few(parts, parts), ["of", "part"]).withColumn("at", F.col("at") + F.col("shift")).drop("part", "shift")


def _blocks(rows: DataFrame, *other: str) -> DataFrame:
    """A row a block of 256 consecutive rows of a group: their digests ``node`` in order, and further columns in lists."""
    found = rows.groupBy("of", F.shiftright("at", BITS).alias("block"), "total").agg(F.array_sort(F.collect_list(F.struct("at", "node", *other))).alias("r"))
    return found.select("of", "block", "total", *(F.col("r")[c].alias(name) for c, name in (("node", "nodes"), *((c, c) for c in other))))


def _subtree(nodes: list[str], total: int) -> Subtree:
    return Subtree.over(nodes, BITS if total > 1 << BITS else None)


def _tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        roots = [_subtree(list(nodes), total).root for nodes, total in zip(f["nodes"], f["total"], strict=True)]
        yield pd.DataFrame({"of": f["of"], "at": f["block"], "total": -(-f["total"] // (1 << BITS)), "node": roots})


def _paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each node of a block what stands beside it and its ancestors, up to the top."""
    for f in frames:
        for of, block, total, nodes, path in zip(f["of"], f["block"], f["total"], f["nodes"], f["path"], strict=True):
            tree, above = _subtree(list(nodes), total), list(path)
            yield pd.DataFrame({"of": of, "block": [(block << BITS) + i for i in range(len(nodes))], "path": [tree.siblings(i) + above for i in range(len(nodes))]})


class Tiers:
    """The blocks of all groups, tier by tier, each a table in the shared folder."""

    def __init__(self, blocks: DataFrame) -> None:
        """``blocks``: the lowest tier (of, block, total, nodes, and any other columns)."""
        self.tables, tops = [blocks], []
        while True:
            low = self.tables[-1].select("of", "block", "total", "nodes")
            up = cut(low.mapInPandas(_tops, "of string, at long, total long, node string"), "tops")
            tops.append(up.where("total = 1").select("of", "node"))
            more = up.where("total > 1")
            if more.isEmpty():
                break
            self.tables.append(cut(_blocks(more), "tier"))
        self.roots = tops[0]
        for t in tops[1:]:
            self.roots = self.roots.unionByName(t)

    def with_paths(self, above: DataFrame) -> DataFrame:
        """The lowest tier, each block with what stands beside its top and the ancestors of this; ``above`` (of, path) has it for whole groups."""
        paths = None
        for table in reversed(self.tables):
            whole = table.where(F.col("total") <= 1 << BITS).join(above, "of")  # a block that is all of its group in this tier
            if paths is not None:
                whole = whole.unionByName(table.where(F.col("total") > 1 << BITS).join(paths, ["of", "block"]))
            if table is self.tables[0]:
                return whole
            paths = cut(whole.select("of", "block", "total", "nodes", "path").mapInPandas(_paths, "of string, block long, path array<string>"), "paths")
        raise AssertionError


@dataclass
class Manifest:
    """``rows``: a row a block with its leaves' ids, digests and changed digests, subroot, and the path above it; root: the digest of all; id_type: the type of the ids, which the rows have as text."""

    rows: DataFrame
    root: str
    id_type: str


def build(docs: DataFrame, changed: Column | None = None, fields: Sequence[str] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", changes: dict[str, Column] | None = None) -> Manifest:
    """The tree over the rows of ``docs``: leaves by group, in the order of their ids (nulls first, equal ids by digest).

    Where ``changed`` holds, a version is to be made with the columns
    ``changes`` instead of those of the row.
    """
    ship(docs.sparkSession)
    new = leaf([(changes or {}).get(f, F.col(f)) for f in fields])
    node = leaf([F.col(f) for f in fields])
    other = F.when(changed, new) if changed is not None else F.lit(None).cast("string")
    rows = cut(docs.select(group_key(F.col(group_col)).alias("of"), F.col(id_col).alias("id"), node.alias("node"), other.alias("other")), "leaves")
    placed = ranked(rows, ["id", "node", "other"]).withColumn("id", F.col("id").cast("string"))  # numbers in lists with nulls would become floats in Python
    tiers = Tiers(cut(_blocks(placed, "id", "other"), "blocks"))
    subroots = cut(tiers.roots.withColumnRenamed("node", "subroot"), "subroots")
    groups = ranked(subroots.select(F.lit("").alias("of"), F.col("of").alias("name"), F.col("subroot").alias("node")), ["name"])
    upper = Tiers(cut(_blocks(groups, "name"), "groups"))
    first = upper.roots.first()
    root = first["node"] if first else joined()
    above = upper.with_paths(docs.sparkSession.createDataFrame([("", [])], "of string, path array<string>"))
    above = cut(above.select("of", "block", "total", "nodes", "path", "name").mapInPandas(_group_paths, "of string, path array<string>"), "above")
    whole = subroots.join(few(above, above), "of")
    whole = cut(whole, "whole")
    found = tiers.with_paths(few(whole.select("of", "path"), whole))
    return Manifest(found.join(few(subroots, subroots), "of"), root, docs.schema[id_col].dataType.simpleString())


def _group_paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for names, total, nodes, path in zip(f["name"], f["total"], f["nodes"], f["path"], strict=True):
            tree, above = _subtree(list(nodes), total), list(path)
            yield pd.DataFrame({"of": list(names), "path": [tree.siblings(i) + above for i in range(len(nodes))]})


def verified(manifest: Manifest) -> DataFrame:
    """One row a leaf: id, leaf, subroot, root, proof_sha256, folded_root, verified, copied.

    A changed leaf's version is climbed to its root, ``copied`` being its own
    nodes from the leaf up; an unchanged leaf is in the tree itself and copies
    nothing.  ``verified``: the root that the leaf leads to is that of the tree.
    """
    root = manifest.root

    def climb(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for ids, nodes, others, total, path, subroot in zip(f["id"], f["nodes"], f["other"], f["total"], f["path"], f["subroot"], strict=True):
                tree, above = _subtree(list(nodes), total), list(path)
                same = climbed(tree.root, above)[-1]
                proofs, folded, copied = [], [], []
                for at, other in enumerate(others):
                    siblings = tree.siblings(at)
                    proofs.append(proof(siblings + above))
                    version = Version.of(tree, at, other) if other is not None else None
                    own = version.copied + climbed(version.copied[-1], above)[1:] if version else []
                    copied.append(own)
                    folded.append(own[-1] if own else same)
                yield pd.DataFrame({"id": pd.Series(list(ids), dtype=object), "leaf": list(nodes), "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded], "copied": copied})

    kind = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<string>"
    return manifest.rows.select("id", "nodes", "other", "total", "path", "subroot").mapInPandas(climb, kind).withColumn("id", F.col("id").cast(manifest.id_type))


def document_manifest(docs: DataFrame) -> DataFrame:
    """Documents as leaves: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 7 divides crc32 of the id as text, the row is tampered with: one is
    added to n_chars.  Null ids and null n_chars stay as they are.  Leaves of a
    language ascend by id, null ids first, equal ids by their digest; a null
    language is a group of its own and comes first.  Repeated rows are leaves
    each.  An empty table gives an empty result; other columns are ignored.
    """
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    found = verified(build(docs, hit, changes={"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
