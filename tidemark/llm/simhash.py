"""Near duplicates by 64-bit SimHash fingerprints and a self-join of binary tries.

Two fingerprints within three bits agree in at least one of four 16-bit blocks.
So the trie is built four times, each with another block as its first levels;
pairs whose first block agrees meet there, which deals tries to tasks by block.
The 48 bits behind a block that very many share are cut in four again, of which
one agrees too.  Tasks take their blocks one after the other.
Inside a task, node pairs go down together, the bits in which they differ add
up, and a pair ends as soon as it has more than the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import LongType

from tidemark.llm.shared import connected_components, cut, few, numbered, spare
from tidemark.llm.shingles import Alike, similar_components, sketch

#: Words in a shingle, and bits in which linked fingerprints may differ.
WIDTH, BUDGET = 3, 3
BITS, BLOCK, PART = 64, 16, 12
SEED = 42
#: Node pairs that are taken down together; more are split, which bounds memory.
FRONT = 1 << 21
#: Shingles whose bits are counted together, and fingerprints whose tries are built together.
STRIP, SLICE = 1 << 15, 1 << 18


def fingerprint(text: str | None) -> int:
    """SimHash of a text's shingles: a bit is set if over half of the shingle hashes have it; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(WIDTH)), strict=False) if len(words) >= WIDTH else iter([words])
    count, ones = max(1, len(words) - WIDTH + 1), np.zeros(BITS, np.int64)
    hashes = (xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles)
    for at in range(0, count, STRIP):
        h = np.fromiter(hashes, np.uint64, min(STRIP, count - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


@pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def as_hex(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _roots(labels: np.ndarray, i: int) -> int:
    while labels[i] != i:
        labels[i] = labels[labels[i]]
        i = labels[i]
    return i


def trie_links(values: np.ndarray, budget: int = BUDGET, shared: int = BLOCK) -> np.ndarray:
    """Pairs of places in ``values`` (sorted, distinct, unsigned) that link all within ``budget`` bits.

    Only values whose first ``shared`` bits agree are compared.  The pairs are a
    spanning forest: any two values with a path of links have one of returned
    pairs.  The budget rises step by step; a pair of nodes whose values are all
    in one component already isn't taken further, which keeps dense groups cheap.
    """
    n = len(values)
    labels, pairs = np.arange(n), []
    ones = np.zeros((BITS, n + 1), np.int32)
    for d in range(shared, BITS):
        np.cumsum((values >> np.uint64(BITS - 1 - d)) & np.uint64(1), out=ones[d, 1:])
    heads = np.flatnonzero(np.r_[True, np.diff(values >> np.uint64(BITS - shared)) != 0]) if n else np.zeros(0, np.int64)
    ends = np.r_[heads[1:], n] if n else heads
    for most in range(1, budget + 1):
        whole = np.array([_roots(labels, i) for i in range(n)], np.int64)
        runs = np.cumsum(np.r_[0, np.diff(whole) != 0]) if n else whole
        many = ends - heads > 1
        stack = [(shared, heads[many], ends[many], heads[many], ends[many], np.zeros(many.sum(), np.int8))]
        while stack:
            depth, alo, ahi, blo, bhi, diff = stack.pop()
            if len(alo) > FRONT:
                half = len(alo) // 2
                stack += [(depth, *(x[part] for x in (alo, ahi, blo, bhi, diff))) for part in (slice(half), slice(half, None))]
                continue
            one_label = (runs[alo] == runs[ahi - 1]) & (runs[blo] == runs[bhi - 1]) & (whole[alo] == whole[blo])
            single = (ahi - alo == 1) & (bhi - blo == 1)
            near = single & ~one_label
            near[near] = np.bitwise_count(values[alo[near]] ^ values[blo[near]]) <= most
            for a, b in zip(alo[near].tolist(), blo[near].tolist(), strict=True):
                if (x := _roots(labels, a)) != (y := _roots(labels, b)):
                    labels[max(x, y)] = min(x, y)
                    pairs.append((a, b))
            go = ~one_label & ~single
            if depth == BITS or not go.any():
                continue
            alo, ahi, blo, bhi, diff = (x[go] for x in (alo, ahi, blo, bhi, diff))
            amid = ahi - (ones[depth, ahi] - ones[depth, alo])
            bmid = bhi - (ones[depth, bhi] - ones[depth, blo])
            cross = ~((alo == blo) & (ahi == bhi))  # a node with itself has its two children as a pair once
            below = [np.concatenate(x) for x in zip(
                (alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1), (amid[cross], ahi[cross], blo[cross], bmid[cross], diff[cross] + 1), strict=True
            )]
            keep = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= most)
            stack.append((depth + 1, *(x[keep] for x in below)))
    return np.array(pairs, np.int64).reshape(-1, 2)


def _trie_tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside a task's tries; rows, in the order of turn, block, part and bits: those and v, the turned fingerprint, and first.

    What is held is some SLICE rows and the block that they end in.
    """
    names = ["turn", "block", "part", "bits"]

    def linked(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for part, own in rows.groupby(["turn", "part"], sort=False):
            v, first, shared = own["v"].to_numpy().view(np.uint64), own["first"].to_numpy(), BLOCK
            if part[1] >= 0:  # the part of this trie comes behind the block
                low, by, width = v & np.uint64((1 << (BITS - BLOCK)) - 1), np.uint64(int(part[1]) * PART), np.uint64(BITS - BLOCK)
                low = ((low << by) | (low >> (width - by))) & np.uint64((1 << (BITS - BLOCK)) - 1)
                v, shared = (v >> width << width) | low, BLOCK + PART
            order = np.argsort(v)
            links = trie_links(v[order], shared=shared)
            yield pd.DataFrame({"a": first[order[links[:, 0]]], "b": first[order[links[:, 1]]]})

    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= SLICE and len(frame):
            rows = pd.concat(held)
            last = (rows[names] == rows[names].iloc[-1]).all(axis=1).to_numpy()  # this block may go on
            yield from linked(rows[~last])
            held, size = [rows[last]], int(last.sum())
    if size:
        yield from linked(pd.concat(held))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints within the budget; ``distinct`` has fp and first, fp being distinct."""
    turns = F.array(*(F.struct(F.lit(t).alias("turn"), (F.shiftleft("fp", BLOCK * t).bitwiseOR(F.shiftrightunsigned("fp", BITS - BLOCK * t)) if t else F.col("fp")).alias("v")) for t in range(BITS // BLOCK)))
    turned = distinct.select(F.explode(turns).alias("t"), "first").select("t.*", "first").withColumn("block", F.shiftrightunsigned("v", BITS - BLOCK))
    crowded = turned.groupBy("turn", "block").agg(F.count("*").alias("n")).where(F.col("n") > SLICE).select("turn", "block", F.lit(True).alias("crowded"))
    crowded = cut(crowded, "blocks")  # of four times 65,536
    parts = F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit((BITS - BLOCK) // PART - 1))).otherwise(F.array(F.lit(-1)))
    split = turned.join(F.broadcast(crowded), ["turn", "block"], "left").withColumn("part", F.explode(parts))
    bits = F.lit(0).cast("long")
    for k in range((BITS - BLOCK) // PART):
        bits = F.when(F.col("part") == k, F.shiftrightunsigned("v", BITS - BLOCK - PART * (k + 1)).bitwiseAND(F.lit((1 << PART) - 1))).otherwise(bits)
    by = ["turn", "block", "part", "bits"]
    dealt = split.withColumn("bits", bits).repartition(*by).sortWithinPartitions(*by)
    return dealt.select(*by, "v", "first").mapInPandas(_trie_tasks, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id (the smallest id reachable by links).

    Texts are lower-cased in A-Z and split at ASCII white space; shingles have
    three words, or all words of shorter texts.  Null, empty and blank texts have
    fingerprint 0, which is linked like any other.  Equal fingerprints are
    grouped before any comparison, so copies cost one row.  Repeated rows are
    each returned.  Rows with a null id get one but take no part in links.  An
    empty table gives an empty result; other columns are ignored.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp")), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")).where("first IS NOT NULL"), "distinct")
    found = connected_components(fingerprint_links(distinct))
    classes = distinct.join(found, distinct["first"] == found["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return rows.join(classes, "fp", "left").select("doc_id", F.col("fp").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, rule: Alike = Alike(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of documents that are alike, directly or over others, with all its columns.

    Alike are texts of which the sets of shingles (``rule.width`` words) have a
    similarity of ``rule.least``.  Tries propose the pairs whose fingerprints
    are within the budget; at that similarity many differ in more bits, so
    bands of minima propose the others.  All proposed pairs are compared by
    their shingles.  The smallest id stays, null ids last; of repeated rows one.
    Words are lower-cased in A-Z and split at ASCII white space; null texts
    and texts without words are alike.  An empty table gives an empty result.
    """
    (row,) = spare(docs, "row")
    rows = numbered(docs, row)
    seen = rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), sketch(F.col(text_col), rule).alias("s")).select("row", "id", "s.*")
    seen = cut(seen, "near-sketches")
    distinct = seen.groupBy("digest").agg(F.min("row").alias("node"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"))
    distinct = cut(distinct, "near-distinct")
    firsts = cut(distinct.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    equal = distinct.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    proposed = fingerprint_links(firsts).unionByName(equal)
    texts = rows.select(F.col(row).alias("node"), F.col(text_col).alias("text"))
    found = similar_components(distinct, texts, rule, proposed)
    classes = distinct.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    each = cut(seen.select("row", "id", "digest").join(classes, "digest").select("row", "id", "component"), "near-components")
    stays = each.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least"), F.count("*").alias("n")).where("n > 1")
    gone = cut(each.join(stays, "component").where("row <> least.row").select(F.col("row").alias(row)), "near-gone")
    return rows.join(few(gone, gone), row, "left_anti").select(docs.columns)
