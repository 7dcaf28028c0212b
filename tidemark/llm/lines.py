"""Line duplicates within an edit distance, found by segments and substrings.

A line is split into threshold + 1 segments.  If a line is within ``threshold``
edits of another, there is a segment i that stands unchanged in the other with
exactly i edits before it: the first stands at the same place from the left, the
last at the same place from the right, those between are shifted by i places
or threshold - i at most.  Windows at these few places of a segment are the
keys; lines whose lengths fall on one step of a grid have the same windows, and
lines just above a step have those of the step below too.  Lines that share a
key are compared by a banded bit-parallel edit distance.

Keys that very many lines share are split: what is left of their lines outside
the shared segment is segmented in the same way.  A rest of a few code points
has its deletion variants as keys.  What is still a crowd after some levels is
dealt in pairs of blocks.  Inside a key, parities of characters and of their
pairs tell most lines apart before their distance is measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from tidemark.llm.hashing import mix, release
from tidemark.llm.shared import WHITE, connected_components, cut, few, numbered, ship, spare

#: Different lines of a key that are compared in one go; a key with more is split, LEVELS times at most, and then dealt in blocks.
CROWD, LEVELS = 4096, 2
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Rule:
    """threshold: edits in code points within which lines are linked; shortest: lines with fewer code points are left alone, except that
    equal lines from ``equal`` code points on are repeats (shortest, where that is None)."""

    threshold: int = 2
    shortest: int = 20
    equal: int | None = None

    def steps(self, length: int) -> set[int]:
        """The grid's steps that a line or rest of this length has windows for."""
        return {n - n % (4 if n < 64 else 16) for n in range(max(0, length - self.threshold), length + 1)}


def line_keys(line: str, rule: Rule, lo: int = 0, hi: int | None = None, parent: int = 0) -> list[tuple[int, int, int]]:
    """(key, lo, hi) of the stretch lo to hi of a line: keys of its windows, and what is left outside each."""
    hi, t = len(line) if hi is None else hi, rule.threshold
    out = []
    for step in rule.steps(hi - lo):
        seed = (parent * 0x9E3779B97F4A7C15 + step * 64) & _MASK
        if step < 2 * t + 4:
            rest = line[lo:hi]
            kinds = {"".join(rest[i] for i in range(len(rest)) if i not in gone) for k in range(t + 1) for gone in map(set, combinations(range(len(rest)), min(k, len(rest))))}
            out += [(_hash(x, seed), lo, hi) for x in kinds]
            continue
        size = step // (t + 1)
        for i in range(t + 1):
            wide = min(i, t - i)
            for shift in range(wide + 1):
                at = lo + i * size + shift if i <= t - i else hi - (t + 1 - i) * size + shift
                end = at + size - wide
                rest = (end, hi) if i <= t - i else (lo, at)
                out.append((_hash(line[at:end], seed + i + 1), *rest))
    return out


def _hash(part: str, seed: int) -> int:
    h = xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), seed & _MASK)
    return h - (1 << 64) if h >> 63 else h


def _digest(line: str) -> tuple[int, int]:
    """The 128 bits that tell a line from others, as two signed numbers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")), ">i8").tolist())


def _same_head(a: str, b: str) -> int:
    """How many code points two texts have in common at their start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def within(a: str, b: str, threshold: int) -> bool:
    """Whether two texts are within ``threshold`` edits.

    Per number of errors a word of bits holds which places of ``a`` are reached
    after each character of ``b``; only the 2 * threshold + 1 places around the
    diagonal are held.
    """
    if abs(len(a) - len(b)) > threshold:
        return False
    head = _same_head(a, b)
    a, b = a[head:], b[head:]
    tail = _same_head(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    width = 2 * threshold + 1
    whole = (1 << width) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a[: len(b) + threshold + 1]):
        places[c] = places.get(c, 0) | 1 << (i + threshold)
    reached = [((1 << (e + 1)) - 1) << threshold & whole for e in range(threshold + 1)]  # bit k: threshold less than k characters of a
    for j, c in enumerate(b):
        match = places.get(c, 0) >> j & whole  # bit k: the character after the place k stands for is c
        new: list[int] = []
        for e, r in enumerate(reached):
            n = r & match  # the window moves on by one, so a match stays where it is
            if e:
                n |= reached[e - 1] >> 1 | reached[e - 1] | new[e - 1] << 1 & whole
            new.append(n)
        reached = new
        if not reached[-1]:
            return False
    end = len(a) - len(b) + threshold
    return bool(reached[-1] >> end & 1)


def parities(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits for each line that say which kinds of characters occur an odd number of times, and 64 for which neighbours do.

    An edit changes 2 of the first at most, and 4 of the second: two characters
    that were neighbours of the place, and two that are.
    """
    points = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(size + 1) - (size + 1)
    value = mix(points + np.uint64(77))
    one = np.uint64(1) << (value >> np.uint64(58))
    two = np.uint64(1) << (mix(value[:-1] * np.uint64(3) + value[1:]) >> np.uint64(58))
    ends = start + size
    one[ends] = 0
    two = np.append(two, np.uint64(0))
    two[ends] = 0
    two[np.maximum(ends - 1, 0)] = 0
    return np.bitwise_xor.reduceat(one, start), np.bitwise_xor.reduceat(two, start)


def group_links(nodes: list[int], lines: list[str], threshold: int) -> list[tuple[int, int]]:
    """Links that join all lines of one key within the threshold, without those between lines that are joined already."""
    if len(lines) < 2:
        return []
    label, out = np.arange(len(lines)), []
    one, two = parities(lines)
    size = np.array([len(x) for x in lines])
    for i in range(1, len(lines)):
        near = (np.bitwise_count(one[:i] ^ one[i]) <= 2 * threshold) & (np.bitwise_count(two[:i] ^ two[i]) <= 4 * threshold)
        near &= (np.abs(size[:i] - size[i]) <= threshold) & (label[:i] != label[i])
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i] and within(lines[j], lines[i], threshold):
                label[label == label[j]] = label[i]
                out.append((nodes[j], nodes[i]))
    return out


def _strip_lines(text: str | None) -> Iterator[tuple[int, str]]:
    """Number and text of each line with more than white space."""
    for no, line in enumerate((text or "").split("\n")):
        line = line.strip(WHITE)
        if line:
            yield no, line


def _occurrences(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (row, doc_id, h, text) a row per line; and one per document, with the number -1 and how many lines it has as length."""
    least = max(rule.shortest, rule.threshold + 1)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            known: dict[bytes, list[int]] = {}  # keys of lines that this batch had already
            place, no, digests, length, keys, counts = [], [], [], [], [], []
            for i, text in enumerate(given["text"]):
                first = len(place)
                for n, line in _strip_lines(text.as_py()):
                    digest = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                    if digest not in known:
                        known[digest] = list({k for k, *_ in line_keys(line, rule)}) if len(line) >= least else []
                    no.append(n)
                    digests.append(digest)
                    length.append(len(line))
                    keys += known[digest]
                    counts.append(len(known[digest]))
                place += [i] * (len(no) - first + 1)
                length.append(len(no) - first)
                no.append(-1)
                digests.append(b"\0" * 16)
                counts.append(0)
            halves = np.frombuffer(b"".join(digests), ">i8").astype("<i8").reshape(-1, 2)
            own = given.select(["row", "doc_id", "h"]).take(pa.array(place, pa.int64()))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts, dtype=np.int64)], pa.int32()), pa.array(keys, pa.int64()))
            arrays = [pa.array(no, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(length, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays([*own.columns, *arrays], names=["row", "doc_id", "h", "no", "hi", "lo", "length", "keys"])
        release()

    return made


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, line) of the wanted lines of texts; a line with another digest is of another text with the same hash."""
    for given in batches:
        nodes, lines = [], []
        for text, wanted in zip(given["text"], given["wanted"].to_pylist(), strict=True):
            parts = text.as_py().split("\n")
            for w in wanted:
                line = parts[w["no"]].strip(WHITE) if w["no"] < len(parts) else ""
                if _digest(line) == (w["hi"], w["lo"]):
                    nodes.append(w["node"])
                    lines.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], names=["node", "line"])


def _linked(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within each key; rows (key, node, line) come in the order of keys."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, lines = None, [], []
        for given in batches:
            found = []
            for key, node, line in zip(*(given[c].to_pylist() for c in ("key", "node", "line")), strict=True):
                if key != now:
                    found += group_links(nodes, lines, rule.threshold)
                    now, nodes, lines = key, [], []
                nodes.append(node)
                lines.append(line)
            yield _pairs(found)
        yield _pairs(group_links(nodes, lines, rule.threshold))
        release()

    return made


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _split(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of what is left of lines beside the key that they share; rows (key, node, lo, hi, line), lo null for keys of whole lines."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            out = set()
            for key, node, lo, hi, line in zip(*(given[c].to_pylist() for c in ("key", "node", "lo", "hi", "line")), strict=True):
                rests = {(lo, hi)} if lo is not None else {(x, y) for k, x, y in line_keys(line, rule) if k == key}
                out |= {(k, node, x, y) for a, b in rests for k, x, y in line_keys(line, rule, a, b, key)}
            arrays = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "node", "lo", "hi"])

    return made


def line_links(keyed: DataFrame, first: DataFrame, texts: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(a, b): nodes of different lines that join all within the threshold.

    ``keyed`` has node and key, ``first`` where each node stands (node, hi, lo, no
    and h, the hash of a text), ``texts`` h and text.  Links between lines that
    others of the same key join already are left out, so that the links of n
    lines alike grow with n.
    """
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(keyed.join(shared, "key").select("key", "node", "n"), "line-members")
    wanted = cut(first.join(members.select("node").distinct(), "node", "left_semi"), "line-wanted")
    asked = few(wanted.groupBy("h").agg(F.collect_list(F.struct("no", "node", "hi", "lo")).alias("wanted")), wanted)
    known = texts.join(asked, "h").select("text", "wanted").mapInArrow(_texts_of, "node long, line string")
    known = cut(known.groupBy("node").agg(F.min("line").alias("line")), "line-texts")

    def links(rows: DataFrame) -> DataFrame:
        dealt = rows.select("key", "node").join(known, "node").repartition("key").sortWithinPartitions("key", "node")
        return dealt.select("key", "node", "line").mapInArrow(_linked(rule), "a long, b long")

    out = links(members.where(F.col("n") <= CROWD))
    crowd = members.where(F.col("n") > CROWD).select("key", "node", "n", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    for _ in range(LEVELS):
        if crowd.isEmpty():
            return out.distinct()
        parts = crowd.join(known, "node").select("key", "node", "lo", "hi", "line").mapInArrow(_split(rule), "key long, node long, lo int, hi int")
        parts = cut(parts.dropDuplicates(["key", "node"]), "line-crowd")
        sizes = parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        parts = cut(parts.join(sizes, "key"), "line-crowd")
        out = out.unionByName(links(parts.where(F.col("n") <= CROWD)))
        crowd = parts.where(F.col("n") > CROWD)
    # a line is with each other one in the block of one pair of blocks at least
    blocks, own = F.ceil(2 * F.col("n") / CROWD), F.pmod(F.xxhash64("node"), F.ceil(2 * F.col("n") / CROWD))
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = crowd.withColumn("own", own).withColumn("other", other)
    return out.unionByName(links(dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node"))).distinct()


def line_classes(docs: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """Lines that are repeated or linked, and the documents; ``docs`` has row (unique), doc_id and text.

    The first has row, no, class_id, near (linked to a different line) and
    removed; the second row, doc_id and n_lines.  Lines linked directly or over others
    are one class.  The line with the smallest document id stays, null ids last,
    then with the smallest row and number.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("row", "doc_id", F.xxhash64("text").alias("h"), "text")
    lines = given.mapInArrow(_occurrences(rule), f"row long, doc_id {kind}, h long, no int, hi long, lo long, length int, keys array<long>")
    lines = cut(lines, "line-occurrences")
    least = rule.shortest if rule.equal is None else min(rule.equal, rule.shortest)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "no", "h")
    kinds = lines.where((F.col("no") >= 0) & (F.col("length") >= least)).groupBy("hi", "lo")
    kinds = kinds.agg(F.count("*").alias("n"), F.min(order).alias("first"), F.any_value("keys").alias("keys"))
    kinds = cut(kinds.withColumn("node", F.monotonically_increasing_id()), "line-kinds")
    keyed = kinds.select("node", F.explode("keys").alias("key"))
    first = kinds.select("node", "hi", "lo", "first.no", "first.h")
    texts = docs.select(F.xxhash64("text").alias("h"), "text").where("text IS NOT NULL")
    found = connected_components(cut(line_links(keyed, first, texts, rule), "line-links"))
    known = kinds.select("node", "hi", "lo", "n", "first").join(found, "node", "left").where("n > 1 OR component IS NOT NULL")
    known = cut(known.withColumn("class_id", F.coalesce("component", "node")).drop("n"), "line-classes")
    stays = known.groupBy("class_id").agg(F.min("first").alias("stays"))
    known = known.join(stays, "class_id").select("hi", "lo", "class_id", F.col("component").isNotNull().alias("near"), F.struct("stays.row", "stays.no").alias("stays"))
    marked = lines.where("no >= 0").select("row", "no", "hi", "lo").join(few(known, known), ["hi", "lo"])
    marked = marked.select("row", "no", "class_id", "near", (F.struct("row", "no") != F.col("stays")).alias("removed"))
    return marked, lines.where("no < 0").select("row", "doc_id", F.col("length").cast("long").alias("n_lines"))


def line_report(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_near (lines linked to a different line), n_removed, removed (line numbers from 0, comma-joined).

    Lines end at line feeds; white space at their ends doesn't count, and blank
    lines are no lines.  Lines shorter than the rule's shortest are removed
    only as repeats of an equal line, from the rule's equal on; equal are lines
    with one 128-bit digest.  Of a class the line of the smallest id stays, null
    ids last.  Null and empty texts have no lines.  Repeated rows and rows with a
    null id are documents of their own.  An empty table gives an empty result;
    other columns are ignored.

    Keys that more than CROWD different lines share are split by further
    segments, and at last dealt in blocks; the classes are the same.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked, counted = line_classes(rows, rule)
    numbers = F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("no"))))
    per = marked.groupBy("row").agg(
        F.sum(F.col("near").cast("long")).alias("n_near"),
        F.sum(F.col("removed").cast("long")).alias("n_removed"),
        F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",").alias("removed"),
    )
    zero = F.lit(0).cast("long")
    found = counted.join(per, "row", "left")
    return found.select("doc_id", "n_lines", *(F.coalesce(c, zero).alias(c) for c in ("n_near", "n_removed")), F.coalesce("removed", F.lit("")).alias("removed"))


@pandas_udf(StringType())
def _without(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    def one(text: str | None, gone: np.ndarray | None) -> str | None:
        if text is None or gone is None:
            return text
        out = set(gone)
        return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in out)

    return pd.Series([one(t, n) for t, n in zip(texts, numbers, strict=True)])


def drop_lines(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their removed lines, with all their columns; documents of which no words are left are gone.

    Which lines are removed is as in line_report; repeated rows and rows with a
    null id are documents of their own.  Documents that had no words before
    stay as they are, null texts too.  An empty table gives an empty result.
    """
    row, gone = spare(docs, "row", "gone")
    rows = numbered(docs, row)
    marked, _ = line_classes(rows.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rule)
    lost = cut(marked.where("removed").groupBy(F.col("row").alias(row)).agg(F.collect_list("no").alias(gone)), "line-gone")
    joined = rows.join(few(lost, lost), row, "left")
    changed = joined.withColumn(text_col, F.when(F.col(gone).isNotNull(), _without(F.col(text_col), F.col(gone))).otherwise(F.col(text_col)))
    return changed.where(F.col(gone).isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)
