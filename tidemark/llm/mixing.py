"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are laid on a line of words in a shuffled order, and the
line is cut into blocks.  Points of the golden-ratio sequence, sent through the
sources' cumulative weights, say which source each slot of the mix takes from;
the r-th slot of a source takes its r-th block, and a line that ends starts anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, few, numbered, spare

#: The golden-ratio step of a sequence of 32-bit points.
STEP, POINTS, PERIOD = 2654435769, 1 << 32, 1 << 31
#: Points fall into so many cells by their upper bits, for the lookup of their source.
CELLS = 1 << 10
#: Rows whose running sum or rank is made together: documents by shuffle key, slots by number; and parts whose running sum is.
KEY_BITS, SLOT_BITS, PART_BITS = 12, 16, 6


@dataclass(frozen=True)
class Mix:
    """weights: dealt to sources in code point order, repeating; share: size of the mix by that of the input;
    most: how often a source may be taken at most; block: words in a block; seed: of the shuffle."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    block: int = 256
    seed: str = "mix"


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per source: no, source, source_size, target, take (whole words), lo and hi (its part of the points).

    A target is the smaller of ``most`` times the size and a level times the
    weight, the level being where all targets add up to the share.  Sources with
    equal ratios of limit and weight need no order: the level is the same.
    """
    every = W.partitionBy(F.lit(0))
    weights = F.array(*map(F.lit, mix.weights))
    total = F.sum("source_size").over(every)
    t = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("no", F.row_number().over(every.orderBy(F.asc_nulls_last("source"))).cast("long") - 1)
        .withColumn("weight", F.get(weights, (F.col("no") % len(mix.weights)).cast("int")))
        .withColumn("most", mix.most * F.col("source_size"))
        .withColumn("wanted", mix.share * total)
    )
    tight = every.orderBy(F.col("most") / F.col("weight"), "no")
    full = F.coalesce(F.sum("most").over(tight.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(tight.rowsBetween(0, W.unboundedFollowing))
    t = t.withColumn("level", (F.col("wanted") - full) / left).withColumn("limited", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("limited"), F.struct((F.col("most") / F.col("weight")).alias("r"), "no", "level"))).over(every)["level"]
    t = t.withColumn("target", F.when(F.col("limited"), F.col("most").cast("double")).otherwise(level * F.col("weight")))
    t = t.withColumn("take", F.floor("target").cast("long"))
    upto = F.sum("target").over(every.orderBy("no").rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("hi", F.floor(upto / F.greatest(F.sum("target").over(every), F.lit(1e-300)) * POINTS).cast("long"))
    t = t.withColumn("lo", F.lag("hi", 1, 0).over(every.orderBy("no")))
    return t.select("no", "source", "source_size", "target", "take", "lo", "hi")


def sums_before(parts: DataFrame, value: str) -> DataFrame:
    """(no, part, before): the sum of ``value`` over a source's parts of smaller numbers, made in groups of parts and then over the groups."""
    parts = parts.withColumn("group", F.shiftright("part", PART_BITS))
    groups = parts.groupBy("no", "group").agg(F.sum(value).alias("whole"))
    upto = lambda of, by: F.coalesce(F.sum(of).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("no", "group", upto("whole", W.partitionBy("no").orderBy("group")).alias("above"))
    inside = parts.withColumn("within", upto(value, W.partitionBy("no", "group").orderBy("part")))
    return inside.join(groups, ["no", "group"]).select("no", "part", (F.col("above") + F.col("within")).alias("before"))


def lines(sizes: DataFrame, sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``sizes`` (doc_id, source, size) with no, source_size, target, take and begin: where each starts on its source's line.

    The order on a line is that of a digest of the id.  Running sums are made in
    two steps, within parts of a line and over the parts, so that no source's
    rows meet in one task.
    """
    digest = F.md5(F.concat(F.lit(mix.seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = (
        sizes.join(sources.select("no", F.col("source").alias("s"), "source_size", "target", "take"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("key", F.substring(digest, 1, 16))
        .withColumn("part", F.conv(F.substring("key", 1, KEY_BITS // 4), 16, 10).cast("long"))
    )
    parts = sums_before(rows.groupBy("no", "part").agg(F.sum("size").alias("words")), "words")
    inner = W.partitionBy("no", "part").orderBy("key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(parts, ["no", "part"])
        .select("row", "doc_id", "no", "size", "source_size", "target", "take", (F.col("before") + F.col("within")).alias("begin"))
    )


def schedule(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per block that the mix takes: slot (its place in the mix), no, turn (the source's how many-th block), words.

    Slots whose source has had its target are left out; blocks that a source
    still lacks when the points end follow at the end, the sources in turn.
    """
    spark = sources.sparkSession
    words, count = sources.agg(F.coalesce(F.sum("take"), F.lit(0)), F.count("*")).first()
    slots = -(-words // mix.block)
    width = POINTS // CELLS
    needed = F.ceil(F.col("take") / mix.block).cast("long")
    owners = sources.where("hi > lo").select(
        "no", "lo", "hi", needed.alias("needed"), F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell")
    )
    drawn = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") % PERIOD * STEP % POINTS).alias("u"))
    drawn = drawn.withColumn("cell", F.expr(f"u div {width}"))
    drawn = drawn.join(owners, "cell").where("u >= lo AND u < hi").select("slot", "no", "needed", F.shiftright("slot", SLOT_BITS).alias("part"))
    parts = drawn.groupBy("no", "part").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("no", "part").orderBy("slot")) - 1
    ranked = drawn.withColumn("rank", rank).join(sums_before(parts, "n"), ["no", "part"])
    main = ranked.select("slot", "no", (F.col("before") + F.col("rank")).alias("turn"), "needed").where("turn < needed")
    had = parts.groupBy("no").agg(F.sum("n").alias("had"))
    late = (
        sources.select("no", needed.alias("needed")).join(had, "no", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < needed")
        .select("no", F.explode(F.sequence("had", F.col("needed") - 1)).alias("turn"))
        .select((F.lit(slots) + F.col("turn") * count + F.col("no")).alias("slot"), "no", "turn")
    )
    last = sources.select("no", "take")
    return (
        main.select("slot", "no", "turn").unionByName(late).join(last, "no")
        .select("slot", "no", "turn", F.least(F.lit(mix.block), F.col("take") - F.col("turn") * mix.block).cast("long").alias("words"))
    )


def pieces(laid: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per row of ``laid``, pass over its line and block that it has words in: its columns, pass, turn, from_word, words; only what the mix takes."""
    own = [c for c in laid.columns if c not in ("source_size", "target")]
    starts = F.transform(F.sequence(F.lit(0), F.lit(mix.most - 1)), lambda p: F.struct(p.alias("pass"), (p * F.col("source_size") + F.col("begin")).alias("at")))
    passes = laid.where("size > 0").select(*own, F.inline(starts))
    parts = passes.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("take"))).where("end > at")
    parts = parts.withColumn("turn", F.explode(F.expr(f"sequence(at div {mix.block}, (end - 1) div {mix.block})")))
    low, high = F.greatest("at", F.col("turn") * mix.block), F.least("end", (F.col("turn") + 1) * mix.block)
    return parts.select(*own, "pass", "turn", (low - F.col("at")).alias("from_word"), (high - low).alias("words"))


def scheduled(sizes: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """The rows of ``sizes`` (row, doc_id, source, size) on their lines, and what slots take of them: row, pass, slot, words."""
    sizes = cut(sizes, "sizes")
    sources = cut(source_targets(sizes, mix), "sources")
    laid = cut(lines(sizes, sources, mix), "lines")
    slots = schedule(sources, mix).select("no", "turn", "slot")
    return laid, pieces(laid, mix).join(slots, ["no", "turn"]).select("row", "pass", "slot", "words")


def mix_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot, n_slots.

    ``taken`` are the words that the schedule's slots take of it, repeats
    counted; the last two say which slot is the first to take any, null if none
    does, and how many do.  A null text has no words; a null source is a source of its own, last in
    order.  A source's taken words are its target rounded down.  Documents
    without words are returned with nothing taken.  Repeated rows are rows of
    their own.  Without any words, all targets are 0; an empty table gives an
    empty result; other columns are ignored.  Texts are read once and not moved.
    """
    id_, source, size = F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    laid, taken = scheduled(docs.select(F.monotonically_increasing_id().alias("row"), id_, source, size), mix)
    per = taken.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.countDistinct("slot").alias("n_slots"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return laid.join(per, "row", "left").select("doc_id", "size", "source_size", "target", zero("taken"), "first_slot", zero("n_slots"))


def repeated(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents in the order of the mix, once for each pass over its source of which slots take half of its words at least.

    A document comes where the first slot stands that takes some of it, so rows
    of different sources alternate as the schedule has it; those that no slot
    takes are gone.  Repeated rows, rows with a null id, null texts (without
    words, so never taken) and null sources count as in mix_documents; all
    columns stay.  An empty table gives an empty result.
    """
    row, slot = spare(docs, "row", "slot")
    rows = numbered(docs, row)
    sizes = rows.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    laid, taken = scheduled(sizes, mix)
    passes = taken.groupBy("row", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot")).join(laid.select("row", "size"), "row")
    passes = passes.where("2 * words >= size").select(F.col("row").alias(row), F.col("slot").alias(slot))
    passes = cut(passes, "passes")
    out = rows.join(few(passes, passes), row)
    return out.repartitionByRange(slot, row).sortWithinPartitions(slot, row).select(docs.columns)
