"""Joins on bands and overlaps, coverage, set comparison, closures and staged entity matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bands that are broadcast, at most.
FEW_BANDS = 100_000


def band_join(df: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: int, default: dict[str, Column]) -> DataFrame:
    """Each row with its band, bounds inclusive; the band with the lowest start wins, defaults stand in where there is none.

    Overlaps are resolved among the bands first, into stretches that belong to
    one band each.  Stretches are cut at multiples of ``width``, so rows meet
    only those of their own cell by an equality, and no row meets two.
    """
    cell = lambda c: F.floor(c / width)
    cut_at = bands.select(F.col(low).alias("__from")).union(bands.select(F.col(high) + 1)).distinct()
    cut_at = cut_at.withColumn("__cell", cell(F.col("__from")))
    # every cell that a band reaches also begins a stretch
    edges = bands.select(F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))).alias("__cell")).distinct().select((F.col("__cell") * width).alias("__from"), "__cell")
    starts = cut_at.unionByName(edges).distinct()
    ends = F.coalesce(F.lead("__from").over(W.partitionBy("__cell").orderBy("__from")), (F.col("__cell") + 1) * width) - 1
    parts = starts.withColumn("__to", ends)
    held = bands.withColumn("__cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    met = parts.join(held, "__cell").where((F.col(low) <= F.col("__from")) & (F.col("__to") <= F.col(high)))
    best = met.groupBy("__cell", "__from", "__to").agg(F.min(F.struct(low, high, *(c for c in bands.columns if c not in (low, high)))).alias("__b"))
    best = best.select("__cell", "__from", "__to", "__b.*")
    if bands.limit(FEW_BANDS + 1).count() <= FEW_BANDS:
        best = F.broadcast(best)
    rows = df.withColumn("__cell", cell(F.col(value)))
    out = rows.join(best, (rows["__cell"] == best["__cell"]) & F.col(value).between(F.col("__from"), F.col("__to")), "left").drop(best["__cell"])
    return out.drop("__cell", "__from", "__to").withColumns({k: F.coalesce(F.col(k), v) for k, v in default.items()})


def overlapping(bands: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """The bands that begin at or before the end of an earlier one of their key."""
    before = W.partitionBy(*keys).orderBy(low, high).rowsBetween(W.unboundedPreceding, -1)
    return bands.withColumn("reach", F.max(high).over(before)).where(F.col("reach") >= F.col(low))


def overlapping_sets(members: DataFrame, key: str, element: str, least: int) -> DataFrame:
    """(x, y, shared): pairs of sets, x < y, that have ``least`` elements in common at least.

    Elements are ordered rare first.  Sets that share ``least`` have one of these
    before their last ``least`` - 1 elements, so the commonest ones, which most
    sets would meet over, aren't met over.  A pair is kept where it meets over
    its first common element, so it comes once and needs no grouping.  A set
    has to fit in a row.
    """
    rows = members.select(key, element).distinct()
    often = rows.groupBy(element).agg(F.count("*").alias("__n"))
    ordered = F.array_sort(F.collect_list(F.struct("__n", element)))
    sets = rows.join(often, element).groupBy(F.col(key).alias("x")).agg(F.transform(ordered, lambda e: e[element]).alias("a")).where(F.size("a") >= least)
    met = sets.select("x", "a", F.explode(F.slice("a", F.lit(1), F.size("a") - (least - 1))).alias("__e"))
    met = met.join(met.withColumnsRenamed({"x": "y", "a": "b"}), "__e").where("x < y").withColumn("__c", F.array_intersect("a", "b"))
    return met.where((F.size("__c") >= least) & (F.get("__c", F.lit(0)) == F.col("__e"))).select("x", "y", F.size("__c").cast("long").alias("shared"))


def compare(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side, and whether it is in ``left_only``, ``right_only`` or ``both``."""
    l = left.select(*keys).distinct().withColumn("__l", F.lit(True))  # noqa: E741
    r = right.select(*keys).distinct().withColumn("__r", F.lit(True))
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return l.join(r, keys, "full").select(*keys, side.alias("side"))


def coverage(population: DataFrame, facts: DataFrame, key: str, group: list[str], shown: int = 5) -> DataFrame:
    """Per group: eligible, covered and missing members, and the first few that are missing with how many more there are."""
    marked = population.join(facts.select(key).distinct().withColumn("__has", F.lit(1)), key, "left")
    counts = marked.groupBy(*group).agg(F.count("*").alias("eligible"), F.count("__has").alias("covered"))
    lacking = marked.where("__has IS NULL").withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(key))).where(F.col("__r") <= shown)
    first = lacking.groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("__m"))
    same = [counts[g].eqNullSafe(first[g]) for g in group]
    out = counts.join(first, same, "left").select(*(counts[g] for g in group), "eligible", "covered", "__m")
    listed = F.coalesce(F.concat_ws(",", F.transform("__m", lambda x: x.cast("string"))), F.lit(""))
    missing = F.col("eligible") - F.col("covered")
    more = F.when(missing > shown, F.concat(listed, F.lit(" +"), (missing - shown).cast("string"), F.lit(" more"))).otherwise(listed)
    return out.select(*group, "eligible", "covered", missing.alias("missing"), more.alias("first_missing"))


def require_complete(population: DataFrame, facts: DataFrame, keys: list[str]) -> None:
    """Refuse if any member lacks a fact."""
    lacking = population.join(facts, keys, "left_anti")
    if not lacking.isEmpty():
        raise ValueError(f"incomplete: {[tuple(r) for r in lacking.select(*keys).take(5)]}")


def violations(df: DataFrame, name: str, not_null: list[str] = [], unique: list[list[str]] = [], checks: dict[str, Column] = {}, foreign: dict[str, tuple[DataFrame, str]] = {}) -> DataFrame:  # noqa: B006
    """How many rows break each constraint: a row per constraint."""
    rules = {f"{name}.{c} not null": F.count_if(F.col(c).isNull()) for c in not_null} | {f"{name} check {k}": F.count_if(~F.coalesce(c, F.lit(True))) for k, c in checks.items()}
    pairs = F.array(*(F.struct(F.lit(k).alias("constraint"), v.alias("broken")) for k, v in rules.items()))
    parts = [df.agg(pairs.alias("p")).select(F.inline("p"))] if rules else []
    for keys in unique:
        again = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("broken"))
        parts.append(again.select(F.lit(f"{name} unique {','.join(keys)}").alias("constraint"), "broken"))
    for column, (other, key) in foreign.items():
        lost = df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)), column, "left_anti")
        parts.append(lost.agg(F.count("*").alias("broken")).select(F.lit(f"{name}.{column} references {key}").alias("constraint"), "broken"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_outcome(stored: DataFrame, offered: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """What an insert-only write would do with each offered row: inserted, duplicate (same content) or conflict."""
    s = stored.select(*keys, F.struct(*content).alias("__was"))
    o = offered.select(*keys, F.struct(*content).alias("__new"))
    outcome = F.when(F.col("__was").isNull(), "inserted").when(F.col("__was").eqNullSafe(F.col("__new")), "duplicate").otherwise("conflict")
    return o.join(s, keys, "left").select(*keys, outcome.alias("outcome"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): everything reachable from each root along (child, parent) edges, shortest way first; cycles end.

    Each step keeps only what is new, so a step's work is that of its frontier.
    """
    from tidemark.scratch import cut, discard

    known = cut(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "closure")
    front, depth = known, 0
    while True:  # every step adds rows of a finite set or is the last
        depth += 1
        met = front.join(edges, front["node"] == edges["child"]).select("root", F.col("parent").alias("node")).distinct()
        new = cut(met.join(known, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if front is not known:
            discard(front)
        front = new
        if front.isEmpty():
            return known
        whole = cut(known.unionByName(front), "closure")
        discard(known)
        known = whole


def _segment_size(length: Column, least: float) -> tuple[Column, Column]:
    """How many segments a name of a length has and their size, so that a name as similar as ``least`` has one of them unchanged.

    Names a and b with a similarity of ``least`` differ in (1 - least) (|a| + |b|)
    insertions and deletions at most, and |b| is (2 - least) / least |a| at most.
    """
    edits = F.floor((1 - least) * (1 + (2 - least) / least) * length + 1e-9)
    parts = F.least(edits + 1, F.greatest(length, F.lit(1))).cast("int")
    return parts, F.greatest(F.floor(length / parts), F.lit(1)).cast("int")


def staged_match(inputs: DataFrame, pool: DataFrame, scope: str, least: float = 0.92, margin: float = 0.03, aliases: DataFrame | None = None, evidence: list[str] = []) -> DataFrame:  # noqa: B006
    """(input_id, entity_id, stage, score): by external id, then in scope by exact name, by alias, without suffix, then by similarity.

    ``inputs`` has input_id, external_id, name, ``scope``; ``pool`` the same with
    entity_id; ``aliases`` alias and name.  A stage answers only if exactly one
    entity fits; the best similarity must lead the next by more than the margin.
    Candidates whose ``evidence`` columns say otherwise than the input's, where
    both say something, fit in no stage but the first.  Similarity is compared
    inside a scope for names that share a segment, which all similar ones do.
    """
    from tidemark.functions.text import indel_ratio, without_suffix

    def only(df: DataFrame, stage: int) -> DataFrame:
        one = df.groupBy("input_id").agg(F.min("entity_id").alias("entity_id"), F.countDistinct("entity_id").alias("n"), F.max("score").alias("score"))
        return one.where("n = 1").select("input_id", "entity_id", F.lit(stage).alias("stage"), "score")

    i = inputs.withColumn("base", without_suffix(F.col("name")))
    p = pool.withColumn("base", without_suffix(F.col("name"))).withColumnsRenamed({e: f"its_{e}" for e in evidence})
    its = [f"its_{e}" for e in evidence]

    def agreeing(met: DataFrame) -> DataFrame:
        for e in evidence:
            met = met.where(~F.coalesce(F.col(e) != F.col(f"its_{e}"), F.lit(False)))
        return met

    sure = F.lit(1.0).alias("score")
    by_id = only(i.join(p.select("entity_id", "external_id"), "external_id").select("input_id", "entity_id", sure), 1)
    by_name = only(agreeing(i.join(p.select("entity_id", "name", scope, *its), ["name", scope])).select("input_id", "entity_id", sure), 2)
    by_base = only(agreeing(i.join(p.select("entity_id", "base", scope, *its), ["base", scope])).select("input_id", "entity_id", sure), 4)
    parts, size = _segment_size(F.length("base"), least)
    asked = i.select("input_id", "base", scope, *evidence, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.substring("base", k * size + 1, size)))).alias("segment"))
    sizes = asked.select(F.length("segment").alias("size")).distinct()  # a few small numbers
    pieces = p.select("entity_id", F.col("base").alias("other"), scope, *its).join(F.broadcast(sizes), F.length("other") >= F.col("size"))
    pieces = pieces.withColumn("segment", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("other") - F.col("size") + 1), lambda k: F.substring("other", k, F.col("size"))))))
    near = agreeing(asked.join(pieces.drop("size"), ["segment", scope])).select("input_id", "entity_id", "base", "other").distinct()
    scored = near.select("input_id", "entity_id", indel_ratio(F.col("base"), F.col("other")).alias("score")).where(F.col("score") >= least)
    w = W.partitionBy("input_id")
    best = scored.withColumn("top", F.max("score").over(w)).where(F.col("score") >= F.col("top") - margin)
    by_score = only(best, 5)
    every = by_id.unionByName(by_name).unionByName(by_base).unionByName(by_score)
    if aliases is not None:
        called = i.withColumnRenamed("name", "alias").join(aliases.select("alias", "name"), "alias")
        every = every.unionByName(only(agreeing(called.join(p.select("entity_id", "name", scope, *its), ["name", scope])).select("input_id", "entity_id", sure), 3))
    first = every.withColumn("r", F.row_number().over(w.orderBy("stage"))).where("r = 1").drop("r")
    return inputs.select("input_id").join(first, "input_id", "left").withColumn("stage", F.coalesce("stage", F.lit(0)))
