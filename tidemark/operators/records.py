"""Records and decisions: upserts, allow-lists, alternative and mapped keys, provenance, rules of record, validation and grading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.temporal import latest_per_key


def upsert(stored: DataFrame, offered: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The table after an upsert: of each key the row with the largest version, an offered one before a stored one of the same.

    Files are never changed in place: what is offered is appended as a new
    version and this is how the table is read.
    """
    both = stored.withColumn("__new", F.lit(0)).unionByName(offered.withColumn("__new", F.lit(1)))
    return latest_per_key(both, keys, [F.desc(version), F.desc("__new")]).drop("__new")


def allowed(df: DataFrame, pairs: DataFrame | None, columns: list[str]) -> DataFrame:
    """The rows whose columns are in the allow-list; no list lets all pass, an empty one none."""
    return df if pairs is None else df.join(pairs.select(*columns).distinct(), columns, "left_semi")


def all_allowed(members: DataFrame, keys: list[str], element: str, allow: DataFrame) -> DataFrame:
    """The keys of which every element is in the allow-list; no set has to fit in a row."""
    marked = members.join(allow.select(element).distinct().withColumn("__in", F.lit(True)), element, "left")
    return marked.groupBy(*keys).agg(F.every(F.col("__in").isNotNull()).alias("__all"), F.count("*").alias("elements")).where("__all").drop("__all")


def either_join(left: DataFrame, right: DataFrame, alternatives: list[tuple[str, str]]) -> DataFrame:
    """Pairs that agree in one of the (left column, right column) equalities at least, each pair once.

    A disjunction would compare all rows with all; here each alternative is a
    join by equality, and takes the pairs that no alternative before it had.
    """
    out = []
    for i, (a, b) in enumerate(alternatives):
        met = left.join(right, F.col(a) == F.col(b))
        for x, y in alternatives[:i]:
            met = met.where(~F.coalesce(F.col(x) == F.col(y), F.lit(False)))
        out.append(met)
    return reduce(DataFrame.unionByName, out)


def mapped_join(left: DataFrame, right: DataFrame, keys: list[str], column: str, mapping: dict[str, str]) -> DataFrame:
    """Left rows with the right row of the same keys and of the value that their ``column`` is mapped to, itself where nothing is mapped."""
    key = reduce(lambda k, kv: k.when(F.col(column) == kv[0], kv[1]), list(mapping.items())[1:], F.when(F.col(column) == next(iter(mapping)), next(iter(mapping.values())))).otherwise(F.col(column))
    return left.withColumn("__key", key).join(right.withColumnRenamed(column, "__key"), [*keys, "__key"], "left").drop("__key")


def provenance(df: DataFrame, key: str, listed: str, other: DataFrame, other_key: str, values: list[str]) -> DataFrame:
    """For each key the values of what its JSON array of numbers names, in the array's order; names that nothing has are left out.

    A key whose array is empty, null, unreadable or names nothing known has an empty list.
    """
    each = df.select(key, F.posexplode_outer(F.from_json(listed, "array<bigint>")).alias("__pos", other_key))
    met = each.join(other.select(other_key, F.struct(*values).alias("__v")), other_key, "left")
    found = F.array_sort(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("__pos", "__v"))))
    return met.groupBy(key).agg(F.transform(found, lambda x: x["__v"]).alias("evidence"))


def mixed_cohorts(df: DataFrame, cohort: list[str], settings: list[str]) -> DataFrame:
    """Cohorts whose rows differ in their settings, with how many kinds they have."""
    kinds = df.select(*cohort, *settings).distinct().groupBy(*cohort).agg(F.count("*").alias("kinds"))
    return kinds.where("kinds > 1")


def require_one_setting(df: DataFrame, cohort: list[str], settings: list[str]) -> None:
    """Refuse if a cohort's rows differ in their settings."""
    mixed = mixed_cohorts(df, cohort, settings)
    if not mixed.isEmpty():
        raise ValueError(f"cohorts of several settings: {[tuple(r) for r in mixed.take(5)]}")


def merge_roles(df: DataFrame, keys: list[str], role: str, base: str, scaled: str, value: str, factor: float, slack: float) -> DataFrame:
    """One row a key of its row in the base role and its row in the scaled role: value, and an issue.

    Issues: no base row, several rows of a role, or a scaled value that isn't the
    factor times the base value within the slack.
    """
    of = lambda r: F.when(F.col(role) == r, F.col(value))
    g = df.groupBy(*keys).agg(F.count(of(base)).alias("__b"), F.count(of(scaled)).alias("__s"), F.min(of(base)).alias("value"), F.min(of(scaled)).alias("__v"))
    off = F.abs(F.col("__v") - factor * F.col("value")) > slack
    issue = F.when(F.col("__b") == 0, "no base row").when((F.col("__b") > 1) | (F.col("__s") > 1), "several rows").when(off, "not in proportion")
    return g.select(*keys, "value", issue.alias("issue"))


def matched_or_held(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left rows with the values of the one right row of their keys; those with none or several are held with the reason."""
    one = right.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.min(v).alias(v) for v in values))
    met = left.join(one, keys, "left")
    reason = F.when(F.col("__n").isNull(), "no match").when(F.col("__n") > 1, "ambiguous")
    return met.select(*left.columns, *(F.when(F.col("__n") == 1, F.col(v)).alias(v) for v in values), reason.alias("held"))


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row for each key and column: stat and value; nulls are left out."""
    return df.unpivot(keys, values, "stat", "value").where("value IS NOT NULL")


def lineup_issues(entries: DataFrame, lineup: str, member: str, cost: str, most_cost: float, sizes: tuple[int, int], group: str, most_of_group: int) -> DataFrame:
    """(lineup, issue) of all lineups that break a rule: size, duplicate, cost, group."""
    whole = entries.groupBy(lineup).agg(F.count("*").alias("n"), F.countDistinct(member).alias("d"), F.sum(cost).alias("c"))
    per_group = entries.groupBy(lineup, group).agg(F.count("*").alias("n")).where(F.col("n") > most_of_group).select(lineup, F.lit("group").alias("issue")).distinct()
    found = F.array(
        F.when(~F.col("n").between(*sizes), "size"), F.when(F.col("d") < F.col("n"), "duplicate"), F.when(F.col("c") > most_cost, "cost"),
    )
    return whole.select(lineup, F.explode(F.array_compact(found)).alias("issue")).unionByName(per_group)


def routed(df: DataFrame, keys: list[str], model_error: Column, baseline_error: Column, covered: Column, same_config: Column) -> DataFrame:
    """Per key whether the model is applied, and else why the baseline stands: the first rule that fails."""
    g = df.groupBy(*keys).agg(F.avg(model_error).alias("model"), F.avg(baseline_error).alias("baseline"), F.every(covered).alias("__c"), F.every(same_config).alias("__s"))
    reason = F.when(~F.col("__c"), "not covered").when(~F.col("__s"), "other configuration").when(F.col("model") >= F.col("baseline"), "no better").otherwise("applied")
    return g.select(*keys, F.round("model", 6).alias("model"), F.round("baseline", 6).alias("baseline"), reason.alias("decision"))


def one_per_target(targets: DataFrame, target: list[str], rich: list[str], unique: str) -> DataFrame:
    """One row for each target reached over several scopes: that with most evidence (fewest nulls among ``rich``), then the smallest id."""
    lacking = reduce(lambda a, b: a + b, (F.col(c).isNull().cast("int") for c in rich))
    return latest_per_key(targets, target, [lacking, F.asc(unique)])


def counter_evidence(df: DataFrame, key: str, value: str, unique: str, top: int) -> DataFrame:
    """For the keys with the ``top`` largest absolute totals their strongest row of the other sign; a report of so many rows."""
    totals = df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc(F.abs("total")), key).limit(top)
    other = df.join(F.broadcast(totals), key).where(F.signum(F.col(value)) == -F.signum("total"))  # ``top`` rows
    first = latest_per_key(other, [key], [F.desc(F.abs(value)), F.asc(unique)]).select(key, F.col(unique).alias("against"), F.col(value).alias("weight"))
    return totals.join(first, key, "left")


def seeded_sample(df: DataFrame, unique: str, seed: str, n: int) -> DataFrame:
    """n rows without replacement, the same on every run: those with the smallest digests of seed and id."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(unique).cast("string")), 256), unique).limit(n)


def subjects(refs: DataFrame, key: str, ref: str, canonical: DataFrame, team: str) -> DataFrame:
    """(key, subject): the canonical names of what a claim refers to, those with several dropped, and the team if all are of one.

    ``canonical`` has ``ref``, name and ``team``; a claim fans out to a row a subject.
    """
    sure = canonical.groupBy(ref).agg(F.min("name").alias("name"), F.min(team).alias(team), F.countDistinct("name").alias("__n")).where("__n = 1")
    met = refs.select(key, ref).join(sure, ref)
    teams = met.groupBy(key).agg(F.min(team).alias("subject"), F.countDistinct(team).alias("__n")).where("__n = 1")
    return met.select(key, F.col("name").alias("subject")).unionByName(teams.select(key, "subject")).distinct()


def roster(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Each key's newest row by the first of ``order`` (the others break ties), and whether rows of that instant differ in the values."""
    top = df.groupBy(key).agg(F.max(order[0]).alias("__t"))
    newest = df.join(top, key).where(F.col(order[0]) == F.col("__t"))
    return newest.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v"), (F.count_distinct(F.struct(*values)) > 1).alias("conflict")).select(key, "__v.*", "conflict")
