"""Derived memory: visibility, merging, conflicts, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized

# States of a fact, those that end its life, and what evidence from outside begins with.
STATUSES = ("candidate", "active", "superseded", "conflicted", "deleted")
TERMINAL = ("deleted", "superseded")
EXTERNAL = (
    "implementation:",
    "tests:",
    "smoke:",
    "migration:",
    "security:",
    "safety:",
    "metrics:",
    "release:",
)


def visible(projects: list, chat=None, chat_col: str = "evidence") -> Column:
    """Facts of every project, of the given projects, or of the chat; with neither projects nor chat, all facts."""
    if not projects and chat is None:
        return F.lit(True)
    seen = F.col("scope") == "global"
    if projects:
        seen = seen | ((F.col("scope") == "project") & F.col("project").isin(projects))
    if chat is not None:
        seen = seen | ((F.col("scope") == "chat") & (F.col(chat_col) == chat))
    return seen


def scope_keys(chat_col: str = "evidence") -> list[Column]:
    """What facts must share to be about the same: their scope, the project or chat where that is the scope, their type."""
    return [F.col("scope"), F.when(F.col("scope") == "project", F.col("project")).alias("project"), F.when(F.col("scope") == "chat", F.col(chat_col)).alias("chat"), F.col("fact_type")]


def merge(facts: DataFrame, arrival: str = "id") -> DataFrame:
    """Facts of one scope, type and text as one: all evidence, the highest confidence, clamped to 0 and 1.

    The status is that of the first to arrive, and active if any later one is.
    """
    return facts.groupBy(*scope_keys(), normalized(F.col("content")).alias("content")).agg(
        F.array_sort(F.collect_set("evidence")).alias("evidence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("confidence"))).alias("confidence"),
        F.when(F.bool_or(F.col("status") == "active"), "active").otherwise(F.min_by("status", arrival)).alias("status"),
    )


def conflicts(facts: DataFrame) -> DataFrame:
    """Groups of one scope and type that say different things, by scope, project, chat and type."""
    live = facts.where(F.col("status").isin("active", "conflicted"))
    grouped = live.groupBy(*scope_keys()).agg(F.countDistinct(normalized(F.col("content"))).alias("variants"), F.count(F.lit(1)).alias("n"))
    return grouped.where("variants > 1")


def resolve(refs: DataFrame, key: str, lookups: list[DataFrame], missing: str) -> DataFrame:
    """Each reference's project from the first lookup that knows it."""
    for lookup in lookups:
        refs = refs.join(lookup, key, "left")
    names = [c for c in refs.columns if c != key]
    return refs.select(key, F.coalesce(*[F.col(n) for n in names], F.lit(missing)).alias("project"))


def invalidate(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """Facts with evidence that is gone are deleted. ``gone`` holds documents and their chunks, each once."""
    marked = facts.join(gone.withColumn("_gone", F.lit(True)), "evidence", "left")
    return marked.withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).drop("_gone")


def supersede(facts: DataFrame, fresh: DataFrame, chat_col: str = "chat") -> DataFrame:
    """Adds new active facts; an older one that a new one names becomes superseded.

    That takes the same scope, type and project, and the same chat, a missing one being the same as a missing one.
    """
    named = fresh.where("supersedes_id IS NOT NULL AND status = 'active'").select(F.col("supersedes_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("scope", "fact_type", "project", chat_col)])
    same = F.col("id") == F.col("_id")
    for c in ("scope", "fact_type", "project", chat_col):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    olds = facts.join(named, same, "left").withColumn("status", F.when(F.col("_id").isNotNull() & ~F.col("status").isin(*TERMINAL), "superseded").otherwise(F.col("status")))
    return olds.select(*facts.columns).unionByName(fresh.drop("supersedes_id"), allowMissingColumns=True)


def first_of_equal_evidence(sets: DataFrame, name: str, evidence: str = "evidence") -> DataFrame:
    """(name, evidence, first): for each row the least name of those that rest on the same evidence."""
    key = F.concat_ws(",", F.transform(F.array_sort(F.array_distinct(evidence)), lambda x: x.cast("string")))
    least = sets.select(F.col(name), F.col(evidence), key.alias("_key"))
    firsts = least.groupBy("_key").agg(F.min(name).alias("first"))
    return least.join(firsts, "_key").drop("_key")


def reference_id(reference: Column) -> Column:
    """The id that a reference (a variant) names: itself if it is text, its ``id`` if it is an object; null for anything else."""
    own, kind = F.try_variant_get(reference, "$.id", "string"), F.schema_of_variant(reference)
    return F.when(kind.startswith("OBJECT"), own).when(kind == "STRING", F.try_variant_get(reference, "$", "string"))


def evidence_counts(facts: DataFrame, known: DataFrame, ref: str = "ref") -> DataFrame:
    """(total, external, broken) over single pieces of evidence: from outside by its prefix, broken if nobody knows it."""
    outside = F.lit(False)
    for prefix in EXTERNAL:
        outside = outside | F.col(ref).startswith(prefix)
    rows = facts.join(known.select(F.col("id").alias(ref), F.lit(True).alias("_known")).distinct(), ref, "left").withColumn("_outside", outside)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("_outside").alias("external"), F.count_if(~F.col("_outside") & F.col("_known").isNull()).alias("broken"))


def context_lines(scenarios: DataFrame, facts: DataFrame, budget: int, used: int) -> DataFrame:
    """(place, line, spent) of a prompt: scenarios while they fit, then facts while they fit after those.

    Both hold (rank, line, cost); the first fact is kept in any case, to be cut by whoever writes the prompt. Pages of at most
    a hundred rows, so the running sums are over one list.
    """
    over = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = scenarios.withColumn("spent", F.sum("cost").over(over) + used).where(F.col("spent") <= budget).select(F.lit(0).alias("part"), "rank", "line", "spent")
    before = kept.agg(F.coalesce(F.max("spent"), F.lit(used)).alias("_before"))
    rows = facts.withColumns({"spent": F.sum("cost").over(over), "_n": F.row_number().over(Window.orderBy("rank")), "_one": F.lit(1)}).join(F.broadcast(before.withColumn("_one", F.lit(1))), "_one")  # one row
    rows = rows.withColumn("spent", F.col("spent") + F.col("_before")).where((F.col("spent") <= budget) | (F.col("_n") == 1))
    whole = kept.unionByName(rows.select(F.lit(1).alias("part"), "rank", "line", "spent"))
    return whole.withColumn("place", F.row_number().over(Window.orderBy("part", "rank"))).select("place", "line", F.col("spent").cast("bigint").alias("spent"))
