"""From request rows to task rows: subtopics, stage templates, dependency edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions import text as tx


def subtopics(requests: DataFrame, key: str, limit: str) -> DataFrame:
    """Distinct clauses of each objective in order of appearance, padded to ``limit``.

    Clauses are exploded and deduplicated by a grouped ``min_by``, so a long text costs
    linear work. Output per request is one array of ``limit`` topics.
    """
    clauses = F.flatten(
        F.transform(F.split("objective", "[\n;,.]"), lambda c: F.split(c, " and "))
    )
    found = (
        requests.select(key, limit, F.posexplode(clauses).alias("pos", "clause"))
        .withColumn("topic", tx.shorten(F.col("clause"), 10))
        .filter(F.contains("topic", F.lit(" ")))
        .groupBy(key, F.lower("topic").alias("folded"))
        .agg(F.min(F.struct("pos", "topic")).alias("t"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .select(key, F.col("ts.topic").alias("topics"))
    )
    stem = tx.shorten(F.col("objective"), 6)
    kept = F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, F.col(limit))
    aspect = F.transform(
        F.sequence(F.lit(1), F.col(limit) + F.size("kept")),
        lambda k: F.concat(F.col("stem"), F.lit(" — aspect "), k.cast("string")),
    )
    pads = F.filter(aspect, lambda a: ~F.array_contains("kept", a))
    return (
        requests.join(found, key, "left")
        .withColumn("kept", kept)
        .withColumn("stem", stem)
        .withColumn("topics", F.slice(F.concat("kept", pads), 1, F.col(limit)))
        .drop("kept", "stem")
    )


def plan_tasks(
    requests: DataFrame, templates: DataFrame, kinds: DataFrame, instructions: DataFrame
) -> DataFrame:
    """One row per (request, stage, slot) from the stage templates of its strategy.

    ``requests`` needs job_id, objective, strategy and max_agents. Templates are small
    relations the caller may extend; nothing here is specific to the nine built in.
    """
    fan = F.greatest(F.col("max_agents"), F.lit(1))
    half = F.greatest(F.floor(F.col("fan") / 2), F.lit(1)).cast("int")
    steps = F.least(F.col("fan"), F.lit(4))
    width = (
        F.when(F.col("width") == "all", F.col("fan"))
        .when(F.col("width") == "half", half)
        .otherwise(1)
        .cast("int")
    )
    repeats = F.when(F.col("width") == "steps", steps).otherwise(1).cast("int")
    sized = requests.withColumn("fan", fan.cast("int"))
    stages = (
        sized.select("job_id", "strategy", "fan")
        .join(F.broadcast(templates), "strategy")
        .withColumn("fanout", width)
        .withColumn("repeats", repeats)
    )
    extra = stages.filter("width = 'steps'").select(
        "job_id", F.col("template_stage").alias("from_stage"), (F.col("repeats") - 1).alias("shift")
    )
    shifted = stages.join(extra, "job_id", "left").withColumn(
        "shift",
        F.when(F.col("template_stage") > F.col("from_stage"), F.col("shift")).otherwise(0),
    )
    slots = (
        shifted.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("fanout") - 1)))
        .withColumn("stage", F.col("template_stage") + F.col("shift") + F.col("step") - 1)
        .withColumn(
            "label",
            F.when(F.col("width") == "steps", F.concat_ws(" ", "label", F.col("step").cast("string")))
            .otherwise(F.col("label")),
        )
    )
    topics = subtopics(sized, "job_id", "fan").select(
        "job_id", "objective", "topics", tx.complexity(F.col("objective")).alias("estimated_complexity")
    )
    focus = F.when(F.col("fanout") == 1, tx.shorten(F.col("objective"), 8)).otherwise(
        F.get("topics", F.col("slot") % F.size("topics"))
    )
    said = F.replace("instruction", F.lit("{focus}"), F.col("focus"))
    said = F.replace(said, F.lit("{objective}"), F.col("objective"))
    return (
        slots.join(topics, "job_id")
        .join(F.broadcast(kinds.select("kind", "min_words")), "kind")
        .join(F.broadcast(instructions), "kind")
        .withColumn("focus", focus)
        .select(
            "job_id",
            "stage",
            "slot",
            "kind",
            F.concat("label", F.lit(" · "), "focus").alias("title"),
            said.alias("description"),
            "estimated_complexity",
            tx.token_estimate(F.col("estimated_complexity")).alias("estimated_tokens"),
            "min_words",
        )
    )


def stage_edges(tasks: DataFrame) -> DataFrame:
    """Every task depends on every task of the stage before it, by definition.

    The equi join on (job, stage) is bounded by the agents one job may have.
    """
    child = tasks.select("job_id", "stage", F.col("slot").alias("child_slot"))
    parent = tasks.select(
        "job_id", (F.col("stage") + 1).alias("stage"), F.col("slot").alias("parent_slot")
    )
    return child.join(parent, ["job_id", "stage"])
