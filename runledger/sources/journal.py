"""Run journal: JSON lines in, typed records out, append-only sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One wide schema for the tagged union; every kind of record fills a part of it.
RECORD = """
  record STRING, seq BIGINT, job_id STRING, task_id STRING, attempt INT, status STRING, reason STRING,
  at TIMESTAMP,
  job STRUCT<id: STRING, status: STRING, status_reason: STRING, created_at: TIMESTAMP,
    request: STRUCT<objective: STRING, execution_strategy: STRING, max_agents: INT>>,
  tasks ARRAY<STRUCT<id: STRING, title: STRING, kind: STRING, stage: INT, state: STRING,
    attempt: INT, dependencies: ARRAY<STRING>>>,
  transition STRUCT<entity: STRING, `from`: STRING, `to`: STRING, actor: STRING, reason: STRING,
    term: BIGINT, correlation_id: STRING, at: TIMESTAMP>,
  result STRUCT<task_id: STRING, agent_id: STRING, kind: STRING, title: STRING, output: STRING,
    confidence: DOUBLE, tokens_in: BIGINT, tokens_out: BIGINT, cost_usd: DECIMAL(12,6),
    duration_ms: BIGINT, deduplicated: BOOLEAN, validation_failures: ARRAY<STRING>>,
  failure STRUCT<task_id: STRING, title: STRING, attempt: INT, error_kind: STRING,
    error_message: STRING, dead_lettered: BOOLEAN>
"""
# A value of another type than its field lands the whole line here.
CORRUPT = "_corrupt"
# ---- fixed values: what a record of each kind must carry --------------------------
REQUIRED = {
    "job_planned": ["job.id"],
    "job_status_changed": ["job_id", "status"],
    "task_transitioned": ["job_id", "transition.to"],
    "task_completed": ["job_id", "result.task_id"],
    "task_failed": ["job_id", "failure.task_id"],
    "job_finished": ["job_id"],
}
PAYLOADS = ["seq", "task_id", "attempt", "status", "reason", "at", "job", "tasks", "transition",
            "result", "failure"]


def append_journal(records: DataFrame, path: str) -> None:
    """Append one JSON object per row; nothing already written is touched.

    Files of several appends have no order among them. Records that are replayed carry
    ``seq``, their place in the journal as a whole.
    """
    records.write.mode("append").option("ignoreNullFields", "true").json(path)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, split offset, and line order inside the split.

    The three columns order lines correctly even when a large file is read as
    several splits by different tasks.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
    )
    return lines.withColumn("line_order", F.monotonically_increasing_id())


def read_journal(spark: SparkSession, path: str, on_corrupt: str = "fail") -> DataFrame:
    """Typed records; ``seq`` orders them, or ``(file, split_start, line_order)`` in one file.

    A line is good if it is JSON of a known kind, every field has its type and those the
    kind requires are there. Blank lines are skipped. A last line that does not parse is a torn append and is
    dropped. Any other bad line fails the read (``fail``) or comes back in a table of
    its own (``report``).
    """
    place = F.struct("split_start", "line_order")
    lines = scan_lines(spark, path)
    last = lines.groupBy("file").agg(F.max(place).alias("last"))
    marked = (
        lines.filter(F.trim("line") != "")
        .withColumn("r", parsed(F.col("line")))
        .withColumn("ok", is_good(F.col("r")))
        .join(last, "file")
        .filter(F.col("ok") | (place != F.col("last")))
        .drop("last")
    )
    if on_corrupt == "report":
        return marked.filter(~F.col("ok")).drop("ok", "r")
    where = F.concat(
        F.lit("journal "), "file", F.lit(" is corrupt at line "),
        F.col("line_order").cast("string"), F.lit(" of the split at byte "),
        F.col("split_start").cast("string"),
    )
    checked = marked.withColumn("r", F.when(F.col("ok"), F.col("r")).otherwise(F.raise_error(where)))
    return typed(checked.drop("ok"))


def parsed(line: Column) -> Column:
    return F.from_json(line, f"{RECORD}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})


def is_good(record: Column) -> Column:
    kinds = [
        (record["record"] == kind) & F.forall(F.array(*[_field(record, f) for f in fields]), lambda there: there)
        for kind, fields in REQUIRED.items()
    ]
    return F.coalesce(record[CORRUPT].isNull() & reduce(lambda a, b: a | b, kinds), F.lit(False))


def _field(record: Column, path: str) -> Column:
    for name in path.split("."):
        record = record[name]
    return record.isNotNull()


def typed(lines: DataFrame) -> DataFrame:
    """The fields of parsed records ``r``, with ``job_id`` for every kind of record."""
    rest = [c for c in lines.columns if c not in ("line", "r")]
    return lines.select(
        *rest,
        F.coalesce("r.job_id", "r.job.id").alias("job_id"),
        F.col("r.record").alias("kind"),
        *[F.col(f"r.{name}").alias(name) for name in PAYLOADS],
    )


def tail_journal(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """The same records as a stream of newly appended files.

    A stream must go on past a torn line, so lines that are not good are dropped.
    """
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
        .select(parsed(F.col("value")).alias("r"))
        .filter(is_good(F.col("r")))
    )
    return typed(lines)


def planned_tasks(records: DataFrame) -> DataFrame:
    """``job_id, task_id, title, kind, stage, state, attempt, dependencies`` of all plan records.

    A large plan may come as several records, each with a part of its tasks.
    """
    rows = records.filter("kind = 'job_planned'").select("job_id", F.explode("tasks").alias("t"))
    return rows.select("job_id", F.col("t.id").alias("task_id"), *[f"t.{c}" for c in ("title", "kind", "stage", "state", "attempt", "dependencies")])


def planned_edges(tasks: DataFrame) -> DataFrame:
    """``job_id, child, parent`` from the dependencies of planned tasks."""
    return tasks.select("job_id", F.col("task_id").alias("child"), F.explode("dependencies").alias("parent"))
