"""Dependency graphs as two relations: tasks (job_id, task_id, ...) and edges
(job_id, child, parent), where ``child`` depends on ``parent``.

Loops advance whole frontiers with joins. Each round writes one table to the shared
folder, which cuts lineage and survives the loss of executors; a round that finds an
empty frontier ends the loop.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.operators.lifecycle import is_terminal
from runledger.session import cut

NODE = ["job_id", "task_id"]


def _ends(edges: DataFrame, end: str) -> DataFrame:
    return edges.select("job_id", F.col(end).alias("task_id"))


def _merged(side: DataFrame) -> DataFrame:
    """One side of a join that grows with the graph: met by a merge, never sent through the driver.

    Spark 4.1 may take a union of tables for dealt as a merge needs it, and then fails where
    adaptive execution has joined partitions of only some of them; so unions are dealt anew.
    """
    side.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return side.hint("merge")


def unknown_dependencies(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    known = tasks.select("job_id", F.col("task_id").alias("parent"))
    return edges.join(_merged(known), ["job_id", "parent"], "left_anti")


def heads(lone: DataFrame) -> DataFrame:
    """``job_id, task_id, head, steps`` for nodes with one dependency (``job_id, child, parent``).

    Such a node comes right behind its dependency, so whole runs and trees of them hang
    from one node with none or several dependencies, their head. The way to it is doubled
    each round. On a cycle of such nodes, or behind one, ``head`` is again such a node.
    """
    hop = cut(lone.select("job_id", F.col("child").alias("task_id"), F.col("parent").alias("head"), F.lit(1).alias("steps")), "hop")
    n = hop.count()
    for _ in range(math.ceil(math.log2(n + 1)) if n else 0):
        onward = hop.select("job_id", F.col("task_id").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
        joined = hop.join(_merged(onward), ["job_id", "head"], "left").select(
            "job_id", "task_id", F.coalesce("next", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("next").isNotNull().alias("moved"),
        )
        hop = cut(joined, "hop", replaces=hop)
        if hop.filter("moved").isEmpty():
            break
    return hop.select("job_id", "task_id", "head", "steps")


def peel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes without open dependencies, wave after wave.

    Returns (job_id, task_id, wave) of all removed nodes, where the wave is the length
    of the longest dependency chain, and the nodes left over: those on a cycle or
    behind one. Nodes with one dependency are first drawn together with their heads, so
    rounds follow how often chains meet, not how long they are. A round joins the heads just
    removed to their weighted out-edges and writes only the nodes that these reach, with
    how many of their dependencies are met so far and the longest chain among those.
    """
    ends = edges.select("job_id", "child", "parent").distinct()
    ends = ends.join(_merged(nodes.select("job_id", F.col("task_id").alias("child"))), ["job_id", "child"], "left_semi")
    need = ends.groupBy("job_id", "child").agg(F.count(F.lit(1)).alias("need"))
    ends = cut(ends.join(_merged(need), ["job_id", "child"]), "edges")
    hung = cut(heads(ends.filter("need = 1")), "heads")
    through = hung.select("job_id", F.col("task_id").alias("parent"), "head", "steps")
    merges = ends.filter("need > 1").join(_merged(through), ["job_id", "parent"], "left").select(
        "job_id", "child", "need", F.coalesce("head", "parent").alias("head"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")
    )
    merges = cut(merges, "merges")
    free = nodes.select(*NODE).distinct().join(_merged(_ends(ends, "child")), NODE, "left_anti")
    free = free.select(*NODE, F.lit(0).cast("bigint").alias("need"), F.lit(0).cast("bigint").alias("met"), F.lit(0).alias("wave"))
    rounds = [cut(free, "wave")]
    while True:
        front = rounds[-1].filter("met = need").select("job_id", F.col("task_id").alias("head"), "wave")
        if front.isEmpty():
            break
        met = (
            merges.join(_merged(front), ["job_id", "head"])
            .groupBy("job_id", F.col("child").alias("task_id"), "need")
            .agg(F.count(F.lit(1)).alias("met"), F.max(F.col("wave") + F.col("steps")).alias("wave"))
        )
        part = rounds[-1].filter("met < need")
        rounds.append(cut(part.unionByName(met).groupBy(*NODE, "need").agg(F.sum("met").alias("met"), F.max("wave").alias("wave")), "wave"))
    written = nodes.sparkSession.read.schema(rounds[0].schema).parquet(*[r._cut_path for r in rounds])
    first = written.filter("met = need").select(*NODE, "wave")
    behind = hung.join(_merged(first.select("job_id", F.col("task_id").alias("head"), F.col("wave").alias("at"))), ["job_id", "head"])
    done = first.unionByName(behind.select(*NODE, (F.col("at") + F.col("steps")).alias("wave")))
    return done, nodes.select(*NODE).distinct().join(_merged(done), NODE, "left_anti")


def waves(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Wave of every task that is not held back by a cycle. ``orderBy(wave, task_id)``
    is a topological order."""
    return peel(tasks, edges)[0]


def graph_shape(waves_: DataFrame) -> DataFrame:
    """Per job: the longest chain in tasks and the widest wave."""
    sizes = waves_.groupBy("job_id", "wave").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("critical_path"),
        F.max("n").alias("widest_wave"),
        F.sum("n").alias("tasks"),
    )


def cycle_members(stuck: DataFrame, edges: DataFrame) -> DataFrame:
    """One task on a cycle per job that has one.

    Among stuck tasks each has a stuck dependency; following the smallest one far
    enough must enter a cycle. The walk is doubled each round, so it takes log(n) joins.
    """
    inside = edges.join(_merged(stuck.withColumnRenamed("task_id", "child")), ["job_id", "child"], "left_semi")
    inside = inside.join(
        _merged(stuck.withColumnRenamed("task_id", "parent")), ["job_id", "parent"], "left_semi"
    )
    hop = cut(
        inside.groupBy("job_id", F.col("child").alias("task_id")).agg(F.min("parent").alias("to")),
        "hop",
    )
    n = hop.count()
    for _ in range(math.ceil(math.log2(n + 1)) if n else 0):
        onward = hop.select("job_id", F.col("task_id").alias("to"), F.col("to").alias("next"))
        hop = cut(
            hop.join(_merged(onward), ["job_id", "to"]).select("job_id", "task_id", F.col("next").alias("to")),
            "hop",
            replaces=hop,
        )
    return hop.groupBy("job_id").agg(F.min("to").alias("cyclic_task"))


def graph_errors(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Jobs that cannot be rebuilt: missing dependencies or cycles, with counts."""
    missing = unknown_dependencies(tasks, edges).groupBy("job_id").agg(
        F.countDistinct("child").alias("missing")
    )
    known = edges.join(_merged(tasks.select("job_id", F.col("task_id").alias("parent"))), ["job_id", "parent"], "left_semi")
    stuck = cut(peel(tasks, known)[1], "stuck")
    counts = stuck.groupBy("job_id").agg(F.count(F.lit(1)).alias("stuck"))
    named = cycle_members(stuck, known)
    return missing.join(counts, "job_id", "full").join(named, "job_id", "left").na.fill(
        0, ["missing", "stuck"]
    )


def ready(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Waiting tasks with no dependency outside the completed set."""
    done = tasks.filter("state = 'completed'").select("job_id", F.col("task_id").alias("parent"))
    held = _ends(edges.join(done, ["job_id", "parent"], "left_anti"), "child")
    waiting = tasks.filter(F.col("state").isin("created", "waiting_for_dependency"))
    return waiting.join(held, NODE, "left_anti")


def reach(start: DataFrame, edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Tasks reachable from ``start`` along child edges, without ``start`` itself.

    ``within`` limits the walk: a task outside it is neither returned nor passed.
    """
    front = cut(start.select(*NODE).distinct(), "front")
    edges = cut(edges.select("job_id", "child", "parent"), "edges")
    within = None if within is None else cut(within.select(*NODE), "within")
    seen = front
    found = front.limit(0)
    while not front.isEmpty():
        step = edges.join(_merged(front.withColumnRenamed("task_id", "parent")), ["job_id", "parent"])
        nxt = _ends(step, "child").distinct()
        if within is not None:
            nxt = nxt.join(_merged(within), NODE, "left_semi")
        front = cut(nxt.join(_merged(seen), NODE, "left_anti"), "front")
        seen = seen.unionByName(front)
        found = found.unionByName(front)
    return found


def stranded(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Open tasks behind an abandoned one: they can never run."""
    lost = tasks.filter(F.col("state").isin("dead_lettered", "cancelled"))
    return reach(lost, edges, tasks.filter(~is_terminal(F.col("state"))))


def cancel_stranded(tasks: DataFrame, edges: DataFrame, depth: DataFrame) -> DataFrame:
    """Task states after stranded tasks of jobs with an empty queue are cancelled.

    ``depth`` (job_id, depth) gives what is still queued or leased per job.
    """
    lost = stranded(tasks, edges).withColumn("lost", F.lit(True))
    out = tasks.join(_merged(lost), NODE, "left").join(depth, "job_id", "left")
    idle = F.coalesce("depth", F.lit(0)) == 0
    return out.withColumn(
        "new_state", F.when(F.col("lost") & idle, "cancelled").otherwise(F.col("state"))
    ).drop("lost", "depth")


def degrees(edges: DataFrame) -> DataFrame:
    """Direct dependencies and dependents per task, as numbers. The lists are the
    edge relation itself; they are not collected, as one hub may have any number."""
    down = edges.select("job_id", F.col("child").alias("task_id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    up = edges.select("job_id", F.col("parent").alias("task_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    return down.unionByName(up).groupBy(*NODE).agg(
        F.sum("i").alias("dependencies"), F.sum("o").alias("dependents")
    )


def upstream_context(tasks: DataFrame, edges: DataFrame, results: DataFrame) -> DataFrame:
    """Excerpts of the results a task builds on, to be read in (stage, title, parent) order."""
    info = results.select(
        "job_id",
        F.col("task_id").alias("parent"),
        "stage",
        "title",
        F.substring("output", 1, fixed.EXCERPT_CHARS).alias("excerpt"),
    )
    return (
        edges.join(info, ["job_id", "parent"])
        .join(_ends(tasks, "task_id").withColumnRenamed("task_id", "child"), ["job_id", "child"], "left_semi")
        .withColumn("block", F.concat(F.lit("\n## "), "title", F.lit("\n"), "excerpt", F.lit("\n")))
    )


def split_tasks(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Replace tasks by parts: ``parts`` (job_id, task_id, part).

    A part inherits the dependencies of its task, the task depends on its parts, and
    what depends on the task stays.
    """
    split = parts.select("job_id", F.col("task_id").alias("child")).distinct()
    kept = edges.join(split, ["job_id", "child"], "left_anti")
    inherited = edges.join(
        parts.withColumnRenamed("task_id", "child"), ["job_id", "child"]
    ).select("job_id", F.col("part").alias("child"), "parent")
    joined = parts.select("job_id", F.col("task_id").alias("child"), F.col("part").alias("parent"))
    cols = ["job_id", "child", "parent"]
    return kept.select(cols).unionByName(inherited).unionByName(joined)


def without_edges(edges: DataFrame, undone: DataFrame) -> DataFrame:
    """Edges left after some are rolled back."""
    return edges.join(undone, ["job_id", "child", "parent"], "left_anti")


WALKS_PER_ROUND = 256


def _closing(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """Positions of proposals whose child already reaches their parent over ``edges``.

    Walks start at each child and carry the proposal; a walk ends where it arrives.
    """
    front = cut(asked.select("job_id", "pos", "parent", F.col("child").alias("at")), "walk")
    edges = cut(edges.select("job_id", F.col("parent").alias("at"), F.col("child").alias("to")), "edges")
    seen, hits = front, asked.select("pos").limit(0)
    while not front.isEmpty():
        step = front.join(edges, ["job_id", "at"]).select("job_id", "pos", "parent", F.col("to").alias("at"))
        front = cut(step.distinct().join(seen, ["job_id", "pos", "parent", "at"], "left_anti"), "walk")
        arrived = front.filter(F.col("at") == F.col("parent")).select("pos")
        hits = hits.unionByName(arrived)
        seen = seen.unionByName(front)
        front = front.join(hits, "pos", "left_anti")
    return cut(hits.distinct(), "closing")


def _core(edges: DataFrame) -> DataFrame:
    """Tasks on cycles or between cycles: what is left after peeling from both ends."""
    nodes = _ends(edges, "child").unionByName(_ends(edges, "parent")).distinct()
    stuck = peel(nodes, edges)[1]
    turned = edges.select("job_id", F.col("parent").alias("child"), F.col("child").alias("parent"))
    for end in ("child", "parent"):
        turned = turned.join(stuck.withColumnRenamed("task_id", end), ["job_id", end], "left_semi")
    return cut(peel(stuck, turned)[1], "core")


def _inside(edges: DataFrame, core: DataFrame) -> DataFrame:
    for end in ("child", "parent"):
        edges = edges.join(core.withColumnRenamed("task_id", end), ["job_id", end], "left_semi")
    return edges


def admit_edges(tasks: DataFrame, edges: DataFrame, proposals: DataFrame) -> DataFrame:
    """Decide proposed edges (job_id, pos, child, parent) as if added one by one in the
    order of ``pos``, which is unique over all proposals.

    Decisions: ``unknown_task``, ``self``, ``exists``, ``cycle``, ``added``. Proposals
    outside the cyclic core of the graph with everything added cannot close a cycle
    and are added together. Inside the core, the next proposals of every job are tested
    at once: one that closes a cycle with what stands already will be refused whenever
    its turn comes, and the first that does not is added. Only where many proposals
    make cycles with each other, and none with what stands, are there many rounds.
    """
    cols = ["job_id", "child", "parent"]
    edges = cut(edges.select(cols).distinct(), "edges")
    known = tasks.select(*NODE).withColumn("known", F.lit(True))
    marked = proposals.select(*cols, "pos")
    for end in ("child", "parent"):
        marked = marked.join(
            known.withColumnsRenamed({"task_id": end, "known": f"known_{end}"}), ["job_id", end], "left"
        )
    marked = marked.join(edges.withColumn("there", F.lit(True)), cols, "left")
    firsts = proposals.groupBy(*cols).agg(F.min("pos").alias("first_pos"))
    at_once = (
        F.when(F.col("known_child").isNull() | F.col("known_parent").isNull(), "unknown_task")
        .when(F.col("child") == F.col("parent"), "self")
        .when(F.col("there"), "exists")
    )
    marked = cut(
        marked.join(firsts, cols).withColumn("decision", at_once).select(*cols, "pos", "first_pos", "decision"),
        "proposals",
    )
    decided = [marked.filter("decision IS NOT NULL").select(*cols, "pos", "decision")]
    undecided = marked.filter("decision IS NULL")
    repeats = undecided.filter("pos > first_pos").select(*cols, "pos", "first_pos")
    open_ = undecided.filter("pos = first_pos").select(*cols, "pos")
    standing = edges
    while not open_.isEmpty():
        core = _core(standing.unionByName(open_.select(cols)))
        unsure = cut(_inside(open_, core), "unsure")
        safe = cut(open_.join(unsure, "pos", "left_anti"), "safe")
        decided.append(safe.select(*cols, "pos", F.lit("added").alias("decision")))
        standing = cut(standing.unionByName(safe.select(cols)), "standing")
        if unsure.isEmpty():
            break
        turn = W.partitionBy("job_id").orderBy("pos")
        asked = unsure.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= WALKS_PER_ROUND)
        asked = cut(asked.drop("turn"), "asked")
        closing = _closing(asked, _inside(standing, core))
        refused = asked.join(closing, "pos", "left_semi")
        decided.append(refused.select(*cols, "pos", F.lit("cycle").alias("decision")))
        free = asked.join(closing, "pos", "left_anti")
        first = free.groupBy("job_id").agg(F.min("pos").alias("pos")).select("pos")
        added = cut(free.join(first, "pos", "left_semi"), "added")
        decided.append(added.select(*cols, "pos", F.lit("added").alias("decision")))
        standing = standing.unionByName(added.select(cols))
        open_ = cut(
            unsure.join(closing.unionByName(added.select("pos")), "pos", "left_anti"), "open"
        )
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    # a repeat of an added edge exists by then; a repeat of a refused one is refused again
    first = out.select(*cols, F.col("pos").alias("first_pos"), "decision")
    again = repeats.join(first, [*cols, "first_pos"]).select(
        *cols, "pos", F.when(F.col("decision") == "added", "exists").otherwise(F.col("decision")).alias("decision")
    )
    return out.unionByName(again)
