"""What many answers to one job agree on, and the job's final report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.functions import text as tx
from runledger.operators import similarity as sim
from runledger.operators.ordered import Ordered
from runledger.session import cut

def report_order() -> list[Column]:
    return [F.asc_nulls_first("stage"), F.asc("title"), F.asc("task_id")]


def with_stage(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Look up the stage of each result; one without a task sorts first."""
    return results.join(tasks.select("job_id", "task_id", "stage"), ["job_id", "task_id"], "left")


def reportable(results: DataFrame, kinds: DataFrame, texts: bool = True) -> DataFrame:
    """Validated results of kinds that belong in a report, tokenised and in report order."""
    wanted = kinds.filter("reportable").select("kind")
    rows = results.filter("passed").join(F.broadcast(wanted), "kind", "left_semi")
    return sim.positioned(rows, report_order(), texts)


def decide(clustered: DataFrame, weighted: bool) -> DataFrame:
    """Consensus per job over rows with a cluster ``label``; jobs with one answer have none.

    Majority takes the largest cluster, the weighted mode the one with most confidence;
    among equals the last founded. Its most confident row speaks, the last among equals.
    """
    exact = F.col("confidence").cast("decimal(12,6)")
    per_cluster = clustered.groupBy("job_id", "label").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(exact).alias("weight"),
        F.max_by("task_id", F.struct("confidence", "pos")).alias("winning_task"),
    )
    rank = F.struct("weight", "label") if weighted else F.struct("size", "label")
    totals = per_cluster.groupBy("job_id").agg(
        F.sum("size").alias("votes"),
        F.sum("weight").alias("total"),
        F.count(F.lit(1)).alias("distinct_positions"),
        F.max_by(F.struct("size", "weight", "winning_task"), rank).alias("w"),
    )
    if weighted:
        share = F.when(F.col("total") > 0, F.col("w.weight").cast("double") / F.col("total").cast("double"))
    else:
        share = F.col("w.size") / F.col("votes")
    return totals.filter("votes >= 2").select(
        "job_id",
        F.col("w.winning_task").alias("winning_task"),
        F.coalesce(share, F.lit(0.0)).alias("agreement_rate"),
        "votes",
        "distinct_positions",
    )


def representatives(clustered: DataFrame) -> DataFrame:
    return clustered.filter("pos = label")


def conflict_counts(clustered: DataFrame) -> DataFrame:
    """Conflicts per representative without listing them.

    Two clusters conflict unless their founders are more than 0.30 alike. Most pairs do,
    so the few that do not are joined and subtracted.
    """
    heads = representatives(clustered)
    sets = sim.classes(heads)
    alike = sim.similar_pairs(sets, fixed.DISAGREEMENT, strict=True)
    ends = alike.select(F.explode(F.array("a", "b")).alias("pos"))
    near = ends.groupBy("pos").agg(F.count(F.lit(1)).alias("alike"))
    sizes = heads.groupBy("job_id").agg(F.count(F.lit(1)).alias("positions"))
    return (
        heads.join(near, "pos", "left")
        .join(sizes, "job_id")
        .withColumn("conflicts", F.col("positions") - 1 - F.coalesce("alike", F.lit(0)))
        .select("job_id", "task_id", "title", tx.headline(F.col("output")).alias("claim"), "conflicts")
    )


def conflict_founders(clustered: DataFrame) -> DataFrame:
    """``job_id, place, task_id, title, claim, pos``: one side of conflicts each, numbered from 0 per job."""
    heads = representatives(clustered).select("job_id", "task_id", "title", tx.headline(F.col("output")).alias("claim"), "pos")
    return Ordered(heads, ["job_id"], "pos").row_number("place").done().withColumn("place", F.col("place") - 1)


def conflict_exceptions(clustered: DataFrame) -> DataFrame:
    """``job_id, a, b``: founders (by ``pos``) that do not conflict, as they are over 0.30 alike."""
    sets = sim.classes(representatives(clustered))
    return sim.similar_pairs(sets, fixed.DISAGREEMENT, strict=True).select("job_id", "a", "b")


def conflict_page(founders: DataFrame, exceptions: DataFrame, start: int, size: int) -> DataFrame:
    """Conflicts number ``start`` up to ``start + size`` of every job, with both claims.

    Every two founders of a job conflict unless they are excepted, so founders and
    exceptions are the whole relation, and no more than a page of its pairs is ever
    made. Pairs are numbered by their later founder, then by the earlier one; excepted
    pairs keep their number and are left out of the page.
    """
    many = founders.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    end = F.least(F.expr("n * (n - 1) div 2"), F.lit(start + size))
    numbers = many.filter(end > start).select("job_id", F.explode(F.sequence(F.lit(start).cast("bigint"), end - 1)).alias("number"))
    guess = F.floor((1 + F.sqrt(1 + 8 * F.col("number").cast("double"))) / 2).cast("bigint")
    before = lambda x: x * (x - 1) / 2
    later = F.when(before(guess) > F.col("number"), guess - 1).when(before(guess + 1) <= F.col("number"), guess + 1).otherwise(guess)
    placed = numbers.withColumn("later", later).withColumn("earlier", F.col("number") - F.expr("later * (later - 1) div 2"))
    side = lambda name: founders.select("job_id", F.col("place").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("task_id", "title", "claim", "pos")])
    pairs = placed.join(side("earlier"), ["job_id", "earlier"]).join(side("later"), ["job_id", "later"])
    alike = exceptions.select("job_id", F.col("a").alias("earlier_pos"), F.col("b").alias("later_pos"))
    return pairs.join(alike, ["job_id", "earlier_pos", "later_pos"], "left_anti").select(
        "job_id",
        "number",
        F.col("earlier_task_id").alias("left_task"),
        F.col("later_task_id").alias("right_task"),
        F.concat(F.lit("`"), "earlier_title", F.lit("` and `"), "later_title", F.lit("` reached materially different conclusions")).alias("description"),
        F.col("earlier_claim").alias("left_claim"),
        F.col("later_claim").alias("right_claim"),
    )


def merge_evidence(items: DataFrame) -> DataFrame:
    """Best supported evidence per job: the first of equal (source, claim), at most 20.

    ``items`` needs job_id, pos, position, source, claim, support. Repeats collapse in a
    partial aggregate; the bounded rank is cut map-side.
    """
    first = items.groupBy("job_id", "source", "claim").agg(
        F.min(F.struct("pos", "position", "support")).alias("f")
    )
    by_support = W.partitionBy("job_id").orderBy(F.desc("f.support"), "f.pos", "f.position")
    return (
        first.withColumn("rank", F.row_number().over(by_support))
        .filter(F.col("rank") <= fixed.MAX_EVIDENCE)
        .select("job_id", "rank", "source", "claim", F.col("f.support").alias("support"))
    )


def top_findings(kept: DataFrame, n: int = fixed.TOP_FINDINGS) -> DataFrame:
    by_confidence = W.partitionBy("job_id").orderBy(F.desc("confidence"), "pos")
    return kept.withColumn("rank", F.row_number().over(by_confidence)).filter(F.col("rank") <= n)


def summaries(jobs: DataFrame, kept: DataFrame, agreement: DataFrame, results: DataFrame) -> DataFrame:
    """Summary text per job: last concluding output, else consensus, else top findings.

    Winners are looked up by task, so no text is carried through the votes.
    """
    last = kept.filter(F.col("kind").isin(fixed.CONCLUDING_KINDS)).groupBy("job_id").agg(F.max("pos").alias("pos"))
    concluding = kept.join(last.select("pos"), "pos").select("job_id", F.col("output").alias("concluded"))
    spoken = agreement.join(
        results.select("job_id", F.col("task_id").alias("winning_task"), "output"), ["job_id", "winning_task"]
    )
    percent = F.bround(F.col("agreement_rate") * 100, 0).cast("int").cast("string")
    agreed = spoken.select(
        "job_id",
        F.concat(
            F.lit("Consensus ("), percent, F.lit("% agreement across "), F.col("votes").cast("string"),
            F.lit(" answers): "), "output",
        ).alias("agreed"),
    )
    lines = top_findings(kept).select(
        "job_id", F.struct("rank", F.concat(
            F.lit("\n- "), "title", F.lit(": "), tx.headline(F.col("output"))).alias("line")).alias("f")
    ).groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list("f"))["line"], "").alias("lines"))
    found = F.concat(F.lit("Findings for: "), "objective", F.lit("\n"), "lines")
    nothing = F.concat(F.lit("No validated output was produced for: "), "objective")
    return (
        jobs.select("job_id", "objective")
        .join(concluding, "job_id", "left")
        .join(agreed, "job_id", "left")
        .join(lines, "job_id", "left")
        .select("job_id", F.coalesce("concluded", "agreed", found, nothing).alias("summary"))
    )


def confidence(kept: DataFrame, counts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Mean confidence of what was kept, scaled by completion, less 0.1 per conflict."""
    mean = kept.groupBy("job_id").agg(
        F.sum(F.col("confidence").cast("decimal(12,6)")).cast("double").alias("s"),
        F.count(F.lit(1)).alias("outputs"),
    )
    raw = F.col("s") / F.col("outputs") * F.try_divide("completed", "total") - 0.1 * F.coalesce("conflicts", F.lit(0))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return (
        counts.select("job_id", "completed", "total")
        .join(mean, "job_id", "left")
        .join(conflicts, "job_id", "left")
        .select(
            "job_id",
            F.coalesce("outputs", F.lit(0)).alias("outputs"),
            F.coalesce("conflicts", F.lit(0)).alias("conflicts"),
            F.when(F.coalesce("outputs", F.lit(0)) == 0, 0.0).otherwise(bounded).alias("confidence_score"),
        )
    )


def final_results(
    jobs: DataFrame, results: DataFrame, counts: DataFrame, kinds: DataFrame, evidence: DataFrame
) -> DataFrame:
    """One row per job. Outputs and evidence stay relations (``drop_redundant``,
    ``merge_evidence``): nested they would put a whole job into one row.

    Consensus is measured before redundancy is dropped, over answers of jobs whose
    strategy asks for it.
    """
    rows = reportable(results, kinds)
    kept = sim.drop_redundant(rows, fixed.REDUNDANT)
    answers = rows.filter("kind = 'answer'")
    clustered = cut(sim.greedy_clusters(answers, fixed.SAME_ANSWER), "clustered")
    kept = cut(kept, "kept-rows")
    voting = jobs.filter(F.col("strategy").isin(fixed.CONSENSUS_STRATEGIES)).select("job_id")
    agreement = decide(clustered.join(voting, "job_id", "left_semi"), weighted=True)
    conflicts = conflict_counts(clustered).groupBy("job_id").agg(
        (F.sum("conflicts") / 2).cast("bigint").alias("conflicts")
    )
    cited = merge_evidence(
        evidence.join(kept.select("job_id", "task_id", "pos"), ["job_id", "task_id"])
    ).groupBy("job_id").agg(F.count(F.lit(1)).alias("evidence"))
    return (
        jobs.select("job_id", "strategy")
        .join(summaries(jobs, kept, agreement, rows), "job_id")
        .join(confidence(kept, counts, conflicts), "job_id")
        .join(cited, "job_id", "left")
        .na.fill(0, ["evidence"])
    )
