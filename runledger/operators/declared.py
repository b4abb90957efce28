"""Data work that the declared tables call for: votes, ballots, semantic search,
fencing, message envelopes, quotas, heartbeats, headroom, sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.operators.ordered import Ordered
from runledger.session import cut


def vote_rounds(votes: DataFrame, rounds: DataFrame) -> DataFrame:
    """Weighted vote per round: decided when the top answer reaches the quorum.

    ``votes`` (round_id, answer, weight), ``rounds`` (round_id, quorum). Equal weights
    are broken by the smaller answer.
    """
    tally = votes.groupBy("round_id", "answer").agg(F.sum("weight").alias("w"))
    top = tally.groupBy("round_id").agg(
        F.min(F.struct((-F.col("w")).alias("minus"), "w", "answer")).alias("t"), F.sum("w").alias("total"),
        F.count(F.lit(1)).alias("positions"),
    )
    return top.join(rounds, "round_id").select(
        "round_id",
        F.col("t.answer").alias("decision"),
        (F.col("t.w") / F.col("total")).alias("agreement_rate"),
        "positions",
        F.when(F.col("t.w") >= F.col("quorum"), "decided").otherwise("open").alias("status"),
    )


def ranked_choice(ballots: DataFrame) -> DataFrame:
    """Winner per round by elimination. ``ballots`` (round_id, ballot, rank, choice).

    Until a choice holds more than half of the ballots, the one with fewest first
    places is struck, among equals the greatest name. Loops at most once per choice.
    """
    alive = cut(ballots.select("round_id", "choice").distinct(), "alive")
    ballots = cut(ballots.select("round_id", "ballot", "rank", "choice"), "ballots")
    won = alive.limit(0).select("round_id", F.col("choice").alias("winner"), F.lit(0).alias("eliminations"))
    turn = 0
    while not alive.isEmpty():
        first = (
            ballots.join(alive, ["round_id", "choice"], "left_semi")
            .groupBy("round_id", "ballot")
            .agg(F.min_by("choice", "rank").alias("choice"))
            .groupBy("round_id", "choice")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        tally = cut(alive.join(first, ["round_id", "choice"], "left").na.fill(0, ["n"]), "tally")
        summary = tally.groupBy("round_id").agg(
            F.sum("n").alias("total"),
            F.max(F.struct("n", "choice")).alias("top"),
            F.max(F.struct((-F.col("n")).alias("few"), "choice")).alias("last"),
            F.count(F.lit(1)).alias("left"),
        )
        summary = cut(summary.withColumn("over", (F.col("top.n") * 2 > F.col("total")) | (F.col("left") == 1)), "summary")
        won = won.unionByName(
            summary.filter("over").select("round_id", F.col("top.choice").alias("winner"), F.lit(turn).alias("eliminations"))
        )
        out = summary.filter("NOT over").select("round_id", F.col("last.choice").alias("choice"))
        going = summary.filter("NOT over").select("round_id")
        alive = cut(
            alive.join(going, "round_id", "left_semi").join(out, ["round_id", "choice"], "left_anti"), "alive"
        )
        turn += 1
    return won


def cosine(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, zero, lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def semantic_top_k(records: DataFrame, queries: DataFrame, k: int, min_score: float) -> DataFrame:
    """Closest records per query inside the query's namespace.

    ``records`` (namespace, record_id, embedding), ``queries`` (namespace, query_id,
    query). The join is on the namespace; the bounded rank is cut before the shuffle.
    """
    scored = records.join(queries, "namespace").withColumn("score", cosine(F.col("embedding"), F.col("query")))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "record_id")
    return (
        scored.filter(F.col("score") >= min_score)
        .select("query_id", "record_id", "score")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def fencing_breaches(writes: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Writes whose term is below the highest term seen before them."""
    highest = Ordered(writes, keys, "pos", rows=rows).running_max(F.col("term"), "highest_term")
    return highest.done().filter(F.col("term") < F.col("highest_term"))


def check_envelopes(messages: DataFrame, as_of_us: int, rows: int | None = None) -> DataFrame:
    """First complaint about each message: repeated key, expired, nobody addressed, or
    a sequence number not above the sender's previous one in the job."""
    first = messages.groupBy("idempotency_key").agg(F.min("pos").alias("first_pos"))
    seq = Ordered(messages, ["sender", "job_id"], "pos", rows=rows).shift({"previous_seq": "sequence_number"})
    return (
        seq.done()
        .join(first, "idempotency_key")
        .withColumn(
            "complaint",
            F.when(F.col("pos") > F.col("first_pos"), "duplicate")
            .when(F.col("expires_us") <= as_of_us, "expired")
            .when(F.col("receiver").isNull() & F.col("topic").isNull(), "unaddressed")
            .when(F.col("sequence_number") <= F.col("previous_seq"), "out_of_order")
            .otherwise("ok"),
        )
        .drop("first_pos", "previous_seq")
    )


def causation_chains(messages: DataFrame) -> DataFrame:
    """Root cause and distance of every message (id, causation_id).

    Pointers double each round, so a chain of n messages takes log2(n) joins. A message
    whose cause is unknown is a root; one on or behind a loop has none and is left out.
    """
    known = messages.select(F.col("id").alias("causation_id"), F.lit(True).alias("k"))
    state = messages.join(known, "causation_id", "left").select(
        "id",
        F.when(F.col("k"), F.col("causation_id")).otherwise(F.col("id")).alias("to"),
        F.when(F.col("k"), 1).otherwise(0).cast("bigint").alias("depth"),
    )
    state = cut(state, "chain")
    roots = state.filter("depth = 0").select("to")
    total = state.count()
    for _ in range(math.ceil(math.log2(total + 1)) if total else 0):
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        state = cut(
            state.join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"),
                                           (F.col("more") > 0).alias("moved")),
            "chain",
        )
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.join(roots, "to", "left_semi").select("id", F.col("to").alias("root"), "depth")


def quota_breaches(calls: DataFrame, quota: int, width: str, slide: str) -> DataFrame:
    """Sliding windows in which a tenant used more tokens than its quota."""
    return (
        calls.groupBy("tenant_id", F.window("at", width, slide).alias("w"))
        .agg(F.sum("tokens").alias("tokens"))
        .filter(F.col("tokens") > quota)
        .select("tenant_id", F.unix_micros("w.start").alias("from_us"), "tokens")
    )


def heartbeat_losses(beats: DataFrame, interval_us: int, missed: int = 3, rows: int | None = None) -> DataFrame:
    """Silences of a node longer than the allowed number of missed beats."""
    nxt = Ordered(beats, ["node_id"], "at_us", rows=rows).shift({"next_us": "at_us"}, back=False).done()
    return nxt.filter(F.col("next_us") - F.col("at_us") > interval_us * missed).select(
        "node_id", F.col("at_us").alias("lost_us"), F.col("next_us").alias("back_us")
    )


def headroom(cpu_utilization: Column, active_tasks: Column) -> Column:
    free = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cpu_utilization))
    return free * 0.5 + (1.0 / (1.0 + active_tasks)) * 0.5


def sweep_summary(runs: DataFrame) -> DataFrame:
    """Benchmark sweep: runs, success share, wall time and cost per agents and topology."""
    return runs.groupBy("agents", "topology").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(F.col("ok").cast("double")).alias("success_rate"),
        F.min("wall_ms").alias("best_ms"),
        F.max("wall_ms").alias("worst_ms"),
        F.sum("cost_micro_usd").alias("cost_micro_usd"),
    )


def repeated_artifacts(artifacts: DataFrame) -> DataFrame:
    """Contents stored more than once, and the bytes that the repeats take."""
    return artifacts.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min("artifact_id").alias("first_id"),
        F.sum("size_bytes").alias("total"), F.max("size_bytes").alias("size_bytes"),
    ).filter("copies > 1").withColumn("wasted_bytes", F.col("total") - F.col("size_bytes")).drop("total")
