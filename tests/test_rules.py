"""Row-level rules, queues, usage and matching on the literal cases."""

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed
from runledger.functions import text as tx
from runledger.operators import audit, declared, expand, inference, lifecycle, match, monitor, quality, queueing, usage


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column).first()[0]


def test_rules_report_every_failure(spark):
    def check(text, *keys):
        o = F.lit(text)
        return one(spark, quality.failures(
            quality.non_empty(o), quality.min_words(o, F.lit(3)), quality.must_mention(o, F.lit("Raft")),
            quality.json_keys(o, F.array(*map(F.lit, keys)))))

    assert check("  ", "a") == ["output is empty", "output has 0 words, needs 3", "output does not mention `Raft`", "output is not valid JSON"]
    assert check('{"a": "we use RAFT here"}', "a") == []
    assert check('{"a": "raft x y"}', "a", "b", "c") == ["JSON output is missing keys: b, c"]
    assert check('["raft", 1, 2, 3]', "a") == ["output is JSON but not an object"]


@pytest.mark.parametrize("text, want", [("Investigate Raft leader election", "investigate-raft-leader-election"), ("!!!", ""),
                                        ("  Ünïcode & ASCII ", "n-code-ascii"), ("x" * 60, "x" * 48)])
def test_slug(spark, text, want):
    assert one(spark, tx.slug(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("do it", 2), ("", 2), ("word " * 500, 8), ("a, b and c; d", 5)])
def test_complexity(spark, text, want):
    assert one(spark, tx.complexity(F.lit(text))) == want


def test_subtopics(spark):
    df = spark.createDataFrame([(1, "compare Raft, Paxos, and Viewstamped Replication", 3), (2, "a big thing and A BIG thing", 2)],
                               "job_id INT, objective STRING, fan INT")
    got = {r.job_id: r.topics for r in expand.subtopics(df, "job_id", "fan").collect()}
    assert len(set(got[1])) == 3 and {"compare Raft", "Viewstamped Replication"} < set(got[1])
    assert got[2] == ["a big thing", "a big thing and A BIG — aspect 1"]


def test_admission(spark):
    data = [(1, "ok", 8, None, None, None), (2, " ", 0, None, None, None), (3, "x", 0, None, None, None), (4, "x", 1001, None, None, None),
            (5, "x", 1, -1.0, None, None), (6, "x", 1, 1.0, 0, None), (7, "x", 1, 1.0, 5, " "), (8, "é" * 4097, 1, None, None, None)]
    df = spark.createDataFrame(data, "id INT, objective STRING, max_agents INT, max_cost DOUBLE, max_runtime_seconds INT, idempotency_key STRING")
    got = {r.id: (r.error_kind, r.message.split()[0] if r.message else "") for r in quality.admit(df).collect()}
    assert got == {1: ("", ""), 2: ("validation", "objective"), 3: ("validation", "max_agents"), 4: ("quota_exceeded", "max_agents"),
                   5: ("validation", "max_cost"), 6: ("validation", "max_runtime_seconds"), 7: ("validation", "idempotency_key"),
                   8: ("validation", "objective")}


def test_labels(spark):
    for raw, want in (("Map-Reduce", "map_reduce"), ("mapreduce", "map_reduce"), ("nope", None)):
        assert one(spark, quality.normal_strategy(F.lit(raw))) == want
    for raw, want in ((" Urgent", "critical"), ("medium", "normal"), ("x", None)):
        assert one(spark, quality.normal_priority(F.lit(raw))) == want
    assert one(spark, tx.plain_id(F.lit("task_0A"), "task")) == "0a"


def backoff(spark, attempt, base=100, cap=800, jitter=False, nonce=0):
    c = queueing.backoff_ms(F.lit(attempt), F.lit(base).cast("bigint"), F.lit(cap).cast("bigint"), F.lit(jitter), F.lit(nonce))
    return one(spark, c)


def test_backoff(spark):
    assert [backoff(spark, a) for a in (1, 2, 3, 4, 9, 99)] == [100, 200, 400, 800, 800, 800]
    assert backoff(spark, 5, base=0) == 0 and backoff(spark, 60, base=2**50, cap=2**60) == 2**60
    assert all(500 <= backoff(spark, 1, 1000, 9000, True, n) <= 1000 for n in (0, 250, 500, 501, 999))


def queue(spark, *items):
    data = [(i, 1, "q", p, e, a, "k", 0, "research") for i, (p, e, a) in enumerate(items)]
    return spark.createDataFrame(data, "task_id INT, job_id INT, queue STRING, priority INT, enqueued_us BIGINT, available_us BIGINT, "
                                       "idempotency_key STRING, attempt INT, required STRING")


def test_queue_order_delay_and_dedup(spark):
    q = queue(spark, (0, 1, 1), (3, 2, 2), (1, 3, 3), (3, 1, 99))
    assert [r.task_id for r in queueing.top_k(q, 9, 10).orderBy("rank").collect()] == [1, 2, 0]
    stats = queueing.queue_statistics(q.withColumn("place", F.lit("ready")), ["queue"], 10).first()
    assert (stats.ready, stats.delayed, stats.depth) == (3, 1, 4)
    counts = queueing.enqueue_counts(q.limit(3), "idempotency_key", ["queue"]).first()
    assert (counts.enqueued, counts.deduplicated) == (1, 2)
    assert queueing.top_k(q, 9, 10, offered=["coding"]).isEmpty()


def test_large_limits_are_cut_by_parts(spark, monkeypatch):
    q = queue(spark, *[(i * 7 % 4, i * 13 % 50, 1) for i in range(300)]).cache()
    want = rows(queueing.top_k(q, 40, 10).select("task_id", "rank"))
    monkeypatch.setattr(queueing, "PUSHED_LIMIT", 10)
    assert rows(queueing.top_k(q, 40, 10).select("task_id", "rank")) == want


def test_capability_predicate(spark):
    def take(need, offer):
        return one(spark, queueing.may_take(F.array(*map(F.lit, need)), F.array(*map(F.lit, offer)).cast("array<string>")))

    assert take(["a"], []) and take(["a"], ["a", "b"]) and not take(["a", "c"], ["a", "b"])


def test_retry_or_park(spark):
    df = spark.createDataFrame([(1, 1, 0, "failure 1"), (2, 3, 0, "failure 3")], "id INT, attempt INT, failed_us BIGINT, reason STRING")
    got = {r.id: (r.decision, r.last_error) for r in queueing.retry_or_park(df).collect()}
    assert got == {1: ("retry", ""), 2: ("park", "failure 3")}


def test_percentiles(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 101)] + [("b", 7)], "k STRING, latency_ms BIGINT")
    assert rows(usage.latency_percentiles(df, ["k"])) == [("a", 50, 95, 99), ("b", 7, 7, 7)]


def test_overhead_and_price(spark):
    def overhead(wall, task, width):
        return one(spark, usage.coordination_overhead(F.lit(wall), F.lit(task), F.lit(width)))

    assert (overhead(1000, 10_000, 10), overhead(2000, 10_000, 10), overhead(0, 1, 1)) == (0.0, 0.5, 0.0)
    assert one(spark, usage.call_cost_micro_usd(F.lit(1_000_000), F.lit(0), 1, 10)) == 1_000_000
    assert one(spark, usage.call_cost_micro_usd(F.lit(0), F.lit(1_000_000), 1, 10)) == 10_000_000


def test_conversation(spark):
    data = [(1, 0, "system", "s"), (1, 1, "user", "first"), (1, 2, "assistant", "a b"), (1, 3, "user", "second")]
    got = usage.conversation_rollup(spark.createDataFrame(data, "request_id INT, turn INT, role STRING, content STRING")).first()
    assert tuple(got) == (1, 5, "second")


def test_counts_add_up_and_cancel(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(fixed.TASK_STATES)], "job_id INT, task_id INT, state STRING")
    row = lifecycle.lifecycle_counts(df).first()
    assert sum(row[g] for g in set(fixed.TASK_GROUP.values())) == row.total == 12
    steps = lifecycle.cancellation_steps(df)
    assert steps.count() == 9 + 1 and steps.filter("from_state = 'running'").first().to_state == "failed"


def test_transition_audit_any_machine(spark):
    edges = spark.createDataFrame([("lamp", "off", "on"), ("lamp", "on", "off"), ("lamp", "on", "dead")], "entity STRING, from_state STRING, to_state STRING")
    log = spark.createDataFrame([("lamp", 1, i, a, b) for i, (a, b) in enumerate([(None, "off"), ("off", "on"), ("off", "dead"), ("dead", "on")])],
                                "entity STRING, id INT, pos BIGINT, from_state STRING, to_state STRING")
    got = lifecycle.audit_transitions(log, edges, ["id"]).orderBy("pos").collect()
    assert [r.legal for r in got] == [True, True, True, False]
    assert [r.continuous for r in got] == [True, True, False, True] and [r.after_terminal for r in got] == [False, False, False, True]


AGENTS = "agent_id INT, status STRING, current_load DOUBLE, success_rate DOUBLE, latency_ms BIGINT, capabilities ARRAY<STRING>"


def test_matching(spark):
    agents = spark.createDataFrame([(1, "idle", 0.5, 1.0, 10, ["research"]), (2, "idle", 0.1, 1.0, 10, ["research", "review"]),
                                    (3, "running", 0.0, 1.0, 1, ["research"]), (4, "registered", 0.1, 1.0, 5, ["planning"])], AGENTS)
    tasks = spark.createDataFrame([(1, ["research"]), (2, ["planning", "review"]), (3, []), (4, ["research"])], "task_id INT, required ARRAY<STRING>")
    pairs = match.candidates(match.requirement_classes(tasks), agents)
    assert rows(pairs.select("class", "agent_id")) == sorted([("", 1), ("", 2), ("", 4), ("research", 1), ("research", 2)], key=str)
    placed = {r.task_id: r.agent_id for r in match.place(tasks, match.pick_least_loaded(pairs)).collect()}
    assert placed == {1: 2, 2: None, 3: 4, 4: 2}
    best = {r["class"]: r.agent_id for r in match.pick_best(pairs, match.score()).collect()}
    assert best["research"] == 2
    turns = {r.task_id: r.agent_id for r in match.round_robin(tasks, pairs).collect()}
    assert turns == {1: 1, 3: 2, 4: 1}


def test_batch_inference_asks_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"f{i % 3}", f"p{i % 3}") for i in range(30)], "request_id INT, fingerprint STRING, prompt STRING")
    log = str(tmp_path)

    def answer(prompts: pd.Series) -> pd.Series:
        import uuid
        from pathlib import Path

        for p in prompts:
            Path(log, uuid.uuid4().hex).write_text(p)
        return prompts.str.upper()

    out = inference.answer_batch(df, answer).collect()
    assert len(out) == 30 and all(r.answer == r.prompt.upper() for r in out) and sum(not r.cached for r in out) == 3
    assert len(list(tmp_path.iterdir())) == 3


def test_fingerprint_covers_what_changes_the_answer(spark):
    base = [(1, 0, "user", "q")], (1, "m", False, 0.2)
    variants = [([(1, 0, "user", "other")], base[1]), (base[0], (1, "m", True, 0.2)), (base[0], (1, "m", False, 0.9)), (base[0], (1, "n", False, 0.2)),
                ([(1, 0, "user", "q"), (1, 1, "user", "q")], base[1])]

    def mark(messages, params):
        m = spark.createDataFrame(messages, "request_id INT, turn INT, role STRING, content STRING")
        return inference.fingerprints(m, spark.createDataFrame([params], "request_id INT, model STRING, json_mode BOOLEAN, temperature DOUBLE")).first().fingerprint

    assert mark(*base) == mark(*base) and mark(*base) not in [mark(*v) for v in variants]


def test_artifacts_of_unknown_job(spark):
    jobs = spark.createDataFrame([(1,)], "job_id INT")
    assert monitor.job_artifacts(1, jobs, graph=jobs)["graph"].count() == 1
    with pytest.raises(LookupError):
        monitor.job_artifacts(2, jobs, graph=jobs)


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "a", 1.5), (3, None, None)], "id INT, k STRING, c DOUBLE")
    got = audit.violations(audit.unique(df, "t", ["k"]), audit.check(df, "t", "c <= 1", F.col("c") <= 1, "id"),
                           audit.references(df, "t", "id", df.filter("id < 3"), "id"))
    assert rows(got.select("rule", "key", "n")) == [("c <= 1", "2", 1), ("references id", "3", 1), ("unique k", "a", 2)]


def test_ranked_choice(spark):
    votes = [["a", "b", "c"]] * 4 + [["b", "c", "a"]] * 3 + [["c", "b", "a"]] * 2
    data = [("r", i, rank, c) for i, v in enumerate(votes) for rank, c in enumerate(v)] + [("s", 0, 0, "x")]
    df = spark.createDataFrame(data, "round_id STRING, ballot INT, rank INT, choice STRING")
    assert rows(declared.ranked_choice(df)) == [("r", "b", 1), ("s", "x", 0)]


def test_causation_loop_has_no_root(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id INT, causation_id INT")
    assert rows(declared.causation_chains(df)) == [(1, 1, 0), (2, 1, 1), (3, 1, 2)]


def test_only_answers_fill_the_cache(spark):
    data = [("f", 1, "error", False), ("f", 2, "circuit_open", False), ("f", 3, "ok", False), ("f", 4, "ok", False), ("f", 5, "error", True),
            ("g", 6, "error", False), ("g", 7, "error", False)]
    df = spark.createDataFrame(data, "fingerprint STRING, pos BIGINT, status STRING, bypass_cache BOOLEAN")
    assert {r.pos for r in usage.cache_hits(df).filter("cache_hit").collect()} == {4}


def test_votes_for_text_answers(spark):
    votes = spark.createDataFrame([("r", "raft", 2), ("r", "paxos", 2), ("r", "none", 1), ("s", "x", 1)], "round_id STRING, answer STRING, weight INT")
    rounds = spark.createDataFrame([("r", 3), ("s", 1)], "round_id STRING, quorum INT")
    got = {r.round_id: (r.decision, r.agreement_rate, r.positions, r.status) for r in declared.vote_rounds(votes, rounds).collect()}
    assert got == {"r": ("paxos", 0.4, 3, "open"), "s": ("x", 1.0, 1, "decided")}
