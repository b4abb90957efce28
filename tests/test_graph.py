import random

import pytest
from conftest import rows

from runledger.operators import graph

EDGE = "job_id INT, child STRING, parent STRING"
DIAMOND = [(1, "a", "plan"), (1, "b", "plan"), (1, "merge", "a"), (1, "merge", "b")]


def tasks(spark, states):
    return spark.createDataFrame([(1, k, v, 0, k) for k, v in states.items()], "job_id INT, task_id STRING, state STRING, stage INT, title STRING")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(DIAMOND, EDGE)


def states(**over):
    return {"plan": "created", "a": "created", "b": "created", "merge": "created"} | over


def test_waves_and_shape(spark, edges):
    waves = graph.waves(tasks(spark, states()), edges)
    assert {r.task_id: r.wave for r in waves.collect()} == {"plan": 0, "a": 1, "b": 1, "merge": 2}
    assert tuple(graph.graph_shape(waves).first()) == (1, 3, 2, 4)


@pytest.mark.parametrize(
    "done, want",
    [([], ["plan"]), (["plan"], ["a", "b"]), (["plan", "a", "b"], ["merge"]),
     (["plan", "a", "b", "merge"], [])],
)
def test_readiness(spark, edges, done, want):
    got = graph.ready(tasks(spark, states(**{k: "completed" for k in done})), edges)
    assert sorted(r.task_id for r in got.collect()) == want


def test_cycle_is_found_and_named(spark, edges):
    looped = edges.unionByName(spark.createDataFrame([(1, "a", "merge"), (1, "tail", "merge")], EDGE))
    every = tasks(spark, states(tail="created"))
    row = graph.graph_errors(every, looped).first()
    assert row.stuck == 3 and row.missing == 0 and row.cyclic_task in ("a", "merge")
    assert graph.graph_errors(every, edges).isEmpty()


def test_missing_dependency(spark, edges):
    lost = edges.unionByName(spark.createDataFrame([(1, "a", "ghost")], EDGE))
    assert rows(graph.unknown_dependencies(tasks(spark, states()), lost).select("child", "parent")) == [("a", "ghost")]
    assert graph.graph_errors(tasks(spark, states()), lost).first().missing == 1


def test_stranded(spark, edges):
    t = tasks(spark, states(plan="completed", a="dead_lettered", b="completed"))
    assert rows(graph.stranded(t, edges).select("task_id")) == [("merge",)]
    assert graph.ready(t, edges).isEmpty()
    busy = spark.createDataFrame([(1, 2)], "job_id INT, depth INT")
    idle = spark.createDataFrame([(1, 0)], "job_id INT, depth INT")
    new = {r.task_id: r.new_state for r in graph.cancel_stranded(t, edges, idle).collect()}
    assert new["merge"] == "cancelled" and new["b"] == "completed"
    assert "cancelled" not in {r.new_state for r in graph.cancel_stranded(t, edges, busy).collect()}


def test_split(spark, edges):
    parts = spark.createDataFrame([(1, "a", "a1"), (1, "a", "a2")], "job_id INT, task_id STRING, part STRING")
    got = rows(graph.split_tasks(edges, parts).select("child", "parent"))
    assert got == sorted(
        [("a", "a1"), ("a", "a2"), ("a1", "plan"), ("a2", "plan"), ("b", "plan"), ("merge", "a"), ("merge", "b")], key=str
    )


def test_large_layered_graph(spark):
    data = [(1, f"0-{i}", "root") for i in range(100)]
    data += [(1, f"{n}-{i}", f"{n - 1}-{j}") for n in range(1, 10) for i in range(100) for j in range(100)]
    e = spark.createDataFrame(data, EDGE)
    t = tasks(spark, {"root": "created"} | {f"{n}-{i}": "created" for n in range(10) for i in range(100)})
    assert tuple(graph.graph_shape(graph.waves(t, e)).first()) == (1, 11, 100, 1001)


def brute_admit(nodes, base, proposals):
    have, out = set(base), []
    for pos, child, parent in proposals:
        if child not in nodes or parent not in nodes:
            verdict = "unknown_task"
        elif child == parent:
            verdict = "self"
        elif (child, parent) in have:
            verdict = "exists"
        else:
            seen, todo = {child}, [child]
            while todo:
                x = todo.pop()
                for c, p in have:
                    if p == x and c not in seen:
                        seen.add(c)
                        todo.append(c)
            verdict = "cycle" if parent in seen else "added"
            if verdict == "added":
                have.add((child, parent))
        out.append((pos, verdict))
    return out


@pytest.mark.parametrize("seed", [1])
def test_edge_admission_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(9)]
    base = list({(names[b], names[a]) for a, b in (sorted(rng.sample(range(9), 2)) for _ in range(7))})
    props = [(i, rng.choice([*names, "ghost"] if i % 9 == 0 else names), rng.choice(names)) for i in range(26)]
    t = tasks(spark, {n: "created" for n in names})
    e = spark.createDataFrame([(1, *x) for x in base], EDGE)
    p = spark.createDataFrame([(1, *x) for x in props], "job_id INT, pos BIGINT, child STRING, parent STRING")
    got = rows(graph.admit_edges(t, e, p).select("pos", "decision"))
    assert got == sorted(brute_admit(set(names), base, props), key=lambda r: str(r[0]))


def brute_waves(n, pairs):
    parents = {i: {p for c, p in pairs if c == i} for i in range(n)}
    wave = {}
    while True:
        new = {i: 1 + max((wave[p] for p in ps), default=-1) for i, ps in parents.items() if i not in wave and all(p in wave for p in ps)}
        if not new:
            return wave
        wave.update(new)


@pytest.mark.parametrize("seed", range(4))
def test_waves_with_runs_trees_and_cycles(spark, seed):
    rng = random.Random(seed)
    n = 120
    pairs = {(i, rng.randrange(max(0, i - 6), i)) for i in range(1, n) for _ in range(rng.choice([0, 1, 1, 1, 2])) if i}
    if seed:
        pairs |= {(20, 40), (41, 42), (42, 41), (60, 60)}
    nodes = spark.createDataFrame([(1, i) for i in range(n)], "job_id INT, task_id INT")
    done, left = graph.peel(nodes, spark.createDataFrame([(1, *p) for p in pairs], "job_id INT, child INT, parent INT"))
    due = brute_waves(n, pairs)
    assert {r.task_id: r.wave for r in done.collect()} == due
    assert {r.task_id for r in left.collect()} == set(range(n)) - due.keys()


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, written = 10_000, []
    monkeypatch.setattr(graph, "cut", lambda *a, f=graph.cut, **k: (written.append(a[1]), f(*a, **k))[1])
    nodes = spark.range(n).selectExpr("1 AS job_id", "id AS task_id")
    edges = spark.range(1, n).selectExpr("1 AS job_id", "id AS child", "id - 1 AS parent")
    done = graph.waves(nodes, edges)
    assert done.filter("wave <> task_id").count() == 0 and done.count() == n
    assert len(written) < 25


def test_loops_send_no_side_of_a_join_through_the_driver(spark, monkeypatch):
    """Every written step of the walks and of peeling joins by merging, however small its tables are."""
    plans, write = [], graph.cut

    def noted(df, *names, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *names, **more)

    monkeypatch.setattr(graph, "cut", noted)
    nodes = spark.createDataFrame([("j", i, "dead_lettered" if i == 1 else "queued") for i in range(1, 30)], "job_id string, task_id long, state string")
    links = [("j", i, i // 2) for i in range(2, 30)] + [("j", i, i // 3) for i in range(3, 30)] + [("j", 4, 9), ("j", 5, 99)]
    links = spark.createDataFrame(links, "job_id string, child long, parent long")
    assert graph.stranded(nodes, links).count() == 28
    row = graph.graph_errors(nodes, links).first()
    assert (row.missing, row.stuck) == (1, 16)
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]
