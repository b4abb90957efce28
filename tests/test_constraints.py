"""The constraint audit against small worked tables and plain counting."""

import random
from collections import Counter

import pytest
from conftest import rows

from runledger.operators import constraints as op
from runledger.sources import tables

RULES = op.parse_rules("""
    parents: unique id
    parents: check size > 0
    parents: unique a, b where a <> 'free'
    children: unique id
    children: parent references parents
""")
IDS = {"parents": "id", "children": "id"}
PARENT, CHILD = "id STRING, size INT, a STRING, b STRING, extra STRING", "id STRING, parent STRING, key STRING, slot INT"


def test_rules_are_read_from_lines(spark):
    assert RULES[2] == op.Rule("parents", "unique a, b where a <> 'free'", "unique", ("a", "b"), "a <> 'free'")
    assert RULES[4] == op.Rule("children", "parent references parents", "references", ("parent",), None, "parents")
    with pytest.raises(ValueError):
        op.parse_rules("parents: primary id")
    declared = op.parse_rules(tables.CONSTRAINTS)
    assert {r.table_name for r in declared} == set(tables.DECLARED)
    for rule in declared:
        assert set(rule.columns) <= set(tables.schema(rule.table_name).fieldNames())


def test_each_kind_of_violation(spark):
    parents = spark.createDataFrame([
        ("p1", 1, "x", "y", ""), ("p1", 0, "x", "y", ""), ("p2", None, "free", "y", ""), ("p3", -1, "free", "y", ""),
        (None, -5, None, "y", ""), (None, 2, None, "y", ""), ("p4", 1, "a/b", "c", ""), ("p5", 1, "a", "b/c", ""),
    ], PARENT)
    children = spark.createDataFrame(
        [("c1", "p1", "k", 1), ("c2", "nobody", "k", 1), ("c3", "nobody", None, 2), ("c4", None, "k", 3), ("c1", "p3", "k", 4)], CHILD
    )
    got = rows(op.audit({"parents": parents, "children": children}, RULES, IDS))
    assert got == sorted([
        ("children", "parent references parents", "nobody", 2),
        ("children", "unique id", "c1", 2),
        ("parents", "check size > 0", None, 1),
        ("parents", "check size > 0", "p1", 1),
        ("parents", "check size > 0", "p3", 1),
        ("parents", "unique a, b where a <> 'free'", "x/y", 2),
        ("parents", "unique id", "p1", 2),
    ], key=lambda r: tuple((v is None, str(v)) for v in r))


def test_empty_and_missing_tables(spark):
    parents, children = spark.createDataFrame([], PARENT), spark.createDataFrame([("c1", "p1", "k", 1)], CHILD)
    assert rows(op.audit({"parents": parents}, RULES, IDS)) == []
    assert rows(op.audit({"children": children}, RULES, IDS)) == []  # no target to compare with
    both = op.audit({"parents": parents, "children": children}, RULES, IDS)
    assert rows(both) == [("children", "parent references parents", "p1", 1)]
    assert op.audit({"parents": parents}, [], IDS).collect() == []
    counts = {(r.table_name, r.rule): (r.broken_keys, r.rows_held) for r in op.rule_counts(both, RULES).collect()}
    assert len(counts) == 5 and counts["children", "parent references parents"] == (1, 1) and counts["parents", "unique id"] == (0, 0)
    with pytest.raises(ValueError):
        op.audit({"parents": parents, "children": children}, RULES[1:], IDS)


def test_a_hot_value_against_plain_counts(spark):
    rng = random.Random(7)
    ids = [str(rng.randrange(400)) for _ in range(500)]
    held = [rng.choice(["7", "gone", str(rng.randrange(800))]) for _ in range(5000)]
    parents = spark.createDataFrame([(i, 1, i, i, "") for i in ids], PARENT).repartition(5)
    children = spark.createDataFrame([(str(n), p, "k", 1) for n, p in enumerate(held)], CHILD).repartition(7)
    want = [("children", "parent references parents", p, n) for p, n in Counter(held).items() if p not in ids]
    want += [("parents", "unique id", i, n) for i, n in Counter(ids).items() if n > 1]
    want += [("parents", "unique a, b where a <> 'free'", f"{i}/{i}", n) for i, n in Counter(ids).items() if n > 1]
    found = op.audit({"parents": parents, "children": children}, RULES, IDS)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(found) == sorted(want, key=str)


def test_rows_that_break_nothing_cost_no_array(spark):
    """Entries are stacked and counted; arrays are made of the broken values alone."""
    parents = spark.createDataFrame([("p1", 1, "a/b\\", "c", "")] * 2 + [("p2", 1, "a", "/b\\/c", "")] * 2, PARENT)
    found = op.audit({"parents": parents, "children": spark.createDataFrame([], CHILD)}, RULES, IDS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate inline") == 1 and "regexp_replace" not in plan
    assert {r.key for r in found.filter("rule LIKE 'unique a%'").collect()} == {"a\\/b\\\\/c", "a/\\/b\\\\\\/c"}
