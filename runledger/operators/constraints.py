"""Audit of all declared constraints in one pass per table and one shuffle.

A rule is a row ``(table_name, rule, kind, columns, predicate, target)``; ``parse_rules``
reads them from lines of text. Each table is scanned once: a row gives a small entry for
every check it breaks, for every unique key it holds, and for every reference in the space
of the key that it points to. One aggregate over all entries then counts, for every key value,
its rows and the references to it from each rule, so a table that many others point to is
not read again for each of them, and a value that a third of all rows hold is summed up
in the tasks before the shuffle.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "table_name STRING, rule STRING, key STRING, n BIGINT"


class Rule(NamedTuple):
    table_name: str
    rule: str
    kind: str  # unique, check or references
    columns: tuple[str, ...]
    predicate: str | None = None  # of a check, or the rows a unique key covers
    target: str | None = None  # the table a reference points to


def parse_rules(text: str) -> list[Rule]:
    """Rules from lines ``table: unique a, b [where p]``, ``table: check p`` and
    ``table: a references other``; the rule's name is its line after the colon."""
    found = []
    for line in filter(None, map(str.strip, text.splitlines())):
        table, rule = re.fullmatch(r"(\w+): *(.+)", line).groups()
        if key := re.fullmatch(r"unique ([\w, ]+?)(?: where (.+))?", rule):
            found.append(Rule(table, rule, "unique", tuple(key[1].replace(" ", "").split(",")), key[2]))
        elif test := re.fullmatch(r"check (.+)", rule):
            found.append(Rule(table, rule, "check", (), test[1]))
        elif link := re.fullmatch(r"(\w+) references (\w+)", rule):
            found.append(Rule(table, rule, "references", (link[1],), None, link[2]))
        else:
            raise ValueError(f"not a rule: {line}")
    return found


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as rows, one per rule."""
    return spark.createDataFrame(
        [(r.table_name, r.rule, r.kind, list(r.columns), r.predicate, r.target) for r in rules],
        "table_name STRING, rule STRING, kind STRING, columns ARRAY<STRING>, predicate STRING, target STRING",
    )


def _key(columns: tuple[str, ...]) -> Column:
    """Key text; null if any part is null, as such rows are exempt. Parts of a key of several
    columns have ``\\`` and ``/`` escaped, so that different keys never read the same."""
    parts = [F.col(c).cast("string") for c in columns]
    if len(parts) > 1:
        parts = [F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/")) for p in parts]
    return F.concat(*[p for c in parts for p in (F.lit("/"), c)][1:])


def _spaces(rules: list[Rule], tables: dict[str, DataFrame], ids: dict[str, str]) -> list[list[Rule]]:
    """A space per check, then one per unique key: the key's own rule in slot 0, then the
    rules that point to it."""
    spaces = [[r] for kind in ("check", "unique") for r in rules if r.kind == kind and r.table_name in tables]
    for rule in rules:
        if rule.kind == "references" and rule.table_name in tables and rule.target in tables:
            at = next(
                (s for s in spaces if s[0].kind == "unique" and s[0].table_name == rule.target and s[0].columns == (ids[rule.target],) and not s[0].predicate),
                None,
            )
            if at is None:
                raise ValueError(f"{rule.table_name}: {rule.rule} has no unique key to point to")
            at.append(rule)
    return spaces


def audit(tables: dict[str, DataFrame], rules: list[Rule], ids: dict[str, str]) -> DataFrame:
    """Violations ``(table_name, rule, key, n)`` of all ``rules`` on the given ``tables``.

    ``ids`` names each table's identifying column: references point to it and failed checks
    are reported by it, with the number of its broken rows (a null id gives a null key). A
    unique rule reports each value held by more than one row, a reference each value that
    is in no row of its target, with the number of rows that hold it. As in SQL, a null
    key part is exempt from unique and reference rules and an unknown check result breaks
    nothing. Rules on tables that are not given are left out, as are references to them.
    Key parts are joined by ``/``. An empty table breaks no rule, but references to it
    point nowhere; columns that no rule names are never read.
    """
    spaces = _spaces(rules, tables, ids)
    own: dict[str, list[tuple[int, int, Rule]]] = {}
    for space, members in enumerate(spaces):
        for slot, rule in enumerate(members):
            own.setdefault(rule.table_name, []).append((space, slot, rule))
    passes = [_one_pass(df, own[name], ids[name]) for name, df in tables.items() if name in own]
    if not passes:
        return next(iter(tables.values())).sparkSession.createDataFrame([], OUT)
    slots = range(max(map(len, spaces)))
    counts = (
        reduce(DataFrame.unionByName, passes).groupBy("space", "key")
        .agg(*[F.count_if(F.col("slot") == s).alias(f"n{s}") for s in slots])
    )
    # a check is broken by one row, a unique key by the second
    most = F.when(F.col("space") < sum(m[0].kind == "check" for m in spaces), 0).otherwise(1)
    hits = [_hit(F.col("n0") > most, 0)] + [_hit((F.col("n0") == 0) & (F.col(f"n{s}") > 0), s) for s in slots[1:]]
    # most values break nothing; they end here, before an array is made of their counts
    kept = counts.filter((F.col("n0") > most) | (F.col("n0") == 0))
    broken = kept.select("space", "key", F.inline(F.array_compact(F.array(*hits))))
    names = F.array(*[
        F.array(*[F.struct(F.lit(r.table_name).alias("table_name"), F.lit(r.rule).alias("rule")) for r in m]) for m in spaces
    ])
    return broken.select(F.get(F.get(names, F.col("space")), F.col("slot")).alias("named"), "key", "n").select("named.*", "key", "n")


def rule_counts(violations: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per rule, unbroken ones too: keys that break it and the rows that hold them. Only one
    row per broken rule meets the list of rules."""
    broken = violations.groupBy("table_name", "rule").agg(
        F.count(F.lit(1)).alias("broken_keys"), F.sum("n").alias("rows_held")
    )
    listed = rules_table(violations.sparkSession, rules).select("table_name", "rule", "kind")
    return listed.join(broken, ["table_name", "rule"], "left").na.fill(0, ["broken_keys", "rows_held"])


def _hit(broken: Column, slot: int) -> Column:
    return F.when(broken, F.struct(F.lit(slot).alias("slot"), F.col(f"n{slot}").alias("n")))


def _one_pass(df: DataFrame, own: list[tuple[int, int, Rule]], id_column: str) -> DataFrame:
    """Entries ``(space, slot, key)`` of one scan."""
    entries = []
    for space, slot, rule in own:
        key = F.col(id_column).cast("string") if rule.kind == "check" else _key(rule.columns)
        counts = key.isNotNull()
        if rule.kind == "check":
            counts = ~F.expr(rule.predicate)
        elif rule.predicate:
            counts &= F.expr(rule.predicate)
        entries += [F.when(counts, F.lit(space)), F.lit(slot), key]
    return df.select(F.stack(F.lit(len(own)), *entries).alias("space", "slot", "key")).filter("space IS NOT NULL")
