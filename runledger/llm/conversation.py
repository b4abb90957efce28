"""Conversation structure repair by iterative-deepening A* (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm import edit_search as es
from runledger.llm.common import batch_of, column, small_batches
from runledger.operators.ordered import Ordered
from runledger.session import cut

#: Rows of a conversation whose letters make one string; a longer one has several.
BLOCK_ROWS = 1 << 14
#: Rows whose edits one task looks for.
TASK_ROWS = 20_000
SPACES = r"' \t\n\u000b\f\r'"
KEY = ["known", "conv"]
REPAIRED = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32 of ``conv_id:turn`` decides on.

    A null counts as one space in the role, the text and the hashed name.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``known, conv``, a key without nulls in place of ``conv_id``."""
    return rows.select(F.col("conv_id").isNotNull().alias("known"), F.coalesce("conv_id", F.lit(0)).cast("bigint").alias("conv"), *[c for c in rows.columns if c != "conv_id"])


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation, first fault, and letter.

    A row is a duplicate if its role and text stand at an earlier place; the first place of
    each repeated pair is an aggregate, so no conversation is gathered for it.
    """
    placed = Ordered(keyed(rows), KEY, "turn", ["role", "text"]).row_number("pos").done()
    placed = placed.withColumn("digest", F.sha2("text", 256))
    same = [*KEY, "role", "digest"]
    repeated = placed.groupBy(*same).agg(F.min("pos").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    bare = F.expr(f"trim(TRAILING {SPACES} FROM text)")
    end = F.right(bare, F.lit(1))
    fault = (
        F.when(bare == "", es.REMOVED)
        .when(F.col("pos") > F.col("first"), es.REMOVED)
        .when(~end.isin(".", "!", "?"), es.TRUNCATED)
        .otherwise(es.SOUND)
    )
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", es.KEEP_S).when(initial == "u", es.KEEP_U).when(initial == "a", es.KEEP_A).otherwise(es.OTHER)
    return (
        placed.join(repeated, same, "left")
        .select(
            *KEY,
            "turn",
            "role",
            "text",
            "pos",
            F.floor((F.col("pos") - 1) / BLOCK_ROWS).cast("bigint").alias("block"),
            (bare == "").alias("blank"),
            fault.alias("fault"),
            role.alias("kind"),
        )
        .withColumn("letter", _letter(F.col("kind") * 3 + F.col("fault")))
        .withColumn("seen", F.when(F.col("blank"), "b").when(F.col("fault") == es.REMOVED, "d").when(F.col("fault") == es.TRUNCATED, "t").otherwise(""))
        .drop("kind", "fault", "blank")
    )


def _letter(place: Column) -> Column:
    return F.substring(F.lit(es.LETTERS), place + 1, F.lit(1))


def codes_of(rows: DataFrame) -> DataFrame:
    """``known, conv, block, last, code``: the letters of up to ``BLOCK_ROWS`` rows in order."""
    letters = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    blocks = rows.groupBy(*KEY, "block").agg(F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("code"))
    return blocks.join(blocks.groupBy(*KEY).agg(F.max("block").alias("last")), KEY)


def edits_of(codes: DataFrame) -> DataFrame:
    """``known, conv, block, entry, cost, edits`` of every block.

    A conversation of one block is searched at once. For a longer one each block gives its
    costs from state to state, a walk from the end gives what follows each block, each block
    then gives the state it leads to from every state, and a walk from the start gives the
    state that it is entered in. The walks see sixteen numbers per block; an audit is a
    string of at most 2 GB, so they have at most 131,072 rows.
    """
    solved = pa.schema([("known", pa.bool_()), ("conv", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    ddl = "known boolean, conv bigint, block bigint, entry int, cost bigint, edits string"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                final = row["block"] == row["last"]
                cost, edits, state = es.solve(row["code"], row["entry"], es.AT_END if final else tuple(row["after"]))
                if final:
                    edits += "I" * (es.AT_END[state] // es.INSERT)
                found.append((row["known"], row["conv"], row["block"], row["entry"], int(cost), edits))
            columns = zip(*found, strict=True) if found else [[]] * len(solved)
            yield batch_of(solved, **dict(zip(solved.names, map(list, columns), strict=True)))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [[x for line in es.costs(c) for x in line] for c in column(batch, "code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[column(batch, n) for n in ("known", "conv", "block", "last")], pa.array(cells, pa.list_(pa.float64()))], names=["known", "conv", "block", "last", "cells"])

    def follow(table: pa.Table) -> pa.Table:
        """What it costs to go on behind each block, from the last to the first."""
        table = table.sort_by([("block", "descending")])
        after, out = es.AT_END, []
        for cells in table.column("cells").to_pylist():
            out.append([float(x) for x in after])
            after = es.before([cells[4 * p : 4 * p + 4] for p in es.STATES], after)
        return table.drop_columns(["cells"]).append_column("after", pa.array(out, pa.list_(pa.float64())))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = []
            for code, after in zip(column(batch, "code").to_pylist(), column(batch, "after").to_pylist(), strict=True):
                goal = tuple(after)
                to.append([es.solve(code, p, goal)[2] for p in es.STATES])
            names = ["known", "conv", "block", "last", "after", "leads"]
            yield pa.RecordBatch.from_arrays([*[column(batch, n) for n in names[:-1]], pa.array(to, pa.list_(pa.int32()))], names=names)

    def enter(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        state, out = es.START, []
        for to in table.column("leads").to_pylist():
            out.append(state)
            state = to[state]
        return table.drop_columns(["leads"]).append_column("entry", pa.array(out, pa.int32()))

    place = "known boolean, conv bigint, block bigint, last bigint"
    rows = codes.agg(F.sum(F.length("code"))).first()[0] or 0
    codes = codes.repartition(-(-rows // TASK_ROWS) or 1, *KEY, "block")  # letters are few bytes, but take long
    nothing = F.lit(None).cast("array<double>")
    short = codes.filter("last = 0").select(*KEY, "block", "last", "code", nothing.alias("after"), F.lit(es.START).alias("entry"))
    long = codes.filter("last > 0")
    behind = long.mapInArrow(tables, f"{place}, cells array<double>").groupBy(*KEY).applyInArrow(follow, f"{place}, after array<double>")
    known = long.join(behind.drop("last"), [*KEY, "block"])
    entered = known.mapInArrow(leads, f"{place}, after array<double>, leads array<int>").groupBy(*KEY).applyInArrow(enter, f"{place}, after array<double>, entry int")
    later = long.join(entered.drop("last"), [*KEY, "block"]).select(short.columns)
    return short.unionByName(later).mapInArrow(solve, ddl)


class Repair:
    """One conversation while its rows stream by: counts, edits and the hash of what is left."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.edits: list[str] = []
        self.cost = 0
        self.seen = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.before = None
        self.hash, self.some = hashlib.sha256(), False
        self.pending: Iterator[str] = iter("")
        self.state = es.START

    def block(self, entry: int, cost: int, edits: str) -> None:
        self.flush()
        if not self.edits:
            self.cost = cost
        self.edits.append(edits)
        self.pending, self.state = iter(edits), entry

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def insert(self) -> None:
        self.put(es.WANTED[self.state], "")
        self.state = es.THEN[self.state]

    def row(self, turn: int | None, role: str, text: str, letter: str, seen: str) -> None:
        self.seen[seen] += 1
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        for edit in self.pending:
            if edit == "I":
                self.insert()
                continue
            if edit == "K":
                self.put(role, text)
                self.state = es.kept(self.state, es.LETTERS.index(letter) // 3)
            elif edit == "R":
                self.put(es.WANTED[self.state], text)
                self.state = es.THEN[self.state]
            return

    def flush(self) -> None:
        """Insertions behind the last row of a block."""
        for _ in self.pending:
            self.insert()

    def result(self) -> tuple:
        self.flush()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return self.conv_id, gaps, self.seen["b"], self.seen["d"], self.seen["t"], self.illegal, self.cost, "".join(self.edits), self.hash.hexdigest()


def repair(conversations: DataFrame) -> DataFrame:
    """Damage, faults and cheapest repair of every conversation (operator 13).

    One row per ``conv_id``, a null one included: ``gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``. Rows go by turn (nulls first), and rows of one
    turn by role and text, so copies are adjacent. A conversation without rows after the
    damage has zeros, an empty audit and the hash of nothing; no rows, no result. Columns
    other than the four are not read, whatever their names.

    Searches see letters only, in blocks of ``BLOCK_ROWS`` that different tasks take. The
    hash of a conversation needs all its text in order: its rows go through one task as a
    sorted stream, of which one batch is held.
    """
    rows = cut(with_faults(damaged(conversations)), "conversation-rows")
    edits = edits_of(cut(codes_of(rows), "conversation-codes"))
    none = {"turn": "bigint", "role": "string", "text": "string", "letter": "string", "seen": "string"}
    marks = keyed(conversations.select("conv_id").distinct()).select(
        *KEY, F.lit(-1).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("edits"),
        *[F.lit(None).cast(t).alias(n) for n, t in none.items()],
    )
    blocks = edits.select(*KEY, "block", F.lit(0).cast("bigint").alias("pos"), "entry", "cost", "edits", *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    texts = rows.select(*KEY, "block", "pos", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("bigint").alias("cost"), F.lit(None).cast("string").alias("edits"), *[F.col(n).cast(t) for n, t in none.items()])
    stream = small_batches(marks.unionByName(blocks).unionByName(texts)).repartition(*KEY).sortWithinPartitions(*KEY, "block", "pos")
    schema = pa.schema(
        [("conv_id", pa.int64())]
        + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repair | None = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["block"] < 0:
                    if now is not None:
                        done.append(now.result())
                    now = Repair(r["conv"] if r["known"] else None)
                elif r["edits"] is not None:
                    now.block(r["entry"], r["cost"], r["edits"])
                else:
                    now.row(r["turn"], r["role"], r["text"], r["letter"], r["seen"])
            if done:
                yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*done, strict=True)), strict=True)))
        if now is not None:
            yield batch_of(schema, **dict(zip(schema.names, [[x] for x in now.result()], strict=True)))

    return stream.mapInArrow(run, REPAIRED)
