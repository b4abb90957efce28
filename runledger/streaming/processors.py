"""Stateful streaming: the batch step functions, driven per micro-batch.

State per key is the same small struct the batch fold carries, so batch and stream
cannot drift apart. Rows of a micro-batch are put in order before the step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runledger.functions import fixed_values as fixed
from runledger.operators import kv, leases
from runledger.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    """Runs ``step(rows, state)`` per key with its state kept by Spark.

    ``due(state)`` may name a time in milliseconds at which ``wake(key, at_us)`` makes
    a row that is fed to the step, such as the sweep of an expired lease.
    """

    def __init__(
        self,
        step: Callable,
        state_schema: T.StructType,
        order: str,
        due: Callable[[dict], int | None] | None = None,
        wake: Callable[[tuple, int], pd.DataFrame] | None = None,
    ) -> None:
        self.step, self.state_schema, self.order = step, state_schema, order
        self.due, self.wake = due, wake

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", self.state_schema)

    def _run(self, rows: pd.DataFrame) -> pd.DataFrame:
        names = self.state_schema.fieldNames()
        before = dict(zip(names, self.state.get())) if self.state.exists() else None
        out, after = self.step(rows, before)
        plain = (v.item() if hasattr(v, "item") else v for v in (after[n] for n in names))
        self.state.update(tuple(plain))
        if self.due:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            at = self.due(after)
            if at is not None:
                self.handle.registerTimer(at)
        return out

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Start a key where a batch fold ended; only in the first micro-batch of a stream."""
        values = (initialState[n].iloc[0] for n in self.state_schema.fieldNames())
        self.state.update(tuple(v.item() if hasattr(v, "item") else v for v in values))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        yield self._run(batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.wake:
            yield self._run(self.wake(key, expiredTimerInfo.getExpiryTimeInMs() * 1000))

    def close(self) -> None:
        pass


def _ordered_out(step: Callable, names: list[str]) -> Callable:
    def run(rows: pd.DataFrame, state: dict | None):
        out, after = step(rows, state)
        return out[names], after

    return run


def fold_stream(
    stream: DataFrame, keys: list[str], order: str, step: Callable, out_ddl: str, state_ddl: str,
    due: Callable | None = None, wake: Callable | None = None, initial: DataFrame | None = None,
) -> DataFrame:
    """Streaming counterpart of ``fold_by_key``. With ``due`` the stream needs a watermark.

    ``initial`` holds one row per key, the keys and the state that the stream starts from.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out, state = T.StructType.fromDDL(out_ddl), T.StructType.fromDDL(state_ddl)
    processor = FoldProcessor(_ordered_out(step, out.fieldNames()), state, order, due, wake)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append",
        timeMode="EventTime" if due else "None",
        initialState=None if initial is None else initial.select(*keys, *state.fieldNames()).groupBy(*keys),
    )


def kv_stream(writes: DataFrame) -> DataFrame:
    return fold_stream(writes.select(*kv.WRITE_COLUMNS), ["namespace", "key"], "pos", kv.apply_writes, kv.OUT, kv.STATE)


def lease_stream(events: DataFrame) -> DataFrame:
    return fold_stream(events.select(*leases.NEED), ["task_id"], "pos", leases.apply_lease_events, leases.OUT, leases.STATE)


def lease_stream_with_expiry(events: DataFrame) -> DataFrame:
    """As ``lease_stream``, but a lease that lapses is swept by an event-time timer.

    ``events`` also carries ``at`` as a watermarked timestamp. Swept rows have pos -1.
    """

    def due(state: dict) -> int | None:
        return -(-state["due_us"] // 1000) if state["place"] == "leased" else None  # never before it lapses

    def wake(key: tuple, at_us: int) -> pd.DataFrame:
        return pd.DataFrame(
            {"task_id": [key[0]], "pos": [-1], "at_us": [at_us], "op": ["sweep"], "duration_ms": [0],
             "max_attempts": [fixed.RETRY_MAX_ATTEMPTS]}
        )

    return fold_stream(
        events.select(*leases.NEED, "at"), ["task_id"], "pos", leases.apply_lease_events, leases.OUT, leases.STATE, due, wake
    )


RELIABILITY_OUT = "agent_id BIGINT, pos BIGINT, success_rate DOUBLE, average_latency_ms BIGINT"
RELIABILITY_STATE = "success_rate DOUBLE, average_latency_ms BIGINT"


def reliability_step(rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
    """One output row per agent and micro-batch: rolling success rate and latency."""
    rate = state["success_rate"] if state else 1.0
    mean = state["average_latency_ms"] if state else 0
    keep = 1.0 - fixed.EWMA_ALPHA
    for ok, ms in zip(rows["ok"].tolist(), rows["latency_ms"].tolist()):
        rate = keep * rate + fixed.EWMA_ALPHA * (1.0 if ok else 0.0)
        mean = ms if mean == 0 else (4 * mean + ms) // 5
    out = pd.DataFrame(
        {"agent_id": [rows["agent_id"].iloc[0]], "pos": [int(rows["pos"].iloc[-1])], "success_rate": [rate],
         "average_latency_ms": [mean]}
    )
    return out, {"success_rate": rate, "average_latency_ms": mean}


def reliability_stream(attempts: DataFrame) -> DataFrame:
    need = attempts.select("agent_id", "pos", "ok", "latency_ms")
    return fold_stream(need, ["agent_id"], "pos", reliability_step, RELIABILITY_OUT, RELIABILITY_STATE)


DELTA_OUT = "job_id BIGINT, state STRING, delta BIGINT"
DELTA_STATE = "state STRING, pos BIGINT"


def state_delta_step(job: int | None, state: str | None, pos: int, before: tuple[str, int] | None) -> tuple[list[tuple], tuple]:
    """Leave the old state, enter the new one; nothing if it is the same or was passed before."""
    old = before[0] if before else None
    if before and before[1] > pos:
        state, pos = before
    moves = [] if old == state else [(job, state, 1)] + ([(job, old, -1)] if old else [])
    return moves, (state, pos)


class StateDeltaProcessor(StatefulProcessor):
    """Runs ``state_delta_step`` on the last transition of a task in each micro-batch.

    Works on rows: a task has a few of them in a micro-batch, and a data frame for each task
    would cost more than all of its transitions.
    """

    def __init__(self) -> None:
        self.state_schema = T.StructType.fromDDL(DELTA_STATE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", self.state_schema)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Start a task where a history ended; only in the first micro-batch of a stream."""
        self.state.update((initialState["state"], initialState["pos"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = None
        for row in rows:
            if last is None or row["pos"] >= last["pos"]:
                last = row
        before = self.state.get()
        moves, after = state_delta_step(key[0], last["to_state"], last["pos"], before)
        if after != before:
            self.state.update(after)
        return (Row(job_id=job, state=state, delta=delta) for job, state, delta in moves)

    def close(self) -> None:
        pass


def state_delta_stream(transitions: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """Changes to the per-job state counts. Their sum is the live job view: an append-only
    log of +1 and -1, so no snapshot is rewritten and nothing is counted twice.

    With ``replayed`` (``job_id, task_id, state, pos``, the last state of each task in the
    history read so far) the changes are those after it. Transitions that the history
    already holds change nothing, so history and stream may overlap.
    """
    transitions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keys = ["job_id", "task_id"]
    return transitions.select(*keys, "pos", "to_state").groupBy(*keys).transformWithState(
        statefulProcessor=StateDeltaProcessor(), outputStructType=T.StructType.fromDDL(DELTA_OUT),
        outputMode="Append", timeMode="None",
        initialState=None if replayed is None else replayed.select(*keys, "state", "pos").groupBy(*keys),
    )


def replayed_states(transitions: DataFrame) -> DataFrame:
    """Last state of every task in a history, for ``state_delta_stream`` to start from."""
    last = transitions.groupBy("job_id", "task_id").agg(F.max(F.struct("pos", "to_state")).alias("last"))
    return last.select("job_id", "task_id", F.col("last.to_state").alias("state"), F.col("last.pos").alias("pos"))


SILENCE_OUT = "node_id BIGINT, change STRING, lost_us BIGINT, back_us BIGINT"
SILENCE_STATE = "starts ARRAY<BIGINT>, ends ARRAY<BIGINT>, told BOOLEAN"


def joined_runs(runs: list[tuple[int, int]], limit_us: int) -> list[tuple[int, int]]:
    """Runs of beats with no gap above the limit. A late beat may join runs, never part them."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start - out[-1][1] <= limit_us:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


class SilenceProcessor(StatefulProcessor):
    """Losses and returns of a node, told once no beat that could change them can come.

    The state is the node's runs of beats since the last settled silence, one or two as a
    rule and at most one per limit within the watermark's delay, whatever the number of
    beats. A timer waits for the first run's end plus the limit (lost), then for the start
    of the run after it (back).
    """

    def __init__(self, limit_us: int) -> None:
        self.limit_us, self.state_schema = limit_us, T.StructType.fromDDL(SILENCE_STATE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", self.state_schema)

    def _read(self) -> tuple[list[tuple[int, int]], bool]:
        if not self.state.exists():
            return [], False
        starts, ends, told = self.state.get()
        return [(int(s), int(e)) for s, e in zip(starts, ends)], bool(told)

    def _due(self, runs: list[tuple[int, int]], told: bool) -> int | None:
        """Next time worth waking at, in microseconds."""
        if not told:
            return runs[0][1] + self.limit_us
        return runs[1][0] if len(runs) > 1 else None

    def _keep(self, runs: list[tuple[int, int]], told: bool) -> None:
        self.state.update(([s for s, _ in runs], [e for _, e in runs], told))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = self._due(runs, told)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, told = self._read()
        for part in rows:
            beats = part["at_us"].sort_values().to_numpy()
            if len(beats):
                cuts = (beats[1:] - beats[:-1] > self.limit_us).nonzero()[0]
                starts, ends = beats[[0, *(cuts + 1)]], beats[[*cuts, -1]]
                runs = joined_runs(runs + list(zip(starts.tolist(), ends.tolist())), self.limit_us)
        if runs:
            self._keep(runs, told)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        (runs, told), found = self._read(), []
        while runs and (due := self._due(runs, told)) is not None and due <= now:
            if told:
                found.append((key[0], "back", runs[0][1], runs[1][0]))
                runs = runs[1:]
            else:
                found.append((key[0], "lost", runs[0][1], None))
            told = not told
        if runs:
            self._keep(runs, told)
        out = pd.DataFrame(found, columns=["node_id", "change", "lost_us", "back_us"])
        yield out.astype({"back_us": "Int64"})

    def close(self) -> None:
        pass


def silence_stream(beats: DataFrame, interval_us: int, missed: int = 3) -> DataFrame:
    """Changes of each node (``node_id, at_us`` and a watermarked timestamp ``at``): ``lost``
    once the watermark is ``missed`` intervals past its last beat, also if it never comes
    back, and ``back`` with the first beat after that. Beats may come in any order within
    the watermark's delay and more than once; rows with a null time are left out.
    """
    beats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    need = beats.select("node_id", "at_us", "at").filter("at_us IS NOT NULL AND node_id IS NOT NULL")
    return need.groupBy("node_id").transformWithStateInPandas(
        statefulProcessor=SilenceProcessor(interval_us * missed), outputStructType=T.StructType.fromDDL(SILENCE_OUT),
        outputMode="Append", timeMode="EventTime",
    )


# --- stateless or built-in stateful streams ------------------------------------------------


def dedup_stream(deliveries: DataFrame, key: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """First delivery per key; a key is forgotten once the watermark is past it."""
    return deliveries.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    return (
        events.withWatermark(at, delay)
        .groupBy(F.window(at, width).alias("w"), "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_micros("w.start").alias("from_us"), "kind", "n")
    )


def watch_prefix(writes: DataFrame, namespace: str, prefix: str) -> DataFrame:
    return writes.filter((F.col("namespace") == namespace) & F.col("key").startswith(prefix))


def route_failures(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], retry_path: str, park_path: str):
    """``foreachBatch`` body: one evaluation, two sinks, each keyed by batch id so that a
    repeated batch overwrites itself."""

    def body(batch: DataFrame, batch_id: int) -> None:
        decided = decide(batch).persist()
        decided.filter("decision = 'retry'").write.mode("overwrite").parquet(f"{retry_path}/batch={batch_id}")
        decided.filter("decision = 'park'").write.mode("overwrite").parquet(f"{park_path}/batch={batch_id}")
        decided.unpersist()

    return stream.writeStream.foreachBatch(body)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there now and return what it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    running = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def drain_writer(writer, label: str, spark: SparkSession) -> None:
    running = writer.option("checkpointLocation", f"{scratch_path(spark, label)}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
