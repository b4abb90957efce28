"""Order-dependent operators that stay safe when one key holds a large share of all rows.

A plain window over a hot key sorts that key in one task. Here the rows are first
cut into blocks along the order column, at quantiles of the data, so that a
``(key, block)`` group never holds more than about ``block_rows`` rows. Windows run
inside the groups; one small row per ``(key, block)`` carries what crosses a border.
With one block (small data) everything collapses to the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.session import block_rows, cut

BLOCK = "_block"
MAX_BLOCKS = 4096
NULL_BLOCK = -1.0


def with_block(df: DataFrame, order: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """Add ``_block``, the slice of the global order a row falls in.

    One pass over the order column yields the row count and the cut points; only
    these few numbers reach the driver. Equal order values share a block; null order
    values, which sort below all others, have a block of their own.
    """
    rows = rows or block_rows(df.sparkSession)
    total = df.select(order).count()
    n = min(MAX_BLOCKS, math.ceil(total / rows))
    if n <= 1:
        return df.withColumn(BLOCK, F.lit(0.0)), 1
    share = [i / n for i in range(1, n)]
    found = df.select(
        F.percentile_approx(F.col(order).cast("double"), share, 20 * MAX_BLOCKS)
    ).first()[0]
    cuts = sorted(set(found or ()))
    out = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol="_order", outputCol=BLOCK
    ).transform(df.withColumn("_order", F.coalesce(F.col(order).cast("double"), F.lit(-math.inf))))
    out = out.withColumn(BLOCK, F.when(F.col(order).isNull(), NULL_BLOCK).otherwise(F.col(BLOCK)))
    return out.drop("_order"), len(cuts) + 1


class Ordered:
    """Rows of ``df`` per ``keys`` in the order of ``order`` (numeric) and ``ties``."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: str,
        ties: Sequence[str] = (),
        descending: bool = False,
        rows: int | None = None,
    ) -> None:
        self.keys = list(keys)
        self.df, self.blocks = with_block(df, order, rows)
        self.by = [order, *ties]
        self.descending = descending

    def _sort(self, descending: bool) -> list[Column]:
        return [F.col(c).desc() if descending else F.col(c).asc() for c in self.by]

    def _local(self, descending: bool) -> W:
        parts = self.keys if self.blocks == 1 else [*self.keys, BLOCK]
        return W.partitionBy(*parts).orderBy(*self._sort(descending))

    def _across(self, descending: bool) -> W:
        edge = F.col(BLOCK).desc() if descending else F.col(BLOCK).asc()
        return W.partitionBy(*self.keys).orderBy(edge)

    def _keep(self, df: DataFrame) -> Ordered:
        self.df = df
        return self

    def done(self) -> DataFrame:
        return self.df.drop(BLOCK)

    def shift(self, values: dict[str, str], back: bool = True) -> Ordered:
        """``values`` maps new column to source column of the previous (or next) row."""
        desc = self.descending != (not back)
        local = self._local(desc)
        df = self.df
        picked = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
        df = df.withColumn("_prev", F.lag(picked).over(local))
        if self.blocks > 1:
            at = F.struct(*[F.col(c) for c in self.by])
            edge = F.max_by(picked, at) if not desc else F.min_by(picked, at)
            tails = (
                self.df.groupBy(*self.keys, BLOCK)
                .agg(edge.alias("_tail"))
                .withColumn("_tail", F.lag("_tail").over(self._across(desc)))
            )
            df = df.join(tails, [*self.keys, BLOCK], "left").withColumn(
                "_prev", F.coalesce("_prev", "_tail")
            )
        for out in values:
            df = df.withColumn(out, F.col("_prev")[out])
        return self._keep(df.drop("_prev", "_tail"))

    def running_sum(self, value: Column, out: str, inclusive: bool = True) -> Ordered:
        """Sum of ``value`` over this and all earlier rows (earlier only if exclusive)."""
        frame = self._local(self.descending).rowsBetween(W.unboundedPreceding, W.currentRow)
        df = self.df.withColumn("_value", value)
        df = df.withColumn(out, F.sum("_value").over(frame))
        if self.blocks > 1:
            before = self._across(self.descending).rowsBetween(W.unboundedPreceding, -1)
            sums = (
                self.df.withColumn("_value", value)
                .groupBy(*self.keys, BLOCK)
                .agg(F.sum("_value").alias("_sum"))
                .withColumn("_offset", F.sum("_sum").over(before))
                .drop("_sum")
            )
            # either part is null while it has met no value; the sum is null only if both are
            df = df.join(sums, [*self.keys, BLOCK], "left").withColumn(
                out, F.coalesce(F.col(out) + F.col("_offset"), out, "_offset")
            )
        if not inclusive:
            df = df.withColumn(out, F.col(out) - F.coalesce("_value", F.lit(0)))
        return self._keep(df.drop("_value", "_offset"))

    def running_max(self, value: Column, out: str) -> Ordered:
        """Largest ``value`` over this and all earlier rows; null while there is none."""
        frame = self._local(self.descending).rowsBetween(W.unboundedPreceding, W.currentRow)
        df = self.df.withColumn(out, F.max(value).over(frame))
        if self.blocks > 1:
            before = self._across(self.descending).rowsBetween(W.unboundedPreceding, -1)
            tops = (
                self.df.groupBy(*self.keys, BLOCK)
                .agg(F.max(value).alias("_top"))
                .withColumn("_top", F.max("_top").over(before))
            )
            df = df.join(tops, [*self.keys, BLOCK], "left").withColumn(out, F.greatest(out, "_top"))
        return self._keep(df.drop("_top"))

    def row_number(self, out: str) -> Ordered:
        """1-based position within the key."""
        return self.running_sum(F.lit(1).cast("bigint"), out)


def in_order(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Rows in the order of ``by``, nulls first, as Spark's windows and ``_block`` have it."""
    return pdf.sort_values(by, kind="stable", na_position="first").reset_index(drop=True)


Step = Callable[[pd.DataFrame, "dict | None"], "tuple[pd.DataFrame, dict]"]


def fold_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str],
    step: Step,
    out_ddl: str,
    state_ddl: str,
    rows: int | None = None,
) -> DataFrame:
    """Run a sequential fold per key whose step no join or window can express.

    ``step(rows, state)`` takes rows in order and the state left by the rows before
    them (``None`` at the start) and returns output rows and the new state. Keys with
    up to ``block_rows`` rows are folded in one grouped call. Larger keys are cut into
    blocks along the order and folded block after block, the state travelling in a
    written table, so no task ever holds more than one block of a key.
    """
    spark = df.sparkSession
    out_schema, state_schema = T.StructType.fromDDL(out_ddl), T.StructType.fromDDL(state_ddl)
    keys, by = list(keys), [order, *ties]
    limit = rows or block_rows(spark)
    hot = df.groupBy(*keys).count().filter(F.col("count") > limit).drop("count")
    hot_keys = cut(hot, "hot-keys")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = step(in_order(pdf, by), None)
        return out[out_schema.fieldNames()]

    if hot_keys.isEmpty():
        return df.groupBy(*keys).applyInPandas(whole, out_schema)

    cold = df.join(hot_keys, keys, "left_anti").groupBy(*keys).applyInPandas(whole, out_schema)
    wide, n = with_block(df.join(hot_keys, keys, "left_semi"), order, limit)
    wide = cut(wide, "hot-rows")
    state_names = state_schema.fieldNames()
    both = T.StructType(
        [T.StructField(f"o_{f.name}", f.dataType) for f in out_schema]
        + [T.StructField(f"k_{k}", df.schema[k].dataType) for k in keys]
        + [T.StructField(f"s_{f.name}", f.dataType) for f in state_schema]
        + [T.StructField("_is_state", T.BooleanType())]
    )

    def block_step(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        state = None
        if len(right):
            state = {name: right[name].iloc[0] for name in state_names}
        if len(left):
            left = in_order(left, by)
            out, state = step(left, state)
            out = out[out_schema.fieldNames()].add_prefix("o_")
            out["_is_state"] = False
        else:
            out = pd.DataFrame()
        carried = {f"s_{k}": [v] for k, v in (state or {}).items()}
        carried |= {f"k_{k}": [v] for k, v in zip(keys, key)}
        tail = pd.DataFrame(carried | {"_is_state": [True]})
        return pd.concat([out, tail], ignore_index=True).reindex(columns=both.fieldNames())

    states = spark.createDataFrame(
        [], T.StructType([df.schema[k] for k in keys] + list(state_schema))
    )
    parts = [cold]
    for block in [NULL_BLOCK, *range(n)]:
        mixed = cut(
            wide.filter(F.col(BLOCK) == block)
            .groupBy(*keys)
            .cogroup(states.groupBy(*keys))
            .applyInPandas(block_step, both),
            "fold",
        )
        parts.append(
            mixed.filter(~F.col("_is_state")).select(
                *[F.col(f"o_{c}").alias(c) for c in out_schema.fieldNames()]
            )
        )
        states = mixed.filter("_is_state").select(
            *[F.col(f"k_{k}").alias(k) for k in keys],
            *[F.col(f"s_{c}").alias(c) for c in state_names],
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scan_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    step: Step,
    summarise: Callable[[pd.DataFrame], dict],
    advance: Callable[[dict, "dict | None"], dict],
    out_ddl: str,
    state_ddl: str,
    summary_ddl: str,
    rows: int | None = None,
) -> DataFrame:
    """``fold_by_key`` for folds whose blocks can be summed up without knowing the state
    they start in, so that the blocks of a hot key run side by side.

    ``summarise(rows)`` describes what a block does to any state; ``advance(summary,
    state)`` applies that description. Three steps: summarise every (key, block); walk
    the few summaries of a key to get the state at each block's start; run ``step`` on
    every block from there.
    """
    keys = list(keys)
    blocked, n = with_block(df, order, rows)
    out_schema, state_schema = T.StructType.fromDDL(out_ddl), T.StructType.fromDDL(state_ddl)
    out_names, state_names = out_schema.fieldNames(), state_schema.fieldNames()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(in_order(pdf, [order]), None)[0][out_names]

    if n == 1:
        return df.groupBy(*keys).applyInPandas(whole, out_schema)

    part = [*keys, BLOCK]
    blocked = cut(blocked, "blocked")
    key_fields = [blocked.schema[k] for k in part]
    summary_schema = T.StructType(key_fields + list(T.StructType.fromDDL(summary_ddl)))
    entry_schema = T.StructType(key_fields + list(state_schema))

    def sum_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        done = summarise(in_order(pdf, [order]))
        row = dict(zip(part, key)) | done
        return pd.DataFrame({name: [row[name]] for name in summary_schema.fieldNames()})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        state, found = None, []
        for row in pdf.sort_values(BLOCK).to_dict("records"):
            if state is not None:
                found.append({k: row[k] for k in part} | {s: state[s] for s in state_names})
            state = advance(row, state)
        return pd.DataFrame(found, columns=entry_schema.fieldNames())

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=out_names)
        state = {s: right[s].iloc[0] for s in state_names} if len(right) else None
        return step(in_order(left, [order]), state)[0][out_names]

    summaries = blocked.groupBy(*part).applyInPandas(sum_up, summary_schema)
    entries = summaries.groupBy(*keys).applyInPandas(walk, entry_schema)
    return blocked.groupBy(*part).cogroup(entries.groupBy(*part)).applyInPandas(run, out_schema)
