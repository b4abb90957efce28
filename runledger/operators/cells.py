"""Pairs of similar number sets, block by block.

Sets of a job are dealt to blocks in the order of their size. Every two blocks whose sizes
allow a similar pair meet in one task, a *cell*, which counts shared numbers with an index of
one side. Only pairs that reach the threshold leave it, so what is shuffled follows the sets
and the number of blocks, never the pairs that are compared or the numbers these share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.session import cut

#: Numbers a block of sets holds, and what a set counts besides its own.
BLOCK_NUMBERS, SET_WEIGHT = 6_000_000, 200
#: Share of the least overlap that may come from a set's most frequent numbers, which are not looked up.
UNSEEN = 0.85
#: Numbers in fewer sets of the other side are looked up together.
FEW = 24
#: Partitions dealt per cell, as several cells may fall on one.
PARTS_PER_CELL = 2


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _overlaps(lefts: np.ndarray, rights: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of ``lefts`` and one of ``rights`` with enough in common.

    Both hold rows of one table in the order of their sizes; given one and the same, each pair
    comes once. Sets of ``m`` and ``n`` need ``(m + n) * threshold / (1 + threshold)`` in common,
    ``threshold * m`` at least. Some fewer of a set's most frequent numbers are taken as shared
    and the others counted; pairs that may suffice are then compared in full.
    """
    same, share = lefts is rights, threshold / (1 + threshold)
    n_left, n_right = sizes[lefts], sizes[rights]
    held = codes[_runs(starts[rights], n_right)]
    holders = np.repeat(np.arange(len(rights)), n_right)[np.argsort(held, kind="stable")]
    often = np.bincount(held, minlength=int(codes.max()) + 1)
    begin = np.cumsum(often) - often
    need = n_right * share - 1e-9
    lows = np.searchsorted(n_right, n_left * threshold - 1e-9)
    highs = np.searchsorted(n_right, n_left / threshold + 1e-9, side="right")
    if same:
        lows = np.maximum(lows, np.arange(len(lefts)) + 1)
    marks = np.zeros(len(often), dtype=bool)
    found_a, found_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at in np.flatnonzero(lows < highs).tolist():
        low, high, n, row = int(lows[at]), int(highs[at]), int(n_left[at]), lefts[at]
        mine = codes[starts[row] : starts[row] + n]
        counts = often[mine]
        rare_first = np.argsort(counts)
        unseen = int(UNSEEN * threshold * n)
        looked = rare_first[: n - unseen]
        counts = counts[looked]
        none, few = np.searchsorted(counts, (1, FEW)).tolist()
        places = begin[mine[looked]]
        parts = [holders[i:j] for i, j in zip(places[few:].tolist(), (places[few:] + counts[few:]).tolist())]
        if none < few:
            parts.append(holders[_runs(places[none:few], counts[none:few])])
        if not parts:
            continue
        shared = np.bincount(np.concatenate(parts), minlength=len(rights))[low:high]
        hits = np.flatnonzero(shared >= need[low:high] + (n * share - unseen)) + low
        if len(hits):
            marks[mine] = True
            ns = n_right[hits]
            both = np.add.reduceat(marks[codes[_runs(starts[rights[hits]], ns)]], np.cumsum(ns) - ns, dtype=np.int64)
            marks[mine] = False
            hits = hits[both >= need[hits] + n * share - 1e-9]
            found_a.append(np.full(len(hits), row))
            found_b.append(rights[hits])
    return np.concatenate(found_a), np.concatenate(found_b)


def _blocks(coded: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Which block a size goes to, and the cells ``x, y`` of a block with its side in them."""
    sizes = coded.groupBy("job_id", "n").agg((F.count(F.lit(1)) * (F.col("n") + SET_WEIGHT)).alias("load"))
    before = F.sum("load").over(W.partitionBy("job_id").orderBy("n")) - F.col("load")
    base = F.floor(before / BLOCK_NUMBERS).cast("int")
    parts = F.greatest(F.ceil(F.col("load") / BLOCK_NUMBERS), F.lit(1)).cast("int")
    dealt = sizes.select("job_id", "n", base.alias("base"), parts.alias("parts")).groupBy("job_id", "base", "parts")
    dealt = cut(dealt.agg(F.min("n").alias("from_n"), F.max("n").alias("to_n")), "dealt")
    block = F.explode(F.sequence("base", F.col("base") + F.col("parts") - 1))
    blocks = dealt.withColumn("block", block).groupBy("job_id", "block").agg(F.min("from_n").alias("low"), F.max("to_n").alias("high"))
    x, y = (blocks.select("job_id", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "low", "high")]) for k in "xy")
    met = x.join(y, "job_id").filter((F.col("block_x") <= F.col("block_y")) & (F.col("high_x") >= F.col("low_y") * threshold - 1e-9))
    met = met.select("job_id", F.col("block_x").alias("x"), F.col("block_y").alias("y"))
    sides = met.select("job_id", F.col("x").alias("block"), "x", "y", F.lit(0).alias("side")).unionByName(
        met.filter("x < y").select("job_id", F.col("y").alias("block"), "x", "y", F.lit(1).alias("side"))
    )
    return dealt, cut(sides, "cells")


def near_pairs(sets: DataFrame, numbers: Column, threshold: float) -> DataFrame:
    """``a, b``: every two ``pos`` of a job, the lesser first, whose ``numbers`` may be alike
    enough: no pair of sets at or above the threshold is missing.

    ``sets`` has ``job_id, pos``, the latter unique; ``numbers`` is an array of ints that
    stand for the members of a set. If two members share a number a pair may seem more
    alike than it is, never less; the caller compares the sets themselves. Empty sets and
    null jobs have no pairs.
    """
    coded = sets.select("job_id", "pos", numbers.alias("codes")).withColumn("n", F.size("codes"))
    coded = cut(coded.filter((F.col("n") > 0) & F.col("job_id").isNotNull()), "coded")
    dealt, sides = _blocks(coded, threshold)
    part = F.pmod(F.xxhash64("pos"), F.col("parts")).cast("int")
    placed = coded.join(dealt, "job_id").filter(F.col("n").between(F.col("from_n"), F.col("to_n")))
    routed = placed.withColumn("block", F.col("base") + part).join(sides, ["job_id", "block"])
    spread = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS_PER_CELL * sides.filter("side = 0").count())
    cells = routed.select("job_id", "x", "y", "side", "pos", "codes").repartition(spread, "job_id", "x", "y")

    def met(table: pa.Table) -> pa.Table:
        lists = table["codes"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        codes = lists.flatten().dictionary_encode().indices.to_numpy()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        starts, pos = np.cumsum(sizes) - sizes, table["pos"].to_numpy()
        by_size = np.argsort(sizes, kind="stable")
        side = table["side"].to_numpy()[by_size]
        lefts = by_size[side == 0]
        rights = by_size[side == 1] if side.any() else lefts
        a, b = (pos[rows] for rows in _overlaps(lefts, rights, starts, sizes, codes, threshold))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return cells.groupBy("job_id", "x", "y").applyInArrow(met, "a bigint, b bigint")
