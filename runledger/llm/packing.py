"""Best-fit packing of documents into sequences, improved by swaps (operator 8)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import batch_of, chunks, column, small_batches, strings
from runledger.llm.tokens import ENCODED_CHARS, spaced_encoder
from runledger.session import cut

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"
#: Pieces that one task packs; a bin below this fill is packed again with those of other groups.
GROUP_PIECES, FULL_ENOUGH = 50_000, 0.98
#: Bins that the local search fails to empty before it gives up, and steps it takes for one.
TRIES, STEPS = 12, 300


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document; only longer documents are cut."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = spaced_encoder(tokenizer_path)
        for batch in batches:
            texts, doc_ids, rows = strings(batch), column(batch, "doc_id").to_pylist(), []
            for a, b in chunks(texts, ENCODED_CHARS):
                for doc_id, ids in zip(doc_ids[a:b], encode(texts[a:b]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            names = schema.names
            yield batch_of(schema, **dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))) if rows else batch_of(schema, **{n: [] for n in names})

    return small_batches(docs).select("doc_id", "text").mapInArrow(pieces, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that it fits into.

    Open bins stand by free space; a bit mask of the spaces in use finds the smallest that
    is large enough.
    """
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = used >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                used &= ~(1 << space)
        else:
            space, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        left = space - size
        if left:
            by_space[left].append(at)
            used |= 1 << left
    return bins


class Swaps:
    """Local search over bins: moves and swaps that raise the sum of squared fills.

    The emptiest bin is the victim. Its items move into bins with room, or one or two of
    them change places with a smaller item there, until it is empty. When none of that is
    left, the bin with most room gives to other bins in the same ways, which gathers room
    in one place. A step is taken only if squared fill grows, so the search ends; a victim
    that cannot be emptied within ``STEPS`` is put back as it was.
    """

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity, self.bins = sizes.astype(np.int64), capacity, bins
        self.bin_of = np.zeros(len(sizes), dtype=np.int64)
        for b, items in enumerate(bins):
            self.bin_of[items] = b
        self.fill = np.bincount(self.bin_of, weights=self.sizes, minlength=len(bins)).astype(np.int64)

    def run(self, tries: int = TRIES) -> list[list[int]]:
        failed = 0
        for victim in np.argsort(self.fill, kind="stable").tolist():
            room = int(self.capacity * np.count_nonzero(self.fill) - self.fill.sum())
            if room < self.capacity or failed >= tries:
                break
            kept = self.bin_of.copy(), self.fill.copy()
            if not self._empty(victim):
                self.bin_of, self.fill = kept
                failed += 1
        packed: dict[int, list[int]] = {}
        for item, b in enumerate(self.bin_of.tolist()):
            packed.setdefault(b, []).append(item)
        return list(packed.values())

    def _empty(self, victim: int) -> bool:
        for _ in range(STEPS):
            if not self.fill[victim]:
                return True
            if self._step(victim, victim):
                continue
            room = np.where(self.fill > 0, self.capacity - self.fill, 0)
            room[victim] = 0
            if not self._step(int(np.argmax(room)), victim):
                return False
        return not self.fill[victim]

    def _step(self, donor: int, victim: int) -> bool:
        """One move or swap that takes from ``donor`` and gives to a bin other than ``victim``."""
        mine = np.flatnonzero(self.bin_of == donor)
        mine = mine[np.argsort(-self.sizes[mine], kind="stable")]
        space = np.where(self.fill > 0, self.capacity - self.fill, 0)
        space[[donor, victim]] = 0
        for item in mine.tolist():  # move
            size = self.sizes[item]
            fits = np.flatnonzero((space >= size) & (self.fill + size > self.fill[donor]))
            if len(fits):
                self._put(item, int(fits[np.argmin(space[fits])]))
                return True
        others = np.flatnonzero(space[self.bin_of] > 0)
        theirs, room = self.sizes[others], space[self.bin_of[others]]
        for item in mine.tolist():  # one for one
            if self._swap((item,), others, theirs, room, donor):
                return True
        few = mine[:8].tolist()
        return any(self._swap((x, y), others, theirs, room, donor) for i, x in enumerate(few) for y in few[i + 1 :])  # two for one

    def _swap(self, given: tuple[int, ...], others: np.ndarray, theirs: np.ndarray, room: np.ndarray, donor: int) -> bool:
        size = int(self.sizes[list(given)].sum())
        gain = size - theirs
        good = (gain > 0) & (gain <= room) & (self.fill[self.bin_of[others]] + gain > self.fill[donor])
        if not good.any():
            return False
        best = int(np.argmax(np.where(good, gain, -1)))
        back, target = int(others[best]), int(self.bin_of[others[best]])
        for item in given:
            self._put(item, target)
        self._put(back, donor)
        return True

    def _put(self, item: int, target: int) -> None:
        self.fill[self.bin_of[item]] -= self.sizes[item]
        self.fill[target] += self.sizes[item]
        self.bin_of[item] = target


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item indexes: best fit, then swaps."""
    return Swaps(sizes, best_fit(sizes, capacity), capacity).run() if len(sizes) else []


def pack_groups(pieces: DataFrame, capacity: int, groups: int, turn: int, settle: bool) -> DataFrame:
    """Pack each of ``groups`` groups on its own; ``sequence_id`` is -1 in bins left open.

    With ``settle`` no bin is left open.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        + [("sequence_id", pa.int64()), ("offset", pa.int64())]
    )
    least = 0 if settle else FULL_ENOUGH * capacity

    def of_group(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        sequence, offset = np.full(len(sizes), -1, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        base = (turn << 56) | (key[0].as_py() << 24)
        for n, items in enumerate(pack(sizes, capacity)):
            filled = sizes[items]
            if filled.sum() >= least:
                sequence[items] = base + n
                offset[items] = np.cumsum(filled) - filled
        columns = [table.column(f.name) for f in schema if f.name not in ("sequence_id", "offset")]
        return pa.table([*columns, pa.array(sequence), pa.array(offset)], schema=schema)

    group = F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(groups)).alias("pack_group")
    dealt = pieces.select(group, *[f.split()[0] for f in PIECES.split(", ")])
    return dealt.groupBy("pack_group").applyInArrow(of_group, PACKED)


def pack_pieces(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``.

    Pieces are dealt by hash to groups of about ``group_pieces`` and each group is packed on
    its own. Bins that stay below ``FULL_ENOUGH`` are opened again and their pieces go to
    the next round, with as many groups as those need. The round that has one group, or
    comes after one that settled less than half, leaves no bin open; what a round settles is written to the shared folder.
    """
    left, count, turn, stuck = pieces, pieces.count(), 0, False
    done: list[DataFrame] = []
    while count or not done:
        groups = max(1, -(-count // group_pieces))
        packed = cut(pack_groups(left, capacity, groups, turn, stuck or groups == 1), "packed")
        done.append(packed.filter("sequence_id >= 0"))
        left = packed.filter("sequence_id < 0")
        before, count, turn = count, left.count(), turn + 1
        stuck = count > before // 2
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack the ids of all documents into sequences of at most ``capacity`` (operator 8).

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A
    null text is empty and gives one piece with its end id; a null ``doc_id`` and repeated
    rows are packed like any other; no documents give no rows. Other columns are not read.
    """
    return pack_pieces(cut(token_pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity)
