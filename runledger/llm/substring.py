"""Removal of word passages that an earlier document has (operator 1).

Passages of ``window`` words meet through content-defined anchors: the least hash of the
short word runs inside. Windows in a row that share an anchor form a segment; equal windows
have equal anchors wherever they stand, so the segments of one anchor, and no others, have
to be held against each other. A shard is a range of anchors: it builds an FM-index over its
different segments and streams the segments of its documents through it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import batch_of, column, ranges, small_batches
from runledger.llm.fm_index import FMIndex
from runledger.session import cut

WINDOW = 50
#: Words of an anchor. An anchor with too many segments gives way to one of the next length;
#: the last is the whole window, whose copies are one row.
ANCHORS = (8, 29, WINDOW)
#: Segments of one anchor above which it is split; the list of such anchors has at most
#: MAX_HOT entries, as the bar rises with the number of all segments.
HOT_SEGMENTS, MAX_HOT = 20_000, 1 << 20
#: Words that one index holds, and windows that one stream brings.
SHARD_WORDS, STREAM_WINDOWS = 500_000, 256

SEGMENT = "h bigint, start int, n int"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def run_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, from one 32-bit code per word."""
    multiplier, result, length = 0x9E3779B97F4A7C15, None, 0
    power, block, span = np.array([multiplier], dtype=np.uint64), codes.astype(np.uint64), 1
    while True:
        if size & span:
            if result is None:
                result, length = block[: len(codes) - span + 1], span
            else:
                n = len(codes) - length - span + 1
                result, length = result[:n] * power + block[length : length + n], length + span
        if 2 * span > size:
            break
        block, span = block[:-span] * power + block[span:], 2 * span
        power = power * power
    result = result ^ (result >> np.uint64(31))
    result = result * np.uint64(0xBF58476D1CE4E5B9)
    return result ^ (result >> np.uint64(29))


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    least, span = values, 1
    while 2 * span <= size:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    rest = size - span
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def segments_of(words: list[bytes], window: int, anchors: tuple[int, ...], hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each segment of a document."""
    if len(words) < window:
        return (np.zeros(0, dtype=np.int64),) * 3
    codes = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    chosen = None
    for level, size in enumerate(anchors[: len(hot) + 1]):
        least = sliding_least(run_hashes(codes, size) ^ np.uint64(level * 0x5851F42D4C957F2D & (1 << 64) - 1), window - size + 1)
        if chosen is None:
            chosen, split = least, np.ones(len(least), dtype=bool)
        else:
            chosen = np.where(split, least, chosen)
        if level < len(hot):
            split &= np.isin(chosen.view(np.int64), hot[level])
            if not split.any():
                break
    edge = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    return chosen[edge].view(np.int64), edge, np.diff(np.concatenate([edge, [len(chosen)]]))


def document_segments(docs: DataFrame, window: int, anchors: tuple[int, ...], hot: list[np.ndarray]) -> DataFrame:
    """``doc_id, body_sha, n_words, segments`` of every row; ``body_sha`` is that of all its words."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("body_sha", pa.binary()), ("n_words", pa.int64()), ("segments", kind)])
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, sizes, found = [], [], []
            for text in column(batch, "text").to_pylist():
                words = words_of(text)
                shas.append(hashlib.sha256(b" ".join(words)).digest())
                sizes.append(len(words))
                found.append(segments_of(words, window, anchors, shared.value))
            flat = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3)]
            offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
            values = pa.StructArray.from_arrays(
                [pa.array(flat[0], pa.int64()), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32))], ["h", "start", "n"]
            )
            yield batch_of(
                schema,
                doc_id=column(batch, "doc_id"),
                body_sha=shas,
                n_words=sizes,
                segments=pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind),
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(segmented, f"doc_id bigint, body_sha binary, n_words bigint, segments array<struct<{SEGMENT}>>")


def anchored(docs: DataFrame, window: int, anchors: tuple[int, ...], hot_segments: int) -> tuple[DataFrame, DataFrame]:
    """Segments of every row, and the anchors that more than one document has.

    Anchors with too many segments are found first, level by level; as long as there are
    some, the documents are read again with those split.
    """
    hot: list[np.ndarray] = []
    while True:
        rows = cut(document_segments(docs, window, anchors, hot), "segments")
        flat = rows.filter(F.col("doc_id").isNotNull()).select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.h")
        counts = cut(
            flat.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high"),
            "anchors",
        )
        if len(hot) == len(anchors) - 1:
            return rows, counts.select("h")
        total = flat.count()
        found = counts.filter(F.col("n") > max(hot_segments, total // MAX_HOT)).select("h").toArrow().column("h").to_numpy()
        if not len(found):
            return rows, counts.select("h")
        hot.append(np.sort(found.astype(np.int64)))


def cut_segments(candidates: DataFrame, window: int, whole: bool) -> DataFrame:
    """The segments of candidate rows by the MD5 of their words.

    ``whole``: ``h, seg, body, low, high``, equal segments of a batch joined, with their
    smallest and largest document. Else ``doc_id, body_sha, start, seg`` of each.
    """
    if whole:
        schema = pa.schema([("h", pa.int64()), ("seg", pa.binary()), ("body", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])
        ddl = "h bigint, seg binary, body binary, low bigint, high bigint"
    else:
        schema = pa.schema([("doc_id", pa.int64()), ("body_sha", pa.binary()), ("start", pa.int32()), ("seg", pa.binary())])
        ddl = "doc_id bigint, body_sha binary, start int, seg binary"

    def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
        columns = (column(batch, n).to_pylist() for n in ("doc_id", "body_sha", "text", "segments"))
        for doc_id, sha, text, segments in zip(*columns, strict=True):
            words = words_of(text)
            for s in segments:
                body = b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1])
                yield doc_id, sha, s["h"], s["start"], hashlib.md5(body).digest(), body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = list(parts(batch.slice(at, 500)))
                if whole:
                    held: dict[tuple[int, bytes], list] = {}
                    for doc_id, _, h, _, seg, body in found:
                        row = held.setdefault((h, seg), [body, doc_id, doc_id])
                        row[1], row[2] = min(row[1], doc_id), max(row[2], doc_id)
                    rows = [(h, seg, *row) for (h, seg), row in held.items()]
                else:
                    rows = [(doc_id, sha, start, seg) for doc_id, sha, _, start, seg, _ in found]
                if rows:
                    yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    return candidates.mapInArrow(run, ddl)


def searched(segments: DataFrame, window: int, shard_words: int) -> DataFrame:
    """``seg, at, n, low``: windows of each segment and the smallest document that has them.

    Tasks take whole anchors, about ``shard_words`` words at a time, index them and run all
    of them through the index; runs of windows with one smallest document come out where
    that document is smaller than some document of the segment.
    """
    schema = pa.schema([("seg", pa.binary()), ("at", pa.int32()), ("n", pa.int32()), ("low", pa.int64())])

    def shard(segs: list[bytes], bodies: list[bytes], lows: np.ndarray, highs: np.ndarray) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        texts = [[known.setdefault(w, len(known) + 1) for w in b.split()] for b in bodies]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        ids = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
        ids[ranges(starts, sizes)] = np.concatenate([np.array(t, dtype=np.int64) for t in texts])
        index = FMIndex(ids, window)
        owner = np.repeat(lows, sizes + 1)[index.order]
        group = np.flatnonzero(index.lcp[:-1] < window)
        least = np.repeat(np.minimum.reduceat(owner, group), np.diff(np.concatenate([group, [len(owner)]])))
        cuts = [(s + a, min(STREAM_WINDOWS, n - window + 1 - a) + window - 1) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True) for a in range(0, n - window + 1, STREAM_WINDOWS)]
        at, lengths = (np.array(x, dtype=np.int64) for x in zip(*cuts, strict=True))
        matched, row = index.matching_statistics(ids, at, lengths)
        place = ranges(at, lengths - window + 1)
        of = np.searchsorted(starts, place, side="right") - 1
        low = least[row[place]]
        good = (matched[place] >= window) & (low < highs[of])
        place, of, low = place[good], of[good], low[good]
        if not len(place):
            return batch_of(schema, seg=[], at=[], n=[], low=[])
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (of[1:] != of[:-1]) | (low[1:] != low[:-1])]))
        runs = np.diff(np.concatenate([first, [len(place)]]))
        return batch_of(
            schema,
            seg=[segs[i] for i in of[first].tolist()],
            at=(place - starts[of])[first].astype(np.int32),
            n=runs.astype(np.int32),
            low=low[first],
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segs: list[bytes] = []
        bodies: list[bytes] = []
        lows: list[int] = []
        highs: list[int] = []
        last, held = None, 0
        for batch in batches:
            columns = (column(batch, n).to_pylist() for n in ("h", "seg", "body", "low", "high"))
            for h, seg, body, low, high in zip(*columns, strict=True):
                if h != last and held >= shard_words:
                    yield shard(segs, bodies, np.array(lows), np.array(highs))
                    segs, bodies, lows, highs, held = [], [], [], [], 0
                last = h
                segs.append(seg)
                bodies.append(body)
                lows.append(low)
                highs.append(high)
                held += body.count(b" ") + 2
        if segs:
            yield shard(segs, bodies, np.array(lows), np.array(highs))

    return segments.repartition("h").sortWithinPartitions("h").mapInArrow(search, "seg binary, at int, n int, low bigint")


def repeated_spans(
    docs: DataFrame,
    window: int = WINDOW,
    anchors: tuple[int, ...] = ANCHORS,
    hot_segments: int = HOT_SEGMENTS,
    shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages that begin in a document with a smaller id.

    Returns the rows (``doc_id, body_sha, n_words``), the texts of those that may hold such
    passages (``doc_id, body_sha, text``), and the passages: ``doc_id, body_sha, spans`` with
    spans ``(start, n, low)``: ``n`` windows from word ``start`` on, seen in document ``low``.
    """
    rows, shared = anchored(docs, window, anchors, hot_segments)
    kept = (
        rows.filter(F.col("doc_id").isNotNull())
        .dropDuplicates(["doc_id", "body_sha"])
        .select("doc_id", "body_sha", F.explode("segments").alias("s"))
        .select("doc_id", "body_sha", "s.*")
        .join(shared, "h", "left_semi")
        .groupBy("doc_id", "body_sha")
        .agg(F.collect_list(F.struct("h", "start", "n")).alias("segments"))
    )
    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    joined = with_body_sha(texts.join(kept.select("doc_id").distinct(), "doc_id", "left_semi"))
    candidates = cut(joined.join(kept, ["doc_id", "body_sha"]).dropDuplicates(["doc_id", "body_sha"]), "candidates")
    different = (
        cut_segments(candidates, window, whole=True)
        .groupBy("h", "seg", "body")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    found = searched(different, window, shard_words)
    hits = cut_segments(candidates, window, whole=False).join(found, "seg").filter("low < doc_id")
    spans = hits.groupBy("doc_id", "body_sha").agg(F.collect_list(F.struct((F.col("start") + F.col("at")).alias("start"), "n", "low")).alias("spans"))
    return rows.select("doc_id", "body_sha", "n_words"), candidates.select("doc_id", "body_sha", "text"), spans


def with_body_sha(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("body_sha", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            shas = [hashlib.sha256(b" ".join(words_of(t))).digest() for t in texts.to_pylist()]
            yield batch_of(schema, doc_id=column(batch, "doc_id"), body_sha=shas, text=texts)

    return docs.mapInArrow(run, "doc_id bigint, body_sha binary, text string")


def kept_words(texts: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """``doc_id, body_sha, n_removed, kept_sha`` of the documents that lose words."""
    schema = pa.schema([("doc_id", pa.int64()), ("body_sha", pa.binary()), ("n_removed", pa.int64()), ("kept_sha", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, found in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist(), strict=True):
                words = words_of(text)
                change = np.zeros(len(words) + 1, dtype=np.int64)
                for s in found:
                    change[s["start"]] += 1
                    change[s["start"] + s["n"] + window - 1] -= 1
                keep = np.cumsum(change)[:-1] == 0
                removed.append(int(len(words) - keep.sum()))
                shas.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])).digest())
            yield batch_of(schema, doc_id=column(batch, "doc_id"), body_sha=column(batch, "body_sha"), n_removed=removed, kept_sha=shas)

    return texts.join(spans, ["doc_id", "body_sha"]).mapInArrow(run, "doc_id bigint, body_sha binary, n_removed bigint, kept_sha binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Words left after passages of earlier documents go (operator 1).

    ``doc_id, n_words, n_removed, kept_sha256``, one row per row of ``docs``: each word covered
    by ``window`` consecutive words that also begin in a document with a smaller ``doc_id`` is
    removed; windows are judged on the input. A null text has no words. A null ``doc_id`` is
    neither earlier nor later than any: such a row loses nothing and takes nothing. Rows that
    repeat a ``doc_id`` do not remove each other's words. No documents, no rows. Columns other
    than ``doc_id`` and ``text`` are not read.
    """
    rows, texts, spans = repeated_spans(docs, window, **options)
    lost = kept_words(texts, spans, window)
    return (
        rows.join(lost, ["doc_id", "body_sha"], "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
            F.lower(F.hex(F.coalesce("kept_sha", "body_sha"))).alias("kept_sha256"),
        )
    )
