"""Language identification by bit-sliced Bloom filters of byte n-grams (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import batch_of, column, small_batches

GRAM, SLOT_BITS, HASHES = 4, 20, 2
#: Odd multipliers of the hash functions.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Texts learned from per language (expected number; those with the smallest hashes of their id).
TRAIN_DOCS = 4_000
#: A gram counts for a language if seen there so often, at this share at least of its best frequency.
#: With few grams in all, once in ``SIGHTING`` of them suffices, so one short text is learned from too.
LEAST_SEEN, SIGHTING, SHARE = 3, 10_000, 0.5
UNDECIDED = "und"

NOT_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams_of(text: str | None) -> np.ndarray:
    """All 4-grams of the UTF-8 bytes of a whole text, in lower case.

    ASCII characters other than letters become spaces, runs of spaces one, and a space is
    put on either side, so a lone letter still has a gram (padded with spaces).
    """
    words = (text or "").lower().encode().translate(NOT_LETTERS).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    body = np.frombuffer(b" " + b" ".join(words).ljust(GRAM - 2) + b" ", dtype=np.uint8).astype(np.uint64)
    n = len(body) - GRAM + 1
    grams = body[:n].copy()
    for k in range(1, GRAM):
        grams |= body[k : n + k] << np.uint64(8 * k)
    return grams


def slots_of(grams: np.ndarray, which: int) -> np.ndarray:
    return (grams * np.uint64(MULTIPLIERS[which])) >> np.uint64(64 - SLOT_BITS)


@dataclass
class Model:
    """``slices[w, slot]`` holds bit ``l % 64`` of language ``l = 64 w + ...`` for each slot."""

    langs: list[str]
    slices: np.ndarray
    false_rate: np.ndarray

    def parts(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Plain values for a broadcast, which workers without this package can read."""
        return self.langs, self.slices, self.false_rate

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score. ``und`` and 0 without a letter, or if nothing was learned.

        Each gram's mask names all languages that contain it. A language's share of grams is
        corrected for its filter's false positives; the largest wins (of equals, the first
        by name) and its part of all shares is the score. If no gram is known, the first
        language by name is given with score 0.
        """
        if not self.langs or not has_letter(text):
            return UNDECIDED, 0.0
        grams = grams_of(text)
        if not len(grams):  # letters only beyond what the grams keep cannot occur; be safe
            return self.langs[0], 0.0
        counts = np.zeros(len(self.langs))
        slots = [slots_of(grams, h) for h in range(HASHES)]
        for w, table in enumerate(self.slices):
            mask = table[slots[0]]
            for s in slots[1:]:
                mask = mask & table[s]
            here = min(64, len(self.langs) - 64 * w)
            if here <= 8:
                seen = np.bincount(mask.astype(np.uint8), minlength=256)
                for bit in range(here):
                    counts[64 * w + bit] = seen[(np.arange(256) >> bit) & 1 == 1].sum()
            else:
                for bit in range(here):
                    counts[64 * w + bit] = np.count_nonzero((mask >> np.uint64(bit)) & np.uint64(1))
        shares = np.clip((counts / len(grams) - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(np.argmax(shares))
        return self.langs[best], float(shares[best] / shares.sum()) if shares[best] > 0 else 0.0


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: crc32 of the id as text leaves 2 when divided by 4."""
    return docs.select("*", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from ``text`` and non-null ``lang`` of the rows given.

    About ``train_docs`` whole texts per language are read, chosen by a hash of ``doc_id``.
    Counting and the filters' slots are Spark aggregates; the driver gets one row per
    language and one per slot (``2**SLOT_BITS`` at most).
    """
    labelled = small_batches(docs).filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    found = {r["lang"]: r["n"] for r in sizes.collect()}
    langs = sorted(found)
    if not langs:
        return Model([], np.zeros((0, 1 << SLOT_BITS), dtype=np.uint64), np.zeros(0))
    spark = docs.sparkSession
    rates = spark.createDataFrame(
        [(name, i, min(1_000_000, 1_000_000 * train_docs // found[name])) for i, name in enumerate(langs)], "lang string, l int, rate int"
    )
    chosen = labelled.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(7)), F.lit(1_000_000)) < F.col("rate"))
    schema = pa.schema([("l", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array(column(batch, "l").to_pylist(), dtype=np.int64)
            texts = column(batch, "text").to_pylist()
            for lang in np.unique(of).tolist():
                grams = np.concatenate([grams_of(texts[i]) for i in np.flatnonzero(of == lang)])
                values, counts = np.unique(grams, return_counts=True)
                yield batch_of(schema, l=np.full(len(values), lang, dtype=np.int32), gram=values.astype(np.int64), n=counts)

    grams = chosen.select("l", "text").mapInArrow(counted, "l int, gram bigint, n bigint").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("l").agg(F.sum("n").alias("total"))
    shares = grams.join(F.broadcast(totals), "l").select("l", "gram", "n", "total", (F.col("n") / F.col("total")).alias("p"))
    best = shares.groupBy("gram").agg(F.max("p").alias("best"))
    enough = F.least(F.lit(LEAST_SEEN), F.ceil(F.col("total") / SIGHTING))
    kept = shares.join(best, "gram").filter((F.col("n") >= enough) & (F.col("p") >= SHARE * F.col("best"))).select("l", "gram")
    put = pa.schema([("w", pa.int32()), ("slot", pa.int64()), ("mask", pa.int64())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = column(batch, "l").to_numpy().astype(np.uint64)
            values = column(batch, "gram").to_numpy().astype(np.uint64)
            for h in range(HASHES):
                yield batch_of(
                    put,
                    w=(of >> np.uint64(6)).astype(np.int32),
                    slot=slots_of(values, h).astype(np.int64),
                    mask=(np.uint64(1) << (of & np.uint64(63))).view(np.int64),
                )

    rows = kept.mapInArrow(placed, "w int, slot bigint, mask bigint").groupBy("w", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    slices = np.zeros((-(-len(langs) // 64), 1 << SLOT_BITS), dtype=np.uint64)
    w, slot, mask = (rows.column(n).to_numpy() for n in ("w", "slot", "mask"))
    slices[w, slot] = mask.astype(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero((slices[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)) for i in range(len(langs))]) / (1 << SLOT_BITS)
    return Model(langs, slices, fill**HASHES)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())  # 8 MB per 64 languages
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = Model(*shared.value)
        for batch in batches:
            found = [chosen.predict(t) for t in column(batch, "text").to_pylist()]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return small_batches(docs).mapInArrow(run, schema)


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Languages of all documents (operator 7): ``doc_id, held_out, lang_pred, score``.

    The model learns from rows that are not held out. A null ``lang`` is not learned from,
    a null or letterless text is ``und``, a null ``doc_id`` is neither held out nor lost;
    repeated rows give a row each; no documents, no rows.
    """
    marked = held_out(docs.select("doc_id", "text", "lang")).withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    model = train(marked.filter(~F.col("held_out")), train_docs)
    return predict(marked.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def drop_unidentified(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns; ``und`` rows go.

    If no language was learned, as no row outside the held-out quarter has a ``lang``, nothing
    is known against a text with letters: only null and letterless texts go.
    """
    model = train(held_out(docs.select("doc_id", "text", "lang")).filter("not coalesce(held_out, false)"), train_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = Model(*shared.value)
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            known = [chosen.predict(t)[0] != UNDECIDED if chosen.langs else has_letter(t) for t in texts]
            yield batch.filter(pa.array(known, pa.bool_()))

    return small_batches(docs).mapInArrow(keep, docs.schema)
