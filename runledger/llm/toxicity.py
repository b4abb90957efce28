"""Toxicity by class-conditional Kneser-Ney models of the letters of words (operator 12)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import batch_of, chunks, column, on_worker, per_process, shared_uri, small_batches, strings, to_workers
from runledger.session import cut

#: Bytes of a gram, the last of which is foretold; up to ``SHARED`` bytes both classes share their counts.
ORDER, SHARED, DISCOUNT = 5, 2, 0.75
#: Bytes at the start and the end of a word.
OPEN, CLOSE = 2, 3
#: Entries of the model that a worker holds at a time (about 16 bytes each), and words whose ratio it remembers.
PART_ENTRIES, CACHED_WORDS = 4_000_000, 300_000
#: One in so many training rows is kept from the counts and calibrates the score, about so many at most.
FOLD, CALIBRATION_ROWS = 8, 20_000
CUTOFF = 0.3
#: Weight of the slope's square in the calibration, which keeps it finite on parted classes.
RIDGE = 1e-3

NOT_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
SCORED = "doc_id bigint, held_out boolean, score double, predicted int"


def words_of(text: str) -> list[bytes]:
    """Lower-case runs of letters; bytes beyond ASCII count as letters."""
    return text.lower().encode().translate(NOT_LETTERS).split()


def events(words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Gram and word index of every byte foretold: each byte of a word, and its end.

    A gram is the byte with up to ``ORDER - 1`` bytes before it in the word, packed into a
    number, the byte foretold lowest. No byte is zero, so a number tells its length.
    """
    words = list(words)
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = bytes([CLOSE, OPEN])
    body = np.frombuffer(bytes([OPEN]) + edge.join(words) + bytes([CLOSE]), dtype=np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(body)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams = body.copy()
    for k in range(1, ORDER):
        grams[k:] |= np.where(place[k:] >= k, body[:-k] << (8 * k), 0)
    told = place > 0
    return grams[told], owner[told]


def held_out(docs: DataFrame) -> DataFrame:
    """``doc_id, text, held_out, fold``; a null id is not held out, and is in no fold as it has no label."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    return docs.select("doc_id", "text", F.coalesce(crc % 4 == 2, F.lit(False)).alias("held_out"), F.floor(crc / 4).cast("bigint").alias("fold"))


def labelled(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of training rows; of several labels of a document the highest counts.

    Both sides are sorted and merged whatever the size of ``labels``, which grows with the
    documents: sent to every task while small, it would give way to another plan later.
    """
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic is not null")
    return marked.filter("not held_out").join(marks.hint("merge"), "doc_id").select("text", "toxic")


def gram_counts(training: DataFrame) -> DataFrame:
    """``gram, n0, n1``: how often each gram ends in the byte foretold, by class, over all rows."""
    schema = pa.schema([("gram", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = strings(batch), column(batch, "toxic").to_pylist()
            for a, b in chunks(texts):
                seen: dict[bytes, list[int]] = {}
                for text, label in zip(texts[a:b], toxic[a:b], strict=True):
                    for word in words_of(text):
                        seen.setdefault(word, [0, 0])[label > 0] += 1
                grams, owner = events(seen)
                values, inverse = np.unique(grams, return_inverse=True)
                of = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 2)[owner]
                sums = [np.bincount(inverse, weights=of[:, c], minlength=len(values)).astype(np.int64) for c in (0, 1)]
                yield batch_of(schema, gram=values, n0=sums[0], n1=sums[1])

    counted = small_batches(training).mapInArrow(count, "gram bigint, n0 bigint, n1 bigint")
    return counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def entries_of(counts: DataFrame) -> DataFrame:
    """``kind, code, value, byte`` of the model; ``byte`` is the last one of the context.

    Adjusted counts as Kneser and Ney have them: grams of full length, and those that start a
    word, count occurrences; shorter ones count the different bytes before them. Up to
    ``SHARED`` bytes the counts of both classes are added, so what either class has hardly
    seen falls back on the same numbers. Interpolated probabilities follow from the short
    grams up, one join a length. Kind 0 holds the log ratio toxic to ordinary of a gram,
    kind 1 the log ratio of the mass that a context leaves to shorter ones.
    """
    counts = cut(counts, "gram-counts")
    full = {ORDER: counts.filter(F.col("gram") >= 256 ** (ORDER - 1))}
    for k in range(ORDER - 1, 0, -1):
        some = [F.sum((F.col(f"n{c}") > 0).cast("bigint")).alias(f"n{c}") for c in (0, 1)]
        left = full[k + 1].groupBy((F.col("gram") % 256**k).alias("gram")).agg(*some)
        first = counts.filter((F.col("gram") >= 256 ** (k - 1)) & (F.col("gram") < 256**k))
        full[k] = cut(left.unionByName(first), "grams") if k > 1 else left.unionByName(first)
    found: list[DataFrame] = []
    shorter: DataFrame | None = None
    for k in range(1, ORDER + 1):
        grams = full[k].withColumn("context", F.shiftright("gram", 8))
        if k <= SHARED:
            grams = grams.withColumn("n0", F.col("n0") + F.col("n1")).withColumn("n1", F.col("n0"))
        sums = [F.sum(f"n{c}").alias(f"all{c}") for c in (0, 1)] + [F.sum((F.col(f"n{c}") > 0).cast("bigint")).alias(f"kinds{c}") for c in (0, 1)]
        contexts = grams.groupBy("context").agg(*sums)
        left_over = {c: F.when(F.col(f"all{c}") > 0, DISCOUNT * F.col(f"kinds{c}") / F.col(f"all{c}")).otherwise(1.0) for c in (0, 1)}
        joined = grams.join(contexts, "context")
        if shorter is None:
            joined = joined.withColumn("p0", F.lit(1 / 256)).withColumn("p1", F.lit(1 / 256))
        else:
            joined = joined.join(shorter.withColumnRenamed("gram", "ending"), F.col("gram") % 256 ** (k - 1) == F.col("ending"))
        chance = {
            c: F.when(F.col(f"all{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"all{c}")).otherwise(0.0) + left_over[c] * F.col(f"p{c}")
            for c in (0, 1)
        }
        shorter = cut(joined.select("gram", chance[0].alias("p0"), chance[1].alias("p1")), "gram-chances")
        byte = F.shiftright("gram", 8).bitwiseAND(F.lit(255)) if k > 1 else F.lit(-1).cast("bigint")
        found.append(shorter.select(F.lit(0).alias("kind"), F.col("gram").alias("code"), F.log(F.col("p1") / F.col("p0")).alias("value"), byte.alias("byte")))
        last = F.col("context").bitwiseAND(F.lit(255)) if k > 1 else F.lit(-1).cast("bigint")
        found.append(contexts.select(F.lit(1).alias("kind"), F.col("context").alias("code"), F.log(left_over[1] / left_over[0]).alias("value"), last.alias("byte")))
    entries = found[0]
    for more in found[1:]:
        entries = entries.unionByName(more)
    return entries


class Model:
    """Where the model's files are, how many parts it has, and the calibration of its score.

    An event is looked up in the part of its context's last byte, so a worker never needs
    more than one part at a time, however large the model.
    """

    def __init__(self, name: str, parts: int, line: tuple[float, float] = (1.0, 0.0), always: float | None = None):
        self.name, self.parts, self.line, self.always = name, parts, line, always

    def _part(self, number: int) -> tuple[np.ndarray, ...]:
        """Sorted codes and values of grams and of contexts; the part used last stays loaded."""
        held = per_process("toxicity parts")
        if held.get("name") != (self.name, number):
            held.clear()
            table = pq.read_table(f"{on_worker(self.name)}/part={number}", columns=["kind", "code", "value"], partitioning=None)
            kind, code, value = (table.column(n).to_numpy() for n in ("kind", "code", "value"))
            order = np.lexsort((code, kind))
            kind, code, value = kind[order], code[order], value[order]
            cut_at = int(np.searchsorted(kind, 1))
            held |= {"name": (self.name, number), "part": (code[:cut_at], value[:cut_at], code[cut_at:], value[cut_at:])}
        return held["part"]

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """Log ratio toxic to ordinary of the likelihood of each word."""
        grams, owner = events(words)
        value = np.zeros(len(grams))
        part_of = ((grams >> 8) & 255) % self.parts
        for number in np.unique(part_of).tolist():
            known, known_value, contexts, context_value = self._part(number)
            at = np.flatnonzero(part_of == number)
            code = grams[at]
            while len(at):
                place = np.minimum(np.searchsorted(known, code), len(known) - 1)
                found = known[place] == code
                value[at[found]] += known_value[place[found]]
                at, code = at[~found], code[~found]
                context = code >> 8
                place = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                value[at] += np.where(contexts[place] == context, context_value[place], 0)
                more = context > 0
                at, code = at[more], code[more]
                top = np.int64(1) << (8 * np.searchsorted(256 ** np.arange(1, ORDER, dtype=np.int64), code, side="right"))
                code = code % top
        return np.bincount(owner, weights=value, minlength=len(words))

    def evidence(self, texts: list[str], known: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log ratio and number of words of each text; ``known`` remembers words."""
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for a, b in chunks(texts):
            lists = [words_of(t) for t in texts[a:b]]
            if len(known) > CACHED_WORDS:
                known.clear()
            fresh = list(set().union(*lists).difference(known))
            known.update(zip(fresh, self.ratios(fresh).tolist(), strict=True))
            sums[a:b] = [math.fsum(map(known.__getitem__, w)) for w in lists]
            counts[a:b] = [len(w) for w in lists]
        return sums, counts


def normalised(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log ratio over the root of the length, by which the chance part of a sum grows."""
    return sums / np.sqrt(np.maximum(counts, 1))


def fit_line(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic line by Newton's method."""
    spread = float(x.std()) or 1.0
    z, middle = (x - x.mean()) / spread, float(x.mean())
    slope = offset = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([np.mean((p - toxic) * z) + RIDGE * slope, np.mean(p - toxic)])
        bend = np.array([[np.mean(w * z * z) + RIDGE, np.mean(w * z)], [np.mean(w * z), np.mean(w) + 1e-9]])
        step = np.linalg.solve(bend, gradient)
        size = max(1.0, float(np.abs(step).max()))
        slope, offset = slope - step[0] / size, offset - step[1] / size
        if np.abs(step).max() < 1e-9:
            break
    return slope / spread, offset - slope * middle / spread


def train(marked: DataFrame, labels: DataFrame) -> Model:
    """Counts from all labelled training rows but one fold, the calibration from that fold.

    ``marked`` is ``held_out`` of the documents. Without words of both classes a model knows
    nothing: every score is the share of toxic rows (0 without rows). Without both classes
    in the calibration fold, the score is the plain logistic of the log ratio and that share.
    """
    spark = marked.sparkSession
    counted = F.col("fold") % FOLD != 0
    of_class = labelled(marked.select("doc_id", F.lit(None).cast("string").alias("text"), "held_out", "fold"), labels).groupBy("toxic").count().collect()
    rows = {c: sum(r["count"] for r in of_class if (r["toxic"] > 0) == c) for c in (False, True)}
    share = rows[True] / max(1, sum(rows.values()))
    counts = cut(gram_counts(labelled(marked.filter(counted), labels)), "gram-counts")
    some = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not some["n0"] or not some["n1"]:
        return Model("", 1, always=share)
    entries = cut(entries_of(counts), "gram-entries")
    parts = min(256, -(-entries.count() // PART_ENTRIES))
    every = F.array(*[F.lit(p) for p in range(parts)])
    placed = entries.withColumn("part", F.explode(F.when(F.col("byte") < 0, every).otherwise(F.array((F.col("byte") % parts).cast("int")))))
    uri = shared_uri(spark, "toxicity-model")
    placed.select("part", "kind", "code", "value").repartition(parts, "part").write.partitionBy("part").parquet(uri)
    model = Model(to_workers(spark, uri), parts)
    fold = labelled(marked.filter(~counted), labels)
    rate = min(1.0, CALIBRATION_ROWS * FOLD / max(1, sum(rows.values())))
    chosen = fold.filter(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1_000_000)) < rate * 1_000_000)
    sample = evidence(chosen.select("toxic", "text"), model).select("toxic", "sum", "words").toArrow()
    x = normalised(sample.column("sum").to_numpy(), sample.column("words").to_numpy())
    toxic = (sample.column("toxic").to_numpy() > 0).astype(float)
    if 0 < toxic.sum() < len(toxic):
        model.line = fit_line(x, toxic)
    else:
        model.line = (1.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return model


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``sum`` and ``words``; only ``text`` is looked at."""
    schema = T.StructType([*docs.schema.fields, T.StructField("sum", T.DoubleType()), T.StructField("words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            sums, counts = model.evidence(strings(batch), known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(counts)], names=schema.names)

    return small_batches(docs).mapInArrow(run, schema)


def score(marked: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            if model.always is None:
                x = normalised(*model.evidence(strings(batch), known))
                scores = 1 / (1 + np.exp(-np.clip(model.line[0] * x + model.line[1], -700, 700)))
            else:
                scores = np.full(batch.num_rows, model.always)
            yield batch_of(schema, doc_id=column(batch, "doc_id"), held_out=column(batch, "held_out"), score=scores, predicted=(scores >= CUTOFF).astype(np.int32))

    return small_batches(marked.select("doc_id", "held_out", "text")).mapInArrow(run, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of all documents (operator 12): ``doc_id, held_out, score, predicted``.

    Learned from ``labels.toxic`` of rows that are not held out. A null or empty text scores
    like a text without evidence; a null ``doc_id`` is scored, never learned from; repeated
    rows give a row each; labels that are null or of no document are not used; columns other
    than ``doc_id``, ``text`` and ``toxic`` are not read. No documents, no rows.
    """
    marked = held_out(docs)
    return score(marked, train(marked, labels.select("doc_id", "toxic")))
