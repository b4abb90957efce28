"""Benchmark items inside documents, by size-partitioned MinHash (operator 6).

Only DataFrame functions run here. Words are runs of letters and digits, lower-cased; a text
of fewer words than a shingle is one shingle. An item is contained when ``threshold`` of its
different shingles occur in a document; a shingle of fewer words, of a short item, occurs where
these words follow each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.session import cut

SHINGLE, THRESHOLD, HASHES = 5, 0.8, 24
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Item signatures are broadcast up to so many rows (16 bytes each), else joined by shuffle.
BROADCAST_ROWS = 500_000


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, not anew wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def runs(text: Column, k: int) -> Column:
    """All runs of ``k`` words, as text."""

    def of(listed: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(listed) - (k - 1)), lambda i: F.concat_ws(" ", F.slice(listed, i, k)))
        return F.when(F.size(listed) >= k, each).otherwise(F.array().cast("array<string>"))

    return bound(words(text), of)


def shingles(text: Column) -> Column:
    """The word runs of a text, as text."""

    def of(listed: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(listed) - (SHINGLE - 1)), lambda i: F.concat_ws(" ", F.slice(listed, i, SHINGLE)))
        short = F.when(F.size(listed) > 0, F.array(F.concat_ws(" ", listed))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(listed) >= SHINGLE, runs).otherwise(short)

    return bound(words(text), of)


def shingle_hashes(text: Column) -> Column:
    """A 64-bit hash of each word run, from the hashes of its words; a short text's from itself."""

    def of(listed: Column) -> Column:
        runs = bound(
            F.transform(listed, lambda w: F.xxhash64(w)),
            lambda hashed: F.transform(
                F.sequence(F.lit(0), F.size(hashed) - SHINGLE), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(SHINGLE)])
            ),
        )
        short = F.when(F.size(listed) > 0, F.array(F.xxhash64(F.concat_ws(" ", listed)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(listed) >= SHINGLE, runs).otherwise(short)

    return bound(words(text), of)


def mask(i: int) -> int:
    """The ``i``-th mask; ``hash xor mask`` puts the hashes into another order."""
    value = (i + 1) * 0x9E3779B97F4A7C15 * 0xBF58476D1CE4E5B9 % (1 << 64)
    value = (value ^ value >> 29) % (1 << 64)
    return value - (1 << 64) if value >> 63 else value


def signature() -> list[Column]:
    return [F.min(F.col("h").bitwiseXOR(F.lit(mask(i)))).alias(f"m{i}") for i in range(HASHES)]


def entries() -> Column:
    """``i, v``: the rows of a signature, least hashes with the mask taken off again."""
    return F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"m{i}").bitwiseXOR(F.lit(mask(i))).alias("v")) for i in range(HASHES)]))


def item_shingles(items: DataFrame) -> DataFrame:
    """``item_id, shingle, n``: the different shingles of each item and their number."""
    every = items.filter(F.col("item_id").isNotNull()).select("item_id", F.explode(shingles(F.col("text"))).alias("shingle")).distinct()
    return every.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))


def joined_small(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Items that documents contain (operator 6): ``item_id, doc_id, n_shingles, n_found, containment``.

    Items are parted by size into classes [B, 2B) of different shingles, B a power of two. Per
    class a document is cut into blocks of B shingles, so that wherever an item stands some
    block is of its size and has a good part of it; MinHash signatures of blocks and items
    that agree anywhere make a candidate. Only documents that have some least shingle of an
    item can agree with it, so the others are put aside first. Candidates are verified by
    the exact shingles of the whole document.

    Rows with a null ``doc_id`` or ``item_id`` are left out, null and empty texts contain
    nothing and are in nothing, rows that repeat an id are taken together; empty tables give
    no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    known = cut(item_shingles(items), "item-shingles")
    sizes = known.select("item_id", F.floor(F.log2("n") + F.lit(1e-9)).alias("size_class")).distinct()
    hashes = items.filter(F.col("item_id").isNotNull()).select("item_id", F.explode(shingle_hashes(F.col("text"))).alias("h"))
    signed = hashes.groupBy("item_id").agg(*signature()).join(sizes, "item_id")
    item_rows = cut(signed.select("item_id", "size_class", entries()), "item-signatures")
    n_rows = item_rows.count()
    classes = [int(r[0]) for r in item_rows.select("size_class").distinct().collect()]  # one per power of two

    # word counts of shingles below SHINGLE words: four values at most
    lengths = sorted(int(r[0]) for r in known.select(F.size(F.split("shingle", " ")).alias("k")).filter(f"k < {SHINGLE}").distinct().collect())

    def with_runs(full: DataFrame, held: DataFrame, run: Callable[[Column], Column]) -> DataFrame:
        """``full`` and the rows of ``held`` that ``run`` makes of the short word runs asked for."""
        for k in lengths:
            full = full.unionByName(held.select("doc_id", run(runs(F.col("text"), k))))
        return full

    def hashed(listed: Column) -> Column:
        return F.transform(listed, lambda x: F.xxhash64(x))

    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    spread = with_runs(texts.select("doc_id", F.explode(shingle_hashes(F.col("text"))).alias("h")), texts, lambda x: F.explode(hashed(x)).alias("h"))
    least = joined_small(item_rows.select(F.col("v").alias("h")).distinct(), n_rows)
    touched = cut(spread.join(least, "h", "left_semi").select("doc_id").distinct(), "touched")
    held = cut(texts.join(touched, "doc_id", "left_semi"), "touched-texts")

    placed = held.select("doc_id", F.posexplode(shingle_hashes(F.col("text"))).alias("pos", "h"))
    placed = with_runs(placed, held, lambda x: F.posexplode(hashed(x)).alias("pos", "h"))
    candidates = None
    for c in sorted(classes):
        blocks = placed.groupBy("doc_id", F.floor(F.col("pos") / (1 << c)).alias("block")).agg(*signature())
        rows = blocks.select("doc_id", entries())
        mine = joined_small(item_rows.filter(F.col("size_class") == c).select("item_id", "i", "v"), n_rows)
        found = rows.join(mine, ["i", "v"]).select("doc_id", "item_id").distinct()
        candidates = found if candidates is None else candidates.unionByName(found)
    if candidates is None:
        candidates = spark.createDataFrame([], "doc_id bigint, item_id bigint")
    candidates = cut(candidates, "candidates")

    wanted = candidates.join(known, "item_id")
    chosen = held.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    there = with_runs(chosen.select("doc_id", F.explode(shingles(F.col("text"))).alias("shingle")), chosen, lambda x: F.explode(x).alias("shingle")).distinct()
    counted = wanted.join(there, ["doc_id", "shingle"]).groupBy("doc_id", "item_id").agg(F.first("n").alias("n_shingles"), F.count("*").alias("n_found"))
    share = F.col("n_found") / F.col("n_shingles")
    return counted.filter(F.col("n_found") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9))).select(
        "item_id", "doc_id", "n_shingles", "n_found", F.round(share, 6).alias("containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns.

    Rows with a null ``doc_id`` stay.
    """
    found = contained_items(docs, items, threshold).select(F.col("doc_id").alias("__found_id")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__found_id"), "left_anti")
