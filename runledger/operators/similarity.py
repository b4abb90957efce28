"""Exact similarity joins on token sets, and what is decided with them.

Rows with equal token sets are one *class* and are compared once, however many copies
there are. Different classes meet in cells of blocks (``cells``), or, where only high
similarities count, by equal *parts* of their sets: tokens are dealt to more parts than two
similar sets have different tokens, so a pair at or above the threshold always has a part in
common, and others hardly ever. Families of near copies are thinned by leaders first: classes
meet the first of those that share a part. Signatures of whole sets bound the overlap a met
pair can have, so most pairs below the threshold end before any set is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.functions import text as tx
from runledger.operators.cells import near_pairs
from runledger.operators.ordered import Ordered
from runledger.session import cut

PAIRS_PER_POSTING = 4
MAX_LEADER_ROUNDS = 12
#: Postings of a token that two sides of one join task hold; more are dealt to a grid of blocks.
GRID_POSTINGS = 2_000
#: 64-bit words of a set's signature.
SIGNATURE_WORDS = 16
#: Slots whose use is counted to order tokens, a power of two up to 2^16, and sets coded at once.
SLOTS, CODED_SETS = 1 << 16, 1 << 14
#: One part more for so many parts: a set's weakest parts are left out. Sets parted at once.
PARTS_PER_SPARE, PARTED_SETS = 4, 1 << 11
#: What pairs are judged by before their sets.
FIELDS = ["pos", "n", *[f"sig{w}" for w in range(SIGNATURE_WORDS)]]


def positioned(rows: DataFrame, order: list[Column], texts: bool = True) -> DataFrame:
    """Rows (job_id, task_id, output, ...) with tokens, set key and a global position.

    The range-partitioned sort gives every partition a contiguous slice, so increasing
    ids follow the order; writing the table fixes them. Tokens are made after the sort:
    less is shuffled, and the work is spread however few files the input had. Without
    ``texts`` the outputs are not written again.
    """
    placed = rows.orderBy(*order).withColumn("pos", F.monotonically_increasing_id())
    keyed = placed.withColumn("tokens", tx.token_set(F.col("output")))
    keyed = keyed.withColumn("set_key", F.md5(F.array_join("tokens", " ")))
    return cut(keyed if texts else keyed.drop("output"), "positioned")


def classes(rows: DataFrame) -> DataFrame:
    """One row per job and distinct token set. ``pos``, its first position, is its id.

    Keys are grouped without the sets; later rows of a class then leave the table, which
    moves no sets as long as they are few.
    """
    grouped = rows.groupBy("job_id", "set_key").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("copies"))
    grouped = cut(grouped.select("pos", "copies"), "grouped")
    later = cut(rows.select("pos").join(grouped, "pos", "left_anti"), "later")
    first = rows.select("job_id", "set_key", "pos", "tokens").join(later, "pos", "left_anti")
    copied = first.join(cut(grouped.filter("copies > 1"), "copied"), "pos", "left")
    return cut(copied.withColumn("copies", F.coalesce("copies", F.lit(1))), "classes")


def _slot_places(sets: DataFrame) -> np.ndarray:
    """Place of every slot, least used first; a token's slot is the end of its hash."""
    used = sets.select(F.explode("tokens").alias("tok")).groupBy(F.pmod(F.hash("tok"), F.lit(SLOTS)).alias("slot"))
    counts = np.zeros(SLOTS, dtype=np.int64)
    for slot, n in used.agg(F.count(F.lit(1))).collect():
        counts[slot] = n
    places = np.empty(SLOTS, dtype=np.int64)
    places[np.argsort(counts, kind="stable")] = np.arange(SLOTS)
    return places


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All members of a column of lists without nulls, and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def encode(sets: DataFrame) -> DataFrame:
    """(job_id, pos, ids): each class's tokens as different numbers, rare ones first.

    A number is the token's hash behind the place of its slot, so all sets hold their
    tokens in one order, which follows their frequency over all classes. Two words of one
    hash look the same: two sets never share fewer numbers than words, and the words decide
    in the end. Empty sets and null jobs are like nothing else and drop out.
    """
    hashes = F.transform("tokens", lambda w: F.hash(w)).alias("hashes")
    held = sets.filter((F.size("tokens") > 0) & F.col("job_id").isNotNull())
    places = _slot_places(held)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CODED_SETS):
                batch = whole.slice(at, CODED_SETS)
                codes, sizes = _lists(batch["hashes"])
                row = np.repeat(np.arange(len(sizes)), sizes)
                ids = np.sort((row << 48) | (places[codes & (SLOTS - 1)] << 32) | (codes.astype(np.int64) & 0xFFFFFFFF))
                new = np.concatenate([[True], ids[1:] != ids[:-1]])
                ids &= (1 << 48) - 1
                if not new.all():  # the second word of one hash in a set, and so on
                    ids |= (np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]) << 48
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch["job_id"], batch["pos"], lists], ["job_id", "pos", "ids"])

    job = sets.schema["job_id"].dataType.simpleString()
    return held.select("job_id", "pos", hashes).mapInArrow(coded, f"job_id {job}, pos bigint, ids array<bigint>")


def _signatures(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits that tell sets apart: each token flips one of ``64 * SIGNATURE_WORDS`` bits.

    Two sets differ in at least as many tokens as their signatures in bits.
    """
    bits = 64 * SIGNATURE_WORDS
    place = np.repeat(np.arange(len(sizes)) * bits, sizes) + (ids >> 16) % bits
    odd = np.bincount(place, minlength=len(sizes) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), SIGNATURE_WORDS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _size_classes(largest: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Least size of each size class, and the most tokens in which similar sets in it differ.

    A class ends at its least size over the threshold, so similar sets are of one class or
    of two that follow each other. Sets of ``m`` and ``n`` tokens differ in
    ``(m + n) * (1 - threshold) / (1 + threshold)`` tokens at most.
    """
    lows = [1]
    while lows[-1] <= largest or len(lows) < 3:
        lows.append(int(lows[-1] / threshold + 1e-9) + 1)
    lows.append(int(lows[-1] / threshold + 1e-9) + 1)
    least = np.array(lows, dtype=np.int64)
    return least[:-1], np.floor(2 * (least[1:] - 1) * (1 - threshold) / (1 + threshold) + 1e-9).astype(np.int64)


def _part_keys(ids: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, level: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of the parts that each set posts as one of its size class ``level``.

    Of ``d + 1 + e`` parts, two sets that differ in ``d`` tokens have ``e + 1`` in common.
    Both leave out their ``e`` weakest parts in one order, which follows from what a part
    holds: of the parts in common these are the first ones of that order, so one stays. Weak are
    parts of few and frequent tokens, which unlike sets may share.
    """
    due = most[level] + 1
    dealt = due + due // PARTS_PER_SPARE
    base = np.cumsum(dealt) - dealt
    place = (ids >> 32) & (SLOTS - 1)
    at = np.repeat(base, sizes) + place % np.repeat(dealt, sizes)
    held = np.zeros(int(dealt.sum()), dtype=np.uint64)
    np.add.at(held, at, _mixed(ids))
    strength = np.bincount(at, weights=np.floor(16 * np.log2(SLOTS + 1 - place)), minlength=len(held)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), dealt)
    part = np.arange(len(held)) - base[row]
    strongest = np.lexsort((held, -strength, row))
    kept = strongest[part < due[row]]  # rows keep their places in this order
    row, part = row[kept], part[kept]
    tag = seeds[row] + _mixed((level[row] << 32) | part)
    return row, _mixed(held[kept] + tag).view(np.int64)


def _parted(coded: DataFrame, threshold: float) -> DataFrame:
    """(pos, toks): each class with the keys of its parts, as a member of its own size class
    and of the next, whose sets may be similar to it."""

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARTED_SETS):
                batch = whole.slice(at, PARTED_SETS)
                ids, sizes = _lists(batch["ids"])
                seeds = batch["seed"].to_numpy().view(np.uint64)
                least, most = _size_classes(int(sizes.max()), threshold)
                own = np.searchsorted(least, sizes, side="right") - 1
                posted = [_part_keys(ids, sizes, seeds, own + up, most) for up in (0, 1)]
                row, key = (np.concatenate(x) for x in zip(*posted))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
                toks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[np.argsort(row, kind="stable")]))
                yield pa.RecordBatch.from_arrays([batch["pos"], toks], ["pos", "toks"])

    seeded = coded.select("pos", "ids", F.xxhash64("job_id").alias("seed"))
    return seeded.mapInArrow(parted, "pos bigint, toks array<bigint>")


def _signed(coded: DataFrame) -> DataFrame:
    """(job_id, pos, n, sig...): size and signature of each class, by the hashes in its ``ids``."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARTED_SETS):
                batch = whole.slice(at, PARTED_SETS)
                ids, sizes = _lists(batch["ids"])
                signatures = _signatures(ids, sizes)
                columns = [batch["job_id"], batch["pos"], pa.array(sizes.astype(np.int32))]
                columns += [pa.array(np.ascontiguousarray(signatures[:, w])) for w in range(SIGNATURE_WORDS)]
                yield pa.RecordBatch.from_arrays(columns, ["job_id", *FIELDS])

    job = coded.schema["job_id"].dataType.simpleString()
    return coded.select("job_id", "pos", "ids").mapInArrow(signed, f"job_id {job}, pos bigint, n int, " + ", ".join(f"{c} bigint" for c in FIELDS[2:]))


def postings(coded: DataFrame, threshold: float) -> DataFrame:
    """(pos, tok, job_id, n, sig...): a row for each part of a class, ``tok`` being its key.

    Two classes of a job at or above the threshold share a key.
    """
    return _parted(coded, threshold).select("pos", F.explode("toks").alias("tok")).join(_signed(coded), "pos")


def _shared(parted: DataFrame) -> DataFrame:
    """(tok, pos): the keys of each class that another class has too, a small part of all."""
    keys = parted.select(F.explode("toks").alias("tok"), "pos")
    return keys.withColumn("f", F.count(F.lit(1)).over(W.partitionBy("tok"))).filter("f > 1").drop("f")


def _verify(pairs: DataFrame, coded: DataFrame, keep: Column) -> DataFrame:
    """Pairs (a, b) of class ids whose true similarity passes."""
    left = coded.select(F.col("pos").alias("a"), F.col("ids").alias("a_ids"), "job_id")
    right = coded.select(F.col("pos").alias("b"), F.col("ids").alias("b_ids"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("similarity", tx.jaccard(F.col("a_ids"), F.col("b_ids")))
        .drop("a_ids", "b_ids")
        .filter(keep)
    )


def _alike(pairs: DataFrame, words: DataFrame, keep: Column) -> DataFrame:
    """As ``_verify`` for few pairs: sets in none of them stay where they are."""
    pairs = cut(pairs, "candidates")
    named = cut(pairs.select(F.explode(F.array("a", "b")).alias("pos")).distinct(), "named")
    return _verify(pairs, words.join(named, "pos", "left_semi"), keep)


def _gridded(post: DataFrame, load: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of postings with themselves, with the cell ``x, y`` they meet in.

    A token with more than ``GRID_POSTINGS`` postings (its number ``f`` is in ``load``) has
    its postings dealt to blocks by a hash. The left side goes to the cells of its own row, the right side to those of its
    own column, on or above the diagonal, so every two postings meet in one cell.
    """
    blocks = F.coalesce(F.ceil(F.col("f") / GRID_POSTINGS), F.lit(1)).cast("int")
    dealt = post.join(load, "tok", "left").withColumn("blocks", blocks)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int")).drop("f")
    left = dealt.withColumn("x", F.col("own")).withColumn("y", F.explode(F.sequence("own", F.col("blocks") - 1)))
    right = dealt.withColumn("y", F.col("own")).withColumn("x", F.explode(F.sequence(F.lit(0), "own")))
    return left.drop("own", "blocks"), right.drop("own", "blocks")


def _allowed(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of a job that lengths and signatures allow.

    Sets of ``m`` and ``n`` tokens need ``(m + n) * threshold / (1 + threshold)`` in common.
    """
    need = (F.col("a_n") + F.col("b_n")) * (threshold / (1 + threshold)) - 1e-9
    apart = sum((F.bit_count(F.col(f"a_sig{w}").bitwiseXOR(F.col(f"b_sig{w}"))) for w in range(SIGNATURE_WORDS)), F.lit(0))
    may = (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * threshold - 1e-9) & (F.col("a_n") + F.col("b_n") - apart >= 2 * need)
    for end in ("b", "a"):
        side = marks.select(F.col("pos").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("job_id", *FIELDS[1:])])
        pairs = pairs.join(side, end)
    return pairs.filter((F.col("a_job_id") == F.col("b_job_id")) & may).select("a", "b")


def _candidates(post: DataFrame, threshold: float, marks: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) that share a key and whose overlap may suffice, by lengths and signatures.

    ``marks`` holds these once for each class, if postings (tok, pos) do not.
    """
    if marks is None:
        marks = post.select("job_id", *FIELDS).distinct()
    post = post.select("tok", "pos")
    hot = post.groupBy("tok").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") > GRID_POSTINGS)
    hot = cut(hot, "hot")
    sides, key, once = (post, post), ["tok"], F.col("a") < F.col("b")
    if not hot.isEmpty():  # else both sides are one table, dealt once
        sides, key, once = _gridded(post, hot), ["tok", "x", "y"], (F.col("x") < F.col("y")) | (F.col("a") < F.col("b"))
    met = sides[0].withColumnRenamed("pos", "a").join(sides[1].withColumnRenamed("pos", "b"), key).filter(once)
    # pairs are a few bytes but costly to verify: keep them spread, not merged by size
    spread = int(post.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _allowed(pairs, marks, threshold).repartition(spread, "a", "b")


def _near(sets: DataFrame, threshold: float) -> DataFrame:
    return near_pairs(sets, F.transform("tokens", lambda w: F.hash(w)), threshold)


def similar_pairs(sets: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """(job_id, a, b, similarity): pairs of classes at or above (strictly above) the
    threshold, the earlier one as ``a``.

    Copies are not paired with each other; ``copies`` of the classes tells how many
    row pairs a class pair stands for.
    """
    similarity = F.col("similarity")
    keep = similarity > threshold if strict else similarity >= threshold
    words = sets.filter(F.size("tokens") > 0).select("job_id", "pos", F.col("tokens").alias("ids"))
    return _verify(cut(_near(sets, threshold), "near"), words, keep)


def keep_first(sets: DataFrame, threshold: float) -> DataFrame:
    """Ids of classes kept when each is dropped iff an earlier *kept* one is similar to it.

    Similar classes share a key of their parts, and a class that shares none is kept.
    Dense families are thinned first without pairing their members: the earliest class
    of a key leads it; one that leads all its keys has no earlier similar class, so it is
    kept, and what is similar to it under its keys is dropped. Each such round costs one
    comparison per posting. Once the pairs left are few, or the rounds stop helping, the
    rest is decided on the full pair relation. Both ways are exact.
    """
    post = cut(_shared(_parted(encode(sets), threshold)), "postings")
    involved = cut(post.select("pos").distinct(), "involved")
    held = cut(sets.select("job_id", "pos", "tokens").join(involved, "pos", "left_semi"), "involved-sets")
    words = held.withColumnRenamed("tokens", "ids")
    hashes = F.transform("tokens", lambda w: F.hash(w).cast("bigint"))
    marks = cut(_signed(held.withColumn("ids", hashes)), "marks")
    alike = F.col("similarity") >= threshold
    dropped = sets.select("pos").limit(0)
    for _ in range(MAX_LEADER_ROUNDS):
        load = post.groupBy("tok").agg(F.count(F.lit(1)).alias("f")).agg(
            F.sum(F.col("f") * (F.col("f") - 1) / 2).alias("pairs"), F.sum("f").alias("rows")
        ).first()
        if not load.rows or load.pairs <= PAIRS_PER_POSTING * load.rows:
            break
        led = post.withColumnRenamed("pos", "b").join(post.groupBy("tok").agg(F.min("pos").alias("a")), "tok")
        leads_all = F.bool_and(F.col("a") == F.col("b"))
        kept = cut(led.groupBy("b").agg(leads_all.alias("k")).filter("k").select(F.col("b").alias("pos")), "kept")
        met = led.filter("a < b").select("a", "b").distinct().join(kept.withColumnRenamed("pos", "a"), "a", "left_semi")
        lost = cut(_alike(_allowed(met, marks, threshold), words, alike).select(F.col("b").alias("pos")).distinct(), "lost")
        dropped = dropped.unionByName(lost)
        before = load.rows
        post = cut(post.join(kept.unionByName(lost), "pos", "left_anti"), "postings")
        if post.count() > 0.9 * before:
            break
    edges = cut(_alike(_candidates(post, threshold, marks), words, alike).select("a", "b"), "edges")
    while not edges.isEmpty():
        free = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
        lost = cut(edges.join(free, "a", "left_semi").select(F.col("b").alias("pos")).distinct(), "lost")
        dropped = dropped.unionByName(lost)
        for end in ("a", "b"):
            edges = edges.join(lost.withColumnRenamed("pos", end), end, "left_anti")
        edges = cut(edges, "edges")
    return sets.select("pos").join(dropped, "pos", "left_anti")


def drop_redundant(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows of a ``positioned`` table that do not repeat an earlier kept one.

    A copy of a set always repeats its first row (kept, or dropped for the same
    reason), so only first rows of kept classes stay.
    """
    return rows.join(keep_first(classes(rows), threshold), "pos", "left_semi")


def row_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(pos, earlier): for each row and each similar class, that class's latest earlier row.

    Later rows of a class are similar to everything its earlier rows are, so the latest
    one stands for all of them in a clustering, and links stay linear in the copies.
    """
    sets = classes(rows)
    pairs = cut(similar_pairs(sets, threshold).select("a", "b"), "pairs")
    copied = cut(sets.filter("copies > 1").select("job_id", "set_key", F.col("pos").alias("class")), "copied")
    if copied.isEmpty():
        return pairs.select(F.col("b").alias("pos"), F.col("a").alias("earlier"))
    members = rows.select("job_id", "set_key", "pos").join(copied, ["job_id", "set_key"]).select("class", "pos")
    # classes of one row link directly; where copies are involved, find the latest earlier row
    multi = copied.select("class").withColumn("m", F.lit(True))
    marked = (
        pairs.join(multi.withColumnsRenamed({"class": "a", "m": "am"}), "a", "left")
        .join(multi.withColumnsRenamed({"class": "b", "m": "bm"}), "b", "left")
    )
    direct = marked.filter("am IS NULL AND bm IS NULL").select(F.col("b").alias("pos"), F.col("a").alias("earlier"))
    wide = marked.filter("am OR bm").select("a", "b")
    both = wide.unionByName(wide.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(
        copied.select(F.col("class").alias("a"), F.col("class").alias("b"))
    )
    singles = wide.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(multi, "class", "left_anti")
    everyone = members.unionByName(singles.select("class", F.col("class").alias("pos")))
    seekers = both.join(everyone.withColumnRenamed("class", "a"), "a").withColumn("is_target", F.lit(0))
    targets = both.join(everyone.withColumnRenamed("class", "b"), "b").withColumn("is_target", F.lit(1))
    marks = cut(seekers.unionByName(targets), "marks")
    seen = Ordered(marks, ["a", "b"], "pos", ["is_target"]).running_max(
        F.when(F.col("is_target") == 1, F.col("pos")), "earlier"
    )
    found = seen.done().filter("is_target = 0 AND earlier IS NOT NULL").select("pos", "earlier")
    return direct.unionByName(found).distinct()


def greedy_clusters(rows: DataFrame, threshold: float) -> DataFrame:
    """Cluster of each row when rows join, in order, the first cluster with a similar member.

    The founder of a row's cluster is the earliest row reachable over links that go
    strictly back in order. So labels start at the row itself and take the least label
    among linked earlier rows; following a label's own label halves the remaining way.
    """
    links = cut(row_links(rows, threshold), "links")
    ends = links.select(F.explode(F.array("pos", "earlier")).alias("pos")).distinct()
    labels = cut(ends.withColumn("label", F.col("pos")), "labels")
    while not links.isEmpty():
        theirs = labels.select(F.col("pos").alias("earlier"), F.col("label").alias("theirs"))
        best = links.join(theirs, "earlier").groupBy("pos").agg(F.min("theirs").alias("theirs"))
        jump = labels.select(F.col("pos").alias("label"), F.col("label").alias("beyond"))
        new = cut(
            labels.join(best, "pos", "left")
            .join(jump, "label", "left")
            .select("pos", F.col("label").alias("old"), F.least("label", "theirs", "beyond").alias("label")),
            "labels",
        )
        labels = new.select("pos", "label")
        if new.filter("label < old").isEmpty():
            break
    return rows.join(labels, "pos", "left").withColumn("label", F.coalesce("label", "pos"))
