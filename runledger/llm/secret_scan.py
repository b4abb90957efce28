"""Secrets in texts, and credentials of several parts that stand together (operator 4).

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.session import cut

# fixed values: the base kinds in their order, their patterns and least lengths
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Weak parts, reported only beside their complements: identifiers, secrets, endpoints.
WEAK_ID = r"""(?i:client|account|tenant|user|access|key)[_-]?(?i:id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]{8,}"""
WEAK_ASSIGN = r"""(?i:pwd|pass|auth|credential|private_?key|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}"""
LONG_RUN = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"
RUN_LENGTH = 40
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Parts belong together when they start at most so many characters apart.
SCOPE = 500

SPAN = "struct<start:bigint,end:bigint,kind:int>"


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """All leftmost non-overlapping matches as (start, end, kind), in code points.

    The lengths of what stands between matches, from splitting at them, and of the matches
    themselves add up to the places. ``keep`` chooses by the match's text and group.
    """
    order = F.lit(KINDS.index(kind))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if "([" in pattern else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pieces = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), whole.alias("whole"), group.alias("part"))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + m["gap"]
        end = start + m["size"]
        span = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), order.alias("kind")).cast(SPAN)
        good = F.lit(True) if keep is None else keep(m["whole"], m["part"])
        return F.struct(end.cast("bigint").alias("at"), F.when(good, F.concat(s["found"], F.array(span))).otherwise(s["found"]).alias("found"))

    found = F.aggregate(F.filter(pieces, lambda m: m["size"].isNotNull()), state, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def mixed_run(run: Column) -> Column:
    return (F.length(run) == RUN_LENGTH) & run.rlike("[A-Z]") & run.rlike("[a-z]") & run.rlike("[0-9]")


def base_and_weak(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, base, weak`` of every row; ``text_key`` tells texts of one id apart.

    A weak part that starts inside a base span is part of that and left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_key"),
        F.array_sort(
            F.concat(
                spans(text, ASSIGN, "assign", lambda _, part: F.length(part) >= ASSIGN_LEAST),
                # a longer run holds the same matches as all runs filtered by length
                spans(text, rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", "access"),
                spans(text, rf"[0-9a-f]{{{HEX_LEAST},}}", "hex"),
            ),
            lambda a, b: F.when(a["start"] < b["start"], -1)
            .when(a["start"] > b["start"], 1)
            .otherwise(a["kind"] - b["kind"]),
        ).alias("base"),
        F.concat(
            spans(text, WEAK_ID, "weak_id"),
            spans(text, WEAK_ASSIGN, "weak_secret"),
            spans(text, LONG_RUN, "weak_secret", lambda run, _: mixed_run(run)),
            spans(text, ENDPOINT, "endpoint"),
        ).alias("weak"),
    )
    inside = lambda w: F.exists("base", lambda b: (b["start"] <= w["start"]) & (w["start"] < b["end"]))
    return rows.withColumn("weak", F.array_distinct(F.filter("weak", lambda w: ~inside(w))))


def beside(parts: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """The parts that one of ``others`` starts at most ``scope`` characters away from.

    An interval join: others stand in the bucket of their place and both next to it, so near
    parts meet on an equal bucket. A bucket holds no more parts than its characters allow.
    """
    left = parts.withColumn("bucket", F.floor(F.col("start") / scope))
    right = others.select(
        F.col("doc_id").alias("o_doc"),
        F.col("text_key").alias("o_key"),
        F.col("start").alias("o_start"),
        F.explode(F.array(*[F.floor(F.col("start") / scope) + k for k in (-1, 0, 1)])).alias("o_bucket"),
    )
    near = (
        F.col("doc_id").eqNullSafe(F.col("o_doc"))
        & (F.col("text_key") == F.col("o_key"))
        & (F.col("bucket") == F.col("o_bucket"))
        & (F.abs(F.col("start") - F.col("o_start")) <= scope)
    )
    return left.join(right, near, "left_semi").drop("bucket")


def linked_parts(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts whose complements stand near: ``doc_id, text_key, start, end, kind``.

    A weak secret needs an identifier beside it; a weak identifier a secret of any kind; an
    endpoint both an identifier and a secret.
    """
    parts = (
        rows.filter(F.size("weak") > 0)
        .select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("s"))
        .select("doc_id", "text_key", "s.*")
        .distinct()
    )
    of = {k: i for i, k in enumerate(KINDS)}
    ids = parts.filter(F.col("kind").isin(of["access"], of["weak_id"]))
    secrets = parts.filter(F.col("kind").isin(of["assign"], of["hex"], of["weak_secret"]))
    weak = lambda kind: parts.filter(F.col("kind") == of[kind])
    return (
        beside(weak("weak_secret"), ids, scope)
        .unionByName(beside(weak("weak_id"), secrets, scope))
        .unionByName(beside(beside(weak("endpoint"), ids, scope), secrets, scope))
    )


def listed(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secrets of all documents (operator 4), one row per row of ``docs``.

    ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``. Base spans are those of the
    three strict kinds; ``spans`` adds weak identifiers, secrets and endpoints that stand
    within ``scope`` of their complements. A null text counts as empty; a null ``doc_id`` is
    scanned like any other; repeated rows give a row each; no documents, no rows. Other
    columns are not read.
    """
    rows = cut(base_and_weak(docs), "secret-parts")
    added = linked_parts(rows, scope).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))
    added = added.select(F.col("doc_id").alias("a_doc"), F.col("text_key").alias("a_key"), "added")
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("text_key") == F.col("a_key")), "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    every = F.concat("base", F.coalesce(F.col("added"), F.array().cast(f"array<{SPAN}>")))
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return joined.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"),
    )
