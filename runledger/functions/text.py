"""Column expressions over text. All run in the JVM on whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.functions import fixed_values as fixed

# Unicode white space, as both regex engines used here can spell it.
SPACE = r"(?U)\s+"
SPACE_RE2 = r"[\s\v\x{85}\p{Z}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def shorten(text: Column, n: int) -> Column:
    """First ``n`` words, single-spaced."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def headline(text: Column) -> Column:
    """First line, up to the end of its first sentence, bounded in length."""
    line = strip(F.substring_index(text, "\n", 1))
    return F.substring(F.substring_index(line, ". ", 1), 1, fixed.HEADLINE_CHARS)


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(text, "[^A-Za-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-", ""), 1, fixed.SLUG_CHARS)
    return F.lower(F.regexp_replace(cut, "-$", ""))


def token_set(text: Column) -> Column:
    """Sorted distinct lower-case words of more than three bytes."""
    parts = F.split(text, r"[^\p{IsAlphabetic}\p{N}]+")
    long = F.filter(parts, lambda w: F.octet_length(w) > 3)
    return F.sort_array(F.array_distinct(F.transform(long, F.lower)))


def jaccard(left: Column, right: Column) -> Column:
    """Two empty sets are equal, so their similarity is 1."""
    both = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def complexity(text: Column) -> Column:
    """2, plus one per ten words and per enumeration mark, within 2..8."""
    marks = F.length(text) - F.length(F.translate(text, ",;\n", ""))
    low = F.lower(text)
    ands = (F.length(low) - F.length(F.replace(low, F.lit(" and "), F.lit("")))) / 5
    score = 2 + F.floor(word_count(text) / 10) + marks + F.floor(ands)
    return F.greatest(F.lit(2), F.least(F.lit(8), score)).cast("int")


def token_estimate(complexity_: Column) -> Column:
    return F.greatest(complexity_, F.lit(1)).cast("bigint") * fixed.TOKENS_PER_COMPLEXITY


def idempotency_key(job: Column, stage: Column, kind: Column, title: Column) -> Column:
    digest = F.substring(F.md5(title), 1, 16)
    return F.concat_ws(":", job.cast("string"), stage.cast("string"), kind, slug(title), digest)


def attempt_key(key: Column, attempt: Column) -> Column:
    return F.concat(key, F.lit("#"), attempt.cast("string"))


def plain_id(value: Column, prefix: str) -> Column:
    """Strip the optional ``prefix_`` of an id and put it in canonical lower case."""
    return F.lower(F.regexp_replace(value, f"^{prefix}_", ""))
