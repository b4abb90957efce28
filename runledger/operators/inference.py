"""Batch inference: each distinct request is answered once, then joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.operators import usage


def _lane(text: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, 15), 16, 10).cast("bigint")


def fingerprints(messages: DataFrame, params: DataFrame) -> DataFrame:
    """Fingerprint per request over model, parameters and its ordered messages.

    Every message is hashed with its turn, so order counts, and the hashes are combined
    by a commutative aggregate: a conversation is never collected in one place.
    Attribution and keys are left out. ``params`` holds request_id, model and whatever
    else changes the answer (json mode, temperature, token limit).
    """
    said = F.concat_ws("\x1f", F.col("turn").cast("string"), "role", "content")
    body = messages.groupBy("request_id").agg(
        F.bit_xor(_lane(said, 1)).alias("h1"),
        F.bit_xor(_lane(said, 16)).alias("h2"),
        F.count(F.lit(1)).alias("n"),
    )
    rest = [c for c in params.columns if c != "request_id"]
    head = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])
    digest = F.md5(F.concat_ws("\x1f", head, F.col("h1").cast("string"), F.col("h2").cast("string"), F.col("n").cast("string")))
    return params.join(body, "request_id").select("request_id", *rest, digest.alias("fingerprint"))


def answer_batch(
    requests: DataFrame,
    answer: Callable[[pd.Series], pd.Series],
    calls_at_once: int | None = None,
) -> DataFrame:
    """Answer (request_id, fingerprint, prompt) with a function from prompts to texts.

    The first request of a fingerprint carries the prompt; repeats take its answer and
    are marked ``cached``. ``calls_at_once`` bounds how many tasks call the function.
    """
    first = requests.groupBy("fingerprint").agg(
        F.min("request_id").alias("asked_by"), F.min_by("prompt", "request_id").alias("prompt")
    )
    if calls_at_once:
        first = first.repartition(calls_at_once, "fingerprint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["answer"] = answer(pdf["prompt"])
            yield pdf[["fingerprint", "asked_by", "answer"]]

    asked_by = requests.schema["request_id"].dataType.simpleString()
    answers = first.mapInPandas(run, f"fingerprint STRING, asked_by {asked_by}, answer STRING")
    return (
        requests.join(answers, "fingerprint")
        .withColumn("cached", F.col("request_id") != F.col("asked_by"))
        .drop("asked_by")
    )


def route_models(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """First provider in order that serves the model; no provider is an error row.

    ``providers`` (provider, ord, model) is a dimension; a null model serves all.
    """
    first = F.min(F.struct("ord", "provider"))
    named = providers.filter("model IS NOT NULL").groupBy("model").agg(first.alias("own"))
    any_ = providers.filter("model IS NULL").agg(first.alias("any")).scalar()
    out = requests.join(F.broadcast(named), "model", "left").withColumn("any", any_)
    pick = F.least("own", "any")  # skips nulls
    error = F.concat(F.lit("no provider serves model `"), "model", F.lit("`"))
    return out.withColumn("provider", pick["provider"]).withColumn(
        "error", F.when(F.col("provider").isNull(), error).otherwise("")
    ).drop("own", "any")


def priced(answers: DataFrame) -> DataFrame:
    cost = usage.call_cost_micro_usd(F.col("tokens_in"), F.col("tokens_out"))
    return answers.withColumn("cost_micro_usd", F.when(F.col("cached"), 0).otherwise(cost))
