"""Requests and their answers, paired as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_within(requests: DataFrame, answers: DataFrame, limit: str) -> DataFrame:
    """(request_id, requested_at, answered_at, outcome, status_code): each request with what answered it within ``limit``, or TIMEOUT.

    requests: (request_id, requested_at); answers: (request_id, answered_at, outcome, status_code). Of tables and of streams; a request with several
    answers has a row for each. An answer without a request, before it, or too late is dropped; null ids never pair, and such a request times out.
    """
    asked, told = requests.alias("q"), answers.alias("a")
    same = (F.col("q.request_id") == F.col("a.request_id")) & (F.col("a.answered_at") >= F.col("q.requested_at")) & (F.col("a.answered_at") <= F.col("q.requested_at") + F.expr(f"interval {limit}"))
    paired = asked.join(told, same, "left_outer")
    outcome = F.coalesce(F.col("a.outcome"), F.lit("TIMEOUT")).alias("outcome")
    return paired.select("q.request_id", "q.requested_at", "a.answered_at", outcome, "a.status_code")


def pair_stream(requests: DataFrame, answers: DataFrame, limit: str, lateness: str = "10 minutes") -> DataFrame:
    """As a stream-stream join: state is kept for ``limit`` and ``lateness``, then an unanswered request comes out and is forgotten."""
    return pairs_within(requests.withWatermark("requested_at", lateness), answers.withWatermark("answered_at", lateness), limit)
