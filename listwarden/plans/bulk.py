"""Bulk screening: requests in, results, hits, rejects and a summary out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from listwarden.config import DEFAULT, ScreeningConfig
from listwarden.operators import quality, screening, stats
from listwarden.operators.staging import materialized


@dataclass(frozen=True)
class BulkScreening:
    matches: DataFrame
    results: DataFrame
    rejects: DataFrame
    summary: DataFrame

    @property
    def hits(self) -> DataFrame:
        return self.results.filter("is_hit")


def bulk_screen(
    requests: DataFrame, listed: DataFrame | screening.PreparedList, config: ScreeningConfig = DEFAULT,
    fail_fast: bool = False,
) -> BulkScreening:
    """Screen every valid request. Invalid ones are kept apart, or stop the run when ``fail_fast``."""
    if fail_fast:
        quality.require_valid(requests, config)
    valid = materialized(quality.validated(requests, config), "valid")
    matches = materialized(screening.screen(valid, listed, config), "matches")
    results = screening.screening_results(valid, screening.rounded(matches), config)
    return BulkScreening(matches, results, quality.rejects(requests, config), stats.bulk_summary(results))


def write_bulk(run: BulkScreening, folder: str) -> None:
    """results, hits, rejects and summary as JSON lines; tables of one run share a folder."""
    for name, df in (("results", run.results), ("hits", run.hits), ("rejects", run.rejects), ("summary", run.summary)):
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
