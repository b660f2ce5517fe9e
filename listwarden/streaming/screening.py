"""Continuous screening: arriving requests against a prepared list."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwarden.config import DEFAULT, ScreeningConfig
from listwarden.operators import quality, screening, staging


def without_duplicates(requests: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Equal requests of one analyst within one second count once."""
    timed = requests.withWatermark("created_at", lateness).withColumn(
        "created_second", F.date_trunc("second", "created_at")
    )
    return timed.dropDuplicatesWithinWatermark(
        ["name", "document_number", "analyst_id", "created_second"]
    ).drop("created_second")


@dataclass(frozen=True)
class ListVersion:
    """A prepared list under the name of its version, and the staged folders that it alone reads."""

    name: str
    listed: screening.PreparedList
    folders: tuple[str, ...]


class ListVersions:
    """The list as it changes while a stream runs.

    ``publish`` prepares a new version beside the current one; a stream takes it up with its next micro batch. A batch works with one
    version from beginning to end, also where it reads it several times. A version's staged tables go once a newer one is current and
    no batch holds it.
    """

    def __init__(self, config: ScreeningConfig = DEFAULT):
        self._config, self._current, self._held, self._retired = config, None, {}, {}
        self._lock = threading.Lock()

    def publish(self, name: str, entities: DataFrame) -> None:
        """Make ``entities`` the current list; ``name`` must be new."""
        with self._lock:
            if self._current and name in {self._current.name, *self._retired}:
                raise ValueError(f"list version {name} is there already")
        before = staging.mark()
        listed = screening.prepare_list(entities, self._config)
        version = ListVersion(name, listed, tuple(staging.taken(before)))
        with self._lock:
            if self._current:
                self._retired[self._current.name] = self._current
            self._current = version
        self._clean()

    def take(self) -> ListVersion:
        """The current version, kept until ``give_back``."""
        with self._lock:
            if self._current is None:
                raise RuntimeError("no list has been published")
            self._held[self._current.name] = self._held.get(self._current.name, 0) + 1
            return self._current

    def give_back(self, version: ListVersion) -> None:
        with self._lock:
            self._held[version.name] -= 1
        self._clean()

    def _clean(self) -> None:
        with self._lock:
            free = [v for n, v in self._retired.items() if not self._held.get(n)]
            for version in free:
                del self._retired[version.name]
        for version in free:
            staging.remove(list(version.folders))


def screen_stream_versions(
    requests: DataFrame, versions: ListVersions, out_path: str, checkpoint: str, config: ScreeningConfig = DEFAULT,
    when_done: Callable[[int, str], None] | None = None,
):
    """As ``screen_stream``, against whatever list version is current when a batch begins.

    Every match carries ``list_version``. A batch that is repeated after a failure is screened against the version that is current then, and replaces
    what it had written. ``when_done(batch_id, version)`` is told after each batch.
    """
    if {"created_at", "analyst_id"} <= set(requests.columns):
        requests = without_duplicates(requests)

    def write(batch: DataFrame, batch_id: int) -> None:
        version, before = versions.take(), staging.mark()
        try:
            valid = quality.validated(batch, config)
            matches = screening.rounded(screening.screen(valid, version.listed, config)).withColumn("list_version", F.lit(version.name))
            matches.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
        finally:
            staging.release(before)
            versions.give_back(version)
        if when_done:
            when_done(batch_id, version.name)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def screen_stream(
    requests: DataFrame, listed: screening.PreparedList, out_path: str, checkpoint: str,
    config: ScreeningConfig = DEFAULT,
):
    """A started-able stream writer: every micro batch runs the same screening as a table.

    A batch writes its own folder, so a repeated batch replaces itself and nothing is written twice. Its
    staged tables go when it is done. Requests that carry their time (created_at) and analyst (analyst_id) are freed of duplicates first; without
    both columns every row is screened.
    """
    if {"created_at", "analyst_id"} <= set(requests.columns):
        requests = without_duplicates(requests)

    def write(batch: DataFrame, batch_id: int) -> None:
        before = staging.mark()
        valid = quality.validated(batch, config)
        matches = screening.rounded(screening.screen(valid, listed, config))
        matches.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
        staging.release(before)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
