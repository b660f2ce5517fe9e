"""Intermediate tables in the cluster's shared checkpoint folder.

A result that several branches of a plan read is written once as Parquet and read back. That cuts
the lineage, survives the loss of executors, keeps column pruning and file statistics, and saves
scanning the raw input once per branch. ``release`` removes what a session has staged so far.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a new temporary one only in one-process local mode without a setting."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{SETTING} must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="listwarden-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; ``release`` removes it."""
    folder = f"{shared_folder(spark)}/listwarden/{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


def materialized(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to a new table of the shared folder and read back; ``by``, its last column, names the files' folders."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Position in the list of staged tables, for ``release(since=...)``."""
    return len(_made)


def taken(since: int) -> list[str]:
    """The folders staged after ``since``, taken off the list: ``release`` leaves them, ``remove`` removes them."""
    folders = _made[since:]
    del _made[since:]
    return folders


def remove(folders: list[str]) -> None:
    """Remove staged folders; call it when no DataFrame reads them any more."""
    for folder in folders:
        store, path = fs.FileSystem.from_uri(folder)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


def temporary(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """``materialized``, and what removes the table again; call that when no DataFrame reads it any more."""
    since = mark()
    made = materialized(df, name)
    folders = taken(since)

    def drop() -> None:
        try:
            remove(folders)
        except (OSError, ValueError, NotImplementedError):  # a store that only Spark reaches: it stays until ``release``
            _made.extend(folders)

    return made, drop


def release(since: int = 0) -> None:
    """Remove the tables staged after ``since``; call it when no DataFrame reads them any more."""
    remove(taken(since))
