"""Written tables: staging between passes, sinks, and fitted state."""

from __future__ import annotations

import functools
import logging
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_log = logging.getLogger(__name__)
# Innermost job last: the paths that each open job has staged.
_open_jobs: list[list[str]] = []


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="adsift-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on one machine.

    A bare path is of the session's default file system, as Spark's own checkpoints are.
    Where that is the machines' own disks, the folder must be a mount that all machines
    share, which is tried once; ``file://`` before the path says that it is one.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if spark.sparkContext.master.split("[")[0] == "local":
        return named.rstrip("/") if named else _own_dir()
    if named and (":/" in named or spark.conf.get("spark.hadoop.fs.defaultFS", None)):
        return named.rstrip("/")
    # Spark gives its folder with the file system; below the named one, each application has its own.
    own = getattr(spark.sparkContext, "getCheckpointDir", lambda: None)()
    if not own:
        if named:
            raise ValueError(f"{CHECKPOINT_CONF} needs the scheme of a shared file system: {named}")
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = own.rsplit("/", 1)[0]
    if not folder.startswith("file:"):
        return folder
    folder = f"file:///{folder.removeprefix('file:').lstrip('/')}"
    _require_shared(spark, folder)
    return folder


@functools.cache
def _require_shared(spark: SparkSession, folder: str) -> None:
    """An error unless the driver and the executors see what executors write to the folder."""
    path = f"{folder}/adsift/shared-{uuid.uuid4().hex}"
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).write.parquet(path)
    seen = spark.read.schema("id long").parquet(path).count()
    remove_tree(path)
    if seen != tasks:
        raise ValueError(f"{folder} is no folder that all machines share; name one in {CHECKPOINT_CONF}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; an open job removes it at its end."""
    path = f"{scratch_dir(spark)}/adsift/{name}-{uuid.uuid4().hex}"
    if _open_jobs:
        _open_jobs[-1].append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and go on from the files.

    For results that several passes read: later passes cost a pruned columnar
    scan instead of the whole upstream plan, and a lost executor costs a
    re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged_job() -> Iterator[None]:
    """Remove at the end what is staged inside; for jobs that write their results."""
    paths: list[str] = []
    _open_jobs.append(paths)
    try:
        yield
    finally:
        _open_jobs.remove(paths)
        for path in paths:
            remove_tree(path)


def remove_tree(path: str) -> None:
    """Delete a folder of any file system that Arrow reaches; else leave it and say so."""
    try:
        files, inner = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        files.delete_dir(inner)
    except FileNotFoundError:
        pass
    except (OSError, ValueError) as error:
        _log.warning("staged files stay in %s: %s", path, error)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """A sink: parquet, replacing what was there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# --- fitted state ---------------------------------------------------------------

#: The layout that this library writes and reads.
STATE_VERSION = 1
_MANIFEST = "path string, bytes bigint, sha256 string, version int, folder string"


def _files_of(spark: SparkSession, folder: str) -> DataFrame:
    """Path below the folder, size and hash of its files; Spark's own marks are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    return files.select(
        F.substring_index("path", f"/{name}/", -1).alias("path"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


@contextmanager
def saved_state(spark: SparkSession, path: str) -> Iterator[str]:
    """Gives a new folder for the parts of a fitted state, and commits it at the end.

    The manifest, which names the folder and its files with sizes and hashes, is written
    last.  Whoever loads meanwhile, or after a save that broke off, gets the state before.
    """
    folder = f"state-{uuid.uuid4().hex}"
    yield f"{path}/{folder}"
    files = _files_of(spark, f"{path}/{folder}").withColumns(
        {"version": F.lit(STATE_VERSION), "folder": F.lit(folder)}
    )
    rows = [tuple(r) for r in files.collect()]
    write_table(spark.createDataFrame(rows, _MANIFEST).coalesce(1), f"{path}/manifest")


def committed_state(spark: SparkSession, path: str) -> str:
    """The folder of the state that was committed last; an error if a file of it is missing,
    cut, changed, or of another version's making."""
    listed = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()
    if not listed or {r["version"] for r in listed} != {STATE_VERSION}:
        raise ValueError(f"no state of version {STATE_VERSION} in {path}")
    folder = f"{path}/{listed[0]['folder']}"
    found = {r["path"]: (r["bytes"], r["sha256"]) for r in _files_of(spark, folder).collect()}
    wrong = [r["path"] for r in listed if found.get(r["path"]) != (r["bytes"], r["sha256"])]
    if wrong:
        raise ValueError(f"the state in {path} is not whole: {sorted(wrong)[:5]}")
    return folder
