"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_base() -> str:
    return "file://" + tempfile.mkdtemp(prefix="piiguard-")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's URI with scheme and authority, as Spark's own writers resolve it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def arrow_uri(uri: str) -> str:
    """A qualified URI as ``pyarrow.fs`` spells it: ``s3a`` is its ``s3``, ``file:/x`` is ``file:///x``."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        return f"s3:{rest}"
    return f"file://{rest}" if scheme == "file" and not rest.startswith("//") else uri


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified URI and the path in it; for tasks that write and read files of their own."""
    return fs.FileSystem.from_uri(arrow_uri(uri))


def checked_base(base: str | None, uri: str | None, master: str) -> str:
    """The qualified folder, or an error where executors of a cluster would each use a disk of their own.

    A folder named with its scheme is taken at its word (``file:`` may be a mount that all share); one without
    a scheme must not end up on the local disk of a cluster's nodes.
    """
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if ":" not in base.split("/", 1)[0] and uri.startswith("file:") and not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir is {base}, which is {uri} here: name a shared folder with its scheme")
    return uri


def one_machine(master: str) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` starts executors of their own."""
    return master == "local" or master.startswith("local[")


def pick_base(named: str | None, others: Sequence[str], qualify: Callable[[str], str], master: str, shared: Callable[[str], bool]) -> str | None:
    """The first folder that driver and executors share: the named one, else one of the others; None of none.

    The named one with its scheme is taken at its word. One that :func:`checked_base` refuses on a cluster, and others
    on a local disk (a warehouse has a scheme even where it is the driver's own folder), must pass the probe ``shared``.
    """
    if one_machine(master):
        return qualify(named or next(iter(others), None) or _local_base())
    for base in filter(None, (named, *others)):
        uri = qualify(base)
        with contextlib.suppress(ValueError):
            if base == named or not uri.startswith("file:"):
                return checked_base(base, uri, "cluster")
        if shared(uri):
            return uri
    return None


def seen_by_all(spark: SparkSession, uri: str) -> bool:
    """Whether driver and tasks find below the folder what tasks write there: tasks for all cores write a file each."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    path = f"{_below(spark, uri)}/probe-{uuid.uuid4().hex}"
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        return spark.read.schema("id long").parquet(path).count() == tasks
    except Exception:  # not there, not writable, or files that others do not see
        return False


_BASES: dict[tuple, str | None] = {}


def _below(spark: SparkSession, base: str) -> str:
    return f"{base.rstrip('/')}/piiguard/{spark.sparkContext.applicationId}"


def _run_dir(spark: SparkSession) -> str | None:
    """The URI of the run's folder below the one that driver and executors share; None without one.

    That is the session's ``spark.checkpoint.dir``, else the checkpoint folder set on the context, else the warehouse. In
    one process (tests) a temporary folder takes the place of the latter.
    """
    context = spark.sparkContext
    conf, made = context.getConf(), context._jsc.sc().getCheckpointDir()
    master = conf.get("spark.master", "")
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    others = [made.get()] if made.isDefined() else []
    if not one_machine(master):
        others.append(spark.conf.get("spark.sql.warehouse.dir", None))
    asked = (context.applicationId, named, *others)
    if asked not in _BASES:
        _BASES[asked] = pick_base(named, others, lambda f: qualified(spark, f), master, lambda uri: seen_by_all(spark, uri))
    base = _BASES[asked]
    return base and _below(spark, base)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI in the run's folder."""
    folder = _run_dir(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share; the warehouse is none")
    return f"{folder}/{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written elsewhere."""
    folder = _run_dir(spark)
    if folder is None:
        return
    files, path = open_folder(folder)
    if files.get_file_info(path).type == fs.FileType.Directory:
        files.delete_dir(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage is cut, executors may go.

    The result reads that table, which stays until :func:`clean_up`. Where no folder is shared, the rows are kept on
    the executors' own disks instead, which must then stay.
    """
    spark = df.sparkSession
    if _run_dir(spark) is None:
        return df.localCheckpoint(eager=True, storageLevel=StorageLevel.DISK_ONLY)
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(made: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more; one that is kept on executors stays."""
    spark = made.sparkSession
    if (folder := _run_dir(spark)) is None:
        return
    parts = {arrow_uri(qualified(spark, f)).rsplit("/", 1)[0] for f in made.inputFiles()}
    files, below = open_folder(folder)
    for part in parts:
        path = open_folder(part)[1]
        if path.startswith(f"{below}/"):
            files.delete_dir(path)
