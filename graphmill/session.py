"""Session helpers: tables, cut points in long lineages, and a local session for tests."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


_OWN = "spark.graphmill.folder"
#: Folders written by this process that still exist, by the frame that reads them.
_written: dict[int, str] = {}
_kept: list[DataFrame] = []


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it.

    Only a local session may go without the setting (in a test); it uses a temporary folder then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = spark.conf.get(_OWN, None)
    if root is None:
        root = "file://" + tempfile.mkdtemp(prefix="graphmill-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set(_OWN, root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends here and the data survives the loss of an executor."""
    df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes the frame as Parquet into the shared folder and reads it back, without a scan for the schema.

    What is still there when the process ends is deleted then; see `discard` for what is not needed before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_sweep)
    back = spark.read.schema(df.schema).parquet(path)
    _written[id(back)] = path
    _kept.append(back)
    return back


def discard(df: DataFrame) -> None:
    """Deletes what `stored` wrote for this very frame; frames derived from it must not be used any more."""
    path = _written.pop(id(df), None)
    if path:
        _delete(path)
        _kept[:] = [k for k in _kept if k is not df]


def _delete(path: str) -> None:
    try:
        where, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        where.delete_dir(inner)
    except (OSError, ValueError, NotImplementedError):  # a file system this process cannot reach: its owner cleans the shared folder
        return


def _sweep() -> None:
    for path in _written.values():
        _delete(path)
    _written.clear()


def local_session(cores: str = "8", name: str = "graphmill") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
