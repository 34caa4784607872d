"""Stages: results written to storage that all executors share, and read again."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application, so that it needn't be installed there."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one where none is set and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOTS:
        _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return _OWN_ROOTS[app]


def files(spark: SparkSession, path: str):
    """(file system, path) of the storage that ``path`` names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, target = files(spark, path)
        fs.delete(target, True)
    except Exception:  # the session may be gone by the time the interpreter ends
        pass


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` and read it back, so that what follows has no lineage into it.

    The files stay until ``discard`` or the end of the interpreter.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the interpreter ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def discard(*stages: DataFrame) -> None:
    """Delete the files of stages that nothing reads any more."""
    for df in stages:
        if path := getattr(df, "_stage_path", None):
            _remove(df.sparkSession, path)


class StageCache:
    """Named stages of one run under ``root``, reused when the run is started again.

    The run's arguments are written beside the stages and compared on the next start:
    stages made with others are refused instead of mixed. A stage counts as done when its
    writer left _SUCCESS, which it does last.
    """

    def __init__(self, spark: SparkSession, root: str, config: dict):
        self.spark, self.root = spark, root.rstrip("/")
        want = json.dumps(config, sort_keys=True)
        pinned = f"{self.root}/_config"
        fs, path = files(spark, pinned)
        if fs.exists(path):
            have = spark.read.text(pinned, wholetext=True).first()[0].strip()
            if have != want:
                raise ValueError(f"stages at {root} were made with {have}, not {want}")
        else:
            spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(pinned)

    def done(self, name: str) -> bool:
        fs, path = files(self.spark, f"{self.root}/{name}/_SUCCESS")
        return fs.exists(path)

    def get(self, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self.done(name):
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
