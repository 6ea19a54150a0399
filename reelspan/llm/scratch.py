"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
#: Applications that have the package.
_SHIPPED: set[str] = set()
#: Folders of scratch tables, in the order in which they were made.
_FOLDERS: list[str] = []


def make_importable(spark: SparkSession) -> None:
    """Ship this package's modules with the application, so that Python workers can import them wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="spark-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{_PACKAGE.name}-modules.zip", "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    context.addPyFile(f"{folder}/{_PACKAGE.name}-modules.zip")
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local master (tests on one machine) gets a temporary folder; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Writes DataFrames as Parquet under ``spark.checkpoint.dir`` and reads them back.

    A table read back has a short lineage, so a lost executor costs only the tasks that ran on it, and
    its size is known to the planner. ``drop`` deletes tables that no later step reads; what a result
    still reads can be deleted once the result is written (see ``temporary``).
    """

    def __init__(self, spark: SparkSession, name: str):
        make_importable(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        _FOLDERS.append(self.root)

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write a table and read it back; with ``by`` in folders by that column."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            _delete(self.spark, t._scratch_path)
        self.release()

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps now; it waits for the driver's garbage collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables of the operators that begin inside the block at its end; results must be written by then."""
    before = len(_FOLDERS)
    try:
        yield
    finally:
        for folder in _FOLDERS[before:]:
            _delete(spark, folder)
        del _FOLDERS[before:]
