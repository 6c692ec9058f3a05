"""Tables that cut lineage: written once into the folder all executors share, then read back."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only on a single machine (master ``local[...]``) a temporary folder stands in where the session names none;
    on a cluster a missing setting is an error, as executors would not find one another's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="lorewell-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed with the tables of the application."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/lorewell/{app}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(app, []).append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and returns a reader of it.

    Survives the loss of executors, unlike cached or locally checkpointed blocks. ``release`` or the end of a
    ``scratch`` block removes the table.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared storage, whatever file system it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(table: DataFrame) -> None:
    """Removes the files of a table that ``cut`` returned, once nothing reads it any more."""
    spark = table.sparkSession
    held = {f.rsplit("/", 2)[-2] for f in table.inputFiles()}
    for path in _written.get(spark.sparkContext.applicationId, []):
        if path.rsplit("/", 1)[-1] in held:
            remove(spark, path)


def release(spark: SparkSession, after: int = 0) -> None:
    """Removes the tables written by this application, once the results that read them are no longer needed."""
    written = _written.get(spark.sparkContext.applicationId, [])
    for path in written[after:]:
        remove(spark, path)
    del written[after:]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside the block are removed at its end; results must have been written or collected by then."""
    before = len(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)
