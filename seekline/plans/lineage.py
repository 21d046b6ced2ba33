"""Cutting lineage with tables written to the cluster's shared folder.

The folder is the session's ``spark.checkpoint.dir``.  Only a local session
that sets none gets one of its own; on a cluster a missing setting is an error,
since a machine-local folder would be lost with its executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        import shutil

        _own["dir"] = tempfile.mkdtemp(prefix="seekline-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; Hadoop removes it when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/seekline-{app}"
    if app not in _marked:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _marked.add(app)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    The result has no lineage but its files, so losing an executor costs at
    most the tasks that ran there.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seekline_path = path
    return out


def laid_out(df: DataFrame, keys: list[str], parts: int, name: str = "laid") -> DataFrame:
    """The same, in ``parts`` buckets by ``keys``: a join or an aggregation on them needs no shuffle of these rows again."""
    spark = df.sparkSession
    table, path = f"seekline_{name}_{uuid.uuid4().hex}", f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._seekline_path, out._seekline_table = path, table
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables written by ``materialize`` or ``laid_out`` that nothing will read again, such as those of an earlier round."""
    for df in tables:
        if name := getattr(df, "_seekline_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path := getattr(df, "_seekline_path", None):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Remove all tables this application has written so far; results that weren't read yet are lost with them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
