"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


#: Names the folder of this session under the scratch folder.
_RUN = "sightline.run.dir"


def get_spark(app: str = "sightline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; a cluster's own values win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # state of a stream outgrows the heap: one row per script body ever seen
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder that survives the loss of an executor: ``spark.checkpoint.dir``.

    Only where the session names none and everything runs in one local process (tests,
    a laptop) a temporary folder is made and recorded in the session, so that later calls
    use the same one. On a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(root, "rdd"))
    return root


def _folder(spark: SparkSession, path: str):
    """The file system of a path, as the session is configured for it, and the path itself."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this session's folder under the scratch folder."""
    run = spark.conf.get(_RUN, None)
    if not run:
        run = f"{scratch_root(spark).rstrip('/')}/sightline-run-{uuid.uuid4().hex}"
        spark.conf.set(_RUN, run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def close_run(spark: SparkSession) -> None:
    """Remove what this session wrote to the scratch folder; DataFrames that read it are of no use afterwards."""
    run = spark.conf.get(_RUN, None)
    if run:
        files, path = _folder(spark, run)
        files.delete(path, True)
        spark.conf.unset(_RUN)


@contextmanager
def scratch_run(spark: SparkSession):
    """What is written to the scratch folder inside goes when the block ends; used per batch of a stream."""
    outer = spark.conf.get(_RUN, None)
    spark.conf.set(_RUN, f"{scratch_root(spark).rstrip('/')}/sightline-run-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        close_run(spark)
        if outer:
            spark.conf.set(_RUN, outer)


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _folder(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    files, whole = _folder(spark, path)
    _, part = _folder(spark, path + ".part")
    stream = files.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    files.delete(whole, False)
    if not files.rename(part, whole):
        raise OSError(f"cannot write {path}")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where it doesn't exist."""
    files, where = _folder(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


def contents(spark: SparkSession, *paths: str) -> tuple:
    """Name, size and time of every file under the paths: equal for two calls if nothing was written between them."""
    out = []
    for p in paths:
        files, path = _folder(spark, p)
        if files.exists(path):
            every = files.listFiles(path, True)
            while every.hasNext():
                f = every.next()
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def persist_table(df, name: str):
    """Write ``df`` once to the shared folder and read it back.

    Used where several downstream joins need the same derived table: it cuts the
    lineage and, unlike a cache, does not have to be recomputed when an executor
    goes away.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df):
    """The side of a join that grows with the input: the two meet by shuffle and merge.

    A compressed table of tokens looks small enough to be broadcast by the size of its files and takes
    twenty times that in the driver, and a plan of dozens of joins holds all of these at once.
    """
    return df.hint("merge")
