"""Tables that an operator writes to the shared folder and reads again, so that lineage ends there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process's staged tables, with the file system that can delete them.
_FOLDERS: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    A folder of our own is set only where none is and all tasks run in this machine's one process (tests); on a
    cluster a missing setting is an error, because a local folder isn't shared there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="phredlens-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder that nothing uses yet. What stands there goes when this process ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/phredlens-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(folder)
        _FOLDERS[folder] = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files when the query ends, not when its driver happens to collect garbage.
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, clean: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as its partitions stand and read it back.

    A lost executor then costs a reread only. Tables that are small after a shuffle have few files already, because
    the engine joins small shuffle partitions. With ``clean`` the shuffle files of the write go when it is done. ``codec`` is
    the files' compression, else the session's.
    """
    path = fresh_path(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANS, None)
    if clean:
        conf.set(_CLEANS, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        if clean:
            conf.unset(_CLEANS) if before is None else conf.set(_CLEANS, before)
    return staged_at(df.sparkSession, path, df.schema)


def staged_at(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table that was written at a ``fresh_path``, in one job or several; ``unstage`` deletes it."""
    out = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    out._phredlens_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no frame in use reads any more; frames that weren't staged are left alone."""
    for df in tables:
        if path := getattr(df, "_phredlens_path", None):
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def clean_up() -> None:
    """Delete all staged tables of this process; runs by itself when it ends. Results must have been written by then."""
    for system, where in _FOLDERS.values():
        try:
            system.delete(where, True)
        except Exception:  # noqa: BLE001  the engine may have ended before us
            pass
    _FOLDERS.clear()


atexit.register(clean_up)
