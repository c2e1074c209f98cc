"""Tables written to shared storage to cut lineage and to survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Paths that are still to be deleted, with their session and, for buckets, the table's name.
_LIVE: dict[str, tuple[SparkSession, str | None]] = {}
_SCRATCH: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, one of our own is made, if driver and tasks share a machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="heaploom-"))
    return _OWN_DIR[0]


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_quietly(path: str) -> None:
    spark, table = _LIVE.pop(path)
    try:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop_path(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended already
        return


@atexit.register
def _drop_all() -> None:
    for path in list(_LIVE):
        _drop_quietly(path)


def _new_path(spark: SparkSession, label: str, table: str | None = None) -> str:
    path = f"{shared_dir(spark)}/heaploom/{label}-{uuid.uuid4().hex}"
    _LIVE[path] = (spark, table)
    return path


def _known(out: DataFrame, path: str) -> DataFrame:
    _PATHS[out] = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return it reread.

    Later plans start from the files, so neither lineage nor a lost executor
    leads back through the work that made them. The files go when they are freed, when
    the scratch scope ends that they were made in, or else when Python ends. With ``by``, each
    value of that column has a folder of its own, so that a filter on it reads that folder alone.
    """
    path = _new_path(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return _known(df.sparkSession.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Like ``stage``, in as many buckets of ``key`` as the session has shuffle partitions.

    A join on ``key`` reads the buckets where they are: only its other side is shuffled, or
    broadcast where Spark finds it small.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"heaploom_{uuid.uuid4().hex}"
    path = _new_path(spark, label, table)
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    return _known(spark.table(table), path)


def free(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again; others are left alone."""
    for t in tables:
        path = _PATHS.pop(t, None)
        if path is not None:
            _drop_quietly(path)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """A scope at whose end the tables staged in it are freed, but for those put in the list it gives."""
    kept: list[DataFrame] = []
    _SCRATCH.append([])
    try:
        yield kept
    finally:
        made = _SCRATCH.pop()
        mine = {id(k) for k in kept}
        free(*(t for t in made if id(t) not in mine))
        if _SCRATCH:
            _SCRATCH[-1] += [t for t in made if id(t) in mine]
