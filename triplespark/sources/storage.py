"""Where intermediate results of iterative programs go."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        spark.sparkContext.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="triplespark-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path for an intermediate result, deleted by :func:`release`."""
    path = f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed now, written to the application's checkpoint folder and read back, without its lineage.

    A written table is computed once, where an RDD's checkpoint is computed twice, and small results are read back in
    few partitions, so a loop of unions and joins doesn't multiply them.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Deletes every intermediate result of this session; call it once what reads them is written."""
    for made, path in [x for x in _MADE if x[0] is spark]:
        _delete(made, path)
        _MADE.remove((made, path))


@atexit.register
def _release_all() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has stopped; the folder's owner cleans up
            return
