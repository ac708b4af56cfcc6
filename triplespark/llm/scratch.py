"""Tables written in the folder that every executor shares.

An operator that uses an intermediate result more than once writes it here as Parquet and reads it back, which cuts
the lineage: a lost executor costs a reread, not a recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where the session names none, as in tests, one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        given = spark.sparkContext.getCheckpointDir()
    if not given:
        given = "file://" + tempfile.mkdtemp(prefix="triplespark-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as a URI that readers outside the JVM understand."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return whole if not whole.startswith("file:/") else "file:///" + whole.removeprefix("file:").lstrip("/")


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


class Scratch:
    """A folder of intermediate tables of one call of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _MADE.append((spark, self.path))

    def table(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Writes df under this name and reads it back."""
        path, schema = f"{self.path}/{name}", df.schema
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        _delete(self.spark, f"{self.path}/{name}")


def release(spark: SparkSession) -> None:
    """Deletes every scratch table of this session; call it once the results that read them are written."""
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
