"""Tables that a job writes on its way: in the folder that the cluster shares, deleted when the driver ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where it is unset, in a local session, one is made here."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def path(spark: SparkSession, kind: str) -> str:
    """A new path there."""
    out = f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    _made.append((where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())))
    return out


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows of df, written there as Parquet and read back: what is read several times is worked out once."""
    out = path(df.sparkSession, kind)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


@atexit.register
def _remove() -> None:
    for where, store in _made:
        with contextlib.suppress(Exception):  # the driver may be ending
            store.delete(where, True)
