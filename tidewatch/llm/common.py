"""What the training-data operators share: scratch tables, checked broadcasts, word splitting."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

#: Up to so many ids (8 bytes each) are broadcast to filter rows by; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_own_folders: dict[str, str] = {}
#: Folder of each settled table: where it is, and its file system, to delete it by after the session has ended too.
_settled: dict[str, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only where it is unset (a local session, as in tests) one is made here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_folders[app]


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them back, so that a lost executor costs no more than the running stage. The table goes when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The settled rows of what `make` gives; the tables that were written on the way to it go."""
    before = set(_settled)
    out = settle(make())
    mine = next(reversed(_settled))
    for path in set(_settled) - before - {mine}:
        _remove(path)
    return out


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, for what goes when the driver ends."""
    path = f"{scratch_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _settled[path] = where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path


def discard(settled: DataFrame) -> None:
    """Delete the table of a settled frame that nothing reads any more."""
    for name in settled.inputFiles()[:1]:
        path = next((p for p in _settled if p.rsplit("/", 1)[-1] in name), None)
        if path:
            _remove(path)


def _remove(path: str) -> None:
    where, store = _settled.pop(path)
    with contextlib.suppress(Exception):  # the driver may be ending
        store.delete(where, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_settled):
        _remove(path)


def checked_broadcast(settled: DataFrame, most: int) -> DataFrame:
    """A settled frame, with a broadcast hint if it has `most` rows or fewer; beyond that Spark joins it by shuffle."""
    return F.broadcast(settled) if settled.count() <= most else settled


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, str]:
    """The rows of docs with their columns named c0, c1 ... and a number, row, written once, so that every step sees the same numbers; the id's column; the text's name."""
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return settle(own.withColumn("row", F.monotonically_increasing_id())), F.col(f"c{docs.columns.index(id_col)}"), f"c{docs.columns.index(text_col)}"


def numbered_by_row(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, str]:
    """As numbered(), in a table that is bucketed by row: the rows are sent once, and joins and groups by row leave them where they are."""
    spark = docs.sparkSession
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).withColumn("row", F.monotonically_increasing_id())
    n, name = max(1, docs.rdd.getNumPartitions()), f"numbered_{uuid.uuid4().hex}"
    own.repartition(n, "row").write.format("parquet").bucketBy(n, "row").option("path", scratch_path(spark, "numbered")).saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name), F.col(f"c{docs.columns.index(id_col)}"), f"c{docs.columns.index(text_col)}"


def _forget(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and with it the name
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def order_key(id_col: Column) -> Column:
    """A long to order rows by: the id if it is a whole number, else its hash; the largest long for a null id."""
    return F.coalesce(id_col.cast("string").try_cast("long"), F.when(id_col.isNotNull(), F.xxhash64(id_col.cast("string"))), F.lit((1 << 63) - 1))


def whole(text: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ with A-Z lower-cased, in UTF-8: bytes.lower and bytes.split touch ASCII alone."""
    return text.encode().lower().split()


def tidied(run: Callable) -> Callable:
    """A function for mapInArrow after whose partition the worker gives the memory that it has freed back to the system. Workers live on through the stages, and what each has left would add up."""

    @wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # glibc's
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
