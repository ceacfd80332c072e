"""Helpers shared by the operators: saved intermediates, Arrow batches, bounded broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words everywhere in this subpackage, as a regex class body.
SPACE = r"\x20\x09-\x0D"

#: A join side of at most this many rows (of a few dozen bytes each) may be broadcast.
BROADCAST_ROWS = 1_000_000

_OWN: list[str] = []
_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and
    driver and executors are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tesela-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        where = _OWN[0]
    return where.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors, and what reads them knows their size. They are removed when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tesela-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (tables := _TABLES.get()) is not None:
        tables.append(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def own_tables(spark: SparkSession, keep: Callable[[list[str]], list[str]]):
    """Tables that are saved inside are removed at the end, but for those that ``keep`` chooses of
    their paths, in the order in which they were saved: what is left must not be read from the others."""
    outer, mine = _TABLES.get(), []
    token = _TABLES.set(mine)
    try:
        yield
    finally:
        _TABLES.reset(token)
        left = keep(mine)
        for path in set(mine) - set(left):
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        if outer is not None:
            outer += left


def bound_batches(spark: SparkSession) -> None:
    """Bound a session's Arrow batches to 4 MB, unless it has set a bound of its own.

    A batch is held a few times over (in the JVM, in Arrow's buffers and in Python), by each task.
    Queries and pipelines call this for their session; operators change no setting.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(key, "4m")


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that gives freed memory back when its task ends.

    Spark keeps its Python workers for later tasks, and freed memory would stay theirs.
    """

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
            trim(0)

    return tidied


def with_row_ids(df: DataFrame, name: str = "rid") -> DataFrame:
    """``df`` saved with a row id that stays the same however often it is read again."""
    return saved(df.withColumn(name, F.monotonically_increasing_id()))


def local_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small table from the driver, as a part of the plan.

    Rows of a Python list would go through Python workers of a pool of their own, which Spark keeps on
    each executor beside those of Arrow functions.
    """
    return spark.createDataFrame(pa.table(columns))


def plain_names(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``df`` with other columns than ``keep`` under names that clash with none of an operator's."""
    return df.toDF(*[c if c in keep else f"other_{i}" for i, c in enumerate(df.columns)])


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast when its counted ``rows`` are within BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % by


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_count(column: str = "text") -> Column:
    """Number of maximal runs of characters that do not separate words."""
    return F.expr(f"regexp_count(coalesce(`{column}`, ''), r'[^{SPACE}]+')").cast("long")
