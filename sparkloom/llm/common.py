"""What the operators of this subpackage share: tables, stages, ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters A-Z and white space as the contracts define them.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of 64 row numbers sent out at once: 16 million rows, some 10 MB.
MOST_WORDS = 250_000
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Let Python workers get at most ``BATCH_ROWS`` rows at once, unless the session
    sets a number of its own: texts are long, and a worker holds a whole batch."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; only Spark's readers touch the path."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session.  Where that is unset, one process on one machine gets a temporary
    folder; on a cluster it is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        place = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again.
    A lost executor then costs its running tasks, not what came before."""
    bounded_batches(df.sparkSession)
    place = new_place(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join whose sides grow with the data: both are dealt out and sorted,
    and neither is sent out whole by way of the driver.  Spark decides by the bytes of
    files, which do not show the rows that a generator makes of each row."""
    return df.hint("merge")


def picked(df: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """The rows of ``df`` whose number, 0 or more, in column ``row`` is in ``rows``,
    which has that column alone.

    The numbers are sent out as bits, a word for 64 rows, so the texts beside them stay
    where they are.  More than ``MOST_WORDS`` words are not sent: the texts are dealt out.
    """
    word, bits = free_name(df, "_word"), free_name(df, "_bits")
    place = (F.col(row) % 64).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    words = staged(rows.groupBy(F.shiftright(row, 6).alias(word)).agg(F.bit_or(one).alias(bits)), "words")
    if words.count() > MOST_WORDS:
        return df.join(dealt(rows), row, "left_semi")
    met = df.join(F.broadcast(words), F.shiftright(row, 6) == F.col(word))
    return met.where(F.getbit(bits, place) == 1).select(*df.columns)


def free_name(docs: DataFrame, name: str) -> str:
    """A name for a new column: ``name``, with underscores before it until no
    column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Return this worker's freed memory to the system: workers live on from stage
    to stage, and what one stage has freed the next one's limit still counts."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc: nothing to do
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bucket(column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; 0 marks held-out documents."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(bucket(column) == 0, F.lit(False))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
