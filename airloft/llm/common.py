"""Column helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words or are stripped.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Spark's setting for removing a query's shuffle files at its end.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of rows in an Arrow batch (a row more may exceed it), and what it is set to; Spark's own is 64 MB.
BATCH_BYTES, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes, used together as one 128-bit key."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)


def hex_to_long(digest: Column, start: int = 1, digits: int = 13) -> Column:
    """A slice of a hex digest as a non-negative long of 4 * digits bits."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Rows kept away from training: crc32 of the id as text leaves remainder 2."""
    return F.coalesce(F.pmod(crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there.

    The folder is the session's spark.checkpoint.dir; a folder of its own is
    set only where that is unset, as in tests on one machine.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(local_folder(spark))
    with shuffles_removed(spark):
        return df.select("*").checkpoint()  # the setting is read as a DataFrame is made


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run within go when their query ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of some ARROW_BYTES; a limit that the session has set itself stays.

    A batch is held several times over, in the executor outside its heap and in the
    worker. The setting is read as a query runs, so it has to outlast the
    function that returns a DataFrame; results do not depend on it.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(ARROW_BYTES))


def local_folder(spark: SparkSession) -> str:
    """A new temporary folder, in local mode only: on a cluster executors would not see it."""
    import tempfile

    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this subpackage made."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


#: Bytes up to which a written table is handed to every task.
BROADCAST_BYTES = 32 << 20


def if_small(df: DataFrame, size: Column | int = 48) -> DataFrame:
    """A written df, hinted for broadcast only if its rows of `size` bytes are few; else Spark shuffles it."""
    size = size if isinstance(size, Column) else F.lit(size)
    held = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def shielded(*needed: str):
    """For functions that add columns to docs: other columns of docs travel under neutral names.

    So an extra column may have any name. One that has the name of an added
    column is replaced by it. `needed` columns must exist and come through.
    """

    def wrap(function):
        @functools.wraps(function)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            extra = {c: f"_x{i}" for i, c in enumerate(docs.columns) if c not in needed}
            out = function(docs.select(*[F.col(f"`{c}`").alias(extra.get(c, c)) for c in docs.columns]), *args, **kwargs)
            hidden = set(extra.values())
            added = [c for c in out.columns if c not in hidden and c not in needed]
            kept = [F.col(extra.get(c, c)).alias(c) for c in docs.columns if c not in added and extra.get(c, c) in out.columns]
            return out.select(*kept, *added)

        return run

    return wrap
