"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.lineage import checkpoint_dir, cut

__all__ = ["ROW", "ascii_lower", "checkpoint_dir", "cut", "dropped", "keyed", "let", "map_batches", "pieces", "table", "without", "words", "written"]

#: ASCII white space, as a Java and RE2 character class body.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The array of words: runs of anything but ASCII white space."""
    return F.array_remove(F.split(c, f"[{SPACE}]+"), "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f over a value that is computed once, for expressions that name it again and again."""
    return F.transform(F.array(value), f)[0]


#: Bytes of rows that a task works on at once.
BATCH_BYTES = 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of `limit` bytes at most; a longer row alone. Slices copy nothing."""
    for whole in batches:
        left = [whole]
        while left:
            b = left.pop()
            if b.num_rows <= 1 or b.nbytes <= limit:
                yield b
            else:
                left += [b.slice(b.num_rows // 2), b.slice(0, b.num_rows // 2)]


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow over slices bounded by their bytes, as texts differ in length a thousandfold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(sliced(batches))
        released()

    return df.mapInArrow(task, schema)


def released() -> None:
    """Gives what a task has freed back to the machine, as Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def pieces(texts: Sequence[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters together, a longer text alone."""
    at = held = 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > limit:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, under a name of its own."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: The column of a row's own key, under a name that no table has.
ROW = "_lodestone_row"


def keyed(docs: DataFrame, key: str = ROW) -> tuple[DataFrame, bool]:
    """docs with a key of each row, and whether that is doc_id: where no two rows share one and none is null; else it is a number in the order of a written copy."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    if ids.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), True
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), False


#: Lists of ids up to this many rows are broadcast; longer ones join by shuffle.
BROADCAST_IDS = 1_000_000


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is in ids; rows with a null key stay. df itself is shuffled only for a list too long to broadcast."""
    listed = cut(ids.select(key).distinct())
    return df.join(F.broadcast(listed) if listed.count() <= BROADCAST_IDS else listed, key, "left_anti").select(df.columns)
