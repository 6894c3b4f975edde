"""What the operators of this subpackage share: table access, the shared folder, and text batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to the vectorised code in slices of about so many bytes (one text at least).
SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that further columns of it can't clash with ours."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and has no executors elsewhere."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"fingerloom-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/fingerloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts lineage, survives lost executors."""
    return written(df, fresh_path(df.sparkSession, label))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables between the steps of one operator, in one folder that goes when the operator ends.

    What the operator returns may not read from it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, fresh_path(spark, label)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """As keep(); a label is used once."""
        return written(df, f"{self.path}/{label}")

    def drop(self, *labels: str) -> None:
        """Tables that nothing reads any more."""
        for label in labels:
            delete(self.spark, f"{self.path}/{label}")

    def settle(self) -> None:
        """Let the driver notice now which shuffles nothing refers to any more, so that their files go before the next large step."""
        self.spark._jvm.System.gc()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        delete(self.spark, self.path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_BYTES for what runs inside, for texts go through several at once in an executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remainder(column: Column, n: int) -> Column:
    """crc32 of an integer id written as text, modulo n."""
    return F.crc32(column.cast("string")) % n


def text_slices(batch: pa.RecordBatch, column: int = 0, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch holding about `limit` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def as_bytes(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def as_texts(array: pa.Array) -> list[str]:
    """Each text; null counts as empty."""
    return [x or "" for x in array.to_pylist()]


def unpacked(batch: pa.RecordBatch, n: int, z: int) -> list[bytes]:
    """Texts in zstd: column n has their bytes' number, z what they are packed as."""
    return [pa.decompress(x, decompressed_size=size, codec="zstd", asbytes=True) if size else b"" for size, x in zip(batch.column(n).to_pylist(), batch.column(z).to_pylist())]
