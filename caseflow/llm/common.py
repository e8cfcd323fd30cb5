"""Helpers shared by the text operators: inputs, cut lineage, Arrow passes."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.session import checkpoint_folder

#: White space between words: blank, tab, newline, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (a path all machines see)."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session that names none (a test, say) gets one beside its warehouse; a cluster has to name one."""
    if checkpoint_folder(spark) is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints")
    return checkpoint_folder(spark)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; what follows starts from those files."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Have Spark remove the shuffle files of each query that ends meanwhile; what it wrote stays."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Scratch:
    """Tables of one operator's run in the shared folder, removed when it is done with them.

    What is written is compressed, unlike a checkpoint, and cuts the lineage like one; the shuffle files
    of the plan that made it go.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.made = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure: object) -> None:
        self.drop()

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.made}"
        self.made += 1
        with shuffles_go(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, number: int | None = None) -> None:
        """Remove one table or the whole folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder if number is None else f"{self.folder}/{number}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """The text of a row; a missing one counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder_of_id(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the identifier's decimal text, modulo ``modulus``; NULL for a missing identifier."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(modulus))


def whole_rows(docs: DataFrame, **more: Column) -> DataFrame:
    """Every row packed into one struct ``row``, beside computed columns, so that no name can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """Back from ``whole_rows`` to the columns of ``like``."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in like.columns])


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows, without copying; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20, rows: int = 1 << 15) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``size`` bytes and ``rows`` documents at most, one longer document alone: first, last, bytes, offsets."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, first + rows, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def arrow_pass(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """``work`` on every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


#: Partial sums of one key that are added up before the last step.
FAN = 64


def summed_lines(rows: DataFrame, kind: type, *keys: str) -> DataFrame:
    """Sums of binary lines (arrays of ``kind``) by ``keys``: one row a key, from one row a key and partition.

    Lines are added up as they come, in ``FAN`` places a key and then in one, so a task holds one sum
    and a batch of lines whatever the number of partitions. Lines should be short (some kilobytes).
    """
    rows = rows.withColumn("place", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    return _summed(_summed(rows, kind, [*keys, "place"]), kind, [*keys])


def _summed(rows: DataFrame, kind: type, names: list[str]) -> DataFrame:
    """One level of ``summed_lines``: rows come to a task by key and in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, kinds = None, None, None

        def told() -> pa.RecordBatch:
            columns = [pa.array([v], k) for v, k in zip(at, kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([total.tobytes()], pa.binary())], [*names, "line"])

        for batch in batches:
            kinds = [c.type for c in batch.columns[:-1]]
            for *head, line in zip(*(c.to_pylist() for c in batch.columns)):
                if head == at:
                    total += np.frombuffer(line, kind)
                    continue
                if at is not None:
                    yield told()
                at, total = head, np.frombuffer(line, kind).copy()
        if at is not None:
            yield told()

    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), "line binary"])
    dealt = rows.select(*names, "line").repartition(partitions(rows.sparkSession), *names)
    return dealt.sortWithinPartitions(*names).mapInArrow(work, schema)


def fixed_binary(values: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as binary values."""
    values = np.ascontiguousarray(values)
    n, width = len(values), values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = np.arange(n + 1, dtype=np.int64) * width
    kind = pa.binary() if offsets[-1] < 2**31 - 1 else pa.large_binary()
    raw = pa.py_buffer(values.tobytes())
    offsets = offsets.astype(np.int32) if kind == pa.binary() else offsets
    return pa.Array.from_buffers(kind, n, [None, pa.py_buffer(offsets.tobytes()), raw]).cast(pa.binary())


def fixed_list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a two-dimensional array as lists of equal length."""
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(values.ravel(), kind))
