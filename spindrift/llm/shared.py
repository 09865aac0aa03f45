"""What the operators share: the shared folder, tables that cut lineage, Arrow batches, and a size-checked broadcast."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes; beyond it, it is shuffled.
BROADCAST_BYTES = 64 << 20
#: Bytes of text that a Python worker handles at once; longer texts are cut into overlapping pieces where an operator can.
PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Where none is named, a session on this one machine, as in
    tests, makes a temporary one; a cluster's can't, since other hosts wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Sent:
    """A value at hand in every task, broadcast with its classes: executors need no copy of this package. It is opened once
    in each Python worker."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self.packed, "_opened"):
            self.packed._opened = pickle.loads(self.packed.value)
            if self.packed._jbroadcast is None:  # in a worker: what is opened needs no packed form
                del self.packed._value
        return self.packed._opened

    def destroy(self) -> None:
        self.packed.destroy()


def table(df: DataFrame, partition: str | None = None) -> DataFrame:
    """Writes df in the shared folder and reads it again: later steps neither recompute it nor depend on its executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As table(), in buckets of the key: a shuffled join on it needn't move these rows again."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, key).write.bucketBy(n, key).format("parquet").option("path", f"{shared_dir(spark)}/{name}")
    writer.saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalog; the files stay, as they have a path of their own
    return out


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table that table() returned."""
    spark, total = df.sparkSession, 0
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in df.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(f)
        total += p.getFileSystem(conf).getFileStatus(p).getLen()
    return total


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its files (written by table()) are small enough; else left to a shuffled join."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def small_batches(spark: SparkSession, rows: int = 2000, mb: int = 16) -> None:
    """Bounds the Arrow batches that Python workers hold, so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def give_back() -> None:
    """Returns freed memory to the system. Workers are reused from step to step; what one step freed would else count
    against the next."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that the column holds about `most` bytes; a longer row comes alone."""
    import numpy as np

    turn = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        begin = 0
        while begin < batch.num_rows:
            if turn % 8 == 0:
                give_back()
            turn += 1
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def lengths(column: pa.Array):
    """Bytes of each value of a string or binary column, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("int64")


def without(docs: DataFrame, bad: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs less those of bad: doc_id and tag, the hash of the text (null: empty), which tells apart texts that share an id."""
    bad = sized(table(bad.select(F.col("doc_id").alias("bad_id"), F.col("tag").alias("bad_tag")).distinct()), 16 << 20)
    tag = F.hash(F.coalesce(F.col(text), F.lit("")))
    return docs.join(bad, (F.col(doc_id).cast("long").eqNullSafe(F.col("bad_id"))) & (tag == F.col("bad_tag")), "left_anti")
