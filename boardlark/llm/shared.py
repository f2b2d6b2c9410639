"""Helpers that the training-data operators share: Arrow passes, shared scratch tables, DataFrame loading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one Python step works on; bounds the memory of a worker.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus.  Where its files give fewer splits than there are cores, its rows are dealt out to all cores, as most of what follows is
    heavy on CPU; a table of more splits is read as it is, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of the id as text, modulo 4, is 2.  A null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fresh(columns: list[str], name: str) -> str:
    """`name`, with underscores in front as long as a column has it (case aside); for columns that an operator adds for itself."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's spark.checkpoint.dir.  Where that is unset, a local session gets a folder of its
    own machine; on a cluster there is none to choose, which is an error.  The session's settings stay as they are."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"file://{tempfile.gettempdir()}/boardlark-{spark.sparkContext.applicationId}"
    raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that the driver and all executors share")


#: Rows and bytes of an Arrow batch while an operator itself runs a job; Spark's own sizes hold for what the caller runs.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds what a task holds in Arrow buffers beside a worker's model; the session has its own settings again afterwards."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Written tables that cut lineage.  They lie in the shared folder and go when the session's JVM ends, or earlier with drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._fs, path = self._open(self.root)
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def _open(self, where: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df, with small Arrow batches meanwhile, and reads it back."""
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._fs.delete(self._open(f"{self.root}/{name}")[1], True)

    def only(self, *names: str) -> None:
        """Drops all tables but these, which a result still reads."""
        for status in self._fs.listStatus(self._open(self.root)[1]):
            if status.getPath().getName() not in names:
                self._fs.delete(status.getPath(), True)


def sliced(batches: Iterator[pa.RecordBatch], text: str | None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `most` bytes of the text column; one longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if text is None:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def arrow_pass(df: DataFrame, text: str | None, keep: list[str], added: StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """One Arrow pass over the columns `keep` and `text`: make() is called once in each worker's task and gives a function from a batch to the
    added columns.  A kept column named like an added one gives way to it."""
    new = set(added.names)
    kept = [c for c in keep if c not in new]
    source = df.select(*dict.fromkeys([*keep, *([text] if text else [])]))
    schema = StructType([StructField(f.name, f.dataType, True) for f in source.schema if f.name in kept] + list(added))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches, text):
            out = work(batch)
            yield pa.RecordBatch.from_arrays([out[n] if n in new else batch.column(n) for n in names], names)

    return source.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets from 0, null flags); a null has length 0."""
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0], nulls


def lists(flat: np.ndarray, sizes, kind: pa.DataType) -> pa.Array:
    """A list column from the flat values and the length of each row's list."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixer, on unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
