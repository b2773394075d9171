"""Tables that a job writes on its way, in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of files that a task measures at once; a larger file is alone.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path in the folder that the cluster shares; where none is set, a local master (and only that) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomset-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomset-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet and read again: lineage ends here, a lost executor costs no recomputation, and Spark can split skewed joins of them."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables from written() that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(files: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """First place and end of runs of files of so many bytes in all; a larger file is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(files), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(files):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def in_slices(df: DataFrame, key: Column, data: Column, f: Callable[[list[bytes | None]], tuple[np.ndarray, list]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """key and what f gives of each file: fields by name, Spark's type and Arrow's.

    f takes some files and returns the places of the files that its rows belong to, and a column of values for each
    field. What is held beside an Arrow batch is made of a slice of it, so it doesn't grow with the batch's rows.
    """
    x = df.select(key.alias("key"), data.alias("data"))
    kind = x.schema["key"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("data")
            for i, j in slices(column):
                at, values = f(column.slice(i, j - i).to_pylist())
                keys = batch.column("key").take(pa.array(np.asarray(at, np.int64) + i))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(v, t) for v, (_, _, t) in zip(values, fields, strict=True))], ["key", *(n for n, _, _ in fields)])

    return x.mapInArrow(scan, ", ".join([f"key {kind}", *(f"`{n}` {t}" for n, t, _ in fields)]))


def by_key(rows: DataFrame, key: str, values: dict[str, Column], f: Callable[[Iterable[dict]], Iterator[tuple]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """key and the rows that f gives for it, of fields by name, Spark's type and Arrow's.

    Rows go to their key's task as they are; `values` are made there, and f gets them row by row, so what is made of a
    row is never shuffled, and a key of many rows isn't gathered.
    """
    x = rows.withColumn("__key", F.col(key)).repartition("__key").sortWithinPartitions("__key").select("__key", *(v.alias(n) for n, v in values.items()))
    kind, arrow = x.schema["__key"].dataType.simpleString(), to_arrow_type(x.schema["__key"].dataType)
    names = [n for n, _, _ in fields]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                columns = batch.slice(at, 256).to_pydict()
                for k, *v in zip(columns.pop("__key"), *columns.values(), strict=True):
                    yield k, dict(zip(columns, v, strict=True))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((k, *out) for k, group in groupby(each(batches), key=lambda r: r[0]) for out in f(v for _, v in group))
        while part := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), [arrow, *(t for _, _, t in fields)], strict=True)], ["__key", *names])

    return x.mapInArrow(scan, ", ".join([f"__key {kind}", *(f"`{n}` {t}" for n, t, _ in fields)])).withColumnRenamed("__key", key)
