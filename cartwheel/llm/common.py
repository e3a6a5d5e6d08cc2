"""Helpers shared by the operators: staged tables, text batches, running totals."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.session import checkpoint_dir


#: rows per Arrow batch where the session does not say: a batch of whole texts stays a few megabytes.
TEXT_BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """What the queries want of a session: the package on the executors, and small batches where none are set."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, TEXT_BATCH_ROWS)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, as ``--py-files`` would.

    Where the package is installed on the executors that copy is the same code.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="cartwheel-code-"), "cartwheel.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "cartwheel")):
            for name in sorted(n for n in names if n.endswith(".py")):
                out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder.

    What comes back is read from there: lineage is cut, a lost executor
    costs no recomputation, and partitions stay as they were.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each led by underscores until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def map_batches(
    df: DataFrame, schema: T.StructType | str, fn: Callable[[pa.RecordBatch], dict | None]
) -> DataFrame:
    """``mapInArrow`` with a function from one batch to a dict of columns."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = arrow_schema(target)
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield record_batch(out, kinds)

    return df.mapInArrow(run, target)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def record_batch(columns: dict, kinds: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in kinds:
        value = columns[field.name]
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        if isinstance(value, pa.Array):
            arrays.append(value if value.type == field.type else value.cast(field.type))
        else:
            arrays.append(pa.array(value, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=kinds)


def crc_bucket(id_col: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null ids fall in bucket -1."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(column.cast("string")), F.lit(buckets)), F.lit(-1))


def part_of(name: str, share: float | Column) -> Column:
    """Whether a row is in the part of about ``share`` of all values of a column, chosen by hash."""
    place = F.pmod(F.xxhash64(name, F.lit("part")), F.lit(2**30)) / F.lit(float(2**30))
    return place < (F.lit(float(share)) if not isinstance(share, Column) else share)


def with_running_start(df: DataFrame, order: list[str], value: str, start: str = "start", partitions: int | None = None) -> DataFrame:
    """Adds ``start``: the sum of ``value`` over all rows before this one in ``order``.

    Rows are range-partitioned and sorted by ``order``, each task sums its
    own rows, and only one total per partition is combined, so no task sees
    more than its range. Rows equal in ``order`` stay together in one task.
    ``value`` is a non-null long. The sorted rows are staged once.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in order]
    width = partitions or shuffle_width(spark)
    ranged = df.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, part, before = arrow_schema(schema), TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.asarray(batch.column(names.index(value)).to_numpy(zero_copy_only=False), dtype=np.int64)
            ends = before + np.cumsum(sizes)
            out = {c: batch.column(i) for i, c in enumerate(names)}
            out |= {"_part": np.full(len(sizes), part, np.int32), "_before": ends - sizes}
            if len(sizes):
                before = int(ends[-1])
            yield record_batch(out, kinds)

    parts = staged(ranged.mapInArrow(run, schema))
    # one row per partition of the range shuffle: as many as tasks, not rows
    totals = parts.groupBy("_part").agg(F.max(F.col("_before") + F.col(value)).alias("_total"))
    from pyspark.sql import Window

    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_base"))
    return (
        parts.join(F.broadcast(bases), "_part")
        .withColumn(start, F.col("_base") + F.col("_before"))
        .drop("_part", "_base", "_before")
    )


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more.

    It only learns of them when the driver's JVM collects its garbage,
    which a driver with little to do puts off for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # noqa: SLF001


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder, and read from there."""
    import uuid

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
