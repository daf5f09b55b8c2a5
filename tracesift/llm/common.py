"""Small helpers shared by the training-data operators."""

import ctypes
import ctypes.util
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from tracesift.sources.scratch import PASSING, file_system, remove, shared_path

#: Bytes of text that a Python task holds as one piece of work.
CHUNK_BYTES = 4 << 20
#: Bytes of the rows that a Python task gathers before it writes them to a table.
GROUP_BYTES = 8 << 20
#: Whether shuffle files go when the rows that need them are made, not when the driver happens to collect its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of the rows that an executor hands to a Python task at a time.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


Batches = Iterator[pa.RecordBatch]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder.

    It cuts the lineage: what follows reads files that outlive any executor.  The shuffles that led there are freed.
    """
    path = shared_path(df.sparkSession, name)
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tabled(df: DataFrame, name: str, run: Callable[[Batches], Batches] | None = None, schema: str | None = None) -> DataFrame:
    """As ``written``, for many tables of numbers, booleans, bytes, strings, and arrays and structs of them; with ``run``, of what
    it makes of the rows, which the same workers write.

    Spark's writer sets the rights of each file in a local or mounted folder by programs that it starts, and while one starts, it holds
    the memory of the executor or driver that starts it, too.  So tasks write files there through Arrow, by names that Spark doesn't
    read; those of the attempts that count get their names in the end.
    """
    path = shared_path(df.sparkSession, name)
    system, place = file_system(path) if path.startswith(("/", "file:")) else (None, path)
    if not system:
        return written(df.mapInArrow(frugal(run), schema) if run else df, name)
    system.create_dir(place)

    @frugal
    def write(batches: Batches) -> Batches:
        system, place = file_system(path)
        made, out = f"_{uuid.uuid4().hex}", None
        for group in _gathered(run(batches) if run else batches):
            out = out or pq.ParquetWriter(f"{place}/{made}", group.schema, filesystem=system)
            out.write_table(group)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([made])], ["made"])

    with _shuffles_freed(df.sparkSession), _set(df.sparkSession, _BATCH_BYTES, str(GROUP_BYTES)):
        files = df.mapInArrow(write, "made string").collect()
    for file in files:
        system.move(f"{place}/{file.made}", f"{place}/part-{file.made[1:]}.parquet")
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def _gathered(batches: Batches) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in filter(len, batches):
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _shuffles_freed(spark: SparkSession) -> AbstractContextManager[None]:
    return _set(spark, _FREE_SHUFFLES, "true")


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def passing() -> Iterator[Callable[..., DataFrame]]:
    """What is written within the block is removed at its end, except by the function that it gives, which is ``tabled`` otherwise."""
    own: list[str] = []
    outer = PASSING.get()
    token = PASSING.set(own)

    def lasting(df: DataFrame, name: str, run: Callable[[Batches], Batches] | None = None, schema: str | None = None) -> DataFrame:
        inner = PASSING.set(outer)
        try:
            return tabled(df, name, run, schema)
        finally:
            PASSING.reset(inner)

    try:
        yield lasting
    finally:
        PASSING.reset(token)
        for path in own:
            remove(path)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices whose ``column`` holds about ``limit`` bytes; a longer value stays whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """Give freed memory back at the end of a task: Python workers stay for the tasks that follow, beside others."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim:  # with the GNU library
        trim(0)
