"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this session sets for rows that hold whole texts: Arrow batches of 2 MB (Spark's 64 MB are held
#: several times by every task, on both sides) and Parquet batches of 512 rows (4096 texts are arrays of
#: tens of MB, which the heap grows for and keeps).
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def small_batches(spark: SparkSession) -> None:
    """Sets BATCHES in this session, but for what it sets itself."""
    own = spark.conf.getAll
    for name, value in BATCHES.items():
        if name not in own:
            spark.conf.set(name, value)


def lean(run):
    """run, a function over Arrow batches or groups, after which a worker gives free memory back: Python's
    and Arrow's allocators keep it otherwise, and reused workers add up."""

    def over_batches(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return over_batches


def _give_back() -> None:
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or, where that is
    unset and all of Spark runs on this machine (tests), a temporary folder set here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_llm_checkpoint_dir", None)
        if not found:
            if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = f"file://{tempfile.mkdtemp(prefix='llm-checkpoint-')}"
            spark.sparkContext.setCheckpointDir(found)
            spark._llm_checkpoint_dir = found
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone by then; a leftover folder is harmless
        pass


def size_of(df: DataFrame) -> int:
    """Spark's estimate of df's bytes, for the number of tasks and buckets."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def few_files(df: DataFrame, about: int, per_file: int = 32 << 20, least: int | None = None) -> DataFrame:
    """df in no more partitions than least (two for every core), or per_file of `about` bytes each: tables
    that are written have files of a sensible size, however many partitions the step before had. Every
    file costs a file system calls, and on a local one a process that sets its permissions."""
    least = 2 * df.sparkSession.sparkContext.defaultParallelism if least is None else least
    return df.coalesce(min((1 << 31) - 1, max(least, about // per_file)))


def written(spark: SparkSession, df: DataFrame, name: str, about: int | None = None, least: int | None = None) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage, outlives lost
    executors, and is computed once however often it is used. about: at most so many bytes."""
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    (df if about is None else few_files(df, about, least=least)).write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what came of them has been written, too."""
    for df in tables:
        _remove(df.sparkSession, df._written_at)


def added(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """df's schema with more fields; names that clash get underscores before them."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t, True) for n, t in fields)])


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it new to df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_sample(df: DataFrame, key: str, per_class: int, label: str) -> DataFrame:
    """At most per_class rows of each 0/1 label, picked by a hash of key: the same rows each time."""
    order = F.xxhash64(F.col(key).cast("string"))
    parts = [df.filter(F.col(label) == y).orderBy(order, F.col(key)).limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body's lambdas use it: an expression that a
    lambda refers to is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column, block: int = 256) -> Column:
    """By element of an array of int, the sum of those before it. Sums run within blocks and over the
    blocks' totals, so arrays that grow element by element stay small."""
    grown = lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))
    sums = lambda ns, start: F.aggregate(ns, F.array(start), grown)
    total = lambda ns: F.aggregate(ns, F.lit(0), lambda a, n: a + n)
    cut = lambda ns: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ns), F.lit(1)), F.lit(block)), lambda k: F.slice(ns, k, block))
    within = lambda ns, start: F.slice(sums(ns, start), F.lit(1), F.size(ns))
    joined = lambda bs: F.flatten(F.zip_with(bs, let(F.transform(bs, total), lambda t: F.slice(sums(t, F.lit(0)), F.lit(1), F.size(t))), within))
    return let(numbers, lambda ns: let(cut(ns), joined))


@contextlib.contextmanager
def without_cycles():
    """Python's cycle collector off for a while: for code that makes many objects and no cycles, whose
    tables the collector would walk again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def utf8(column) -> list:
    """The UTF-8 bytes of an Arrow string column, None for null."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def byte_batches(batches, column: str, max_bytes: int = 16 << 20):
    """Arrow batches cut into pieces whose column holds about max_bytes at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
