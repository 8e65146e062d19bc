"""Bounded memory of Python workers and of the driver.

Workers are kept between tasks. What a task has freed stays with its worker's allocators unless it is handed
back, and idle workers then hold what the next stages need. The driver's JVM is the same between jobs.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def release() -> None:
    """Hand freed memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def release_driver(spark: SparkSession) -> None:
    """Hand memory that the driver no longer uses back to the system, between steps of many small jobs.

    A collection lets go of plans and broadcasts and shrinks the heap. Native blocks that the JVM has freed stay with
    the C library until HotSpot (17.0.9 and later) is told to trim them; on other JVMs they stay.
    """
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    try:
        # by the interface's method: the server's own class is not open to reflection
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        arguments[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        arguments[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JError:
        pass
    release()


def _parts(batches: Iterator[pa.RecordBatch], column: str | None, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if column is None or batch.num_rows < 2:
            yield batch
        else:
            lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy()
            part = np.cumsum(lengths, dtype=np.int64) // size
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)
        batch = None
        release()


def lean(run: Callable, column: str | None = None, size: int = 4 << 20) -> Callable:
    """``run``, a function for mapInArrow, handing memory back after every batch and at its end.

    With ``column`` it sees each batch in slices of about ``size`` bytes of that column (a longer value is a
    slice of its own), in order, every row once. Spark is told to send batches of about twice that size, not of
    ten thousand rows of any length, so neither side holds more.
    """
    if (spark := SparkSession.getActiveSession()) is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(_parts(batches, column, size))
        finally:
            release()

    return wrapped
