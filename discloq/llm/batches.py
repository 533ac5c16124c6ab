"""Arrow record batches cut by bytes, so that memory follows bytes and not row counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of a batch that Spark sends to a Python worker, where the session sets none. Its own
#: 64 MB are held by the JVM, outside its heap, and by the worker, for each running task.
BATCH_BYTES, _SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


#: What operators remember in a worker process from task to task, by operator and use. Workers are
#: shared: tasks of an operator that remembers nothing let go of it.
MEMORIES: dict[tuple[str, str], object] = {}


def let_go() -> None:
    MEMORIES.clear()
    pa.default_memory_pool().release_unused()


def bounded(df: DataFrame) -> DataFrame:
    """``df`` as it is, in a session that sends it to Python workers in small batches; a setting
    of the session's own stays."""
    conf = df.sparkSession.conf
    conf.set(_SETTING, conf.get(_SETTING, str(BATCH_BYTES)))
    return df


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of ``column`` each; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) // most
        cuts = [0, *(np.nonzero(np.diff(block))[0] + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
