"""Small helpers for operators that read text from Arrow batches inside a task."""

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: A batch is worked on in slices of about this many bytes of text, which bounds the arrays made from it.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch, where the session has Spark's default of 10,000: with texts that takes many times the memory, in Spark and in Python.
BATCH_ROWS = 2000
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(rows):
    """The rows (a DataFrame), after the session's Arrow batches are made small unless it says otherwise."""
    conf = rows.sparkSession.conf
    if conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        conf.set(_SETTING, str(BATCH_ROWS))
    return rows


@lru_cache(1)
def _trim():
    """The C library's function that gives freed memory back to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """What the last slices took goes back to the system: a worker is kept for later tasks of other operators, beside which it would lie idle."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def _sizes(column) -> np.ndarray:
    """The bytes of each value of a string or binary array, from its offsets; what is under a null counts too."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, dtype=np.int64 if wide else np.int32)
    return np.diff(offsets[column.offset : column.offset + len(column) + 1]).astype(np.int64)


def row_slices(batch, columns, limit=SLICE_BYTES):
    """Yield (first row, part of the batch) for runs of rows whose values in the columns take about limit bytes; nothing is copied."""
    ends = np.cumsum(sum(_sizes(batch.column(c)) for c in columns)) if batch.num_rows else np.zeros(0, np.int64)
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, batch.slice(first, last - first)
        first = last
    give_back()


def text_slices(batch, column="text", limit=SLICE_BYTES):
    """Yield (first row, list of UTF-8 bytes) for runs of rows; a null text is the empty one."""
    for first, part in row_slices(batch, [column], limit):
        values = part.column(column)
        plain = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()) if not pa.types.is_binary(values.type) else values
        yield first, [v or b"" for v in plain.to_pylist()]


def joined(rows, separator=b"\n"):
    """One byte array of all rows, each followed by the separator, and where each row begins (one more at the end)."""
    data = np.frombuffer(separator.join(rows) + separator, dtype=np.uint8)
    starts = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r) + len(separator) for r in rows], out=starts[1:])
    return data, starts


def rows_to_batch(schema, columns):
    """A record batch of the schema (a pyarrow schema) from a dict of lists or arrays."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


_BYTE = np.random.default_rng(20240607).integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes with all bits of each spread over it."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int, cache={}) -> np.ndarray:  # noqa: B006  one table per worker
    if len(cache.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        cache[base] = np.multiply.accumulate(steps)
    return cache[base][:n]


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each span data[first:last], from one running sum; which (0, 1): of two independent ones."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[which][data] * _powers(_BASE, len(data)), dtype=np.uint64)))
    return mixed((sums[last] - sums[first]) * _powers(pow(_BASE, -1, 2**64), len(data) + 1)[first])
