"""Counts of 64-bit keys over whole tables.

Tasks add their keys up before anything is shuffled, and send them as blobs, one for each segment
of the key space. A segment's blobs meet in one task, which gets its distinct keys with their
counts. A key that holds a third of all occurrences is one entry for each flush of a task.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.shared import runs

#: Keys that a task gathers before it adds them up and sends them on (16 bytes each).
FLUSH = 1 << 20
#: Bytes of text that a segment is meant to get its keys from.
SEGMENT_BYTES = 1 << 22
BLOBS = "segment long, keys binary, counts binary"


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def segment_bits(size: int, each: int = SEGMENT_BYTES) -> int:
    """Bits that number the segments of about `each` units."""
    return min(40, max(5, (size // each).bit_length()))


def segment_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value per run between `cuts`."""
    data = np.ascontiguousarray(values)
    width = data.dtype.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.Array.from_buffers(
        pa.binary(),
        len(cuts) - 1,
        [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(data)],
    )


def segment_blobs(segments: np.ndarray, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of BLOBS: values (of one or more columns) and counts, by segment."""
    order = np.argsort(segments, kind="stable")
    segments = segments[order]
    cuts = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1], [True]]))
    return pa.record_batch(
        [
            pa.array(segments[cuts[:-1]]),
            _blobs(values[order], cuts),
            _blobs(counts[order].astype(np.uint32), cuts),
        ],
        ["segment", "keys", "counts"],
    )


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts[:0]


def grouped_blobs(
    rows: DataFrame, work: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """`work(segment, keys, counts)` for each segment with all of its keys, which may repeat."""

    def mapper(batches):
        now, keys, counts = None, [], []
        for batch in batches:
            for segment, key, count in zip(*batch.columns, strict=True):
                segment = segment.as_py()
                if segment != now and keys:
                    yield from work(now, np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [], []
                now = segment
                keys.append(np.frombuffer(key.as_buffer(), np.uint64))
                counts.append(np.frombuffer(count.as_buffer(), np.uint32).astype(np.int64))
        if keys:
            yield from work(now, np.concatenate(keys), np.concatenate(counts))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(mapper, schema)


def tally(
    docs: DataFrame,
    keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]],
    bits: int,
    work: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Count keys: `keys_of` gives a run's keys and the routes, of which the upper `bits` name
    the segment (a key has one route); `work(segment, keys, counts)` gets distinct keys."""

    def mapper(batches):
        kept, size = [], 0

        def flush():
            keys, routes = (np.concatenate(x) for x in zip(*kept, strict=True))
            keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
            return segment_blobs(segment_of(routes[first], bits), keys, counts)

        for batch in batches:
            for run in runs(batch, "text"):
                keys, routes = keys_of(run)
                if not len(keys):
                    continue
                kept.append((keys, routes))
                size += len(keys)
                if size >= FLUSH:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    return grouped_blobs(
        docs.mapInArrow(mapper, BLOBS), lambda s, k, n: work(s, *added_up(k, n)), schema
    )
