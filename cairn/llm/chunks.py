"""Texts in chunks that ask shards of a model for what they need, packed as arrays; inside tasks and between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Keys a part from which on each part is packed by itself, as short as it can be.
DENSE = 8
CHUNK_SCHEMA = "chunk long, docs binary"


def chunked(chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: chunk and docs, rows of about so many bytes of text as one compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts, held = [], 0

        def flushed() -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as stream:
                for part in parts:
                    stream.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["chunk", "docs"])

        for batch in batches:
            sizes, at = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), 0
            for end, size in enumerate(sizes.tolist(), 1):
                held += size
                if held >= chunk_bytes:
                    parts.append(batch.slice(at, end - at))
                    yield flushed()
                    number, parts, held, at = number + 1, [], 0, end
            if at < batch.num_rows:
                parts.append(batch.slice(at))
        if parts:
            yield flushed()

    return run


def rows_of(docs: bytes) -> pa.Table:
    """The rows of a chunk."""
    return pa.ipc.open_stream(docs).read_all()


def joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and where those of each row begin, and the end."""
    parts = column.to_pylist()
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), dtype=kind), np.cumsum([0, *(len(x) // size for x in parts)])


def cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values as a column of packed arrays that begin and end there."""
    return _binary(np.ascontiguousarray(values).view(np.uint8), np.asarray(ends) * values.dtype.itemsize)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A column of bytes that begin and end there."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def packed_parts(keys: np.ndarray, ends: np.ndarray) -> pa.Array:
    """packed() of the sorted keys, below 2 ** 32 - 1, between ends. Parts of few keys are written all at once, with differences of four bytes."""
    parts = len(ends) - 1
    if len(keys) >= DENSE * parts:
        return pa.array([packed(keys[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
    steps = np.diff(keys.astype(np.int64), prepend=0)
    begins = ends[:-1][np.diff(ends) > 0]
    steps[begins] = keys[begins].astype(np.int64)
    own = np.repeat(np.arange(parts), np.diff(ends)) + 1  # as many bytes of width stand before a key
    data = np.full(4 * len(keys) + parts, 4, dtype=np.uint8)
    at = 4 * np.arange(len(keys)) + own
    data[at[:, None] + np.arange(4)] = steps.astype("<u4").view(np.uint8).reshape(-1, 4)
    return _binary(data, 4 * ends + np.arange(parts + 1))


def edges_of(shards: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where the part of each shard in ``found`` begins, and the end, given the shard of each of sorted keys; none is in another.

    Only shards that have keys are looked at, so that a task's work doesn't grow with the number of shards.
    """
    return np.append(np.searchsorted(shards, found), len(shards))


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of two to four bytes, whichever are shortest; the largest number adds itself and goes on."""
    steps = np.diff(keys.astype(np.int64), prepend=0)
    width, most, more = min(((w, (1 << (8 * w)) - 1, steps // ((1 << (8 * w)) - 1)) for w in (2, 3, 4)), key=lambda x: x[0] * (len(steps) + int(x[2].sum())))
    out = np.full(len(steps) + int(more.sum()), most, dtype="<u4")
    out[np.cumsum(more + 1) - 1] = steps - more * most
    return bytes([width]) + out.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """What packed() was given, as 64-bit integers."""
    width = data[0]
    raw = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(raw), 4), dtype=np.uint8)
    steps[:, :width] = raw
    steps = steps.view("<u4").ravel().astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64)[steps != (1 << (8 * width)) - 1]
