"""Rows packed into compressed blobs before a shuffle.

A task collects the rows of each key and sends them as compressed Arrow streams,
so texts and word lists cross the network and the disks at a fraction of their
size. Spark still partitions, shuffles and groups by the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of rows that a task holds before it sends them.
HELD_BYTES = 24 << 20
#: Of compression; a third of the way to the smallest blobs at twice the time of the least level.
LEVEL = 3


def pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack(blobs: pa.ChunkedArray) -> pa.Table | None:
    """All rows of the blobs; None if there are none."""
    found = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs]
    return pa.concat_tables(found) if found else None


def split_by(rows: pa.Table, key: np.ndarray) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each key."""
    order = np.argsort(key, kind="stable")
    keys, starts = np.unique(key[order], return_index=True)
    rows = rows.take(pa.array(order))
    for k, a, b in zip(keys.tolist(), starts.tolist(), [*starts[1:].tolist(), len(key)]):
        yield k, rows.slice(a, b - a)


def packed(df: DataFrame, key: str) -> DataFrame:
    """``key, blob``: the rows of ``df`` (without the int column ``key``) packed by it."""
    return packed_by(df, key, lambda rows: rows[key].to_numpy(), drop=[key])


def packed_by(df: DataFrame, key: str, key_of: Callable[[pa.Table], np.ndarray], drop: list[str] = []) -> DataFrame:  # noqa: B006
    """``key, blob``: the rows of ``df`` (without the columns ``drop``) packed by what ``key_of`` gives for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys = sorted(held)
            blobs = [pack(pa.concat_tables(held[k]).combine_chunks()) for k in keys]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=[key, "blob"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for k, part in split_by(rows.drop_columns(drop), key_of(rows)):
                held.setdefault(k, []).append(part)
            size += batch.nbytes
            if size > HELD_BYTES:
                yield out()
                size = 0
        yield out()

    return df.mapInArrow(run, f"{key} int, blob binary")
