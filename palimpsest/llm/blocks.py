"""Blocks of whole rows: the unit that phases of one operator number, address and send answers to.

A block holds consecutive rows, all their columns, in up to ``PARTS`` parts: compressed Arrow streams of about
``limit`` text bytes each. Phases work part by part, which bounds their memory, and send one message per block and
bucket, so that messages stay few. Blocks are written before they are addressed, so that a recomputed task cannot
number them anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textvec
from .scratch import Phases

PART_BYTES, PARTS = 4 << 20, 4
SCHEMA = "block long, part int, body binary"


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(body)))


def _cut(text_col: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = textvec.string_buffer(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in textvec.pieces(offsets, limit):
                row = [pa.array([base + n // PARTS]), pa.array([n % PARTS], pa.int32()), pa.array([pack(batch.slice(a, b - a))], type=pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["block", "part", "body"])
                n += 1

    return run


def blocks(docs: DataFrame, text_col: str, phases: Phases, limit: int = PART_BYTES) -> DataFrame:
    """A written table (block, part, body) of all rows of ``docs``."""
    return phases.write(docs.mapInArrow(_cut(text_col, limit), SCHEMA), opaque=True)


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(block, its parts) of a stored table. A block that two tasks read halves of comes up in both of them."""

    def rows() -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                yield block, batch.column(2)[i].as_py()

    for block, parts in groupby(rows(), key=lambda row: row[0]):
        yield block, (body for _, body in parts)
