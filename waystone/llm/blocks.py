"""Documents in compressed blocks, and answers that come back to a block.

Work that compares everything with everything is cut by value: a block sends each value
range what it has of it, a range answers each block. Only these exchanges and the
compressed blocks travel; nothing is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.stage import stage
from .batches import SLICE_BYTES, byte_lengths, frugal, slices, texts_of

#: UTF-8 bytes of text in a block.
BLOCK_BYTES = 2 << 20
#: What a value range may hold, in bytes of its values.
RANGE_BYTES = 8 << 20

SCHEMA = "block long, ids array<long>, sizes array<long>, n_bytes long, z binary"


def stored_blocks(
    docs: DataFrame, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and the columns in ``carry``) in blocks, stored once so
    that numbers stay the same."""
    types = dict(docs.dtypes)
    extra = "".join(f", `{c}` array<{types[c]}>" for c in carry)

    @frugal
    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, limit=min(block_bytes, SLICE_BYTES)):
            texts = texts_of(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            sizes = byte_lengths(texts)
            data = b"".join(t.encode() for t in texts.to_pylist())
            n = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + number], pa.int64()), pa.ListArray.from_arrays(n, ids),
                    pa.ListArray.from_arrays(n, pa.array(sizes)), pa.array([len(data)], pa.int64()),
                    pa.array([pack.compress(data)], pa.binary()),
                    *(pa.ListArray.from_arrays(n, batch.column(c)) for c in carry),
                ],
                names=["block", "ids", "sizes", "n_bytes", "z", *carry],
            )
            number += 1

    return stage(docs.select("doc_id", "text", *carry).mapInArrow(run, SCHEMA + extra), "blocks")


class Block:
    """One row of stored blocks, unpacked."""

    def __init__(self, row: dict):
        self.number, self.row = row["block"], row
        self.ids = row["ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.raw = zstandard.ZstdDecompressor().decompress(row["z"], max_output_size=row["n_bytes"] + 1)
        self.data = np.frombuffer(self.raw, np.uint8)

    def texts(self) -> list[str]:
        ends = self.bounds.tolist()
        return [self.raw[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)]


def unpacked(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch.slice(k, 1).to_pylist()[0])


def range_count(blocks: DataFrame, share: float) -> int:
    """Value ranges for values that take ``share`` of the text's bytes: as many as the
    session has shuffle partitions, more where a range would outgrow ``RANGE_BYTES``."""
    total = blocks.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(total * share / RANGE_BYTES) + 1)


def with_answers(
    blocks: DataFrame, answers: DataFrame, work: Callable[[Block, pa.Table], list], schema: str
) -> DataFrame:
    """``work(block, its answers)`` gives record batches; every block gets its turn."""

    empty = arrow_schema(schema).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [batch for row in left.to_pylist() for batch in work(Block(row), right)]
        return pa.Table.from_batches(made) if made else empty

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def squeeze(values: np.ndarray, level: int = 1) -> bytes:
    """Numbers as compressed bytes."""
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(values).tobytes())


def spread(data: bytes, kind) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)
    return np.frombuffer(raw, kind)
