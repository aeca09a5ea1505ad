"""Asked rows against blocks of other rows: a task holds one block at a time and the asked rows stream past."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def against_blocks(
    index: DataFrame, asked: DataFrame, parts: int, held: Callable[[pa.Table], object],
    answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """``answer(held(rows of a block), batch of asked rows)`` for each row of ``asked`` and the block it names.

    Both frames have ``part``, the number of a block. The rows of a block move once, whatever number
    of rows ask; a task holds the rows of one block, which the caller keeps to a bound, and one batch
    of asked rows. Blocks that nobody asks are not built.
    """
    both = index.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartitionById(parts, "part").sortWithinPartitions("part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("part").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                piece, (own, asks) = batch.slice(a, b - a), divmod(int(key[a]), 2)
                if own != part:
                    part, rows, block = own, [], None
                if not asks:
                    rows.append(piece)
                    continue
                if rows:
                    block, rows = held(pa.Table.from_batches(rows)), []
                if block is not None:
                    yield from answer(block, piece)

    return dealt.mapInArrow(run, schema)
