"""Vectors of whole numbers, in blocks: what exact search and negative mining share.

Every component x becomes floor(256 x), a double that holds a whole number exactly.  Inner
products are whole too, and computed as such: by matrix multiplication where no sum can leave
the doubles' exact range, by Python integers otherwise.  Scores beyond a long are the longest
of their sign.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
MOST = 2**63 - 1
# No block is wider than this many bytes of doubles, nor longer than so many rows.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 1 << 16
# Tables are cut into so many blocks if they have the rows, so that all cores have work.
BLOCKS = 64


def is_sound(vector: Column | str) -> Column:
    """No null vector, no null component, and 256 times every component is finite."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))


def one_per_id(rows: DataFrame, *rest: str) -> DataFrame:
    """vec_id, embedding (array<double>) and ``rest``: rows without id go, of a repeated id the smallest stays."""
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    one = F.min(F.struct(vector, *rest)).alias("row")
    return rows.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(one).select("vec_id", "row.*")


def rows_a_block(n: int, width: int) -> int:
    """Rows of a block of a table of ``n`` vectors: bounded in rows and bytes, at least ``BLOCKS`` blocks if it is long."""
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width, 1)), max(256, -(-n // BLOCKS))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column times 256, floored; shorter ones end in zeros."""
    starts = np.asarray(column.offsets)
    sizes, flat = np.diff(starts), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], sizes)] = flat
    return np.floor(out * SCALE)


def lengths(m: np.ndarray) -> np.ndarray:
    """Squared lengths; infinite where a double cannot hold them."""
    with np.errstate(over="ignore"):
        return np.einsum("ij,ij->i", m, m)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products (rows of ``a`` x rows of ``b``) as longs."""
    largest = np.sqrt(lengths(a).max(initial=0.0)) * np.sqrt(lengths(b).max(initial=0.0))
    if largest < 2.0**52:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a).reshape(a.shape) @ whole(b).reshape(b.shape).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, equal ones in the order of their places."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.argsort(-scores[places], kind="stable")[:k]]


def by_block(
    rows: DataFrame,
    build: Callable[[pa.Table], object],
    ask: Callable[[object, pa.RecordBatch], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """What the rows of each ``block`` that ``asks`` get of those that do not.

    A task holds one block's rows at a time, built before the first question; questions stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, built = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(of)]):
                if of[a] != block:
                    block, held, built = of[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(part)
                    continue
                if built is None:
                    built, held = build(pa.Table.from_batches(held, batch.schema)), []
                yield ask(built, part)

    return rows.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(run, schema)
