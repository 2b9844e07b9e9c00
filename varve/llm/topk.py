"""Exact top-k search by inner product, with pivot tables that eliminate candidates.

Pivots are spread-out rows of a sample.  The distance between a query q and a row x is at least
``max |d(q, p) - d(x, p)|`` over all pivots p, and ``2 q.x = |q|^2 + |x|^2 - d(q, x)^2``; so a
table of distances to the pivots gives every row a highest score it can have.

* *Cells.*  A row belongs to the cell of its nearest pivot.  A cell's least and largest distances
  to all pivots bound the scores of all its rows; this table has pivots x pivots entries at any
  size of the data.  Large cells are dealt to several blocks by a hash of the id.
* *First round.*  A query meets the block it lies in; its k-th score there is its floor.
* *Second round.*  It goes to the other blocks of those cells that may hold a score of its floor or
  more.  In a block, rows are evaluated from the highest bound down, until the next bound is below
  the k-th score found: the result is exact.

On vectors without structure bounds exclude little; then queries meet all rows, block by block,
and the work is that of brute force and of the bounds.

Results: vectors that are null, or hold null or non-finite components (also: times 256), and rows
without id take no part; of a repeated id the smallest vector counts.  A shorter vector counts as
if it ended in zeros, an empty one scores 0.  Queries with fewer candidates get fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm import vectors as V
from varve.llm.common import stored

# Pivots whose distances are compared before the rows they exclude go.
PIVOTS_AT_ONCE = 8
HITS = "query_id bigint, vec_id bigint, score bigint"


@dataclass(frozen=True)
class Settings:
    pivots: int = 32
    # Rows that pivots are chosen from: those of the smallest hashes of their ids.
    sample: int = 2_048


class Pivots:
    """The chosen pivots and distances to them."""

    def __init__(self, sample: np.ndarray, most: int):
        """Farthest first: each pivot is the sample's row that is farthest from those before it."""
        size = V.lengths(sample)
        chosen = [int(np.argmax(np.where(np.isfinite(size), size, -1)))]
        away = np.nan_to_num(self._apart(sample, sample[chosen])[:, 0])
        while len(chosen) < most and away.max() > 0:
            chosen.append(int(np.argmax(away)))
            away = np.minimum(away, np.nan_to_num(self._apart(sample, sample[chosen[-1:]])[:, 0]))
        self.rows, self.longest = sample[chosen], float(np.sqrt(size[chosen].max()))

    @staticmethod
    def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances; nan, which excludes nothing, where doubles cannot hold them."""
        with np.errstate(over="ignore", invalid="ignore"):
            square = V.lengths(a)[:, None] + V.lengths(b)[None] - 2 * (a @ b.T)
            return np.sqrt(np.maximum(np.where(np.isfinite(square), square, np.nan), 0))

    def table(self, m: np.ndarray) -> np.ndarray:
        return self._apart(m, self.rows)

    def cells(self, m: np.ndarray) -> np.ndarray:
        return np.argmin(np.nan_to_num(self.table(m), nan=np.inf), axis=1)


def highest(query_square, row_square, apart, longest_pivot: float) -> np.ndarray:
    """The highest score rows at a distance of at least ``apart`` can have, rounding allowed for; nan shows nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        sure = np.maximum(apart - 1e-7 * (np.sqrt(query_square) + np.sqrt(row_square) + longest_pivot), 0)
        top = (query_square + row_square) * (0.5 + 1e-9) - 0.5 * sure * sure + 1
    return np.where(np.isnan(top), np.inf, top)


def _index(rows: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = pivots.cells(V.matrix(batch.column("embedding"), width)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, "vec_id bigint, embedding array<double>, cell int")


class Cells:
    """Per cell: its rows, its longest one, and its least and largest distance to each pivot."""

    def __init__(self, index: DataFrame, pivots: Pivots, width: int, block_rows: int):
        n = len(pivots.rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = V.matrix(batch.column("embedding"), width)
                cell, far, square = batch.column("cell").to_numpy(), pivots.table(m), V.lengths(m)
                for c in np.unique(cell):
                    own = cell == c
                    columns = [np.full(n, c), np.arange(n, dtype=np.int32), np.full(n, own.sum()), np.full(n, square[own].max()),
                               far[own].min(axis=0), far[own].max(axis=0)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cell", "pivot", "n", "longest", "least", "most"])

        made = index.mapInArrow(run, "cell int, pivot int, n bigint, longest double, least double, most double")
        # At most pivots x pivots rows.  In Spark nan is greater than any number, also in max and min.
        summed = made.groupBy("cell", "pivot").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("longest", "most")],
                                                   F.min("least").alias("least"), F.max(F.isnan("least")).alias("unknown"))
        self.n, self.longest = np.zeros(n, dtype=np.int64), np.zeros(n)
        self.least, self.most = np.zeros((n, n)), np.zeros((n, n))
        for r in summed.collect():
            c, p = r["cell"], r["pivot"]
            self.n[c], self.longest[c], self.most[c, p] = r["n"], r["longest"], r["most"]
            self.least[c, p] = np.nan if r["unknown"] else r["least"]
        self.longest_pivot = pivots.longest
        self.blocks = -(-self.n // block_rows)
        self.first = np.cumsum(self.blocks) - self.blocks

    def bounds(self, square: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Highest score (queries x cells) of queries at distances ``far`` to the pivots."""
        out = np.empty((len(far), len(self.n)))
        with np.errstate(invalid="ignore"):
            for c in range(len(self.n)):
                # Of the pivots the one that shows most; those of which nothing is known show nothing.
                apart = np.fmax(np.fmax(self.least[c] - far, far - self.most[c]), 0).max(axis=1)
                out[:, c] = highest(square, self.longest[c], apart, self.longest_pivot)
        return out


class _Block:
    """A block's rows by id, with their distances to the pivots."""

    def __init__(self, rows: pa.Table, pivots: Pivots, width: int):
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids)
        vectors = rows.column("embedding").combine_chunks()
        self.ids, self.m = ids[order], V.matrix(vectors, width)[order] if len(ids) else np.zeros((0, width))
        self.square, self.far = V.lengths(self.m), np.ascontiguousarray(pivots.table(self.m).T)
        self.longest_pivot = pivots.longest

    def bounds(self, own: int, square: float, far: np.ndarray, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows that may score ``floor`` or more, and the highest scores they can have.

        Pivots are taken some at a time, and no longer once they exclude less than half of what is left.
        """
        live = np.flatnonzero(self.ids != own)
        apart = np.zeros(len(live))
        for start in range(0, len(far), PIVOTS_AT_ONCE):
            with np.errstate(invalid="ignore"):
                for p in range(start, min(start + PIVOTS_AT_ONCE, len(far))):
                    np.fmax(apart, np.abs(self.far[p][live] - far[p]), out=apart)
            top = highest(square, self.square[live], apart, self.longest_pivot)
            keep = np.ones(len(live), dtype=bool) if floor is None else top >= floor
            if 2 * keep.sum() > len(live):
                return live[keep], top[keep]
            live, apart, top = live[keep], apart[keep], top[keep]
        return live, top

    def search(self, own: int, query: np.ndarray, square: float, far: np.ndarray, k: int, floor: int | None):
        """Places and scores of the ``k`` best rows that score ``floor`` or more."""
        order, top = self.bounds(own, square, far, floor)
        by_bound = np.argsort(-top, kind="stable")
        order, top = order[by_bound], top[by_bound]
        places, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at, step = 0, 16 * k
        while at < len(order):
            if len(scores) == k and top[at] < scores[-1]:
                break
            some = order[at : at + step]
            places = np.concatenate([places, some])
            scores = np.concatenate([scores, V.products(query[None], self.m[some])[0]])
            keep = np.lexsort((places, -scores))[:k]
            places, scores = places[keep], scores[keep]
            at, step = at + step, min(2 * step, 8192)
        good = np.ones(len(scores), dtype=bool) if floor is None else scores >= floor
        return self.ids[places[good]], scores[good]


def _met(rows: DataFrame, pivots: Pivots, width: int, k: int) -> DataFrame:
    def ask(block: _Block, part: pa.RecordBatch) -> pa.RecordBatch:
        own, floors = part.column("vec_id").to_numpy(), part.column("floor").to_pylist()
        m = V.matrix(part.column("embedding"), width)
        square, far = V.lengths(m), pivots.table(m)
        found = [block.search(own[i], m[i], square[i], far[i], k, floors[i]) for i in range(len(own))]
        columns = [np.repeat(own, [len(f[0]) for f in found]), *(np.concatenate([f[j] for f in found]) for j in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return V.by_block(rows, lambda t: _Block(t, pivots, width), ask, HITS)


def _elsewhere(queries: DataFrame, pivots: Pivots, cells: Cells, width: int) -> DataFrame:
    """Queries once for each block, but their own, of the cells that may hold what they lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few queries at a time where each may go to very many blocks.
            step = max(1, 16_384 // int(cells.blocks.sum()))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                m = V.matrix(part.column("embedding"), width)
                floor = np.array([-np.inf if f is None else f for f in part.column("floor").to_pylist()])
                may = (cells.bounds(V.lengths(m), pivots.table(m)) >= floor[:, None]) & (cells.n > 0)
                who, cell = np.nonzero(may)
                count = cells.blocks[cell]
                who, begin = np.repeat(who, count), np.repeat(cells.first[cell] - (np.cumsum(count) - count), count)
                block = begin + np.arange(len(begin))
                other = block != part.column("block").to_numpy()[who]
                sent = part.take(pa.array(who[other]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[other]), *(sent.column(c) for c in ("asks", "vec_id", "embedding", "floor"))],
                    ["block", "asks", "vec_id", "embedding", "floor"],
                )

    return queries.mapInArrow(run, "block bigint, asks boolean, vec_id bigint, embedding array<double>, floor bigint")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    sound = stored(V.one_per_id(vectors.where(V.is_sound("embedding"))))
    total = sound.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not total["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = total["width"]
    few = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.sample).select("embedding").collect()
    sample = V.matrix(pa.array([r["embedding"] for r in few], pa.list_(pa.float64())), width)
    pivots = Pivots(sample, s.pivots)
    index = stored(_index(sound, pivots, width))
    cells = Cells(index, pivots, width, V.rows_a_block(total["n"], width))

    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
    block = (at(cells.first) + F.pmod(F.xxhash64("vec_id"), at(np.maximum(cells.blocks, 1)))).cast("bigint")
    no_floor = F.lit(None).cast("bigint").alias("floor")
    rows = index.select(block.alias("block"), F.lit(False).alias("asks"), "vec_id", "embedding", no_floor)
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("asks", F.lit(True))
    first = stored(_met(rows.unionByName(queries), pivots, width, k))
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asking = queries.drop("floor").join(floors, "vec_id", "left").select("block", "asks", "vec_id", "embedding", "floor")
    second = _met(rows.unionByName(_elsewhere(asking, pivots, cells, width)), pivots, width, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
