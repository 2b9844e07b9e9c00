"""Approximate nearest neighbours by shifted space-filling curves.

Unit vectors are projected on a few random directions, shifted, and put in the order of a
Hilbert curve; each of several curves has directions and a shift of its own.  Every curve is
cut into key ranges of equal numbers of rows.  A query meets all rows of its range and of the
two ranges beside it (its window), on every curve; what it meets is ranked by the exact
cosine, and the best over all curves are its neighbours.

Only queries are copied to the ranges beside theirs.  Equal vectors are one unit of the index
with its smallest ids, so that a vector that a third of the rows share costs one row; no more
of its ids than a result can hold are needed.

A window is a fixed share of the rows (three ranges of ``ranges``), at every size: vectors
without structure have no near neighbours in a small share of any order, and recall is a
function of that share.

Results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows without id, nor vectors of another length than the most frequent one.  Rows
of one id are one row (its smallest vector).  Queries with fewer candidates get fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import stored


@dataclass(frozen=True)
class Settings:
    curves: int = 16
    ranges: int = 32
    directions: int = 8
    bits: int = 4
    seed: int = 5


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (coordinates below ``2**bits``) on the Hilbert curve.

    Each axis is walked from its high bit down, exchanging or inverting lower bits so that
    the sub-cubes follow each other, then Gray-coded (the transposed form of the index).
    """
    axes = [c.copy() for c in cells.T.astype(np.int64)]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            set_ = (axes[i] & bit) != 0
            swap = np.where(set_, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(set_, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> level) & 1 == 1, turn ^ ((1 << level) - 1), turn)
    axes = [a ^ turn for a in axes]
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << 1) | ((a >> level) & 1)
    return key


def curve_keys(vectors: np.ndarray, s: Settings) -> np.ndarray:
    """Keys (rows x curves) of ``vectors``: the cell on each curve, then bits of the vector itself."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng(s.seed)
    width = vectors.shape[1]
    used = min(s.directions, width)
    # Components of random unit projections have standard deviation of about width ** -0.5.
    reach, cells = 3.0 * width**-0.5, 1 << s.bits
    out = np.empty((len(vectors), s.curves), dtype=np.int64)
    tie = (np.abs(unit @ rng.normal(size=width)) * 1e9).astype(np.int64) & 0xFFFF
    for c in range(s.curves):
        axes = np.linalg.qr(rng.normal(size=(width, used)))[0]
        shift = rng.random(used)
        scaled = (unit @ axes / reach + 1) / 2 * (cells - 1) + shift
        out[:, c] = (hilbert(np.clip(np.floor(scaled), 0, cells - 1).astype(np.int64), s.bits) << 16) | tie
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def units(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """Distinct vectors: unit (smallest id), embedding, ids (the k + 1 smallest), asked (is one a query)."""
    sound = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    length = sound.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").select("n").limit(1).collect()
    width = length[0]["n"] if length else 0
    single = sound.where(F.size("embedding") == width).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    single = single.withColumn("embedding", F.col("embedding").cast("array<double>"))
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = single.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    few = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = single.groupBy("embedding").agg(F.max(F.pmod("vec_id", F.lit(every)) == 0).alias("asked"))
    return few.join(asked, "embedding").select(F.col("ids")[0].alias("unit"), "embedding", "ids", "asked")


def _indexed(rows: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = curve_keys(_matrix(batch.column("embedding")), s)
                made = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(keys) + 1, dtype=np.int32) * s.curves), pa.array(keys.ravel())
                )
                yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "keys"])

    return rows.mapInArrow(run, "unit bigint, embedding array<double>, asked boolean, keys array<bigint>")


def _met(placed: DataFrame, k: int) -> DataFrame:
    """(query, unit, score): the best ``k`` units each query meets in one range of one curve."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        unit = table.column("unit").to_numpy()
        asks = table.column("asks").to_numpy()
        matrix = _matrix(table.column("embedding").combine_chunks())
        lengths = np.linalg.norm(matrix, axis=1)
        rows_q, rows_c = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: list[tuple] = []
        for first in range(0, len(rows_q), 256):
            q = rows_q[first : first + 256]
            best_s = np.full((len(q), 0), -np.inf)
            best_u = np.zeros((len(q), 0), dtype=np.int64)
            for begin in range(0, len(rows_c), 8192):
                c = rows_c[begin : begin + 8192]
                score = (matrix[q] @ matrix[c].T) / (lengths[q][:, None] * lengths[c][None])
                score = np.concatenate([best_s, np.where(unit[q][:, None] == unit[c][None], -np.inf, score)], axis=1)
                who = np.concatenate([best_u, np.broadcast_to(unit[c], (len(q), len(c)))], axis=1)
                # Rounded for the order only, so that equal scores go by id.
                order = np.lexsort((who, -np.round(score, 14)), axis=1)[:, :k] if score.shape[1] <= 64 else _top(score, who, k)
                best_s, best_u = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)
            keep = np.isfinite(best_s)
            found.append((np.broadcast_to(unit[q][:, None], keep.shape)[keep], best_u[keep]))
        query = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
        other = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(other)], ["query", "unit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place = None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column("place").to_numpy()
            cuts = [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if places[a] != place and held:
                    yield solve(held)
                    held = []
                place = places[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield solve(held)

    return placed.repartition("place").sortWithinPartitions("place").mapInArrow(run, "query bigint, unit bigint").distinct()


def _top(score: np.ndarray, who: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` best of each row, equal scores by ``who``."""
    rounded = np.round(score, 14)
    kth = -np.partition(-rounded, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(score), k), dtype=np.int64)
    for r in range(len(score)):
        near = np.flatnonzero(rounded[r] >= kth[r])
        out[r] = near[np.lexsort((who[r][near], -rounded[r][near]))[:k]]
    return out


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id ``every`` divides."""
    index = stored(units(vectors, k, every))
    keyed = stored(_indexed(index.select("unit", "embedding", "asked"), s))
    cuts = [i / s.ranges for i in range(1, s.ranges)]
    bounds = keyed.agg(
        *[F.percentile_approx(F.col("keys")[c], cuts, 10_000).alias(f"c{c}") for c in range(s.curves)]
    ).first()
    edges = F.array(*[F.array(*[F.lit(x) for x in sorted(set(bounds[c] or []))]).cast("array<bigint>") for c in range(s.curves)])
    on_curve = keyed.select("unit", "embedding", "asked", F.posexplode("keys").alias("curve", "key"))
    place = F.size(F.filter(F.element_at(edges, F.col("curve") + 1), lambda e: e < F.col("key")))
    on_curve = on_curve.withColumn("at", place)
    spot = lambda at: (F.col("curve") * (s.ranges + 2) + at + 1).alias("place")
    rows = on_curve.select(spot(F.col("at")), F.lit(False).alias("asks"), "unit", "embedding")
    around = F.explode(F.array(*[F.col("at") + d for d in (-1, 0, 1)])).alias("near")
    asking = on_curve.where("asked").select("curve", around, "unit", "embedding").select(
        spot(F.col("near")), F.lit(True).alias("asks"), "unit", "embedding"
    )
    met = stored(_met(rows.unionByName(asking), k))
    # Every query also meets the other rows of its own vector.
    own = index.where("asked").select(F.col("unit").alias("query"), "unit")
    one = index.select(F.col("unit").alias("query"), F.col("embedding").alias("a"))
    two = index.select("unit", F.col("embedding").alias("b"), "ids")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    score = dot(F.col("a"), F.col("b")) / (F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b"))))
    ranked = met.unionByName(own).join(one, "query").join(two, "unit").select("query", score.alias("score"), F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = ranked.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    # A unit's queries share what it found, each without itself.
    asks = (
        vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
        .groupBy(F.col("vec_id").alias("query_id"))
        .agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
        .join(index.select("embedding", F.col("unit").alias("query")), "embedding")
        .select("query_id", "query")
    )
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asks.join(ranked, "query")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
