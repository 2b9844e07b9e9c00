"""Hard-negative mining by slots between the positives' upper limits.

An anchor's positives are the rows of its label that score highest with it.  A negative for a
positive of score s is a row of another label that scores from ``lowest * s`` to s: as many
windows as positives, which overlap.  Their upper limits cut the scores into disjoint slots:

    slot 0: (s2, s1]    slot 1: (s3, s2]    ...    last slot: [lowest * sm, sm]

Every block keeps the k best rows of each slot of an anchor, Spark merges the blocks' rows per
slot, and a positive's answer is read off its slot and those below it, which follow each other
in descending order: the k first of that suffix, cut at the positive's own lower limit.  No row
is looked at once per window, and an anchor never has more than positives x k rows together.

Anchors meet all rows in blocks that hold every label in proportion, so no label is a hot group.

Results: rows without id, with a null label or vector, or with a null or non-finite component
(also: times 256) take no part; of a repeated id the row of the smallest vector, then label,
counts.  A shorter vector counts as if it ended in zeros.  A positive of negative score has an
empty window.  Equal scores go by the smaller id; positives of equal score have equal answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.llm import vectors as V
from varve.llm.common import stored

FOUND = "anchor_id bigint, slot int, vec_id bigint, score bigint"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 5
    # The lower limit of a window as a fraction of its upper one, in whole numbers.
    low: int = 4
    low_of: int = 5


def least_score(positive: int, s: Settings) -> int:
    """The smallest whole score of at least ``low / low_of`` of the positive's."""
    return -(-s.low * positive // s.low_of)


class _Block:
    """A block's rows by id."""

    def __init__(self, rows: pa.Table, width: int):
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids)
        self.ids, self.labels = ids[order], rows.column("label").to_numpy()[order]
        vectors = rows.column("embedding").combine_chunks()
        self.m = V.matrix(vectors, width)[order] if len(ids) else np.zeros((0, width))
        self.of_label = {label: np.flatnonzero(self.labels == label) for label in np.unique(self.labels)}

    def positives(self, own: int, label: int, query: np.ndarray, k: int):
        rows = self.of_label.get(label, np.zeros(0, dtype=np.int64))
        rows = rows[self.ids[rows] != own]
        scores = V.products(query[None], self.m[rows])[0]
        top = V.best(scores, k)
        return np.zeros(len(top), dtype=np.int32), self.ids[rows[top]], scores[top]

    def negatives(self, label: int, scores: np.ndarray, limits: list[int], s: Settings):
        """The best rows of each slot; ``limits`` are distinct, descending and not negative."""
        rows = np.flatnonzero((self.labels != label) & (scores <= limits[0]) & (scores >= least_score(limits[-1], s)))
        slots = len(limits) - 1 - np.searchsorted(np.array(limits[::-1]), scores[rows])
        found = []
        for slot in np.unique(slots):
            inside = rows[slots == slot]
            found.append((slot, inside[V.best(scores[inside], s.negatives)]))
        rows = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
        return np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int32), self.ids[rows], scores[rows]


def _answers(anchors: np.ndarray, found: list) -> pa.RecordBatch:
    sizes = [len(f[0]) for f in found]
    columns = [np.repeat(anchors, sizes), *(np.concatenate([f[j] for f in found]) for j in range(3))]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor_id", "slot", "vec_id", "score"])


def _copies(anchors: DataFrame, blocks: int, limits: Column) -> DataFrame:
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    return anchors.select(every.alias("block"), F.lit(True).alias("asks"), "vec_id", "label", "embedding", limits.alias("limits"))


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(vectors: DataFrame, every: int = 100, s: Settings = Settings()) -> DataFrame:
    """Hard negatives of every anchor (a row whose id ``every`` divides) and each of its positives.

    ``vectors`` has vec_id, embedding and label (whole numbers); the result has anchor_id, positive_id, rank,
    negative_id, positive_score and negative_score.
    """
    spark = vectors.sparkSession
    labelled = vectors.where(V.is_sound("embedding") & F.col("label").isNotNull()).withColumn("label", F.col("label").cast("bigint"))
    sound = stored(V.one_per_id(labelled, "label"))
    total = sound.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not total["n"]:
        return spark.createDataFrame([], RESULT)
    width = total["width"]
    blocks = -(-total["n"] // V.rows_a_block(total["n"], width))
    no_limits = F.lit(None).cast("array<bigint>")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("bigint").alias("block")
    rows = sound.select(block, F.lit(False).alias("asks"), "vec_id", "label", "embedding", no_limits.alias("limits"))
    anchors = sound.where(F.col("vec_id") % every == 0)

    def ask_positives(b: _Block, part: pa.RecordBatch) -> pa.RecordBatch:
        own, labels, m = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), V.matrix(part.column("embedding"), width)
        return _answers(own, [b.positives(own[i], labels[i], m[i], s.positives) for i in range(len(own))])

    build = lambda t: _Block(t, width)
    met = V.by_block(rows.unionByName(_copies(anchors, blocks, no_limits)), build, ask_positives, FOUND)
    positives = stored(
        _best(met, ["anchor_id"], s.positives)
        .where("score >= 0")
        .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )

    # At most s.positives limits for each anchor.
    limits = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_set("positive_score"), asc=False).alias("limits")
    )

    def ask_negatives(b: _Block, part: pa.RecordBatch) -> pa.RecordBatch:
        own, labels, m = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), V.matrix(part.column("embedding"), width)
        given, found = part.column("limits").to_pylist(), []
        # Scores of some anchors at a time: rows x anchors stay below a few million.
        step = max(1, (4 << 20) // max(len(b.ids), 1))
        for start in range(0, len(own), step):
            scores = V.products(m[start : start + step], b.m)
            found += [b.negatives(labels[start + i], row, given[start + i], s) for i, row in enumerate(scores)]
        return _answers(own, found)

    asking = _copies(anchors.join(limits, "vec_id"), blocks, F.col("limits"))
    met = V.by_block(rows.unionByName(asking), build, ask_negatives, FOUND)
    slots = _best(met, ["anchor_id", "slot"], s.negatives)
    # Slots descend, so an anchor's rows in order of slot and place are in order of score and id.
    row = F.struct("slot", "place", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    lists = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    wanted = positives.join(limits.withColumnRenamed("vec_id", "anchor_id"), "anchor_id").withColumn(
        "slot", F.array_position("limits", F.col("positive_score")) - 1
    )
    lower = F.ceil(F.col("positive_score").cast("decimal(20,0)") * s.low / s.low_of)
    suffix = F.slice(F.filter("rows", lambda r: r["slot"] >= F.col("slot")), 1, s.negatives)
    answers = wanted.join(lists, "anchor_id").withColumn("found", F.filter(suffix, lambda r: r["negative_score"] >= lower))
    return answers.select("anchor_id", "positive_id", "positive_score", F.posexplode("found").alias("at", "r")).select(
        "anchor_id",
        "positive_id",
        (F.col("at") + 1).alias("rank"),
        "r.negative_id",
        "positive_score",
        "r.negative_score",
    )


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's labels: where 7 divides the id, the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", label.alias("label"))
