"""varve: incremental lakehouse operators for PySpark.

Bronze lands files exactly once, silver cleans and merges them into current-state,
history and fact tables, gold folds each new batch of facts into marts.  Everything is
DataFrame in, DataFrame out; only ``varve.sources.tables`` and the plans write.
"""

from varve.operators.merge import MergeResult, additive_merge, insert_only, merge, upsert
from varve.operators.scd2 import scd2_merge

__all__ = ["MergeResult", "additive_merge", "insert_only", "merge", "scd2_merge", "upsert"]
