from varve.operators.changes import apply_changes, new_images, read_changes
from varve.operators.dedupe import latest_by_key, rows_not_in
from varve.operators.merge import MergeResult, additive_merge, insert_only, merge, new, old, upsert
from varve.operators.scd2 import scd2_merge
from varve.operators.watermark import high_watermark, newer_than

__all__ = [
    "MergeResult",
    "additive_merge",
    "apply_changes",
    "high_watermark",
    "insert_only",
    "latest_by_key",
    "merge",
    "new",
    "new_images",
    "newer_than",
    "old",
    "read_changes",
    "rows_not_in",
    "scd2_merge",
    "upsert",
]
