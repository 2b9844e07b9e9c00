"""A fresh place for tables a query writes, in the storage the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from varve.sources.tables import Settings


def workspace(spark: SparkSession) -> Settings:
    """Own databases under ``spark.checkpoint.dir``; where it is unset, under the warehouse, which a
    cluster shares, or in a temporary folder if the session is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        local = spark.sparkContext.master.split("[")[0] == "local"
        shared = tempfile.mkdtemp() if local else spark.conf.get("spark.sql.warehouse.dir")
    name = uuid.uuid4().hex[:12]
    return Settings(root=f"{shared}/varve_{name}", env=f"w{name}")
