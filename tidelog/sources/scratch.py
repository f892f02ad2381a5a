"""Folders for tables and files that a query writes on its way, in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path. Only a local session may go without the setting: a cluster's machines share no other folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = tempfile.mkdtemp(prefix="tidelog-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
