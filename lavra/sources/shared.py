"""The folder that driver and executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A path that does not exist yet, under spark.checkpoint.dir; only where that is unset and all runs on one
    machine (tests), under a new temporary folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lavra-')}")
        named = context.getCheckpointDir()
    return f"{named.rstrip('/')}/lavra-{what}-{uuid.uuid4().hex}"
