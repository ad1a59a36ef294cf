"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
_OWN = "factloom.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a new folder below the warehouse, or, if
    the session runs in this process alone, a temporary one."""
    base = spark.conf.get(SETTING, None) or spark.conf.get(_OWN, None)
    if not base:
        alone = spark.sparkContext.master.startswith("local")
        if alone:
            base = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/factloom-{uuid.uuid4().hex}"
        spark.conf.set(_OWN, base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new table there."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
