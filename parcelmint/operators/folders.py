"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        shared = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/parcelmint/{uuid.uuid4().hex}"
