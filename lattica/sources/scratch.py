"""A folder that driver and executors share, for tables that live as long as the application."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import RequestError


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.  Only a local master, whose tasks see the driver's disk, may do without that setting."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise RequestError("NO_SHARED_FOLDER", "set spark.checkpoint.dir to a folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "lattica-shared")
    return f"{top.rstrip('/')}/lattica-{sc.applicationId}"


def fresh(spark: SparkSession, suffix: str = "") -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}{suffix}"
