"""Folders for tables that a query writes and reads back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; on a local master without it, in one that is removed at exit."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told is None:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="rolloutlake-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        told = "file://" + _LOCAL[app]
    return f"{told}/{what}-{uuid.uuid4().hex}"
