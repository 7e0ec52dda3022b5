"""Folders for what a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid


def folder(spark, name: str) -> str:
    """A path that no other run uses, below the folder that all executors share (spark.checkpoint.dir); a folder of our own
    only where that is unset and all tasks run in this process."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master") or ""):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='galacov-')}"
    return f"{root.rstrip('/')}/galacov-{uuid.uuid4().hex}/{name}"
