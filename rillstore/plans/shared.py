"""What executors need from the driver: the package itself, and a folder that all share."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that its functions can be unpickled there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(root):  # already running from a shipped archive
        return
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".py"))
    blobs = [(os.path.relpath(f, os.path.dirname(root)), open(f, "rb").read()) for f in files]
    digest = hashlib.sha256(b"".join(n.encode() + b for n, b in blobs)).hexdigest()[:16]
    sc = spark.sparkContext
    if getattr(sc, "_rillstore_shipped", None) == digest:
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="rillstore")), f"rillstore_{digest}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name, blob in blobs:
            z.writestr(name, blob)
    sc.addPyFile(path)
    sc._rillstore_shipped = digest


def folder(spark: SparkSession) -> str:
    """Under spark.checkpoint.dir; a temporary folder only where that is unset and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rillstore"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/rillstore-{uuid.uuid4().hex}"
