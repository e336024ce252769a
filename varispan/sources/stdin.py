"""Standard input as a file that executors can read."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import SparkSession

BLOCK = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder for what comes from standard input")
    return "file://" + tempfile.mkdtemp(prefix="varispan-")


def path_of(spark: SparkSession, path: str, stream=None) -> str:
    """``path`` itself, or for ``-`` a copy of standard input; gzip is told by its first bytes. Goes when the driver ends."""
    if path != "-":
        return path
    stream = stream or sys.stdin.buffer
    block = stream.read(BLOCK)
    target = f"{shared_folder(spark)}/stdin-{uuid.uuid4().hex[:12]}.{'txt.gz' if block[:2] == b'\x1f\x8b' else 'txt'}"
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    out = fs.create(at)
    while block:
        out.write(bytearray(block))
        block = stream.read(BLOCK)
    out.close()
    return target
