"""File-system checks through Hadoop's FileSystem API, so paths work the
same on a local disk, HDFS or an object store (the checkpoint folder of a
cluster is usually not local)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def list_names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p))


def join(*parts: str) -> str:
    head, *rest = parts
    return "/".join([head.rstrip("/")] + [r.strip("/") for r in rest])


def write_text_atomically(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under a hidden name, then rename it into place, so
    readers never see a partial file (a commit-log entry)."""
    jvm = spark.sparkContext._jvm
    final, fs = _path(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(final.getParent(), "." + final.getName() + ".tmp")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if not fs.rename(tmp, final):
        raise OSError(f"could not publish {path}")
