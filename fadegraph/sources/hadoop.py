"""The few file operations a manifest needs, on whatever file system a path names."""
from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text_once(spark: SparkSession, path: str, text: str) -> None:
    """Write ``path``, or raise if it is there already; of several writers one succeeds.

    On a local file system a whole file of another name is linked to it, which is atomic.  On others the file is created
    without leave to overwrite, which HDFS and stores with conditional puts do atomically; who reads it must bear an unfinished one.
    """
    fs, p = _fs(spark, path)
    local = fs.getUri().getScheme() == "file"
    beside = _fs(spark, f"{path}.{uuid.uuid4().hex}")[1] if local else p
    fs.mkdirs(p.getParent())
    try:
        stream = fs.create(beside, False)
    except Py4JJavaError as e:
        raise FileExistsError(f"another writer committed {path}") from e
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if local:
        files, paths = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Paths
        try:
            files.createLink(paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0)),
                             paths.get(beside.toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0)))
        except Py4JJavaError as e:
            raise FileExistsError(f"another writer committed {path}") from e
        finally:
            fs.delete(beside, False)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder or file with what is in it."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)
