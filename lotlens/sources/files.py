"""Small driver-side file work on the target's own Hadoop FileSystem: atomic texts, folders, removal."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath, jvm


def _has_jvm(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext._jvm is not None
    except Exception:  # noqa: BLE001 - Spark Connect
        return False


def write_text_atomic(spark: SparkSession, path: str, text: str) -> None:
    """Small driver-side file (the manifest) via the target's Hadoop FS: written
    beside it, then renamed over it, so a reader sees the old or the new text.
    Without a JVM handle (Spark Connect) it is written as a one-row
    text dataset instead (still last, still a marker)."""
    if not _has_jvm(spark):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    _, final, jvm = _fs(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fs, tmp, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(tmp, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(tmp, final, overwrite)


def read_text(spark: SparkSession, path: str) -> str:
    if not _has_jvm(spark):
        try:
            return "\n".join(r.value for r in spark.read.text(path).collect())
        except Exception as exc:  # noqa: BLE001
            raise FileNotFoundError(path) from exc
    fs, hpath, jvm = _fs(spark, path)
    if not fs.exists(hpath):
        raise FileNotFoundError(path)
    stream = fs.open(hpath)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path`` (none if there is no such path)."""
    fs, hpath, _ = _fs(spark, path)
    if not fs.exists(hpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hpath) if s.isDirectory())


def remove_folder(spark: SparkSession, path: str) -> None:
    """The folder and what is in it, if there is one.  (Without a JVM handle nothing is removed.)"""
    if _has_jvm(spark):
        fs, hpath, _ = _fs(spark, path)
        fs.delete(hpath, True)
