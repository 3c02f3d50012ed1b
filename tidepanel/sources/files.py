"""Small files on whatever file system a path names, through Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme and whole name."""
    system, place = _at(spark, path)
    return system.makeQualified(place).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all in it; nothing where there is none."""
    system, place = _at(spark, path)
    system.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str:
    system, place = _at(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` beside ``path`` and rename it there, so that a reader never sees a part of it."""
    system, place = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    stream = system.create(part, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    system.delete(place, False)
    if not system.rename(part, place):
        raise OSError(f"{path} can't be written")


def sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, read as a stream."""
    system, place = _at(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def replace_folder(spark: SparkSession, written: str, path: str) -> None:
    """Put the folder ``written`` in the place of ``path``; the old one goes only once the new one is whole."""
    system, new = _at(spark, written)
    _, place = _at(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(path + ".old")
    system.delete(old, True)
    if system.exists(place) and not system.rename(place, old):
        raise OSError(f"{path} can't be replaced")
    if not system.rename(new, place):
        system.rename(old, place)
        raise OSError(f"{path} can't be written")
    system.delete(old, True)
