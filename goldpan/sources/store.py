"""Single files in whatever file system a path names, through Spark: the same store that Spark's readers see."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

CHUNK = 1 << 20


def _at(path) -> tuple:
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(path) -> bool:
    fs, where = _at(path)
    return fs.exists(where)


def chunks(path) -> Iterator[bytes]:
    fs, where = _at(path)
    source = fs.open(where)
    try:
        while part := bytes(source.readNBytes(CHUNK)):
            yield part
    finally:
        source.close()


def text(path) -> str:
    return b"".join(chunks(path)).decode()


def digest(parts: Iterable[bytes]) -> str:
    sha = hashlib.sha256()
    for part in parts:
        sha.update(part)
    return "sha256:" + sha.hexdigest()


def file_hash(path) -> str:
    return digest(chunks(path))


def write(path, parts: Iterable[bytes]) -> str:
    """Written beside its place and then moved there, so a reader sees the whole file or none; its hash."""
    fs, where = _at(path)
    beside = where.suffix(f".{uuid.uuid4().hex}.part")

    def copied(sink) -> Iterator[bytes]:
        for part in parts:
            sink.write(bytearray(part))
            yield part

    sink = fs.create(beside, True)
    try:
        found = digest(copied(sink))
    finally:
        sink.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"{beside} can't be moved to {where}")
    return found


def write_json(value: dict, path) -> str:
    """The path."""
    write(path, [json.dumps(value, indent=2, sort_keys=True).encode()])
    return str(path)
