"""Numbered manifests: small files that say which data folders count.

Data are written into fresh folders first and published by the next manifest. A manifest is put in place by one rename that never replaces
another file, so of two writers one has to start over, readers see a change whole or not at all, and a crash before the rename
leaves everything as it was.
"""
from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm


def newest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the newest manifest of a folder; 0 and nothing before the first."""
    path, fs, jvm = _place(spark, f"{folder}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    number = max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit()), default=0)
    if not number:
        return 0, {}
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, f"{number:012d}.json"))
    try:
        return number, json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Put the manifest of this number in place; False if another writer was first."""
    path, fs, jvm = _place(spark, f"{folder}/manifests")
    draft, final = (jvm.org.apache.hadoop.fs.Path(path, n) for n in (f"draft-{uuid.uuid4().hex}", f"{number:012d}.json"))
    stream = fs.create(draft, False)
    stream.write(json.dumps(content, sort_keys=True).encode())
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    try:
        # Without the option to overwrite, an existing file makes this fail.
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(draft, False)
        return False
    return True


def sweep(spark: SparkSession, folder: str, named: set[str], keep: int = 1) -> int:
    """Remove folders that are not named and all but the ``keep`` newest manifests; the number of things removed.

    For times when no reader is on an older manifest.
    """
    path, fs, jvm = _place(spark, folder)
    inner = jvm.org.apache.hadoop.fs.Path(path, "manifests")
    if not fs.exists(inner):
        return 0
    manifests = sorted((s.getPath().getName(), s.getPath()) for s in fs.listStatus(inner))
    stays = {n for n, _ in manifests if n.endswith(".json") and not n.startswith(".")}
    stays = set(sorted(stays)[-keep:])
    gone = [p for n, p in manifests if n not in stays and not n.startswith(".")]
    gone += [p for p in (s.getPath() for s in fs.listStatus(path)) if p.getName() not in {*named, "manifests"} and not p.getName().startswith((".", "_"))]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
