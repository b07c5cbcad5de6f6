"""Files that can be created once: how writers that know nothing of each other agree.

``create_once`` makes a whole file appear under a name, or tells that the name is taken; of any
number of writers at once exactly one succeeds. On a local or mounted folder the finished file is
linked to its name, which the file system refuses if the name exists; other file systems create it
without overwriting, which the name node (or store) decides. Nothing is checked first and written later.
"""
from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def create_once(spark: SparkSession, path: str, content: bytes = b"") -> bool:
    """Create ``path`` with ``content``; False, and nothing written, where it exists."""
    fs, p = _resolve(spark, path)
    if fs.getUri().getScheme() == "file":
        target = p.toUri().getPath()
        folder, name = os.path.split(target)
        os.makedirs(folder, exist_ok=True)
        draft = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        with open(draft, "wb") as file:
            file.write(content)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if not fs.exists(p):
            raise
        if "AlreadyExists" not in str(e.java_exception):
            raise
        return False
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder (none if there is no folder), without hidden ones."""
    fs, p = _resolve(spark, folder)
    if not fs.exists(p):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(p))
    return sorted(n for n in found if not n.startswith((".", "_")))


def make_folder(spark: SparkSession, folder: str) -> None:
    fs, p = _resolve(spark, folder)
    fs.mkdirs(p)
