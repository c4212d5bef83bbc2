"""A11 for several builders at once: a table is there when a pointer file names it.

Every builder writes a folder of its own. The pointer is written aside and put in place by one step of the file system that fails if there is
a pointer already, so of several builders exactly one commits; the others drop their own folder and read the table that the
pointer names. A table, once named, is never changed, moved or deleted, and an interrupted build leaves no pointer.

The step is a rename on file systems whose rename refuses an existing target (HDFS), and a hard link on a local one. An object store without
either has no such step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

POINTER = "_CURRENT"


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        fs = self.at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(self.at(""))
        self.local = fs.resolvePath(self.at("")).toUri().getScheme() == "file"
        # Without checksum files beside the pointer.
        self.fs = fs.getRawFileSystem() if hasattr(fs, "getRawFileSystem") and fs.getScheme() == "file" else fs

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, content: str) -> bool:
        """Put a file in place in one step; False if there is one."""
        aside = f"{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self.at(aside), False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if not self.local:
                return bool(self.fs.rename(self.at(aside), self.at(name)))
            paths = self.jvm.java.nio.file.Paths
            real = lambda n: paths.get(self.fs.resolvePath(self.at(n if n == aside else aside)).toUri()).resolveSibling(n)
            self.jvm.java.nio.file.Files.createLink(real(name), real(aside))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            self.fs.delete(self.at(aside), False)

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None."""
    name = _Folder(spark, path).read(POINTER)
    return None if name is None else spark.read.parquet(f"{path}/{name}")


def committed_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` that hold a committed table."""
    top = _Folder(spark, path)
    names = [s.getPath().getName() for s in top.fs.listStatus(top.at(""))]
    return sorted(n for n in names if top.fs.exists(top.at(f"{n}/{POINTER}")))


def build_once(spark: SparkSession, build: Callable[[], DataFrame], path: str) -> DataFrame:
    """The table at ``path``; ``build`` is called only if no builder has committed one."""
    folder = _Folder(spark, path)
    name = folder.read(POINTER)
    if name is None:
        own = f"table-{uuid.uuid4().hex}"
        build().write.parquet(f"{path}/{own}")
        if folder.create(POINTER, own):
            name = own
        else:
            folder.drop(own)
            name = folder.read(POINTER)
    return spark.read.parquet(f"{path}/{name}")
