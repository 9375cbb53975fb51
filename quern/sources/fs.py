"""Atomic small-file operations through Hadoop's FileSystem API, so that any shared store works."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class SharedFiles:
    """Driver-side access to one folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _p(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        p = self._p(folder)
        if not self._fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def is_folder(self, name: str) -> bool:
        return self.exists(name) and self._fs.getFileStatus(self._p(name)).isDirectory()

    def delete(self, name: str) -> None:
        self._fs.delete(self._p(name), True)

    def read_json(self, name: str) -> dict:
        stream = self._fs.open(self._p(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def create_json(self, name: str, content: dict) -> bool:
        """Create a file that must not exist yet; False if another writer was first.

        The content is written beside it and renamed without overwriting, so readers never see half
        a file and a writer that dies leaves only an unused part. That a rename does not replace a
        file is atomic on HDFS and stores with its semantics. A local disk checks and then renames,
        which is safe within one driver at a time. Object stores without an atomic rename need a
        committer of their own in place of this method; several writers at once are not safe there.
        """
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        part = self._p(f".{name.replace('/', '-')}.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        target = self._p(name)
        self._fs.mkdirs(target.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getParent().toUri() if target.getParent().toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(options, 1)
        plain[0] = options.NONE
        try:
            context.rename(part, target, plain)
            return True
        except Py4JJavaError:
            if not self._fs.exists(target):
                raise
            self._fs.delete(part, False)
            return False
