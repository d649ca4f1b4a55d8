"""Numbered versions of something in a folder: one JSON file each, committed by renaming it to a number that isn't taken."""

from __future__ import annotations

import json
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_LOCK = threading.Lock()


class VersionLog:
    """The versions under a folder; numbers begin with 1."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._context = spark.sparkContext
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, name: str):
        """A path in the folder, as Hadoop has it."""
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def fs(self):
        return self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, at = self.fs(), self.at("manifests")
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, n: int | None = None) -> dict | None:
        """What a version says, the newest by default; None before the first."""
        if n is None:
            there = self.versions()
            if not there:
                return None
            n = there[-1]
        stream = self.fs().open(self.at(f"manifests/{n:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, n: int, told: dict) -> bool:
        """Whether this became version n; False if there is one."""
        fs, tmp, to = self.fs(), self.at(f"manifests/.{uuid.uuid4().hex}"), self.at(f"manifests/{n:012d}.json")
        fs.mkdirs(self.at("manifests"))
        out = fs.create(tmp, False)
        try:
            out.write(bytearray(json.dumps(told).encode()))
        finally:
            out.close()
        options = self._context._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        with _LOCK:
            try:
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self._conf).rename(tmp, to, options)
                return True
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                    raise
                fs.delete(tmp, False)
                return False
