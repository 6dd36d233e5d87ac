"""Numbered commits of a folder that all executors share.

A table that grows by parts names each part in a commit, which is written last: what no commit
names does not exist, be it the rest of a run that was lost, and nothing that was committed is
ever written again. Works on every file system that Hadoop knows.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Commits:
    """The commits below ``folder``: JSON files numbered from 0 on."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm, self.folder = spark._jvm, f"{folder.rstrip('/')}/commits"
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self.folder).getFileSystem(self._conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def all(self) -> list[dict]:
        """What was committed, in order; empty for a new folder."""
        place = self._path(self.folder)
        if not self._files.exists(place):
            return []
        found = []
        for status in self._files.listStatus(place):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith("."):
                stream = self._files.open(status.getPath())
                try:
                    found.append((int(name[:-5]), json.loads(bytes(stream.readAllBytes()))))
                finally:
                    stream.close()
        return [entry for _, entry in sorted(found, key=lambda f: f[0])]

    def add(self, number: int, entry: dict) -> None:
        """Commits ``entry`` under ``number``: wholly or not at all. A number that is taken, because
        another writer was faster, raises FileExistsError."""
        end = self._path(f"{self.folder}/{number:08}.json")
        start = self._path(f"{self.folder}/.{number:08}-{uuid.uuid4().hex}")
        stream = self._files.create(start, False)
        try:
            stream.write(bytearray(json.dumps(entry), "utf-8"))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(end.toUri() if end.toUri().getScheme() else self._files.getUri(), self._conf)
        try:
            # a rename that does not overwrite is the one step that decides
            context.rename(start, end, self._no_options)
        except Py4JJavaError as error:
            self._files.delete(start, False)
            if "AlreadyExists" in error.java_exception.getClass().getName() or self._files.exists(end):
                raise FileExistsError(f"commit {number} of {self.folder} was made by another writer") from None
            raise
