"""Small files on any file system that Spark reads, through Hadoop's file system API.

A new file appears whole or not at all: it is written under another name, synced, and then given its own name, which
fails if that name is taken. A local file gets it by a hard link and a sync of its folder; elsewhere the file system
renames without overwriting, which HDFS does in one step.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class Torn(ValueError):
    """A file that is no whole JSON document."""


class Files:
    """Listing, exclusive creation, reading and deletion under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._array = spark.sparkContext._gateway.new_array
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self.local = self._fs.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path) if not s.getPath().getName().startswith((".", "_")))

    def create(self, name: str, content: dict) -> bool:
        """Write a JSON file; False if it is there already. Whoever gives a number first has it."""
        folder, _, last = name.rpartition("/")
        part = f"{folder}/.{last}.{uuid.uuid4().hex}"
        data = json.dumps(content).encode()
        return self._create_local(name, part, data) if self.local else self._create(name, part, data)

    def _create_local(self, name: str, part: str, data: bytes) -> bool:
        target, part = (self._path(n).toUri().getPath() for n in (name, part))
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(part, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        self.sync(name.rpartition("/")[0])
        return True

    def _create(self, name: str, part: str, data: bytes) -> bool:
        self._fs.mkdirs(self._path(name).getParent())
        out = self._fs.create(self._path(part), False)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        try:
            context.rename(self._path(part), self._path(name), self._array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:  # py4j wraps the file system's own exceptions
            self._fs.delete(self._path(part), False)
            if self._fs.exists(self._path(name)):
                return False
            raise OSError(f"cannot create {name}") from e
        return True

    def sync(self, folder: str = "") -> None:
        """Make the names in a folder durable; other file systems than local ones keep them so by themselves."""
        path = self._path(folder).toUri().getPath()
        if self.local and os.path.isdir(path):
            handle = os.open(path, os.O_RDONLY)
            try:
                os.fsync(handle)
            finally:
                os.close(handle)

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError as e:
            raise Torn(name) from e
        finally:
            stream.close()

    def read_all(self, folder: str, names: list[str]) -> list[tuple[str, dict]]:
        """The files in order. A last one that is torn was never acknowledged: it goes, so that its name is free."""
        out = []
        for name in names:
            try:
                out.append((name, self.read(f"{folder}/{name}")))
            except Torn:
                if name != names[-1]:
                    raise
                self.delete(f"{folder}/{name}")
        return out

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def delete_path(self, path: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)
