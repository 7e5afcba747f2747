"""Small-file operations on any file system Spark knows, through Hadoop's API on the driver."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import SparkSession

from ..errors import ConflictError, NotFound


class Store:
    """A folder on a Hadoop file system. Only metadata goes through here; table data is read and written by Spark."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def at(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def qualified(self) -> str:
        return self._fs.makeQualified(self._path(self.root)).toString()

    def _p(self, name: str):
        return self._path(self.at(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def mkdirs(self, name: str = "") -> None:
        self._fs.mkdirs(self._p(name))

    def read(self, name: str) -> str:
        if not self.exists(name):
            raise NotFound(f"{self.at(name)} doesn't exist")
        stream = self._fs.open(self._p(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace a small file: written beside it, then renamed over it in one step, so that readers see the old or the new one."""
        own = f"{name}.tmp-{uuid.uuid4().hex}"
        self._create(own, text, False)
        try:
            self._replace(own, name)
        except Exception:
            self.delete(own)
            raise

    def _replace(self, own: str, name: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        source, target = (self._fs.makeQualified(self._p(n)) for n in (own, name))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, target, how)

    def _create(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs.create(self._p(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Create a file that must not exist; False if it does."""
        if self.exists(name):
            return False
        try:
            self._create(name, text, False)
        except Exception as e:
            if "already exists" in str(e):
                return False
            raise
        return True

    def age(self, name: str) -> float | None:
        """Seconds since a file was last written, or None if it isn't there."""
        try:
            return time.time() - self._fs.getFileStatus(self._p(name)).getModificationTime() / 1000
        except Exception:
            if self.exists(name):
                raise
            return None

    @contextmanager
    def beating(self, name: str, text: str, every: float) -> Iterator[None]:
        """Write a file again every so many seconds, so that its age tells whether its owner lives."""
        done = threading.Event()

        def beat() -> None:
            while not done.wait(every):
                with suppress(Exception):  # a missed beat only ages the file
                    if self.exists(name) and self.read(name) == text:
                        self._create(name, text, True)

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()

    def rename(self, old: str, new: str) -> None:
        if self.exists(new) or not self._fs.rename(self._p(old), self._p(new)):
            raise ConflictError(f"{self.at(old)} can't become {self.at(new)}")

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._p(name), True)

    def list(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(name)))

    def is_dir(self, name: str) -> bool:
        return self.exists(name) and self._fs.getFileStatus(self._p(name)).isDirectory()

    def sha256(self, name: str) -> str:
        """The digest of one small file."""
        stream = self._fs.open(self._p(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def files(self, name: str) -> dict[str, int]:
        """Sizes of all files below a folder, by path from the root; hidden and checksum files are left out."""
        out: dict[str, int] = {}
        if not self.exists(name):
            return out
        it = self._fs.listFiles(self._p(name), True)
        base = self._fs.makeQualified(self._path(self.root)).toUri().getPath().rstrip("/") + "/"
        while it.hasNext():
            s = it.next()
            path = s.getPath().toUri().getPath()
            leaf = os.path.basename(path)
            if not leaf.startswith((".", "_")):
                out[path[len(base) :]] = s.getLen()
        return out

    def copy_to(self, name: str, target: str) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        to = self._path(target)
        util = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
        if not util.copy(self._fs, self._p(name), to.getFileSystem(conf), to, False, conf):
            raise ConflictError(f"{self.at(name)} can't be copied to {target}")

    def read_json(self, name: str):
        return json.loads(self.read(name))

    def write_json(self, name: str, value) -> None:
        self.write(name, json.dumps(value, indent=1))

    def free_bytes(self) -> int:
        return self._fs.getStatus().getRemaining()
