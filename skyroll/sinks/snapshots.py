"""Numbered snapshots of a table, committed one after another (SNK2).

A writer puts its files into a folder of its own and then claims the next number by
creating that number's marker, which names the folder. Creating a marker fails if it
is there: of two writers that start from the same snapshot one wins, and the other
starts again from the winner's. Nobody's rows are lost, and a folder without a marker
(a failed or half-written run) is seen by no reader.

The claim is a hard link on local disks and a rename elsewhere; both refuse a taken
name on file systems with atomic renames (HDFS and its like). A store without them
needs one writer at a time.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_VERSION = re.compile(r"^v=(\d+)$")


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm

    def _entries(self) -> dict[int, str | None]:
        """Number -> folder of every claimed snapshot (None: claimed, not committed)."""
        fs, p, jvm = self._fs(self.path)
        if not fs.exists(p):
            return {}
        found: dict[int, str | None] = {}
        for status in fs.listStatus(p):
            m = _VERSION.match(status.getPath().getName())
            if not m:
                continue
            at = status.getPath()
            if status.isDirectory():     # a folder that is its own marker once complete
                done = fs.exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))
                found[int(m.group(1))] = at.toString() if done else None
                continue
            stream = fs.open(at)
            try:
                name = jvm.java.io.BufferedReader(
                    jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
            finally:
                stream.close()
            found[int(m.group(1))] = f"{self.path}/{name}"
        return found

    def committed(self) -> dict[int, str]:
        """Number -> folder of the committed snapshots, ascending."""
        return {v: folder for v, folder in sorted(self._entries().items()) if folder}

    def next_version(self) -> int:
        return max(self._entries(), default=0) + 1

    def marker(self, version: int) -> str:
        return f"{self.path}/v={version:06d}"

    def new_folder(self) -> str:
        """A folder that no other writer uses."""
        return f"{self.path}/data-{uuid.uuid4().hex}"

    def commit(self, folder: str, version: int) -> bool:
        """Make ``folder`` (under this path) snapshot ``version``; False if it is taken."""
        fs, mark, jvm = self._fs(self.marker(version))
        fs.mkdirs(mark.getParent())
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(folder.rsplit("/", 1)[1].encode() + b"\n"))
        out.close()
        if fs.getUri().getScheme() != "file":
            done = bool(fs.rename(draft, mark))
            if not done:
                fs.delete(draft, False)
            return done
        local = [jvm.java.io.File(x.toUri().getPath()).toPath() for x in (mark, draft)]
        try:
            jvm.java.nio.file.Files.createLink(*local)
            return True
        except Py4JJavaError as exc:
            if "FileAlreadyExists" not in exc.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(draft, False)

    def discard(self, folder: str) -> None:
        """Remove a folder of this writer that lost its claim."""
        fs, p, _ = self._fs(folder)
        fs.delete(p, True)
