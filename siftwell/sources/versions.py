"""Versioned contents with one atomic pointer, in a folder that all sessions share."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another session has committed this version first."""


@dataclass
class Versions:
    """Numbered JSON files; the highest number is the present version.

    A version appears whole, by a rename that fails if its number is taken, and never changes after that: readers of an
    earlier one are not disturbed, and of two writers that build on the same version one is told to begin anew.
    """

    spark: SparkSession
    path: str

    def _file(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._file("x").toUri(), conf)

    def all(self) -> list[int]:
        files, folder = self._files(), self._file("x").getParent()
        if not files.util().exists(folder):
            return []
        names = [s.getPath().getName() for s in files.util().listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def latest(self) -> int:
        """The present version; 0 if there is none yet."""
        return max(self.all(), default=0)

    def read(self, version: int) -> dict:
        return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(self._open(version))))

    def _open(self, version: int):
        return self._files().open(self._file(f"{version:09d}.json"))

    def commit(self, content: dict, after: int) -> int:
        """Makes content the version after `after`, and returns its number; Conflict if that exists."""
        jvm, files = self.spark.sparkContext._jvm, self._files()
        draft, final = self._file(f".draft-{uuid.uuid4().hex}"), self._file(f"{after + 1:09d}.json")
        create = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
        parents = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
        parents[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
        out = files.create(draft, create, parents)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            files.rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {after + 1} of {self.path} exists") from e
            raise
        return after + 1
