"""Tables that are published together, by version.

A version is a folder with one or more tables. It is written in full first, and then
published by a small file whose name is its number and which is moved into place in one
step. Readers take the highest number, so they see all tables of one version, or all of
another; a load that fails before the last step is never seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from stoopwise.session import drop_path


class Versions:
    """The published versions below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Published versions, oldest first; there are as many as ``drop_older`` leaves."""
        folder = self._path(f"{self.root}/published")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int | None:
        found = self.numbers()
        return found[-1] if found else None

    def publish(self, tables: Mapping[str, DataFrame], after: int | None = None) -> int:
        """Write the tables and publish them as the next version; returns its number.

        With ``after`` the load was made from that version: if another one was published
        meanwhile nothing is, and a RuntimeError says so.
        """
        folder = f"{self.root}/versions/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        return self.point_to(folder, after)

    def point_to(self, folder: str, after: int | None = None) -> int:
        """Publish a folder that is written already."""
        last = self.latest()
        if after is not None and after != last:
            raise RuntimeError(f"version {last} was published after version {after}")
        number = (last or 0) + 1
        waiting = self._path(f"{self.root}/waiting/{uuid.uuid4().hex}")
        out = self._files.create(waiting)
        out.write(bytearray(folder.encode()))
        out.close()
        place = self._path(f"{self.root}/published/{number:012d}")
        self._files.mkdirs(place.getParent())
        if self._files.exists(place) or not self._files.rename(waiting, place):
            self._files.delete(waiting, False)
            raise RuntimeError(f"version {number} was published by another load")
        return number

    def folder(self, number: int) -> str:
        return self.spark.read.text(f"{self.root}/published/{number:012d}", wholetext=True).first()[0]

    def read(self, *names: str, number: int | None = None) -> dict[str, DataFrame]:
        """Tables of one version, the latest by default."""
        number = self.latest() if number is None else number
        if number is None:
            raise FileNotFoundError(f"nothing is published below {self.root}")
        folder = self.folder(number)
        return {name: self.spark.read.parquet(f"{folder}/{name}") for name in names}

    def drop_older(self, keep: int = 2) -> None:
        """Delete all versions but the last ``keep``; readers of older ones must be done."""
        for number in self.numbers()[:-keep]:
            folder = self.folder(number)
            drop_path(self.spark, f"{self.root}/published/{number:012d}")
            drop_path(self.spark, folder)
