"""Published snapshots of tables: written to a folder of their own, then named by the next number.

A writer says which snapshot it started from. It writes all its tables to a fresh folder, and publishes
them by a small file that is renamed to the next number and never over an existing one: of two
writers that started from one snapshot, the second one's rename fails and nothing of it is seen. Readers
see whole snapshots only and may keep to one number. The rename is the file system's; HDFS and its
like do it at once, a local disk checks first and then renames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has published in the meantime."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _names(self) -> dict[int, str]:
        """Number and folder of each published snapshot."""
        at = self._path("published")
        fs = at.getFileSystem(self._conf)
        if not fs.exists(at):
            return {}
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return {int(n.split("-", 1)[0]): n for n in names if n[:1].isdigit()}

    def current(self) -> int:
        """The newest number, 0 if nothing is published."""
        return max(self._names(), default=0)

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table of a snapshot, of the newest one unless a number is given."""
        number = self.current() if number is None else number
        at = self._path("published", f"{number:012d}")
        stream = at.getFileSystem(self._conf).open(at)
        try:
            own = bytes(stream.readAllBytes()).decode("ascii")
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.folder}/data/{own}/{table}")

    def commit(self, tables: dict[str, DataFrame], base: int) -> int:
        """Publishes the tables as the snapshot after `base`, or raises Conflict."""
        if self.current() != base:
            raise Conflict(f"snapshot {self.current()} was published after {base}")
        own = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/data/{own}/{name}")
        draft, final = self._path("drafts", own), self._path("published", f"{base + 1:012d}")
        stream = draft.getFileSystem(self._conf).create(draft, False)
        stream.write(bytearray(own.encode("ascii")))
        stream.close()
        final.getFileSystem(self._conf).mkdirs(self._path("published"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = none
        try:
            context.rename(draft, final, kinds)
        except Exception as e:  # the JVM's error for an existing name, by whatever file system
            if "AlreadyExists" in str(e) or final.getFileSystem(self._conf).exists(final):
                raise Conflict(f"snapshot {base + 1} was published by another writer") from e
            raise
        return base + 1
