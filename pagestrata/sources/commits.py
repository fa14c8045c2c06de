"""Append-only tables for several writers: numbered commits, each made by the first who takes its number.

The rows of an append are staged in a folder of their own, which nobody reads until a commit names it. A
commit is a small file under the next free number, put in place by an operation that fails if the number
is taken (a hard link on a local or mounted folder, a rename without overwriting elsewhere). Who loses reads
what the other committed, checks again, and takes the number after that; so a check always holds for
exactly the rows before the commit. Staged folders of refused or broken appends are never read.

The store must refuse to link or rename onto an existing name in one step, as local file systems and HDFS
do; a plain object store does not.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.errors import AuditError

# So many others may commit while one append is being checked.
TRIES = 100


class CommittedTable:
    """A table of Parquet folders that commits name, in order."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def commits(self) -> list[tuple[int, str]]:
        """Number and folder of every commit, in order (a small file per append)."""
        try:
            files = self.spark.read.text(f"{self.path}/commits", wholetext=True)
            rows = files.select(F.col("_metadata.file_name").alias("name"), "value").collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            return []
        found = sorted((int(row.name), row.value) for row in rows)
        if [number for number, _ in found] != list(range(1, len(found) + 1)):
            raise AuditError("COMMIT_GAP", f"The commits of {self.path} are not numbered without a gap.")
        return found

    def rows(self, commits: list[tuple[int, str]] | None = None) -> DataFrame:
        """All committed rows, or those of the commits given."""
        commits = self.commits() if commits is None else commits
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{folder}" for _, folder in commits])

    def append(self, checked: Callable[[DataFrame], DataFrame]) -> tuple[int, DataFrame]:
        """Commits ``checked(rows)``, which raises if the rows held forbid it; its number and the rows.

        If somebody else commits meanwhile, ``checked`` is asked again with what is held then.
        """
        for _ in range(TRIES):
            held = self.commits()
            folder = uuid.uuid4().hex
            checked(self.rows(held)).write.parquet(f"{self.path}/data/{folder}")
            if self._take(len(held) + 1, folder):
                return len(held) + 1, self.rows([(len(held) + 1, folder)])
        raise AuditError("COMMIT_CONFLICT", f"Others kept committing to {self.path}.")

    def _take(self, number: int, folder: str) -> bool:
        """Puts the file of a commit in place, unless its number is taken."""
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs
        target = hadoop.Path(f"{self.path}/commits/{number}")
        staged = hadoop.Path(f"{self.path}/commits/_{folder}")
        system = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(target.getParent())
        out = system.create(staged, False)
        out.write(bytearray(folder.encode()))
        out.close()
        try:
            if system.getUri().getScheme() == "file":
                os.link(staged.toUri().getPath(), target.toUri().getPath())
                return True
            return system.rename(staged, target)
        except FileExistsError:
            return False
        finally:
            system.delete(staged, False)
