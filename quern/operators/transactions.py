"""Reversible changes: tables in versions, SQL with commit and rollback, a log of what undoes what, retries."""

from __future__ import annotations

import random
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """A table as a folder of Parquet versions; which one holds is a row in the folder's log, so undo writes no data.

    The log has one row per commit or undo: (seq, version). A version is never changed once it is written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> list[int]:
        """Versions in the order of the log; one per change of the table."""
        try:
            rows = self.spark.read.schema("seq long, version long").json(f"{self.path}/log").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return [r["version"] for r in sorted(rows, key=lambda r: r["seq"])]

    def _history(self) -> list[int]:
        """The stack of versions: a commit (a new number) is put on it, an undo (-1) takes the last one off."""
        stack: list[int] = []
        for v in self._log():
            if v >= 0:
                stack.append(v)
            elif len(stack) > 1:
                stack.pop()
        return stack

    def _append(self, version: int) -> None:
        n = len(self._log())
        self.spark.createDataFrame([(n, version)], "seq long, version long").coalesce(1).write.mode("append").json(f"{self.path}/log")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self._history()[-1]}")

    def commit(self, df: DataFrame) -> int:
        n = sum(v >= 0 for v in self._log())
        df.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        self._append(n)
        return n

    def undo(self) -> bool:
        """Back to the version before; False at the first one."""
        if len(self._history()) < 2:
            return False
        self._append(-1)
        return True


class Folder:
    """A folder of files with versions: commit takes the files as they are, undo puts back what was before.

    A version is a table of (path, content); files are read and written by the tasks, through the file system that the
    folder's address names, so the folder must be one that all executors see.
    """

    def __init__(self, spark: SparkSession, folder: str, versions: str):
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), Versions(spark, versions)

    def files(self) -> DataFrame:
        """(path, content) of the files as they are now; the path is that below the folder."""
        try:
            got = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "path string, content binary")
        base = self.folder.split(":", 1)[-1].lstrip("/")
        return got.select(F.regexp_replace("path", rf"^[a-z0-9]*:?/*{re.escape(base)}/", "").alias("path"), "content")

    def write(self, files: DataFrame) -> int:
        """Writes files (path, content); how many there were."""
        folder = self.folder

        def put(batches):
            import pyarrow as pa
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(folder)
            for b in batches:
                for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                    system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(f"{base}/{path}") as f:
                        f.write(content)
                yield pa.record_batch([b.column("path")], ["path"])

        return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(put, "path string").count()

    def commit(self) -> int:
        return self.versions.commit(self.files())

    def changes(self) -> DataFrame:
        """(path, change) since the last commit: added, removed or changed."""
        now = self.files().select("path", F.sha2("content", 256).alias("now"))
        old = self.versions.read().select("path", F.sha2("content", 256).alias("old"))
        both = now.join(old, "path", "full").filter(~F.col("now").eqNullSafe(F.col("old")))
        return both.select("path", F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))

    def restore(self) -> None:
        """The files of the version that holds; others go."""
        gone = self.changes().filter("change = 'added'").select("path")
        for r in gone.toLocalIterator():
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{r['path']}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, False)
        self.write(self.versions.read())

    def undo(self) -> bool:
        """Back to the version before; False at the first one."""
        if not self.versions.undo():
            return False
        self.restore()
        return True


class Database:
    """Tables with a working state: statements change it, commit keeps it, rollback drops it.

    Statements: SELECT ..., INSERT INTO t SELECT or VALUES ..., DELETE FROM t [WHERE c], UPDATE t SET a = e, ... [WHERE c];
    their queries can read all tables as they are at that moment. A commit writes the changed tables as new versions and
    then one log file that names them all, so that either all of a commit is seen or nothing of it.
    """

    def __init__(self, spark: SparkSession, path: str):
        # a session of its own, so that its views hide no one else's
        self.spark, self.path, self.work = spark.newSession(), path, {}

    def _kept(self) -> tuple[int, dict[str, str]]:
        """The number of the next commit, and the folder of each table that the last one of it wrote."""
        try:
            rows = self.spark.read.schema("seq long, name string, folder string").json(f"{self.path}/commits").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return max([-1, *(r["seq"] for r in rows)]) + 1, {r["name"]: r["folder"] for r in sorted(rows, key=lambda r: r["seq"])}

    def _keep(self, tables: dict[str, DataFrame]) -> None:
        seq, _ = self._kept()
        rows = []
        for name, df in tables.items():
            folder = f"{name}/v{seq}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.path}/{folder}")
            rows.append((seq, name, folder))
        if rows:
            self.spark.createDataFrame(rows, "seq long, name string, folder string").coalesce(1).write.mode("append").json(f"{self.path}/commits")

    def table(self, name: str) -> DataFrame:
        return self.work[name] if name in self.work else self.spark.read.parquet(f"{self.path}/{self._kept()[1][name]}")

    def create(self, name: str, df: DataFrame) -> None:
        self._keep({name: df})

    def fetch(self, sql: str) -> DataFrame | None:
        """The rows of a SELECT; None if it fails."""
        try:
            return self._query(sql)
        except Exception:
            return None

    def _query(self, sql: str) -> DataFrame:
        """The rows of a query, to which each table is a view as it is now."""
        for name in {*self._kept()[1], *self.work}:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql)

    def execute(self, statements: str) -> int:
        """0 if all statements, separated by semicolons, went through, else 1; lines that open with -- are left out."""
        before = dict(self.work)
        try:
            for s in (x.strip() for x in statements.split(";")):
                if s and not s.startswith("--"):
                    self._one(s)
            return 0
        except Exception:
            self.work = before
            return 1

    def _one(self, s: str) -> None:
        if m := re.match(r"(?is)insert\s+into\s+(\w+)\s+(.*)", s):
            old = self.table(m[1])
            new = self._query(m[2].strip() if m[2].strip().lower().startswith(("select", "values", "with")) else "select " + m[2])
            self.work[m[1]] = old.union(new.toDF(*old.columns))
        elif m := re.match(r"(?is)delete\s+from\s+(\w+)(?:\s+where\s+(.*))?$", s):
            keep = ~F.coalesce(F.expr(m[2]), F.lit(False)) if m[2] else F.lit(False)
            self.work[m[1]] = self.table(m[1]).filter(keep)
        elif m := re.match(r"(?is)update\s+(\w+)\s+set\s+(.*?)(?:\s+where\s+(.*))?$", s):
            old = self.table(m[1])
            hit = F.coalesce(F.expr(m[3]), F.lit(False)) if m[3] else F.lit(True)
            new = {k.strip(): F.expr(e) for k, e in (a.split("=", 1) for a in re.split(r",(?![^()]*\))", m[2]))}
            self.work[m[1]] = old.select(*[F.when(hit, new[c].cast(t)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c, t in old.dtypes])
        elif re.match(r"(?is)\s*(select|with)\b", s):
            self._query(s)
        else:
            raise ValueError(f"no such statement: {s[:40]}")

    def commit(self) -> None:
        self._keep(self.work)
        self.work = {}

    def rollback(self) -> None:
        self.work = {}


def reversals(log: DataFrame) -> DataFrame:
    """(forward, success, failures) from a log (forward, back, outcome, seq): the first call that undid it, and all that didn't."""
    ok = F.col("outcome")
    tried = F.transform(F.sort_array(F.collect_list(F.when(~ok, F.struct("seq", "back")))), lambda x: x["back"])
    return log.groupBy("forward").agg(F.min_by(F.when(ok, F.col("back")), F.when(ok, F.col("seq"))).alias("success"), tried.alias("failures"))


def retried(f: Callable, attempts: int = 3, first: float = 1.0, most: float = 60.0, errors: tuple = (Exception,), sleep: Callable[[float], None] = time.sleep):
    """The result of ``f``, tried again after a growing random pause; the last error is raised."""
    for k in range(attempts):
        try:
            return f()
        except errors:
            if k + 1 == attempts:
                raise
            sleep(random.uniform(0, min(most, first * 2**k)))
