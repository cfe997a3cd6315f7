"""Session settings and durable intermediate tables.

Iterative operators cut lineage by writing each round as a Parquet table below the folder named by
``spark.checkpoint.dir``. All executors share that folder, so a lost executor costs a re-read and never a
recomputation from the start. Only a ``local`` master may fall back to a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Folders of the workspaces of this process.
_ROOTS: set[str] = set()


def build_session(app: str = "strandloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC times and adaptive execution; master and partitions are left to the cluster if None."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return _FALLBACK[app]


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def release(spark: SparkSession) -> None:
    """Remove the durable tables of all operators called so far; results that still read them can't be used any more."""
    while _ROOTS:
        files, place = _file_system(spark, _ROOTS.pop())
        files.delete(place, True)


def sweep(spark: SparkSession, hours: float = 48) -> list[str]:
    """Remove what earlier applications left in the shared folder and nobody has written to for some hours; gives the paths."""
    files, place = _file_system(spark, shared_folder(spark))
    ours = {root.rpartition("/")[2] for root in _ROOTS}
    removed = []
    for status in files.listStatus(place) if files.exists(place) else []:
        path, own = status.getPath(), status.getPath().toString()
        written = max([status.getModificationTime(), *(s.getModificationTime() for s in files.listStatus(path))]) if status.isDirectory() else 0
        if re.fullmatch(r"[a-z]+-[0-9a-f]{32}", path.getName()) and written and written < (time.time() - 3600 * hours) * 1000 and path.getName() not in ours:
            files.delete(path, True)
            removed.append(own)
    return removed


class Workspace:
    """Durable tables of one operator call.

    ``save`` writes a table and reads it back, ``drop`` removes tables that are no longer needed. Tables that a
    returned DataFrame still reads stay until :func:`release` or the end of the process; :func:`sweep` removes
    those of processes that were killed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._saved: dict[int, tuple[DataFrame, str]] = {}  # the table is held, so that its id() stays its own
        self._count = 0
        _ROOTS.add(self.root)
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        path = f"{self.root}/{self._count}"
        self._count += 1
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._saved[id(table)] = (table, path)
        return table

    def together(self, *tables: DataFrame) -> DataFrame:
        """Saved tables of one schema as a single scan."""
        return self.spark.read.schema(tables[0].schema).parquet(*[self._saved[id(t)][1] for t in tables])

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            _, path = self._saved.pop(id(table), (None, None))
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        try:
            files, place = _file_system(self.spark, path)
            files.delete(place, True)
        except Exception:  # the session has ended
            pass
