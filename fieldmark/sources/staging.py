"""Written intermediates that cut lineage, survive the loss of executors and have an owner.

A staged table is a Parquet folder. It belongs to the innermost open ``Owner`` and is deleted when that owner
closes or, earlier, when the readers it was written for are done; without an owner it belongs to the
application and goes when that ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
FOLDER = "fieldmark-stage"
#: With it Spark deletes the shuffle files of a query when the query ends, and not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_root(spark: SparkSession) -> str:
    """Shared folder for intermediates, as the session names it.

    Only a local session may lack the setting; it takes its warehouse folder. A
    cluster session without it is an error, because a folder on one machine
    would not be seen by the others.
    """
    configured = spark.conf.get(SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that every executor can reach")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


class _Folder:
    """A staged folder and how many readers it still has (None: as long as its owner is open)."""

    def __init__(self, spark: SparkSession, path: str, readers: int | None) -> None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.place, self.readers = place, readers
        # Whatever happens to its owner, the folder does not outlive the application.
        self.files.deleteOnExit(place)

    def delete(self) -> None:
        self.files.delete(self.place, True)
        self.files.cancelDeleteOnExit(self.place)


class Owner:
    """Owner of the tables that are staged while it is open.

    ``with Owner() as mine:`` deletes them all when it closes, so what reads them has to be consumed or
    staged by then. ``mine.hand_over(table)`` passes a staged table on to the next owner outside. An
    owner serves one thread, the one that opened it.
    """

    _open: ContextVar[Owner | None] = ContextVar("owner", default=None)

    def __init__(self) -> None:
        self._folders: dict[int, tuple[DataFrame, _Folder]] = {}
        self._token = None

    def __enter__(self) -> Owner:
        self._token = Owner._open.set(self)
        return self

    def __exit__(self, *error) -> None:
        Owner._open.reset(self._token)
        for _, folder in self._folders.values():
            folder.delete()
        self._folders.clear()

    def hand_over(self, table: DataFrame) -> DataFrame:
        """Let ``table``, which this owner holds, outlive it; returns it."""
        entry = self._folders.pop(id(table))
        outside = self._token.old_value
        if isinstance(outside, Owner):
            outside._folders[id(table)] = entry
        return table

    def done(self, *tables: DataFrame) -> None:
        """One reader of each of ``tables`` is done; a table without further readers is deleted."""
        for table in tables:
            _, folder = self._folders[id(table)]
            folder.readers = 0 if folder.readers is None else folder.readers - 1
            if folder.readers <= 0:
                folder.delete()
                del self._folders[id(table)]


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Queries that are built and run inside free their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, partition_by: Sequence[str] = (), readers: int | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Use it where a costly result feeds more than one later step. The columns
    stay prunable, the file sizes give the optimiser real statistics, and a
    lost executor re-reads files instead of repeating the work above. With
    ``partition_by`` (few values each), filters on these columns read only the
    matching folders. ``readers`` is how often ``Owner.done`` will be told that
    a step reading the table is through.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{FOLDER}/{uuid.uuid4().hex}"
    with freeing(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    folder = _Folder(spark, path, readers)
    table = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    owner = Owner._open.get()
    if owner is not None:
        # The table is kept, so that its identity is not given to another one.
        owner._folders[id(table)] = (table, folder)
    return table
