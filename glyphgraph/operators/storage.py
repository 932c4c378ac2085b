"""Intermediate tables that outlive the executors that computed them, and their owners."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's checkpoint folder.

    A cluster names it in `spark.checkpoint.dir`. Only a local session that names nothing, as in tests, gets
    a temporary folder; on a cluster, executors would not share one, so that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured and not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    if not context.getCheckpointDir():
        if not context.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="glyphgraph-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a written table, wherever Spark keeps it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has ended, on all executors.

    Its cleaner does so when the driver collects garbage, which may otherwise be after several large steps. Call it
    when a step's table is written.
    """
    spark._jvm.System.gc()


def find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is installed or sent with --py-files, and this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


@contextmanager
def session_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A SQL setting for the jobs that run within the block; what the session had comes back."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def meeting_in_place(spark: SparkSession):
    """Rows that lie together by some columns may be joined by these and others where they lie.

    Spark would deal both sides out anew by all keys of the join, which guards against columns that put very different
    numbers of rows together; so give rows that are dealt evenly.
    """
    return session_setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def counted_batches(spark: SparkSession):
    """Rows go to Python workers in batches of so many rows, whose bytes are not added up.

    Spark adds up a batch after each row, which takes longer than sending it where rows are as small as a character.
    """
    return session_setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1))


def _write(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write `frame` once to the shared folder and go on from the written table.

    This cuts the lineage: a lost executor never makes Spark repeat the work before it. Use it for a
    result that is much smaller than its input and is read more than once. The table stays; work that writes
    tables it can do without later gives them to `Tables`.
    """
    return _write(frame, new_path(frame.sparkSession, name))


class Tables:
    """The written tables of one piece of work, by name.

    Writing a name again deletes the table that had it, once the new one is there: an iteration that writes each
    round's table from the last one's holds no more than two. At the end of the `with` block every table goes that was
    not kept for what the work returns. Nothing may still be waiting to read a table when its name is written again or
    dropped; a frame that was not run yet is such a reader.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._held: dict[str, tuple[str, str | None]] = {}
        self._kept: set[str] = set()

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[name for name in self._held if name not in self._kept])

    @property
    def names(self) -> list[str]:
        return sorted(self._held)

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        path = new_path(self._spark, name)
        written = _write(frame, path)
        self.drop(name)
        self._held[name] = path, None
        return written

    def write_bucketed(self, frame: DataFrame, name: str, buckets: int, column: str, *, grouped: bool = False) -> DataFrame:
        """A catalog table in `buckets` buckets of `column`: joins and groupings by it need no shuffle of it.

        The rows are dealt out first, so there is one file per bucket. A frame that is `grouped` by the column is dealt
        out by its own shuffle, and not a second time.
        """
        path, table = new_path(self._spark, name), f"glyphgraph_{uuid.uuid4().hex}"
        dealt = frame if grouped else frame.repartition(buckets, column)
        partitions = "spark.sql.shuffle.partitions"
        with session_setting(self._spark, partitions, str(buckets) if grouped else self._spark.conf.get(partitions)):
            dealt.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(table)
        self.drop(name)
        self._held[name] = path, table
        return self._spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._held:
                path, table = self._held.pop(name)
                if table is not None:
                    self._spark.sql(f"DROP TABLE IF EXISTS {table}")
                delete_path(self._spark, path)

    def keep(self, *names: str) -> None:
        """These tables outlive the `with` block, as a returned frame reads them."""
        self._kept.update(names)
