"""Versions of a loaded table: write, validate, publish.

A version is a folder of Parquet files that is written whole and checked before anything points
to it. Publishing creates one small marker file named after the version, which a file system does at
once or not at all; the current version is the highest one with a marker. So a load that fails
leaves the data as they were, and readers of an older version are not disturbed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from viewloom.sources.records import BAD_RECORD, ROW_ORDER, packed_order

DIGITS = 12


class Refused(ValueError):
    """What was loaded is malformed or fails its check."""


@dataclass(frozen=True)
class Store:
    """A folder on shared storage with `version=N` folders and the markers of those that are published."""

    spark: SparkSession
    folder: str

    def _files(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        path, files = self._files(kind)
        if not files.exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(path) if s.getPath().getName().isdigit())

    def versions(self) -> list[int]:
        """The published versions, oldest first."""
        return self._numbers("published")

    def refusals(self) -> list[int]:
        """The numbers of loads that were refused."""
        return self._numbers("refused")

    def current(self) -> int | None:
        return max(self.versions(), default=None)

    def _mark(self, kind: str, number: int) -> None:
        path, files = self._files(kind, f"{number:0{DIGITS}d}")
        if not files.exists(path):  # the same load, done again after a failure
            files.create(path, False).close()

    def _data(self, number: int) -> str:
        return f"{self.folder}/data/version={number:0{DIGITS}d}"

    def read(self, version: int | None = None) -> DataFrame:
        """A published version, by default the current one."""
        version = self.current() if version is None else version
        if version is None or version not in self.versions():
            raise LookupError(f"no published version {version} in {self.folder}")
        return self.spark.read.parquet(self._data(version)).drop(BAD_RECORD)

    def next_number(self) -> int:
        return max([0, *self.versions(), *self.refusals()]) + 1

    def load(self, records: DataFrame, check: Callable[[DataFrame], bool] | None = None, number: int | None = None) -> int:
        """Write the records as a new version and publish it; returns its number.

        If they are malformed, or `check` of the written version says no, `Refused` is raised, and the
        current version stays. Read them with `keep_bad`: bad records are then found in the written version;
        without it the job that writes fails. With `number` a load that is done again replaces its own unpublished data;
        a published version is never written again.
        """
        number = self.next_number() if number is None else number
        if number in self.versions():
            return number
        try:
            records.write.mode("overwrite").parquet(self._data(number))
        except (PySparkException, Py4JJavaError) as error:
            if "MALFORMED" not in str(error) and "malformed JSON" not in str(error):
                raise  # not the data's fault
            self._mark("refused", number)
            raise Refused(f"load {number} is malformed") from error
        written = self.spark.read.schema(records.schema).parquet(self._data(number))
        if BAD_RECORD in written.columns and not written.where(F.col(BAD_RECORD).isNotNull()).isEmpty():
            self._mark("refused", number)
            raise Refused(f"load {number} is malformed")
        if check is not None and not check(written):
            self._mark("refused", number)
            raise Refused(f"load {number} fails its check")
        self._mark("published", number)
        return number


def watch_versions(
    spark: SparkSession, folder: str, schema: str, store: Store, progress: str, lines: bool = True, once: bool = False
) -> StreamingQuery:
    """Load each file that arrives in `folder` as the next version of `store`, and go on past malformed ones.

    A file with a malformed record is refused as a whole: the version before it stays the current one.
    Versions bear the number of the file's turn, from 1, so after a failure a file is loaded again under its own
    number. `progress` is a folder on shared storage that remembers which files were done.
    """
    arriving = (
        spark.readStream.schema(f"{schema}, {BAD_RECORD} string")
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .option("maxFilesPerTrigger", 1)
        .json(folder)
        .select("*", F.col("_metadata.file_block_start").alias("_block"))
    )

    def one_file(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn(ROW_ORDER, packed_order(F.lit(0), F.col("_block"))).drop("_block")
        try:
            store.load(placed, number=number + 1)
        except Refused:
            pass  # the store keeps the refusal

    writer = arriving.writeStream.foreachBatch(one_file).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()
