"""Each new file of records replaces the one before, as when a person loads the next file.

The views of a file depend on all of its rows and on nothing else, so there is no state to
keep between files: a micro-batch is one file, and the batch operators run on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from viewloom.sources.records import ROW_ORDER, packed_order


def watch_folder(
    spark: SparkSession,
    folder: str,
    schema: str,
    derive: Callable[[DataFrame, int], None],
    progress: str,
    lines: bool = True,
    once: bool = False,
) -> StreamingQuery:
    """Call `derive(records, number)` for each file that arrives in `folder`, in turn.

    `derive` builds the views and writes them; after a failure it is called again with the
    same records and number, so it should overwrite by number. `progress` is a folder on
    shared storage that remembers which files were done. A malformed file stops the query.
    With `once`, the files present are worked off and the query ends.
    """
    arriving = (
        spark.readStream.schema(schema)
        .option("multiLine", not lines)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", 1)
        .json(folder)
        .select("*", F.col("_metadata.file_block_start").alias("_block"))
    )

    def one_file(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn(ROW_ORDER, packed_order(F.lit(0), F.col("_block")))
        derive(placed.drop("_block"), number)

    writer = arriving.writeStream.foreachBatch(one_file).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()
