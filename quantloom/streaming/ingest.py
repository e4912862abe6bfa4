"""A panel that follows a folder of archives as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quantloom.sources.bars import build, named

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, archives: str, panel: str, checkpoint: str, files_a_batch: int = 200, every: str | None = None, built=build) -> StreamingQuery:  # noqa: ANN001
    """Builds the months of new archives below a folder: all that are there by now, and then ends; or, with `every` (an interval), goes on.

    The checkpoint knows which files have been seen. A batch writes whole months, each in the place of what was there, so a batch that was cut off
    between its write and its commit is written again on a restart and leaves what it would have left at once. An archive
    that replaces an older one needs a new name to be seen; `quantloom.sources.bars.ingest` compares times instead.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(archives)

    def write(batch: DataFrame, number: int) -> None:
        built(named(batch), panel)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
