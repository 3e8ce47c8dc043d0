"""Incremental repair: micro-batches of pages are repaired and written as waves of a page log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelake.functions.repair import repair
from quirelake.operators.pagelog import PageLog

PAGES = "source_hash string, page_number int, raw_text string"


def repaired_pages(pages: DataFrame, signature: str) -> DataFrame:
    """Rows (PAGES) with repaired text and signature; the same in a stream and in a batch."""
    return pages.select("source_hash", "page_number", "raw_text", repair(F.col("raw_text")).alias("repaired_text"), F.lit(signature).alias("repair_signature"))


def upsert(batch: DataFrame, path: str, stream: str, number: int) -> None:
    """Writes the pages of a batch as a wave of the log at ``path``; of a page's repeats in one batch any one stays.

    A batch costs what it has, not what its books have. The stream's name and the batch's
    number stand in the commit, so a batch that runs again after a crash is not written
    twice, and one that was written but not committed doesn't count.
    """
    log = PageLog(batch.sparkSession, path)
    log.write(batch.dropDuplicates(["source_hash", "page_number"]).withColumn("complete", F.lit(True)), stream, number)
    log.compact()


def start(pages: DataFrame, signature: str, path: str, progress_path: str) -> StreamingQuery:
    """Runs over what there is and stops; ``progress_path`` is the stream's own checkpoint folder, and names it."""
    writer = repaired_pages(pages, signature).writeStream.option("checkpointLocation", progress_path).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, number: upsert(batch, path, progress_path, number)).start()
