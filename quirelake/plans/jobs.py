"""Jobs that a callback can stop while they run, and numbers of rows in order without a window over all of them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.durable import durable
from quirelake.errors import Cancelled

T = TypeVar("T")
#: Seconds between two questions whether to stop.
ASK_SECONDS = 0.5


def stoppable(spark: SparkSession, cancelled: Callable[[], bool] | None, action: Callable[[], T], seconds: float | None = None) -> T:
    """The action's result. While its jobs run, another thread asks ``cancelled()`` again and again; once that is true the jobs are interrupted and Cancelled is raised."""
    if cancelled is None:
        return action()
    tag, over, stop = f"quirelake-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        while not over.wait(ASK_SECONDS if seconds is None else seconds):
            if stop.is_set() or cancelled():
                stop.set()
                spark.sparkContext.cancelJobsWithTag(tag)  # again and again, as an action may start further jobs

    watcher = threading.Thread(target=watch, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watcher.start()
    try:
        return action()
    except Exception as e:
        if stop.is_set():
            raise Cancelled("stopped while a job ran") from e
        raise
    finally:
        over.set()
        spark.sparkContext.removeJobTag(tag)
        watcher.join()


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``rows``, durable, with their number from 0 in an order: each task numbers the range that it has sorted, and adds the counts of the ranges before."""
    place = F.monotonically_increasing_id()
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = durable(parted.withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1))))
    before, starts = 0, []
    for r in sorted(held.groupBy("_part").count().collect()):  # a row a task
        starts.append((r[0], before))
        before += r[1]
    firsts = rows.sparkSession.createDataFrame(starts, "_part long, _first long")
    return held.join(F.broadcast(firsts), "_part").withColumn(name, F.col("_first") + F.col("_place")).drop("_part", "_place", "_first")
