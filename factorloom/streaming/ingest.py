"""Preference lines as a stream of files, folded into a snapshot of preferences batch by batch.

A micro-batch takes the place of a generation: late lines fall into the next one. The snapshot is versioned by the batch number; a batch that is run again
after a failure overwrites its own version from the one before, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import merge_old_new
from ..sources.events import event_lines, parse_lines
from ..sources.store import Store


def lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """``value STRING`` of new files of a folder, compressed or not."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def snapshots(store: Store, path: str) -> list[int]:
    return [int(v) for v in store.list(path) if v.isdigit() and store.exists(f"{path}/{v}/_SUCCESS")]


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    there = snapshots(Store(spark), path)
    return spark.read.parquet(f"{path}/{max(there):010d}") if there else None


def fold(spark: SparkSession, source: DataFrame, path: str, checkpoint: str, decay: float = 1.0, zero_threshold: float = 0.0, keep: int = 2, **trigger) -> StreamingQuery:
    """Starts folding parsed lines into snapshots under ``path``; bad lines go to ``path-bad``. By default takes all that is there and ends."""
    store = Store(spark)

    def take(batch: DataFrame, number: int) -> None:
        before = [v for v in snapshots(store, path) if v < number]
        old = spark.read.parquet(f"{path}/{max(before):010d}") if before else None
        parsed = parse_lines(batch.select("value")).persist()
        try:
            merge_old_new(old, parsed.where("not is_bad"), decay, zero_threshold).write.mode("overwrite").parquet(f"{path}/{number:010d}")
            parsed.where("is_bad").select("value").write.mode("overwrite").parquet(f"{path}-bad/{number:010d}")
        finally:
            parsed.unpersist()
        for v in before[: -(keep - 1)] if keep > 1 else before:
            store.delete(f"{path}/{v:010d}", recursive=True)

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append(df: DataFrame, folder: str) -> None:
    """Writes events (user_text, item_text, value) as lines to an inbound folder; files appear when they are complete."""
    event_lines(df.select("user_text", "item_text", "value")).write.mode("append").option("compression", "gzip").text(folder)
