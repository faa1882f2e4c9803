"""Streams run until nothing is left to read, into an appended table, with what became of their rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: State that keeps timers and several variables a key.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.numRecentProgressUpdates": "100000"}


@dataclass(frozen=True)
class Drained:
    """Of one run: batches, rows read, rows that came behind the watermark and were dropped, rows still held as state."""

    batches: int
    rows: int
    dropped: int
    held: int


def drained(stream: DataFrame, out: str, checkpoint: str) -> Drained:
    """Run ``stream`` until it has read all that is there, appending to the Parquet table ``out``; a later run goes on from ``checkpoint``.

    Rows dropped are counted by Spark where they meet state: one by one for
    sessions and deduplication, for windows once per window and key of a task, for
    debounced changes once per time and key of a task.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    seen = q.recentProgress
    state = [s for p in seen for s in p["stateOperators"]]
    return Drained(len(seen), sum(p["numInputRows"] for p in seen), sum(s["numRowsDroppedByWatermark"] for s in state), sum(s["numRowsTotal"] for s in seen[-1]["stateOperators"]) if seen else 0)
