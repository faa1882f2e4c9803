"""Changes that are held until their path has been quiet, as two aggregations over event time.

Changes of a key closer than ``quiet`` form a burst, of which the last counts: a
burst is a session of its key with that gap.  The first aggregation holds a change
until the watermark is past it and drops those that come behind; the second holds a key's open
sessions, and gives one out once the watermark is within a microsecond of its last time plus ``quiet``: then nothing
that could still join it can arrive, so the result does not depend on how the changes were cut into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Time without a change after which a path counts as settled.
QUIET_MS = 1000


def merged(bursts: list[tuple], quiet: int) -> list[tuple]:
    """What a key's sessions come to, plainly: bursts (first, last, rank, body), any order, with those less than ``quiet`` apart made one; each keeps its last change."""
    out: list[tuple] = []
    for b in sorted(bursts):
        if out and b[0] - out[-1][1] < quiet:
            a = out[-1]
            out[-1] = (a[0], *max(a[1:], b[1:]))
        else:
            out.append(b)
    return out


def debounced(changes: DataFrame, key: str = "note_id", time: str = "changed_at", quiet_ms: int = QUIET_MS, late: str = "1 minute", rank: str | None = None) -> DataFrame:
    """Of each burst of changes (a stream) the last, once its key has been quiet for ``quiet_ms``.

    Of changes at one time the one with the largest ``rank`` (a whole number; by
    default a hash of the row) counts.  Changes later than ``late`` are dropped by the
    watermark.  State is native, a row for each time and session that is still open.
    """
    schema = changes.schema
    order = F.col(rank).cast("long") if rank else F.xxhash64(*[c for c in changes.columns if "map<" not in schema[c].dataType.simpleString()])
    rows = changes.withWatermark(time, late).select(F.col(key).alias("key"), F.col(time).alias("moment"), order.alias("rank"), F.to_json(F.struct(*changes.columns)).alias("body"))
    # grouped by the time itself: a change behind the watermark is late, whatever session it would fall in
    moments = rows.groupBy("key", "moment").agg(F.max(F.struct("rank", "body")).alias("change"))
    # sessions that touch are one to Spark; changes exactly ``quiet_ms`` apart are two bursts, so the gap is a microsecond less
    bursts = moments.groupBy("key", F.session_window("moment", f"{quiet_ms * 1000 - 1} microseconds")).agg(F.max(F.struct("moment", "change")).alias("last"))
    return bursts.select(F.from_json("last.change.body", schema).alias("c")).select("c.*")
