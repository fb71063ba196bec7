"""Groups of emissions that provably cannot influence each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.operators.ordered import attach, number_chunk, with_run_start


def frequency_islands(regions: DataFrame, gap_hz: int) -> DataFrame:
    """Add `island`: centres of a session separated by more than `gap_hz` never meet.

    A channel centre is an average of its members, so it cannot leave the range of its
    island. Cuts are found on the distinct centres, of which a band only has so many.
    """
    centers = regions.select("session_id", "center_hz").distinct()
    w = Window.partitionBy("session_id").orderBy("center_hz")
    before = F.lag("center_hz").over(w)
    islands = (
        centers.withColumn(
            "_new", (before.isNull() | (F.col("center_hz") - before > gap_hz)).cast("int")
        )
        .withColumn("island", F.sum("_new").over(w))
        .drop("_new")
    )
    return attach(regions, islands, ["session_id", "center_hz"], how="inner")


def track_islands(
    regions: DataFrame,
    association_hz: int = P.ASSOCIATION_HZ,
    holdoff: int = P.HOLDOFF_FRAMES,
    buckets_per_gap: int = 15,
    chunk_frames: int = P.CHUNK_FRAMES,
) -> DataFrame:
    """Add `island` (frequency) and `time_island` to single-frame regions.

    Centroids are cut on coarse buckets: `buckets_per_gap + 1` buckets apart means more
    than the association distance apart. In time, a track that has missed `holdoff`
    frames is closed, so a longer silence of an island separates its tracks.
    """
    keys = ["session_id", "segment_start"]
    width = association_hz / buckets_per_gap
    rows = regions.withColumn("_bucket", F.floor(F.col("center_hz") / F.lit(width)))
    buckets = rows.select(*keys, "_bucket").distinct()
    w = Window.partitionBy(*keys).orderBy("_bucket")
    before = F.lag("_bucket").over(w)
    islands = (
        buckets.withColumn(
            "_new",
            (before.isNull() | (F.col("_bucket") - before > buckets_per_gap)).cast("int"),
        )
        .withColumn("island", F.sum("_new").over(w))
        .drop("_new")
    )
    rows = attach(rows, islands, [*keys, "_bucket"], how="inner").drop("_bucket")
    place = [*keys, "island"]
    chunk = number_chunk("frame_id", chunk_frames)
    frames = rows.select(*place, "frame_id").distinct()
    frames = with_run_start(
        frames,
        place,
        ["frame_id"],
        ["frame_id"],
        lambda here, before: before("frame_id").isNull()
        | (here("frame_id") - before("frame_id") > holdoff),
        chunk,
        "frame_id",
        "time_island",
    ).drop("prev_frame_id")
    return attach(rows, frames, [*place, "frame_id"], how="inner")
