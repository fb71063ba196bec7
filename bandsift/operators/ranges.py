"""Joins on frequency ranges, turned into equi joins on frequency buckets.

No side is broadcast by hand: Spark broadcasts the small one by its measured size, and
otherwise shuffles both by bucket and splits skewed buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandsift import params as P


#: A channel is known by its session and its number in it.
CHANNEL = ["session_id", "channel_id"]

#: Widths of cells grow by FACTOR from level to level; so many levels lie below the given width and so
#: many above it. Only levels that some range needs are used.
FINER, WIDER, FACTOR = 4, 2, 16

#: Points of a cell that are joined in one piece; a cell with more is split.
HOT_POINTS = 100_000


def point_in_range(
    points: DataFrame,
    ranges: DataFrame,
    point: str,
    low: str,
    high: str,
    bucket_hz: int,
    hot_points: int = HOT_POINTS,
) -> DataFrame:
    """Pairs with low <= point <= high, once each.

    Cells have several widths. A range is put into the cells of the narrowest width of which it
    touches few, so wide ranges don't become many rows and narrow ones don't meet all points of a wide
    cell; a point looks into its cell of each width that a range has. A cell that holds more than
    `hot_points` points is dealt into parts by a hash of the point, and the ranges of that cell go to all
    of its parts; so one busy frequency is joined by many tasks.
    """
    ranges = ranges.filter(F.col(low) <= F.col(high))
    widths, level = cell_widths(low, high, bucket_hz)
    used = sorted(row[0] for row in ranges.select(level).distinct().collect())
    # A cell and its level are one number.
    own = [F.floor(F.col(point) / widths[i]) * len(widths) + i for i in used]
    p = points.withColumn("_cell", F.explode(F.array(*own).cast("array<bigint>")))
    width = F.element_at(F.array(*map(F.lit, widths)), level + 1)
    of = lambda name: F.floor(F.col(name) / width)
    cells = F.transform(F.sequence(of(low), of(high)), lambda c: c * len(widths) + level)
    r = ranges.withColumn("_range_cell", F.explode(cells))

    hit = (p["_cell"] == r["_range_cell"]) & (p[point] >= r[low]) & (p[point] <= r[high])
    # Where there are no more points than that at all, no cell can have more.
    if points.limit(hot_points + 1).count() <= hot_points:
        return p.join(r, hit).drop("_cell", "_range_cell")
    busy = p.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_points)
    busy = busy.select(F.col("_cell").alias("_busy"), F.ceil(F.col("_n") / hot_points).alias("_parts"))
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*points.columns), F.col("_parts"))).otherwise(F.lit(0))
    p = p.join(busy, F.col("_cell") == F.col("_busy"), "left").withColumn("_part", part).drop("_busy", "_parts")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))
    r = r.join(busy, F.col("_range_cell") == F.col("_busy"), "left").withColumn("_range_part", every).drop("_busy", "_parts")
    hit = (
        (p["_cell"] == r["_range_cell"])
        & (p["_part"] == r["_range_part"])
        & (p[point] >= r[low])
        & (p[point] <= r[high])
    )
    return p.join(r, hit).drop("_cell", "_part", "_range_cell", "_range_part")


def cell_widths(low: str, high: str, bucket_hz: int) -> tuple[list[float], Column]:
    """Widths of cells by level, and the level of a range: the lowest of which it touches few cells."""
    widths = [bucket_hz * float(FACTOR) ** i for i in range(-FINER, WIDER + 1)]
    level = F.ceil(F.log(float(FACTOR), (F.col(high) - F.col(low)) / (FACTOR * widths[0])))
    return widths, F.greatest(F.lit(0), F.least(F.lit(len(widths) - 1), F.coalesce(level, F.lit(0)))).cast("int")


#: Of windows: widths of cells grow by STEP from level to level, BELOW levels lie below the given width, a
#: cell holds LISTS lists of points.
LEVELS, BELOW, STEP, LISTS = 40, 8, 4, 32

#: Points that the windows of one task may meet; a window costs as much as WINDOW points.
MEET, WINDOW = 200_000_000, 50


def points_in_windows(
    points: DataFrame,
    windows: DataFrame,
    point: str,
    low: Column,
    high: Column,
    bucket_hz: int,
    hot_points: int = HOT_POINTS,
    meet: int = MEET,
) -> DataFrame:
    """Pairs with low <= point <= high, once each, as `point_in_range`, for many windows with many points each.

    `low` and `high` are worked out of the columns of a window, which moves once and without them. It goes
    to the cell that its low end is in, of the lowest level whose cells are wider than the window. A point
    goes to its cell and the one before, of each level that a window has, so a window meets all its points
    in one cell. There they lie in lists by finer cells, and a window opens the lists that it touches.

    A cell that holds more than `hot_points` points or a quarter of `meet` is dealt into pieces by hashes of
    points and of windows, and tasks are as many as the pairs need, not the rows that move.
    """
    widths = [bucket_hz * float(STEP) ** (i - BELOW) for i in range(LEVELS)]
    # So much wider that the ends of a window are at most LISTS lists apart, also where they are rounded.
    level = F.ceil(F.log(float(STEP), 1.02 * (high - low) / widths[0]))
    level = F.greatest(F.lit(0), F.coalesce(level, F.lit(0))).cast("int")

    def fine(hz: Column, at: Column) -> Column:
        return F.floor(hz / (F.element_at(F.array(*map(F.lit, widths)), at + 1) / LISTS))

    def cell(of: Column, at: Column) -> Column:
        """A cell and its level are one number."""
        return F.floor(of / LISTS) * LEVELS + at

    windows = windows.filter(low <= high)
    used = sorted(row[0] for row in windows.select(level).distinct().collect())
    w = windows.withColumn("_cell", cell(fine(low, level), level))
    own = [(fine(F.col(point), F.lit(i)), F.lit(i)) for i in used]
    places = [F.struct((cell(f, i) - back).alias("_cell"), f.alias("_fine")) for f, i in own for back in (0, LEVELS)]
    places = F.array(*places).cast("array<struct<_cell:bigint,_fine:bigint>>")
    p = points.filter(F.col(point).isNotNull()).select(F.struct(*points.columns).alias("_point"), F.explode(places).alias("_at"))
    p = p.select("_point", "_at.*")

    n, m = F.col("_points"), F.col("_windows")
    cells = p.groupBy("_cell").agg(F.count(F.lit(1)).alias("_points"))
    cells = cells.join(w.groupBy("_cell").agg(F.count(F.lit(1)).alias("_windows")), "_cell")
    cells = cells.select(
        "_cell",
        (m.cast("double") * (n + WINDOW)).alias("_met"),
        F.ceil(n / hot_points).alias("_parts"),
        F.ceil(m.cast("double") * F.least(n + WINDOW, F.lit(hot_points)) / (meet / 4)).alias("_deals"),
    )
    busy = F.when((F.col("_parts") > 1) | (F.col("_deals") > 1), F.struct("_cell", "_parts", "_deals"))
    met, busy = cells.agg(F.sum("_met"), F.collect_list(busy)).first()
    keys = ["_cell", "_piece"] if busy else ["_cell"]
    if busy:
        columns = {k: pa.array([row[k] for row in busy], pa.int64()) for k in ("_cell", "_parts", "_deals")}
        known = points.sparkSession.createDataFrame(pa.table(columns))
        parts, deals = F.coalesce("_parts", F.lit(1)), F.coalesce("_deals", F.lit(1))
        each = lambda number: F.explode(F.sequence(F.lit(0).cast("bigint"), number - 1))
        p = p.join(known, "_cell", "left").withColumn("_deal", each(deals))
        p = p.withColumn("_piece", F.pmod(F.xxhash64("_point"), parts) * deals + F.col("_deal")).drop("_deal", *columns.keys() - {"_cell"})
        w = w.join(known, "_cell", "left").withColumn("_part", each(parts))
        w = w.withColumn("_piece", F.col("_part") * deals + F.pmod(F.xxhash64(*windows.columns), deals)).drop("_part", *columns.keys() - {"_cell"})
    if (met or 0) > meet:
        tasks = max(int(met / meet), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        p, w = p.repartition(tasks, *keys), w.repartition(tasks, *keys)

    of = {c: f"_list_{i}" for i, c in enumerate(points.columns)}
    lists = p.groupBy(*keys, "_fine").agg(F.collect_list("_point").alias("_list"))
    lists = lists.select(*keys, "_fine", *[F.col("_list")[c].alias(of[c]) for c in points.columns])
    at = F.pmod(F.col("_cell"), F.lit(LEVELS)).cast("int")
    w = w.withColumns({"_low": low, "_high": high}).withColumns({"_first": fine(F.col("_low"), at), "_last": fine(F.col("_high"), at)})
    near = w.join(lists, keys).filter("_fine BETWEEN _first AND _last")
    near = near.select(*windows.columns, "_low", "_high", *of.values(), F.posexplode(of[point]).alias("_at", "_point"))
    near = near.filter("_point BETWEEN _low AND _high")
    mine = [F.col("_point").alias(c) if c == point else F.get(of[c], "_at").alias(c) for c in points.columns]
    return near.select(*mine, *windows.columns)


def overlap(
    left: DataFrame,
    right: DataFrame,
    left_low: str,
    left_high: str,
    right_low: str,
    right_high: str,
    bucket_hz: int,
) -> DataFrame:
    """Pairs of overlapping ranges; each is kept in the first bucket both touch."""

    def spread(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
        return df.withColumn(
            name,
            F.explode(
                F.sequence(F.floor(F.col(low) / bucket_hz), F.floor(F.col(high) / bucket_hz))
            ),
        )

    a = spread(left, left_low, left_high, "_lb")
    b = spread(right, right_low, right_high, "_rb")
    first = F.floor(F.greatest(a[left_low], b[right_low]) / bucket_hz)
    hit = (
        (a["_lb"] == b["_rb"])
        & (b[right_high] >= a[left_low])
        & (b[right_low] <= a[left_high])
        & (a["_lb"] == first)
    )
    return a.join(b, hit).drop("_lb", "_rb")


def recordings_near_channel(
    recordings: DataFrame, channels: DataFrame, bucket_hz: int = 100_000
) -> DataFrame:
    """Recordings whose window, half a sample rate either way, holds the channel centre."""
    half = F.col("sample_rate") / 2
    near = points_in_windows(
        channels.select(*CHANNEL, "center_hz"),
        recordings.select("recording_id", F.col("center_hz").alias("recording_hz"), "sample_rate"),
        "center_hz",
        F.col("recording_hz") - half,
        F.col("recording_hz") + half,
        bucket_hz,
    )
    return near.select(
        "recording_id",
        *CHANNEL,
        F.abs(F.col("recording_hz") - F.col("center_hz")).alias("distance_hz"),
    )


def recording_filter(
    recordings: DataFrame,
    ts_from: str | None = None,
    ts_to: str | None = None,
    freq_lo_mhz: float | None = None,
    freq_hi_mhz: float | None = None,
    near: DataFrame | None = None,
    bucket_hz: int = 100_000,
) -> DataFrame:
    """Inclusive time and frequency bounds; `near` keeps recordings of given channels."""
    out = recordings
    if ts_from is not None:
        out = out.filter(F.col("ts") >= F.lit(ts_from).cast("timestamp"))
    if ts_to is not None:
        out = out.filter(F.col("ts") <= F.lit(ts_to).cast("timestamp"))
    if freq_lo_mhz is not None:
        out = out.filter(F.col("center_hz") >= freq_lo_mhz * 1e6)
    if freq_hi_mhz is not None:
        out = out.filter(F.col("center_hz") <= freq_hi_mhz * 1e6)
    if near is not None:
        hits = recordings_near_channel(out, near, bucket_hz).select("recording_id").distinct()
        out = out.join(hits, "recording_id", "left_semi")
    return out


def reference_marker_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        P.REFERENCE_MARKERS, "marker_hz BIGINT, marker_label STRING, marker_kind STRING"
    )


def reference_range_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        P.REFERENCE_RANGES, "lo_hz BIGINT, hi_hz BIGINT, range_label STRING"
    )


def _occupied(channels: DataFrame) -> DataFrame:
    half = F.floor(F.col("bandwidth_hz") / 2)
    return channels.select(
        *CHANNEL,
        (F.col("center_hz") - half).alias("start_hz"),
        (F.col("center_hz") + half).alias("stop_hz"),
    )


def reference_markers(
    channels: DataFrame, markers: DataFrame, bucket_hz: int = 100_000
) -> DataFrame:
    """Markers inside each channel's occupied band."""
    return point_in_range(
        markers, _occupied(channels), "marker_hz", "start_hz", "stop_hz", bucket_hz
    ).select(*CHANNEL, "marker_hz", "marker_label", "marker_kind")


def reference_ranges(
    channels: DataFrame, ranges: DataFrame, bucket_hz: int = 500_000
) -> DataFrame:
    """Sub-bands that each channel's occupied band touches."""
    return overlap(
        _occupied(channels), ranges, "start_hz", "stop_hz", "lo_hz", "hi_hz", bucket_hz
    ).select(*CHANNEL, "lo_hz", "hi_hz", "range_label")


#: Cells of whole numbers of Hz; those of a level are so many times as wide as those of the one below.
TREE_LEVELS, TREE_FACTOR = 9, 8


def _cells_between(first: Column, last: Column, side: int) -> Column:
    """The few cells (level, cell) that make up all positions from `first` to `last`."""
    kind = "struct<low:bigint,high:bigint,cells:array<struct<level:bigint,cell:bigint,side:int>>>"

    def taken(level: Column, low: Column, high: Column) -> Column:
        run = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(run, lambda c: F.struct(level.cast("bigint").alias("level"), c.alias("cell"), F.lit(side).alias("side")))

    def climb(s: Column, level: Column) -> Column:
        up = F.least(s["high"], F.ceil(s["low"] / TREE_FACTOR) * TREE_FACTOR)
        down = F.greatest(up, F.floor(s["high"] / TREE_FACTOR) * TREE_FACTOR)
        cells = F.concat(s["cells"], taken(level, s["low"], up), taken(level, down, s["high"]))
        return F.struct(F.ceil(up / TREE_FACTOR).alias("low"), F.floor(down / TREE_FACTOR).alias("high"), cells.alias("cells")).cast(kind)

    none = F.array().cast("array<struct<level:bigint,cell:bigint,side:int>>")
    begin = F.struct(first.alias("low"), (last + 1).alias("high"), none.alias("cells")).cast(kind)
    top = F.lit(TREE_LEVELS - 1)
    return F.aggregate(
        F.sequence(F.lit(0), top - 1), begin, climb, lambda s: F.concat(s["cells"], taken(top, s["low"], s["high"]))
    )


def focus_channel(focus: DataFrame, channels: DataFrame) -> DataFrame:
    """For each focus (focus_id, focus_hz, sample_rate): the channel in its window that
    was seen last, the nearest on a tie.

    Centres are whole numbers of Hz. Cells of several widths hold the channel seen last, the lowest and
    the highest of them on a tie; below the focus the highest of a cell is the nearest, above it the
    lowest. A window is made up of few cells, so it never meets all channels that lie in it.
    """
    name = F.struct("last_seen", F.col("center_hz").cast("bigint").alias("center_hz"), *CHANNEL)

    def seen(c: Column, near: Column) -> Column:
        return F.struct(c["last_seen"], near, -c["session_id"], -c["channel_id"])

    own = channels.select(name.alias("_c")).withColumn("_cell", F.col("_c.center_hz")).filter("_cell IS NOT NULL")
    first = F.max_by("_c", seen(F.col("_c"), F.lit(0)))
    own = own.groupBy("_cell").agg(first.alias("_c"))
    cells = F.array(*(F.struct(F.lit(i).cast("bigint").alias("level"), F.floor(F.col("_cell") / TREE_FACTOR**i).alias("cell")) for i in range(TREE_LEVELS)))
    tree = own.select(F.explode(cells).alias("_at"), "_c").groupBy("_at.level", "_at.cell").agg(
        F.max_by("_c", seen(F.col("_c"), -F.col("_c.center_hz"))).alias("_lowest"),
        F.max_by("_c", seen(F.col("_c"), F.col("_c.center_hz"))).alias("_highest"),
    )
    half = F.col("sample_rate") / 2
    low, high = F.ceil(F.col("focus_hz") - half), F.floor(F.col("focus_hz") + half)
    middle = F.floor("focus_hz")
    windows = focus.filter(low <= high).select(
        "focus_id", "focus_hz", F.explode(F.concat(_cells_between(low, middle, 0), _cells_between(middle + 1, high, 1))).alias("_at")
    ).select("focus_id", "focus_hz", "_at.*")
    near = windows.join(tree, ["level", "cell"]).withColumn("_c", F.when(F.col("side") == 0, F.col("_highest")).otherwise(F.col("_lowest")))
    c = F.col("_c")
    best = near.groupBy("focus_id").agg(
        F.max_by(F.struct(*[c[k].alias(k) for k in CHANNEL]), seen(c, -F.abs(c["center_hz"] - F.col("focus_hz")))).alias("_c")
    )
    return best.select("focus_id", "_c.*")


def rule_holds() -> Column:
    """Whether the rule of a row holds for the channel of the row; absent bounds do not restrict."""
    mhz = F.col("center_hz") / F.lit(1e6)

    def at_least(value: Column, bound: str) -> Column:
        return F.col(bound).isNull() | (value >= F.col(bound))

    return (
        at_least(mhz, "freq_lo_mhz")
        & (F.col("freq_hi_mhz").isNull() | (mhz <= F.col("freq_hi_mhz")))
        & at_least(F.col("snr_db"), "min_snr")
        & at_least(F.col("confidence"), "min_confidence")
        & (
            ~F.coalesce("require_regular_cadence", F.lit(False))
            | (F.col("recurrence_interval_s").isNotNull() & (F.col("observation_count") >= 4))
        )
    )


def alert_rule_match(
    channels: DataFrame,
    rules: DataFrame,
    bucket_hz: int = 100_000,
    keys: Sequence[str] = tuple(CHANNEL),
) -> DataFrame:
    """First enabled rule each channel satisfies; absent bounds do not restrict.

    `rules` has rule_id, rule_order, enabled, freq_lo_mhz, freq_hi_mhz, min_snr,
    min_confidence, require_regular_cadence. Open frequency bounds are closed at the
    edges of the channels' own band, so the rules meet channels by bucket.
    """
    edges = channels.agg(
        F.min("center_hz").alias("_first"), F.max("center_hz").alias("_last")
    )
    bounded = (
        rules.filter("enabled")
        .join(F.broadcast(edges))
        .withColumn(
            "_low",
            F.greatest(F.coalesce(F.floor(F.col("freq_lo_mhz") * 1e6) - 1, "_first"), "_first"),
        )
        .withColumn(
            "_high",
            F.least(F.coalesce(F.ceil(F.col("freq_hi_mhz") * 1e6) + 1, "_last"), "_last"),
        )
    )
    hits = point_in_range(channels, bounded, "center_hz", "_low", "_high", bucket_hz).filter(rule_holds())
    return hits.groupBy(*keys).agg(
        F.min_by("rule_id", F.struct("rule_order", "rule_id")).alias("rule_id")
    )


def detection_channel(
    detections: DataFrame, channels: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Detections of existing sessions; those of a removed channel keep a null one."""
    known = channels.select(
        F.col("session_id").alias("_session"),
        F.col("channel_id").alias("_id"),
        F.col("center_hz").alias("channel_hz"),
    )
    kept = detections.join(sessions.select("session_id"), "session_id", "left_semi")
    same = (kept["session_id"] == known["_session"]) & (kept["channel_id"] == known["_id"])
    return (
        kept.join(known, same, "left")
        .drop("channel_id", "_session")
        .withColumnRenamed("_id", "channel_id")
    )


def nearest_marker(
    channels: DataFrame, markers: DataFrame, reach_hz: int = 1_000_000
) -> DataFrame:
    """Closest marker of each channel within reach; the earlier label on a tie."""
    windows = markers.select(
        "marker_hz",
        "marker_label",
        (F.col("marker_hz") - reach_hz).alias("_low"),
        (F.col("marker_hz") + reach_hz).alias("_high"),
    )
    near = point_in_range(
        channels.select(*CHANNEL, "center_hz"), windows, "center_hz", "_low", "_high", reach_hz
    )
    distance = F.abs(F.col("marker_hz") - F.col("center_hz"))
    return near.groupBy(*CHANNEL).agg(
        F.min_by("marker_label", F.struct(distance, "marker_label")).alias("marker_label"),
        F.min(distance).alias("distance_hz"),
    )
