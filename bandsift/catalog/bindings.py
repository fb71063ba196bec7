"""The given tables read as spectrum tables, once for Spark and once for SQL.

An expression written once is the same text in both; a pair is (Spark, SQL).
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from bandsift.runtime import prepare, shared_folder

# 2024-01-01 and 2024-01-15, microseconds.
_BASE = 1_704_067_200_000_000
AS_OF = "2024-01-15 00:00:00"
_AS_OF_US = 1_705_276_800_000_000

#: Rows of a part of a streamed file.
FILE_ROWS = 500_000


def _at(micros: str) -> tuple[str, str]:
    return f"timestamp_micros({micros})", f"make_timestamp({micros})"


def _ts(column: str) -> tuple[str, str]:
    return f"cast({column} as timestamp)", column


_PLACE = "867000000 + (user_id * 19391) % 3000000"

BINDINGS: dict[str, tuple[str, dict[str, str | tuple[str, str]]]] = {
    "psd_frames": (
        "embeddings",
        {
            "session_id": "cast(label as bigint)",
            "frame_seq": "vec_id",
            "ts": _at(f"{_BASE} + vec_id * 100000 + (vec_id * vec_id) % 777 * 10"),
            "f0_hz": "cast(867000000 + (vec_id % 4) * 500000 as double)",
            "bin_hz": "cast(46875 as double)",
            "power_db": (
                "transform(embedding, x -> cast(x as double) * 100 - 60)",
                "list_transform(embedding, lambda x: cast(x as double) * 100 - 60)",
            ),
        },
    ),
    "iq_blocks": (
        "embeddings",
        {
            "session_id": ("vec_id div 250", "vec_id // 250"),
            "start_sample": (
                "(vec_id % 250) * 32 + 1000 * ((vec_id % 250) div 50)",
                "(vec_id % 250) * 32 + 1000 * ((vec_id % 250) // 50)",
            ),
            "center_hz": "cast(868269000 as bigint)",
            "sample_rate": "cast(2400000 as int)",
            "captured_at": (
                "cast((vec_id % 250) as double) / 65536 + cast((vec_id % 250) div 40 as double) / 64",
                "cast((vec_id % 250) as double) / 65536 + cast((vec_id % 250) // 40 as double) / 64",
            ),
            "iq": "embedding",
        },
    ),
    "tuned_blocks": (
        "embeddings",
        {
            "session_id": ("vec_id div 250", "vec_id // 250"),
            "start_sample": (
                "(vec_id % 250) * 32 + 1000 * ((vec_id % 250) div 50)",
                "(vec_id % 250) * 32 + 1000 * ((vec_id % 250) // 50)",
            ),
            "center_hz": (
                "868269000 + ((vec_id % 250) div 60) * 400000",
                "868269000 + ((vec_id % 250) // 60) * 400000",
            ),
            "sample_rate": "cast(case when vec_id % 250 < 130 then 2400000 else 1200000 end as int)",
            "captured_at": "cast(vec_id % 250 as double) / 65536",
            "iq": "embedding",
        },
    ),
    # The texts of a session end to end: one gap-free run of samples.
    "cu8_blocks": (
        "documents",
        {
            "session_id": "doc_id % 100",
            "start_sample": (
                "coalesce(sum(octet_length(encode(text, 'utf-8')) div 2) over (partition by doc_id % 100 order by doc_id rows between unbounded preceding and 1 preceding), 0)",
                "cast(coalesce(sum(octet_length(encode(text)) // 2) over (partition by doc_id % 100 order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint)",
            ),
            "center_hz": "cast(868269000 as bigint)",
            "sample_rate": "cast(2400000 as int)",
            "captured_at": "cast(doc_id as double)",
            "raw": ("encode(coalesce(text, ''), 'utf-8')", "encode(coalesce(text, ''))"),
        },
    ),
    "detections": (
        "events",
        {
            "detection_id": "event_id",
            "session_id": "user_id % 10",
            "channel_id": "user_id",
            "ts": _ts("ts"),
            "center_hz": _PLACE,
            "bandwidth_hz": "5000 + (user_id % 7) * 10000",
            "peak_power_db": "value - 120",
            "avg_power_db": "value / 2 - 120",
            "snr_db": "value",
            "duration_ms": "case when event_id % 3 = 0 then cast(event_id % 400 as double) end",
        },
    ),
    "arrivals_by_part": (
        "lineitem",
        {
            "session_id": "l_suppkey % 10",
            "channel_id": "l_partkey",
            "detection_id": "l_orderkey * 8 + l_linenumber",
            "ts": _ts("l_shipdate"),
            "center_hz": "867000000 + (l_partkey * 19391) % 3000000",
            "peak_power_db": "l_quantity - 120",
        },
    ),
    "client_events": (
        "events",
        {
            "event_id": "event_id",
            "ts": _ts("ts"),
            "kind": "event_type",
            "message": "concat(event_type, ' by ', cast(user_id as varchar(20)))",
            "client_id": "cast(user_id as varchar(20))",
            "data": "props",
        },
    ),
    "decodes": (
        "events",
        {
            "decode_id": "event_id",
            "ts": _ts("ts"),
            "decoder": "'jsonl'",
            "protocol": "event_type",
            "freq_hz": _PLACE,
            "known": "event_type <> 'error'",
            "fields": "props",
            "session_id": "user_id % 10",
        },
    ),
    "decoder_lines": (
        "events",
        {
            "event_id": "event_id",
            "value": (
                "case event_id % 5 when 0 then props "
                "when 1 then concat('{\"model\":\"', event_type, '\",\"freq\":', value, '}') "
                "when 2 then concat('{\"protocol\":\"', event_type, '\",\"freq\":\"high\"}') "
                "when 3 then concat('raw ', event_type) else '{\"model\":\"\",\"freq\":868}' end",
                "case event_id % 5 when 0 then props "
                "when 1 then concat('{\"model\":\"', event_type, '\",\"freq\":', value, '}') "
                "when 2 then concat('{\"protocol\":\"', event_type, '\",\"freq\":\"high\"}') "
                "when 3 then concat('raw ', event_type) else '{\"model\":\"\",\"freq\":868}' end",
            ),
        },
    ),
    "sweep_lines": (
        "events",
        {
            "event_id": "event_id",
            "value": (
                "case when event_id % 11 = 0 then 'date, time, low' "
                "when event_id % 13 = 0 then concat('2024-01-01, 00:00:00, x, 0, 1, 2, ', value) "
                "else concat('2024-01-01, 00:00:00, ', 867000000 + user_id * 1000, "
                "', 868000000, 250, 3, ', value, ', -', value, ', 1.5') end"
            ),
        },
    ),
    "log_lines": (
        "events",
        {
            "event_id": "event_id",
            "value": (
                "case when event_id % 17 = 0 then '' when event_id % 19 = 0 then '{\"freq_hz\": 86' "
                "else concat('{\"sequence\":', event_id, ',\"freq_hz\":', 867000000 + user_id, "
                "',\"peak_snr_db\":', value, '}') end"
            ),
        },
    ),
    "bursts": (
        "events",
        {
            "session_id": "user_id % 10",
            "sequence": "event_id",
            "start_s": "cast(event_id as double) / 64",
            "measured_hz": "cast(867569000 + (user_id * 19391) % 1400000 as double) + value",
            "freq_hz": "cast(867569000 + (user_id * 19391) % 1400000 as bigint)",
            "raw_duration_ms": "value * 10",
            "duration_ms": "value * 10",
            "bandwidth_hz": "(event_id * 37) % 60000",
            "peak_snr_db": "value",
            "noise_db": "-90 - value / 4",
            "above_frames": "event_id % 5",
            "qualified": "event_id % 5 >= 2",
        },
    ),
    "frame_regions": (
        "events",
        {
            "session_id": "user_id % 10",
            "segment_start": "cast(0 as bigint)",
            "frame_id": ("event_id div 4", "event_id // 4"),
            "frame_start": ("(event_id div 4) * 2048", "(event_id // 4) * 2048"),
            "center_hz": "cast(867569000 + (user_id % 40) * 9000 as double) + value",
            "peak_db": "value - 100",
            "peak_snr_db": "value",
            "width_hz": "cast(1 + event_id % 3 as double) * 4687.5",
        },
    ),
    "band_regions": (
        "events",
        {
            "session_id": "user_id % 10",
            "frame_seq": "event_id",
            "ts": _ts("ts"),
            "center_hz": f"{_PLACE} + event_id % 9 * 1000",
            "bandwidth_hz": "5000 + (event_id % 7) * 10000",
            "peak_power_db": "value - 120",
            "avg_power_db": "value / 2 - 120",
            "snr_db": "value",
        },
    ),
    "open_tracks": (
        "events",
        {
            "session_id": "user_id % 10",
            "start_frame": "event_id",
            "close_frame": "event_id + 2 + (event_id * 13) % 90",
            "center_hz": "cast(867569000 + (user_id * 19391) % 1400000 as double) + value",
        },
    ),
    "segment_totals": (
        "supplier",
        {
            "session_id": "s_suppkey",
            "n_frames": "1000 + s_suppkey * 3",
            "sample_rate": "cast(2400000 as int)",
        },
    ),
    "hints": (
        "events",
        {
            "session_id": "user_id % 10",
            "frame_seq": "event_id",
            "center_hz": (
                "868000000 + (event_id div 500) * 100000",
                "868000000 + (event_id // 500) * 100000",
            ),
            "modulation": (
                "case event_type when 'click' then 'OOK' when 'purchase' then 'FSK' "
                "else 'unknown' end"
            ),
        },
    ),
    "metrics": (
        "events",
        {"metric": "event_type", "sample_id": "event_id", "value": "value"},
    ),
    "messages": (
        "events",
        {
            "consumer": "user_id % 20",
            "type": (
                "case event_type when 'click' then 'spectrum' when 'view' then 'scope' "
                "else event_type end"
            ),
            "seq": "event_id",
            "payload": "value",
        },
    ),
    "snapshots": (
        "events",
        {
            "session_id": "(event_id % 50) % 5",
            "snapshot_seq": ("event_id div 50", "event_id // 50"),
            "ts": _ts("ts"),
            "channel_id": ("(event_id % 50) div 5", "(event_id % 50) // 5"),
            "center_hz": "867000000 + (event_id % 50) * 60000",
            "snr_db": "value",
            "confidence": "0.5",
            "recurrence_interval_s": "case when event_id % 2 = 0 then 4.0 end",
            "observation_count": "event_id % 9",
            "status": (
                "case when value > 50 then 'active' when value > 20 then 'recently_active' "
                "else 'inactive' end"
            ),
        },
    ),
    "channels": (
        "customer",
        {
            "session_id": "c_custkey % 10",
            "channel_id": "c_custkey",
            "center_hz": "867000000 + (c_custkey * 19391) % 3000000",
            "bandwidth_hz": "cast(5000 + c_nationkey * 3000 as bigint)",
            "current_power_db": "c_acctbal / 128 - 90",
            "peak_power_db": "c_acctbal / 128 - 60",
            "avg_power_db": "c_acctbal / 256 - 90",
            "snr_db": "abs(c_acctbal) / 256",
            "observation_count": "c_custkey % 25",
            "first_seen": _at(f"{_AS_OF_US} - (c_custkey % 977) * 3600000000 - 7200000000"),
            "last_seen": _at(f"{_AS_OF_US} - (c_custkey % 60) * 1000000"),
            "typical_burst_ms": (
                "case when c_custkey % 5 <> 0 then cast((c_custkey % 13) * 60 as double) end"
            ),
            "recurrence_interval_s": (
                "case when c_custkey % 3 <> 0 then cast(c_custkey % 97 as double) / 4 + 1 end"
            ),
            "confidence": "cast(c_custkey % 25 as double) / 32 + 0.0625",
            "status": (
                "case when c_custkey % 60 <= 3 then 'active' "
                "when c_custkey % 60 <= 30 then 'recently_active' else 'inactive' end"
            ),
        },
    ),
    "channel_updates": (
        "orders",
        {
            "session_id": "o_custkey % 10",
            "channel_id": "o_custkey",
            "center_hz": "867000000 + (o_custkey * 19391) % 3000000 + o_orderkey % 50",
            "peak_power_db": "o_totalprice / 4096 - 100",
            "status": "case when o_orderstatus = 'F' then 'inactive' else 'active' end",
            "version": "o_orderkey",
        },
    ),
    "removed_channels": (
        "supplier",
        {"session_id": "(s_suppkey * 3) % 10", "channel_id": "s_suppkey * 3"},
    ),
    "channel_pairs": (
        "customer",
        {
            "session_id": "c_custkey % 10",
            "channel_a": "c_custkey",
            "channel_b": "c_custkey + ((c_custkey * 7 + 1) % 5 + 1) * 10",
        },
    ),
    "pins": (
        "supplier",
        {
            "session_id": "(s_suppkey * 7) % 10",
            "channel_id": "s_suppkey * 7",
            "pinned": "s_nationkey % 2 = 0",
            "label": "case when s_nationkey % 3 = 0 then '' else s_name end",
        },
    ),
    "rules": (
        "nation",
        {
            "rule_id": "cast(n_nationkey as bigint)",
            "rule_order": "cast((n_nationkey * 7) % 25 as bigint)",
            "enabled": "n_nationkey % 4 <> 0",
            "freq_lo_mhz": (
                "case when n_nationkey % 5 <> 0 then 867.0 + cast(n_nationkey as double) / 8 end"
            ),
            "freq_hi_mhz": (
                "case when n_nationkey % 6 <> 0 then 867.5 + cast(n_nationkey as double) / 8 end"
            ),
            "min_snr": "case when n_nationkey % 3 = 0 then 10.0 end",
            "min_confidence": "case when n_nationkey % 7 = 0 then 0.5 end",
            "require_regular_cadence": "n_nationkey % 2 = 1",
        },
    ),
    "focuses": (
        "supplier",
        {
            "focus_id": "s_suppkey",
            "focus_hz": "867000000 + (s_suppkey * 77773) % 3000000",
            "sample_rate": "cast(200000 as int)",
        },
    ),
    "sessions": (
        "supplier",
        {
            "session_id": "s_suppkey",
            "started_at": _at(f"{_BASE} + s_suppkey * 60000000"),
            "stopped_at": _at(f"{_BASE} + s_suppkey * 60000000 + 3600000000"),
            "start_hz": "867500000 - (s_suppkey % 3) * 100000",
            "end_hz": "869000000 + (s_suppkey % 4) * 500000",
            "backend": "case when s_suppkey % 2 = 0 then 'sim' else 'rtlsdr' end",
            "simulation": "s_suppkey % 2 = 0",
        },
    ),
    "recordings": (
        "orders",
        {
            "recording_id": "o_orderkey",
            "ts": _ts("o_orderdate"),
            "path": "concat('iq_', cast(o_orderkey as varchar(20)))",
            "center_hz": "867000000 + (o_custkey * 77773) % 3000000",
            "sample_rate": "cast(2000 + (o_orderkey % 3) * 1000 as int)",
            "duration_ms": "1000 + o_orderkey % 9000",
            "format": "case when o_orderkey % 2 = 0 then 'cu8' else 'cf32_le' end",
            "bytes": ("cast(rint(o_totalprice) as bigint)", "cast(round_even(o_totalprice, 0) as bigint)"),
        },
    ),
    "observed_windows": (
        "orders",
        {
            "session_id": "o_custkey",
            "start_hz": "cast(867000000 as bigint)",
            "end_hz": "cast(870000000 as bigint)",
            "lo_hz": "867000000 + (o_orderkey * 7919) % 3000 * 1000 - 200000",
            "hi_hz": "867000000 + (o_orderkey * 7919) % 3000 * 1000 + 300000",
        },
    ),
    "config_versions": (
        "part",
        {
            "receiver_id": "p_partkey % 40",
            "version": "p_partkey",
            "start_hz": "case when p_partkey < 40 or p_size % 3 = 0 then 867000000 + p_size * 10000 end",
            "end_hz": "case when p_partkey < 40 or p_size % 5 = 0 then 867400000 + p_size * 20000 - (p_partkey % 11) * 50000 end",
            "step_hz": "case when p_partkey < 40 or p_size % 7 = 0 then (p_size % 4) * 1000000 end",
            "sample_rate": "case when p_partkey < 40 or p_size % 6 = 0 then 1000000 + p_size * 50000 end",
            "gain": "case when p_partkey < 40 or p_size % 4 = 0 then case p_size % 3 when 0 then 'auto' when 1 then '20.5' else 'high' end end",
            "noise_floor_alpha": "case when p_partkey < 40 or p_size % 8 = 0 then cast(p_size as double) / 32 end",
            "fft_size": "case when p_partkey < 40 or p_size % 9 = 0 then case when p_size % 2 = 0 then 2048 else 1000 end end",
            "spectrum_fps": "case when p_partkey < 40 or p_size % 10 = 0 then p_size * 2 end",
            "backend": "case when p_partkey < 40 or p_size % 11 = 0 then case when p_size % 2 = 0 then 'sim' else 'other' end end",
            "retention_days": "case when p_partkey < 40 or p_size % 12 = 0 then p_size % 4 end",
        },
    ),
    "references_hz": (
        "nation",
        {
            "session_id": "cast(n_nationkey as bigint)",
            "reference_hz": "868000000 + cast(n_nationkey as bigint) * 46875",
            "current_ppm": "cast(n_nationkey % 5 as bigint)",
        },
    ),
}


def _pick(expr: str | tuple[str, str], i: int) -> str:
    text = expr if isinstance(expr, str) else expr[i]
    return text.replace("varchar(20)", "string") if i == 0 else text


def binding_sql(name: str) -> str:
    base, columns = BINDINGS[name]
    body = ", ".join(f"{_pick(e, 1)} AS {c}" for c, e in columns.items())
    return f"SELECT {body} FROM {base}"


def with_bindings(sql: str) -> str:
    """Put the bindings a query mentions in front of it."""
    used = [n for n in BINDINGS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ", ".join(f"{n} AS ({binding_sql(n)})" for n in used)
    text = sql.strip()
    if text[:5].upper() == "WITH ":
        head = "WITH RECURSIVE " if text[5:15].upper() == "RECURSIVE " else "WITH "
        return f"{head}{ctes}, {text[len(head):]}"
    return f"WITH {ctes} {text}"


class Tables:
    """The bound tables of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BINDINGS:
            raise AttributeError(name)
        base, columns = BINDINGS[name]
        return self.base(base).selectExpr(
            *[f"{_pick(e, 0)} AS `{c}`" for c, e in columns.items()]
        )

    def stream(self, name: str) -> DataFrame:
        """A bound table read as a stream of its files."""
        base, columns = BINDINGS[name]
        schema = self.base(base).schema
        rows = self.spark.readStream.schema(schema).parquet(f"{self.folder}/{base}*.parquet")
        return rows.selectExpr(*[f"{_pick(e, 0)} AS `{c}`" for c, e in columns.items()])

    def drained(self, stream: DataFrame, mode: str = "append") -> DataFrame:
        """Run a stream over all there is and read back what it wrote."""
        out = shared_folder(self.spark, "stream")
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .format("parquet")
            .start(f"{out}/rows")
        )
        query.awaitTermination()
        return self.spark.read.schema(stream.schema).parquet(f"{out}/rows")

    def out_of_order(self, name: str, time_us: str, files: int = 4) -> tuple[DataFrame, str]:
        """A bound table as a stream of files whose rows overlap in time, and how late rows can be.

        Each row goes to a file by its time plus up to half a file's width, so neighbouring files hold
        rows of the same times, and rows within a file lie as a hash has them.
        """
        from pyspark.sql import functions as F

        rows = getattr(self, name)
        rows = rows.withColumn("_us", F.expr(time_us).cast("bigint")).withColumn("_hash", F.xxhash64("_us", *rows.columns[:2]))
        low, high, n = rows.agg(F.min("_us"), F.max("_us"), F.count(F.lit(1))).first()
        width = max(1, (high - low) // files + 1) if low is not None else 1
        late = F.pmod(F.col("_hash"), F.lit(width // 2 + 1))
        rows = rows.withColumn("_file", F.least(F.floor((F.col("_us") - F.lit(low) + late) / width), F.lit(files - 1)))
        # However many parts a file of a large table has, they make one micro-batch.
        folder, parts = shared_folder(self.spark, "stream-in"), max(1, n // (files * FILE_ROWS))
        for i in range(files):
            one = rows.filter(F.col("_file") == i).repartition(parts, "_hash").sortWithinPartitions("_hash").drop("_us", "_hash", "_file")
            one.write.parquet(f"{folder}/{i}")
            written = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/{i}")
            for _ in range(parts - written.select("path").count()):
                one.limit(0).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
        schema = getattr(self, name).schema
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", parts).parquet(f"{folder}/*")
        return stream, f"{width // 1_000_000 + 1} seconds"

    def drained_to_end(self, make, marks: DataFrame) -> DataFrame:
        """Run `make(closing)` over all there is; then send the closing marks and read all results."""
        from bandsift.streaming.buffer import on_time

        folder, out = shared_folder(self.spark, "closing"), shared_folder(self.spark, "stream")
        marks = marks.withColumn("ts", marks["ts"].cast("timestamp"))
        marks.limit(0).write.parquet(folder)
        for last in (False, True):
            if last:
                marks.write.mode("append").parquet(folder)
            stream = make(self.spark.readStream.schema(marks.schema).parquet(folder))
            query = (
                stream.writeStream.option("checkpointLocation", f"{out}/checkpoint")
                .trigger(availableNow=True)
                .format("parquet")
                .start(f"{out}/rows")
            )
            query.awaitTermination()
        return on_time(self.spark.read.schema(stream.schema).parquet(f"{out}/rows"))

    def drained_updates(self, stream: DataFrame, keys: list[str]) -> DataFrame:
        """As `drained`, for a stream in update mode: the last row written of each key."""
        from pyspark.sql import functions as F

        out = shared_folder(self.spark, "stream")

        def write(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

        query = (
            stream.writeStream.outputMode("update")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
        rows = self.spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch=*")
        rest = [c for c in stream.columns if c not in keys]
        latest = F.max_by(F.struct(*rest), "batch").alias("_r")
        return rows.groupBy(*keys).agg(latest).select(*keys, "_r.*")

    @cached_property
    def as_of(self):
        from pyspark.sql import functions as F

        return F.lit(AS_OF).cast("timestamp")
