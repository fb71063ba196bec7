"""Text sources: sweep tables, decoder lines, the candidate log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_sweep(lines: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Bins of binned-power lines: date,time,low,high,step,n,dB,dB,...

    Lines with fewer than seven fields or a field that is no number are skipped.
    """
    parts = F.transform(F.split("value", ","), lambda p: F.trim(p))
    number = lambda c: c.try_cast("double")
    rows = (
        lines.select(*carried, parts.alias("_p"))
        .filter(F.size("_p") >= 7)
        .select(
            *carried,
            number(F.get("_p", F.lit(2))).alias("_low"),
            number(F.get("_p", F.lit(4))).alias("_step"),
            F.transform(F.slice("_p", 7, F.greatest(F.size("_p") - 6, F.lit(0))), number).alias("_db"),
        )
        .filter(
            F.col("_low").isNotNull()
            & F.col("_step").isNotNull()
            & ~F.exists("_db", lambda v: v.isNull())
        )
    )
    return rows.select(*carried, "_low", "_step", F.posexplode("_db").alias("bin", "power_db")).select(
        *carried, (F.col("_low") + F.col("bin") * F.col("_step")).alias("freq_hz"), "power_db"
    )


def read_sweep_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_sweep(spark.read.text(path))


def parse_decoder_lines(lines: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Decodes from JSON lines; a line that is no JSON object is kept raw and unknown.

    Works on streams as well.
    """
    text = F.trim("value")
    rows = lines.filter(text != "").select(
        *carried, text.alias("_line"), F.try_parse_json(text).alias("_v")
    )
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))

    def text_of(name: str) -> Column:
        value = F.try_variant_get("_v", f"$.{name}", "string")
        return F.when(~value.isin("", "0", "false"), value)

    kind = F.schema_of_variant(F.try_variant_get("_v", "$.freq", "variant"))
    numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    megahertz = F.when(
        is_object & numeric, F.try_variant_get("_v", "$.freq", "double") * F.lit(1e6)
    )
    protocol = F.when(
        is_object, F.coalesce(text_of("model"), text_of("protocol"), F.lit("unknown"))
    ).otherwise(F.lit("unknown"))
    return rows.select(
        *carried,
        protocol.alias("protocol"),
        megahertz.cast("bigint").alias("freq_hz"),
        (protocol != "unknown").alias("known"),
        F.when(is_object, F.to_json("_v"))
        .otherwise(F.to_json(F.struct(F.col("_line").alias("raw"))))
        .alias("fields"),
    )


def read_decoder_jsonl(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return parse_decoder_lines(reader.format("text").load(path))


CANDIDATE_SCHEMA = (
    "timestamp STRING, session_id BIGINT, receiver_center_hz BIGINT, sequence BIGINT, "
    "freq_hz BIGINT, bandwidth_hz BIGINT, duration_ms DOUBLE, peak_snr_db DOUBLE, "
    "candidate_score DOUBLE, candidate_reasons ARRAY<STRING>"
)


def candidate_lines(bursts: DataFrame) -> DataFrame:
    """One JSON line per flagged burst."""
    names = [part.split()[0] for part in CANDIDATE_SCHEMA.split(", ")]
    return bursts.select(F.to_json(F.struct(*names)).alias("value"))


def candidate_log_append(bursts: DataFrame, path: str) -> None:
    """Append to the log; earlier lines are never rewritten."""
    candidate_lines(bursts).write.mode("append").text(path)


def candidate_log_stream(bursts: DataFrame, path: str, checkpoint: str):
    return (
        candidate_lines(bursts)
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def parse_candidate_log(
    lines: DataFrame, schema: str = CANDIDATE_SCHEMA, carried: Sequence[str] = ()
) -> DataFrame:
    """Records of the log; blank and broken lines are skipped."""
    bad = "_corrupt_record"
    parsed = F.from_json(
        "value", f"{schema}, {bad} STRING", {"columnNameOfCorruptRecord": bad}
    )
    return (
        lines.filter(F.trim("value") != "")
        .select(*carried, parsed.alias("_r"))
        .filter(F.col("_r").isNotNull() & F.col(f"_r.{bad}").isNull())
        .select(*carried, "_r.*")
        .drop(bad)
    )


def candidate_log_read(
    spark: SparkSession, path: str, limit: int | None = None
) -> DataFrame:
    """Newest first."""
    rows = parse_candidate_log(spark.read.text(path)).orderBy(
        F.col("timestamp").desc(), F.col("session_id").desc(), F.col("sequence").desc()
    )
    return rows if limit is None else rows.limit(limit)


def candidate_log_count(lines: DataFrame) -> DataFrame:
    """Number of non-blank lines, broken ones included."""
    return lines.filter(F.trim("value") != "").agg(F.count(F.lit(1)).alias("lines"))
