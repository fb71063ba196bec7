"""Tables on disk: declared schemas, date partitions, repeatable appends, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandsift import schemas
from bandsift.operators.report import EXPORT_LIMITS, export_rows

TABLES = {
    "detections": schemas.DETECTIONS,
    "bursts": schemas.BURSTS,
    "sessions": schemas.SESSIONS,
    "decodes": schemas.DECODES,
    "recordings": schemas.RECORDINGS,
    "client_events": schemas.CLIENT_EVENTS,
}
_DATED = {"detections", "bursts", "decodes", "recordings", "client_events"}


def ingest(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Append one batch; a batch that is sent again replaces itself and nothing else."""
    names = [part.split()[0] for part in TABLES[table].split(", ")]
    out = rows.select(*names).withColumn("ingest_batch", F.lit(int(batch_id)))
    parts = ["ingest_batch"]
    if table in _DATED:
        out = out.withColumn("date", F.to_date("ts"))
        parts = ["date", "ingest_batch"]
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(f"{root}/{table}")
    )


def ingest_stream(rows: DataFrame, root: str, table: str, checkpoint: str):
    """Streaming form of `ingest`; Spark's batch id makes a replay harmless."""
    return (
        rows.writeStream.foreachBatch(lambda df, batch: ingest(df, root, table, batch))
        .option("checkpointLocation", checkpoint)
    )


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Declared columns plus the partition columns, so date filters prune folders."""
    dated = ", date DATE" if table in _DATED else ""
    return (
        spark.read.schema(f"{TABLES[table]}{dated}, ingest_batch INT").parquet(f"{root}/{table}")
    )


def iq_block_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Live IQ blocks from a folder of Parquet files, rate limited per micro-batch.

    Each micro-batch reports `iq_blocks` (blocks, samples, first and last position) with its
    progress; counters by source are those of `live_acquisition`.
    """
    rows = (
        spark.readStream.schema(schemas.IQ_BLOCKS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
    return rows.observe(
        "iq_blocks",
        F.count(F.lit(1)).alias("blocks"),
        F.coalesce(F.sum(F.size("iq") / 2), F.lit(0.0)).cast("bigint").alias("samples"),
        F.max("start_sample").alias("last_position"),
        F.min("start_sample").alias("first_position"),
    )


def export_csv(rows: DataFrame, kind: str, path: str, order: list[str], limit: int | None = None) -> None:
    export_rows(rows, kind, order, limit).write.mode("overwrite").csv(path, header=True)


def export_json(rows: DataFrame, kind: str, path: str, order: list[str], limit: int | None = None) -> None:
    """One JSON object per line; uncapped exports stay distributed."""
    export_rows(rows, kind, order, limit).write.mode("overwrite").json(path)


def export_document(rows: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """The export of interactive size as one JSON document: {"kind": ..., kind: [rows]}.

    One document is one row, so this form always has the limit of its kind.
    """
    flat = export_rows(rows, kind, order, EXPORT_LIMITS[kind])
    return flat.agg(F.collect_list(F.struct(*flat.columns)).alias("_rows")).select(
        F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("_rows").alias(kind))).alias("value")
    )
