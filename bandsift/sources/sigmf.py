"""IQ captures as SigMF file pairs, read and written by tasks in byte ranges."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.functions.samples import decode, encode
from bandsift.operators.ordered import number_chunk, with_running_sum
from bandsift.runtime import cut_lineage

SIGMF_SCHEMA = (
    "capture STRING, start_sample BIGINT, center_hz BIGINT, sample_rate INT, "
    "captured_at DOUBLE, iq ARRAY<FLOAT>"
)
_DATA, _META = ".sigmf-data", ".sigmf-meta"

#: What a listing says of a file pair.
LISTING_SCHEMA = (
    "capture STRING, path STRING, bytes BIGINT, datatype STRING, center_hz BIGINT, sample_rate INT, "
    "captured_at DOUBLE, date DATE"
)

#: Bytes that a read task gets, and samples of a block.
PARTITION_BYTES, BLOCK_SAMPLES = 128 << 20, 262_144


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def list_sigmf(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file pair under `path`: Spark lists the folder and tasks read the sidecars.

    Data files without a sidecar, and sidecars without data, are left out. A listing may be stored as a
    table (`write_sigmf` returns what it needs too), so that later reads list nothing.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    stem = lambda suffix: F.expr(f"left(path, length(path) - {len(suffix)})")
    data = found.option("pathGlobFilter", f"*{_DATA}").load(_uri(path)).select(stem(_DATA).alias("_stem"), "path", F.col("length").alias("bytes"))
    text = F.col("content").cast("string")
    meta = found.option("pathGlobFilter", f"*{_META}").load(_uri(path)).select(stem(_META).alias("_stem"), F.from_json(text, _SIDECAR).alias("m"))
    first = F.col("m.captures")[0]
    at = F.coalesce(F.to_timestamp(first["core:datetime"]).cast("double"), F.lit(0.0))
    return data.join(meta, "_stem").select(
        F.element_at(F.split("_stem", "/"), -1).alias("capture"),
        "path",
        "bytes",
        F.col("m.global")["core:datatype"].alias("datatype"),
        first["core:frequency"].cast("bigint").alias("center_hz"),
        F.col("m.global")["core:sample_rate"].cast("int").alias("sample_rate"),
        at.alias("captured_at"),
        F.to_date(F.timestamp_seconds(at)).alias("date"),
    )


_SIDECAR = (
    "global STRUCT<`core:datatype`: STRING, `core:sample_rate`: DOUBLE>, "
    "captures ARRAY<STRUCT<`core:datetime`: STRING, `core:frequency`: DOUBLE>>"
)


def read_listed(
    listing: DataFrame, block_samples: int = BLOCK_SAMPLES, partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """`iq_blocks` of the listed captures; filters on the listing (centre, date, name) prune files.

    Large files are cut into ranges of whole blocks, and ranges are packed, by running sum of their
    bytes, into partitions of about `partition_bytes`: many small files make few partitions.
    """
    width = F.when(F.col("datatype") == "cu8", 2).otherwise(8).cast("bigint")
    most = F.greatest(F.lit(1), F.floor(F.lit(partition_bytes) / (width * block_samples))) * width * block_samples
    cut = listing.withColumn("_most", most.cast("bigint")).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.col("_most")))
    )
    cut = cut.withColumn("last", F.least(F.col("first") + F.col("_most"), F.col("bytes"))).drop("_most")
    # Where a range lies in the order of packing; its chunk of the running sum follows from it.
    cut = cut.withColumn("_place", F.pmod(F.xxhash64("path"), F.lit(1 << 20))).withColumn("_all", F.lit(0))
    size = F.col("last") - F.col("first")
    placed = cut_lineage(with_running_sum(cut, ["_all"], ["_place", "path", "first"], {"_through": size}, number_chunk("_place", 1024)))
    total = placed.agg(F.max("_through")).first()[0] or 0
    tasks = max(1, -(-total // partition_bytes))
    bin_ = F.least(F.floor((F.col("_through") - size) / partition_bytes), F.lit(tasks - 1)).cast("int")
    packed = placed.withColumn("_bin", bin_).repartitionById(tasks, "_bin").select(*_RANGE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _blocks(row, block_samples)

    rows = packed.mapInArrow(read, SIGMF_SCHEMA)
    return rows.withColumn("session_id", F.xxhash64("capture"))


_RANGE = ["capture", "path", "datatype", "center_hz", "sample_rate", "captured_at", "first", "last"]
_BLOCK = pa.schema(
    [
        ("capture", pa.string()),
        ("start_sample", pa.int64()),
        ("center_hz", pa.int64()),
        ("sample_rate", pa.int32()),
        ("captured_at", pa.float64()),
        ("iq", pa.list_(pa.float32())),
    ]
)


def _blocks(row: dict, block_samples: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one range of a file."""
    width = 2 if row["datatype"] == "cu8" else 8
    fs, where = pafs.FileSystem.from_uri(_uri(row["path"]))
    at = row["first"]
    with fs.open_input_file(where) as f:
        f.seek(at)
        while at < row["last"]:
            raw = f.read(min(block_samples * width, row["last"] - at))
            raw = raw[: len(raw) // width * width]
            if not raw:
                break
            iq, start = decode(raw, row["datatype"]), at // width
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["capture"]]),
                    pa.array([start], pa.int64()),
                    pa.array([row["center_hz"]], pa.int64()),
                    pa.array([row["sample_rate"]], pa.int32()),
                    pa.array([row["captured_at"] + start / row["sample_rate"]]),
                    pa.ListArray.from_arrays(pa.array([0, len(iq)], pa.int32()), pa.array(iq, pa.float32())),
                ],
                schema=_BLOCK,
            )
            at += len(raw)


def read_sigmf(
    spark: SparkSession, path: str, block_samples: int = BLOCK_SAMPLES, partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """`iq_blocks` of every capture under `path`; the capture's name gives the session."""
    return read_listed(list_sigmf(spark, path), block_samples, partition_bytes)


RECORDING_SCHEMA = (
    "session_id BIGINT, timestamp STRING, path STRING, center_hz BIGINT, sample_rate INT, "
    "gain STRING, duration_ms BIGINT, format STRING, bytes BIGINT, sigmf_meta STRING"
)


def sidecar(datatype: str, rate: int, center: int, stamp: str, note: str, gain: str, annotations: list) -> dict:
    """The metadata of one recording, by the SigMF specification; `gain` is an extension field."""
    segment = {"core:sample_start": 0, "core:datetime": stamp, "core:frequency": center, "gain": gain}
    described = {"core:version": "1.0.0", "core:datatype": datatype, "core:sample_rate": rate}
    return {
        "global": described | {"core:description": note},
        "captures": [segment],
        "annotations": annotations,
    }


def _stamp(start_us: int) -> str:
    at = datetime.fromtimestamp(0, UTC) + timedelta(microseconds=start_us)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def write_sigmf(
    captures: DataFrame,
    path: str,
    fmt: str = "cu8",
    gain: str = "auto",
    reason: str = "triggered",
    max_ms: int = P.MAX_RECORDING_MS,
) -> DataFrame:
    """Write each capture as one file pair, or several of at most `max_ms` each if it is longer;
    returns the recordings rows, one per pair.

    `captures` has session_id, captured_ts, center_hz, sample_rate, iq and annotations
    (JSON text, which goes with the first pair). Names hold session, centre, start in
    microseconds and a hash of the content, so captures of one instant stay apart, and a
    task that runs again writes the same files. Nothing is written until the result is used.
    """
    datatypes = {"cf32": "cf32_le", "cu8": "cu8"}
    if fmt not in datatypes:
        raise ValueError(f"{fmt!r} is not one of the sample formats {', '.join(datatypes)}")
    datatype = datatypes[fmt]
    target = _uri(path)
    names = [part.split()[0] for part in RECORDING_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(target)
        fs.create_dir(root, recursive=True)

        def put(session: int, start_us: int, center: int, rate: int, iq, notes: str | None) -> tuple:
            raw, stamp = encode(iq, datatype), _stamp(start_us)
            text = json.dumps(sidecar(datatype, rate, center, stamp, f"{reason} recording", gain, json.loads(notes or "[]")))
            name = f"{root}/s{session}-f{center}-t{start_us}-{hashlib.blake2b(raw, digest_size=6).hexdigest()}"
            for content, suffix in ((text.encode(), _META), (raw, _DATA)):
                with fs.open_output_stream(name + suffix) as f:
                    f.write(content)
            ms = round(len(iq) // 2 / rate * 1000.0)
            return session, stamp, name + _DATA, center, rate, gain, ms, datatype, len(raw), text

        for batch in batches:
            for i in range(batch.num_rows):
                session, start_us, center, rate, notes = (
                    batch.column(c)[i].as_py()
                    for c in ("session_id", "start_us", "center_hz", "sample_rate", "annotations")
                )
                iq = batch.column("iq")[i].values.to_numpy(zero_copy_only=False)
                most = 2 * max(1, int(rate * max_ms / 1000.0))
                out = [
                    put(session, start_us + at // 2 * 1_000_000 // rate, center, rate, iq[at : at + most], None if at else notes)
                    for at in range(0, max(1, len(iq)), most)
                ]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(),
                         pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names
                )

    return captures.select(
        "session_id",
        F.unix_micros(F.col("captured_ts").cast("timestamp")).alias("start_us"),
        "center_hz",
        "sample_rate",
        "iq",
        "annotations",
    ).mapInArrow(run, RECORDING_SCHEMA)
