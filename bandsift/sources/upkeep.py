"""Upkeep of what lies on disk: old rows and recordings go, and with them their folders and files.

Whatever deletes writes down first what it is going to do (an intent), does it, and takes the note
away. Each step can be done again, so a run that died is finished by the next one (`recover`).

* `prune_dated`: of a table in dated folders, folders before the cutoff go whole; of the day that the
  cutoff cuts, the rows that stay are written beside it and take its place.
* `evict_recordings`, `delete_recordings`: file pairs are deleted by tasks, as many at a time as there
  are cores, and then the rows that name them. `delete_orphans` deletes pairs that no row names.

Readers of a table should not run while a day is replaced: for a moment it isn't there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandsift.operators.maintenance import recording_delete, retention_prune, storage_cap_evict
from bandsift.sources import files
from bandsift.sources.sigmf import _DATA, _META, _uri

JOURNAL = "_intents"


def _note(spark: SparkSession, root: str, steps: list[list]) -> str:
    path = f"{root}/{JOURNAL}/{uuid.uuid4().hex}.json"
    files.write_text(spark, path, json.dumps(steps))
    return path


def _do(spark: SparkSession, step: list) -> None:
    kind, *paths = step
    if kind == "delete":
        files.delete(spark, paths[0])
    elif kind == "replace":
        new, old = paths
        if files.exists(spark, new):  # else it has taken its place already
            files.delete(spark, old)
            files.rename(spark, new, old)
    elif kind == "pairs":
        if files.exists(spark, paths[0]):
            deleted = delete_pairs(spark.read.schema("path STRING").parquet(paths[0]))
            deleted.agg(F.sum("files")).collect()
    else:
        raise ValueError(f"unknown step {kind!r}")


def _finish(spark: SparkSession, note: str) -> None:
    for step in json.loads(files.read_text(spark, note)):
        _do(spark, step)
    files.delete(spark, note)


def recover(spark: SparkSession, root: str) -> int:
    """Finish what a run that died had begun; returns how many notes there were."""
    notes = [n for n in files.names(spark, f"{root}/{JOURNAL}") if n.endswith(".json")]
    for name in notes:
        _finish(spark, f"{root}/{JOURNAL}/{name}")
    return len(notes)


def prune_dated(spark: SparkSession, root: str, table: str, as_of: str, days: int) -> int:
    """Delete the rows of root/table that are older than `days` before `as_of`; returns the folders
    that went or were replaced. Only the day that the cutoff cuts is read."""
    recover(spark, root)
    cutoff = datetime.fromisoformat(as_of) - timedelta(days=days)
    held = [n for n in files.names(spark, f"{root}/{table}") if n.startswith("date=") and n[5:15].replace("-", "").isdigit()]
    old = [n for n in held if date.fromisoformat(n[5:]) < cutoff.date()]
    steps = [["delete", f"{root}/{table}/{n}"] for n in old]
    day = f"date={cutoff.date().isoformat()}"
    if day in held and cutoff.time() != datetime.min.time():
        path, beside = f"{root}/{table}/{day}", f"{root}/{JOURNAL}/{uuid.uuid4().hex}"
        rows = spark.read.parquet(path)
        retention_prune(rows, as_of, days).write.partitionBy("ingest_batch").parquet(beside)
        steps.append(["replace", beside, path])
    if steps:
        _finish(spark, _note(spark, root, steps))
    return len(steps)


def delete_pairs(paths: DataFrame) -> DataFrame:
    """(path, files): delete the data file `path` and its sidecar; how many of the two were there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = batch.column("path").to_pylist(), []
            for path in own:
                fs, where = pafs.FileSystem.from_uri(_uri(path))
                pair = [where, where.removesuffix(_DATA) + _META]
                there = [f.path for f in fs.get_file_info(pair) if f.type == pafs.FileType.File]
                for one in there:
                    fs.delete_file(one)
                n.append(len(there))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(n, pa.int32())], names=["path", "files"])

    return paths.select("path").mapInArrow(run, "path string, files int")


def _delete(spark: SparkSession, root: str, table: str, recordings: DataFrame, kept: DataFrame) -> None:
    """File pairs of the recordings that aren't kept, then the rows: of the days that lose any."""
    gone = recordings.join(kept.select("recording_id"), "recording_id", "left_anti")
    listed = f"{root}/{JOURNAL}/{uuid.uuid4().hex}"
    gone.select("recording_id", "path", "date").write.parquet(listed)
    lost = spark.read.parquet(listed)
    days = lost.select("date").distinct()
    beside = f"{root}/{JOURNAL}/{uuid.uuid4().hex}"
    rest = recordings.join(days, "date", "left_semi").join(lost.select("recording_id"), "recording_id", "left_anti")
    rest.select(recordings.columns).write.partitionBy("date", "ingest_batch").parquet(beside)
    left = set(files.names(spark, beside))
    steps = [["pairs", listed]]
    for name in sorted(f"date={r[0].isoformat()}" for r in days.collect()):
        path = f"{root}/{table}/{name}"
        steps.append(["replace", f"{beside}/{name}", path] if name in left else ["delete", path])
    steps.append(["delete", beside])
    steps.append(["delete", listed])
    _finish(spark, _note(spark, root, steps))


def evict_recordings(spark: SparkSession, root: str, recordings: DataFrame, cap_bytes: int, incoming_bytes: int = 0, table: str = "recordings") -> None:
    """Delete the oldest recordings until `incoming_bytes` more fit under the cap: pairs and rows.

    `recordings` is the table below root, with its `date`.
    """
    recover(spark, root)
    kept = storage_cap_evict(recordings, cap_bytes, incoming_bytes)
    _delete(spark, root, table, recordings, kept)


def delete_recordings(spark: SparkSession, root: str, recordings: DataFrame, ids: DataFrame, table: str = "recordings") -> None:
    """Delete the named recordings: pairs and rows."""
    recover(spark, root)
    _delete(spark, root, table, recordings, recording_delete(recordings, ids))


def delete_orphans(spark: SparkSession, folder: str, recordings: DataFrame, older_than: str) -> int:
    """Delete the file pairs below `folder` that no row of `recordings` names: what jobs that failed for
    good have left. Files written after `older_than` stay, since their rows may still come. Returns how
    many files went; a run that died is made up for by the next."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{_DATA}").load(_uri(folder))
    old = found.filter(F.col("modificationTime") < F.lit(older_than).cast("timestamp"))
    bare = lambda c: F.regexp_replace(c, "^file:(//)?", "")
    listed = old.select("path", bare("path").alias("_bare"))
    named = recordings.select(bare("path").alias("_bare"))
    gone = delete_pairs(listed.join(named, "_bare", "left_anti"))
    return int(gone.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0])
