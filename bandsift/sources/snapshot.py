"""A table of channels that is kept up to date in place: buckets, copied when written, and versions.

Rows are dealt to a fixed number of buckets by (session, channel). An update reads and writes only the
buckets that it touches, into a folder of its own; then a manifest, which names for each bucket the
folder that holds it, is put in place by one rename. A reader takes the newest manifest, so it sees a
whole version or the one before it. A manifest also has the id of the batch that made it: a batch that
is sent again changes nothing.

    root/data/v=7/bucket=3/...      root/versions/0000000007.json

One writer at a time: a second one that wants the same version fails at the rename.

Edge cases: an update without rows makes a version with the buckets of the last one; repeated rows of
a channel count once, the newest version column wins; the snapshot of an empty root has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandsift.operators.maintenance import channel_upsert, drop_merged_channels
from bandsift.sources import files

KEY = ["session_id", "channel_id"]


class Snapshot:
    """The table below `root`; `schema` (DDL) is that of its rows."""

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = 64):
        self.spark, self.root, self.schema, self.buckets = spark, root.rstrip("/"), schema, buckets

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in files.names(self.spark, f"{self.root}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, or the newest: version, batch, number of buckets, and for each its folder."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        if version is None:
            return {"version": 0, "batch": None, "buckets": self.buckets, "held": {}}
        return json.loads(files.read_text(self.spark, self._path(version)))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version), None).drop("bucket")

    def upsert(self, updates: DataFrame, version_column: str, batch: int) -> int:
        """Take in the newest row of each channel; returns the version that has them."""
        return self._change(updates, lambda old, new: channel_upsert(old, new, version_column), batch)

    def drop(self, removed: DataFrame, batch: int) -> int:
        """Take out channels (session_id, channel_id), for example those merged into others."""
        return self._change(removed, drop_merged_channels, batch)

    def upsert_stream(self, updates: DataFrame, version_column: str, checkpoint: str):
        """A writer that keeps the table up to date; a batch that runs twice counts once."""

        def write(df: DataFrame, batch: int) -> None:
            self.upsert(df, version_column, batch)

        return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete manifests but the newest `keep`, and the folders that none of these names."""
        known = self.versions()
        gone = known[:-keep] if keep else known
        for version in gone:
            files.delete(self.spark, self._path(version))
        used = {v for version in known[len(gone) :] for v in self.manifest(version)["held"].values()}
        lost = [int(n[2:]) for n in files.names(self.spark, f"{self.root}/data") if n.startswith("v=")]
        lost = [v for v in lost if v not in used and v <= known[-1]] if known else []
        for version in lost:
            files.delete(self.spark, f"{self.root}/data/v={version}")
        return lost

    def _path(self, version: int) -> str:
        return f"{self.root}/versions/{version:010d}.json"

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")

    def _rows(self, manifest: dict, only: list[int] | None) -> DataFrame:
        held = {int(b): v for b, v in manifest["held"].items() if only is None or int(b) in only}
        schema = f"{self.schema}, bucket INT"
        if not held:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
        out = None
        # Folders of one version are read together; there are as many versions as buckets at most.
        for v in sorted(set(held.values())):
            own = [p for p, b in zip(paths, sorted(held), strict=True) if held[b] == v]
            rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data/v={v}").parquet(*own)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _change(self, rows: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], batch: int) -> int:
        now = self.manifest()
        if now["batch"] is not None and batch <= now["batch"]:
            return now["version"]
        version, buckets = now["version"] + 1, now["buckets"]
        touched = [r[0] for r in rows.select(self._bucket(buckets)).distinct().collect()]
        held = {int(b): v for b, v in now["held"].items()}
        if touched:
            names = T.StructType.fromDDL(self.schema).names
            new = apply(self._rows(now, touched).select(*names), rows).withColumn("bucket", self._bucket(buckets))
            folder = f"{self.root}/data/v={version}"
            new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
            # A bucket that lost its last row has no folder any more.
            there = {int(n[7:]) for n in files.names(self.spark, folder) if n.startswith("bucket=")}
            held = {b: v for b, v in held.items() if b not in touched} | {b: version for b in there}
        text = json.dumps({"version": version, "batch": batch, "buckets": buckets, "held": {str(b): v for b, v in sorted(held.items())}})
        files.write_text(self.spark, self._path(version), text)
        return version
