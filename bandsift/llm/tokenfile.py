"""Token-id files: one array of ids for many documents, with Elias-Fano boundaries.

A file holds the ids of documents in ascending doc_id order, two bytes each where the vocabulary
allows, then the Elias-Fano sequence of where each document ends, then that of the doc_ids, then a
footer. A set of files is described by a manifest, written last: a file that no manifest row names
(a lost attempt) does not count.

Edge cases: a null text is empty, so the document has its end id only; a null doc_id comes before
all others; repeated doc_ids stay together, in any order; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandsift.llm.chunks import chunks
from bandsift.llm.common import batches, cut_lineage, documents, give_back, open_in, open_out, ready, shared_folder, texts
from bandsift.llm.eliasfano import EliasFano, encode

MAGIC = b"TOKEF001"
#: ids, documents, null doc_ids, least doc_id, bytes an id, where the boundaries begin
FOOTER = "<QQQqBQ8s"

MANIFEST = "path string, n_docs long, n_ids long, n_null long, first_id long, last_id long"


def _write(path: str, it: Iterator[tuple[int | None, bytes]], wide: int) -> tuple:
    """Stream (doc_id, ids as u4) in order to a file; returns its manifest row."""
    total, ends, own, nulls = 0, [], [], 0
    with open_out(path) as out:
        for doc_id, ids in it:
            total += len(ids) // 4
            out.write(ids if wide == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
            ends.append(total)
            if doc_id is None:
                nulls += 1
            else:
                own.append(doc_id)
        least = own[0] if own else 0
        out.write(encode(np.array(ends, dtype=np.uint64)))
        out.write(encode((np.array(own, dtype=np.int64) - least).view(np.uint64)))
        out.write(struct.pack(FOOTER, total, len(ends), nulls, least, wide, total * wide, MAGIC))
    return path, len(ends), total, nulls, own[0] if own else None, own[-1] if own else None


class TokenFile:
    """Random access to one file: document i's ids without a table of offsets."""

    def __init__(self, path: str):
        self.file = open_in(path)
        size = self.file.size()
        tail = self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER))
        self.n_ids, self.n_docs, self.nulls, self.least, self.wide, at, magic = struct.unpack(FOOTER, tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        data = self.file.read_at(size - struct.calcsize(FOOTER) - at, at)
        self.ends = EliasFano(data)
        self.ids_of_docs = EliasFano(data, self.ends.end)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.ids_of_docs.select(i - self.nulls)

    def read(self, start: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - start) * self.wide, start * self.wide)
        return np.frombuffer(raw, "<u2" if self.wide == 2 else "<u4")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Encode documents(doc_id, text) and write them below folder; returns the manifest table.

    Range partitions of doc_id, whose number follows the session's settings, become files of
    bounded size. size: number of ids of the vocabulary, the end id included.
    """
    wide = 2 if size <= 1 << 16 else 4
    last = np.array([end_id], "<u4").tobytes()

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            encoder = chunks(vocabulary, True)
            for batch in batches(it):
                yield from zip(batch.column("doc_id").to_pylist(), (x + last for x in encoder.encode(texts(batch))), strict=True)

        stream = rows()
        first = next(stream, None)
        if first is None:
            return

        def all_rows():
            yield first
            yield from stream

        row = _write(f"{folder}/{uuid.uuid4().hex}.tok", all_rows(), wide)
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip([x.split()[0] for x in MANIFEST.split(", ")], row, strict=True)}, schema=_MANIFEST)

    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    written = cut_lineage(ordered.mapInArrow(write, MANIFEST))
    # One row a file: the running sum is over the files, not over documents.
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "last_id").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


_MANIFEST = pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("n_docs", "n_ids", "n_null", "first_id", "last_id"))])


#: Documents whose boundaries, and ids of which, are decoded at a time.
STEP_DOCS, STEP_IDS = 2048, 1 << 20


def read_token_files(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """(doc_id, start, ids as little-endian unsigned 32-bit binary) of every document of the files.

    A file is walked in steps: boundaries and doc_ids of a step's documents come from the select
    structures, so no task holds a table of offsets. Files are dealt over `tasks` tasks.
    """

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in it:
                for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                    file = TokenFile(path)
                    for at in range(0, file.n_docs, STEP_DOCS):
                        yield from _step(file, start, at, min(at + STEP_DOCS, file.n_docs))
        finally:
            give_back()

    tasks = tasks or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("path", "start").repartition(tasks, "path")
    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def _step(file: TokenFile, before: int, at: int, upto: int) -> Iterator[pa.RecordBatch]:
    """Documents at to upto - 1 of a file; `before`: ids in the files before it."""
    cuts = np.concatenate([[file.span(at)[0]], file.ends.between(at, upto)])
    null = min(max(file.nulls - at, 0), upto - at)
    own = [None] * null + (file.ids_of_docs.between(at + null - file.nulls, upto - file.nulls) + file.least).tolist() if upto > file.nulls else [None] * (upto - at)
    i = 0
    while i < upto - at:
        k = max(i + 1, int(np.searchsorted(cuts, cuts[i] + STEP_IDS, side="right")) - 1)
        ids = file.read(int(cuts[i]), int(cuts[k])).astype("<u4").tobytes()
        places = ((cuts[i : k + 1] - cuts[i]) * 4).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[i:k], pa.int64()), pa.array(cuts[i:k] + before, pa.int64()), pa.array([ids[a:b] for a, b in zip(places[:-1], places[1:], strict=True)], pa.binary())],
            names=["doc_id", "start", "ids"],
        )
        i = k


def token_file_digests(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    ready(spark)
    manifest = write_token_files(docs, shared_folder(spark, "tokens"), vocabulary, end_id, size)
    ids = read_token_files(manifest)
    return ids.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


