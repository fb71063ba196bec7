"""Byte-level BPE by given ranks: overlapping chunks, stitched where pre-tokens resynchronise.

A long text is cut into chunks that overlap; each is pre-tokenised from its own start, in parallel.
The pattern looks ahead only, so two runs that share a boundary agree from there on: the first
boundary that a chunk shares with its successor in their overlap is where one piece ends and the
next begins. A text in which some overlap has no common boundary (a pre-token longer than the
overlap) is encoded in one piece. Pieces are encoded in parallel and joined in order. Decoding
concatenates the bytes of the ids.

Edge cases: a null or empty text has no ids and decodes to no bytes; repeated rows and doc_ids give
a row each; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from bandsift.llm.common import MEMO, batches, documents, texts

#: Characters of a chunk and of the overlap behind it.
CHUNK, OVERLAP = 1 << 15, 1 << 10

#: A boundary counts if so many characters after it are known: the longest look ahead, less one.
AHEAD = 2

INTS = ArrayType(IntegerType())

#: Pre-tokens remembered in a worker.
REMEMBERED = 400_000


def ranks(path: str) -> dict[bytes, int]:
    def read() -> dict[bytes, int]:
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    return MEMO.of(("ranks", path), read)


def pattern(text: str) -> regex.Pattern:
    """The pattern with white space as the property of that name, whatever the library's \\s is."""
    return regex.compile(text.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Encoder(dict):
    """pre-token -> its ids as 32-bit integers."""

    def __init__(self, path: str, split: str):
        super().__init__()
        self.pattern = pattern(split)
        self.bpe = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks(path), special_tokens={})

    def __missing__(self, token: str) -> bytes:
        ids = self[token] = array("i", self.bpe.encode_ordinary(token)).tobytes()
        return ids

    def encode(self, text: str, size: int | None = None) -> bytes:
        """Ids of the first `size` characters, which end at a boundary; the rest is only looked at."""
        if len(self) > REMEMBERED:
            self.clear()
        tokens = self.pattern.findall(text)
        beyond = 0 if size is None else len(text) - size
        while beyond > 0:
            beyond -= len(tokens.pop())
        return b"".join(map(self.__getitem__, tokens))

    def boundaries(self, text: str, ends: bool) -> list[int]:
        """Where pre-tokens start; but for the end of a text, only what more text can't change."""
        sure = len(text) if ends else len(text) - AHEAD
        return [m.end() for m in self.pattern.finditer(text) if m.end() <= sure]


def encoder(path: str, split: str) -> Encoder:
    return MEMO.of(("bpe", path, split), lambda: Encoder(path, split))


def _ids(found: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))


def _encode(rows: DataFrame, column: str, path: str, split: str) -> DataFrame:
    """Replaces a text column (and the column `size` beside it, if there) by its ids."""
    kept = [c for c in rows.columns if c not in (column, "size")]
    sized = "size" in rows.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, split)
        for batch in batches(it, column):
            found = texts(batch, column)
            sizes = batch.column("size").to_pylist() if sized else [None] * len(found)
            ids = _ids(list(map(own.encode, found, sizes)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], names=[*kept, "ids"])

    schema = rows.select(*kept).schema.add("ids", INTS)
    return rows.mapInArrow(run, schema)


def _stitched(long: DataFrame, path: str, split: str, chunk: int, overlap: int) -> DataFrame:
    """(key, doc_id, piece, text, size) of long texts: pieces with the few characters after each."""
    n = F.ceil(F.length("text") / chunk).cast("int")
    keyed = long.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", n.alias("n"))
    cut = keyed.select("key", "doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"), "text")
    cut = cut.select("key", "doc_id", "n", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("text"))

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, split)
        for batch in batches(it):
            heads, tails = [], []
            for text, k, n in zip(texts(batch), batch.column("k").to_pylist(), batch.column("n").to_pylist(), strict=True):
                at = own.boundaries(text, ends=k >= n - 1)
                heads.append([0] + [p for p in at if p < overlap])
                tails.append([p - chunk for p in at if chunk <= p < chunk + overlap])
            arrays = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "heads", "tails"])

    schema = cut.schema.add("heads", INTS).add("tails", INTS)
    marked = cut.repartition("key", "k").mapInArrow(mark, schema)
    order = Window.partitionBy("key").orderBy("k")
    met = marked.withColumn("next", F.array_min(F.array_intersect("tails", F.lead("heads").over(order)))).drop("heads", "tails")
    met = met.withColumn("own", F.coalesce(F.lag("next").over(order), F.lit(0)))
    whole = F.min((F.col("k") == F.col("n") - 1) | F.col("next").isNotNull()).over(Window.partitionBy("key"))
    met = met.withColumn("agree", whole)
    last = F.col("k") == F.col("n") - 1
    size = F.when(last, F.length("text")).otherwise(F.when(F.col("agree"), chunk + F.col("next")).otherwise(chunk))
    met = met.withColumn("size", size - F.when(F.col("agree"), F.col("own")).otherwise(0))
    text = F.when(F.col("agree"), F.substring("text", F.col("own") + 1, F.col("size") + AHEAD)).otherwise(F.substring("text", F.lit(1), F.col("size")))
    pieces = met.select("key", "doc_id", F.when(F.col("agree"), F.col("k")).otherwise(0).alias("piece"), "k", text.alias("text"), "size")
    # One row for each piece; all chunks of a text whose chunks don't agree.
    joined = pieces.groupBy("key", "doc_id", "piece").agg(
        F.sort_array(F.collect_list(F.struct("k", "text"))).alias("parts"), F.sum("size").cast("int").alias("size")
    )
    return joined.select("key", "doc_id", "piece", F.array_join(F.col("parts.text"), "").alias("text"), "size")


def encode(docs: DataFrame, path: str, split: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of documents(doc_id, text): each match of the pattern merged by the ranks in path."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    docs = documents(docs)
    short = _encode(docs.filter(F.length("text") <= chunk), "text", path, split)
    pieces = _encode(_stitched(docs.filter(F.length("text") > chunk), path, split, chunk, overlap), "text", path, split)
    parts = pieces.groupBy("key", "doc_id").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    return short.unionByName(parts.select("doc_id", F.flatten("parts.ids").alias("ids")))


def decode(rows: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """Adds `decoded`, the bytes of the ids, in place of the ids."""
    kept = [c for c in rows.columns if c != column]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks(path)
        word = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            word[i] = token
        for batch in it:
            ids = batch.column(column)
            flat = np.asarray(ids.values)
            at = np.asarray(ids.offsets).tolist()
            out = [b"".join(map(word.__getitem__, flat[a:b].tolist())) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("decoded", "binary"))


def round_trip(docs: DataFrame, path: str, split: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = encode(docs, path, split, chunk, overlap)
    hashed = ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        "ids",
    )
    out = decode(hashed, path)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
