"""Filter interaction audit: what every order of five filters would keep, remove and repeat.

Each document gets a mask of the filters it fails, and documents are counted by part and mask. For a
mask, the orders in which it falls at one step to one filter begin with filters that it passes, then
that filter; such orders are neighbours in lexicographic order. So a mask's removals are a few
intervals of Lehmer ranks for each step: its counts are added where an interval begins and taken away
where it ends, and a running sum over the 120 ranks gives all orders at once. No order is replayed.

Filters: A under LEAST_WORDS words; B fewer than half of the words distinct; C over 2 % capitals;
D any character of SYMBOLS; E a text that a smaller doc_id has too, anywhere in the table.

Edge cases: a null text is empty; a null source is the empty string; a null doc_id is never larger
than another, so its text is a first one, and it has no labels; repeated rows count as they stand
(equal doc_ids are not smaller than each other); a document is good or toxic if any label row of its
doc_id says 1; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandsift.llm.common import batches, cut_lineage, texts

LETTERS = "ABCDE"
LEAST_WORDS = 200
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
SAME_TEXT = 1 << LETTERS.index("E")

#: All orders; the place of one is its Lehmer rank.
ORDERS = ["".join(p) for p in permutations(LETTERS)]

COUNTS = ["n", "good", "toxic"]


def facts(text: str) -> tuple[int, bytes]:
    """(mask of the filters A to D that a text fails, a digest that only equal texts share)."""
    data = text.encode()
    words = data.split()
    mask = len(words) < LEAST_WORDS
    mask |= (100 * len(set(words)) < 50 * len(words)) << 1
    mask |= (100 * (len(data) - len(data.translate(None, CAPITALS))) > 2 * len(text)) << 2
    mask |= (len(data) != len(data.translate(None, SYMBOLS))) << 3
    return int(mask), hashlib.sha256(data).digest()


def intervals(mask: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank after the last) of the orders that remove such a document at a step."""
    size = [1, 1, 2, 6, 24]
    out = []

    def walk(rank: int, rest: str) -> None:
        for place, letter in enumerate(rest):
            block = size[len(rest) - 1]
            low = rank + place * block
            if mask >> LETTERS.index(letter) & 1:
                out.append((len(LETTERS) - len(rest) + 1, low, low + block))
            elif len(rest) > 1:
                walk(low, rest[:place] + rest[place + 1 :])

    if mask:
        walk(0, LETTERS)
    return out


def _facts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        masks, digests = zip(*map(facts, texts(batch)), strict=True) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            names=["doc_id", "part", "mask", "digest"],
        )


def tallies(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, 32 rows a part at most.

    Equal rows are counted together before anything is joined, and the first holder of a text is
    found by (doc_id, digest), so that copies of one text meet in no task.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = own.mapInArrow(_facts, "doc_id long, part string, mask int, digest binary")
    rows = cut_lineage(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")))
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    joined = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.when(again, F.col("mask") + SAME_TEXT).otherwise(F.col("mask"))
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return joined.groupBy("part", mask.alias("mask")).agg(of("good"), of("toxic"), F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    spark = docs.sparkSession
    tallied = cut_lineage(tallies(docs, labels))

    ends = [(m, s, rank, sign) for m in range(1 << len(LETTERS)) for s, low, high in intervals(m) for rank, sign in ((low, 1), (high, -1))]
    ends = spark.createDataFrame(ends, "mask int, step int, rank int, sign int")
    steps = [(r, s, order, order[s - 1]) for r, order in enumerate(ORDERS) for s in range(1, len(LETTERS) + 1)]
    steps = spark.createDataFrame(steps, "rank int, step int, filter_order string, letter string")

    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(len(LETTERS))]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(len(LETTERS))]
    parts = tallied.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))

    changes = tallied.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(*(F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTS))
    grid = parts.crossJoin(F.broadcast(steps)).join(changes, ["part", "step", "rank"], "left")
    by_rank = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("part", "letter")
    place = F.expr(f"instr('{LETTERS}', letter)")
    summed = grid.select("*", *(F.coalesce(F.sum(c).over(by_rank), F.lit(0)).alias(f"{c}_removed") for c in COUNTS))
    removed = F.col("n_removed")
    return summed.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum(removed).over(along)).alias("kept"),
        removed.alias("removed"),
        (F.element_at("fails", place) - removed).alias("redundant"),
        F.element_at("alone", place).alias("unique_fails"),
        F.col("good_removed").alias("good_lost"),
        F.col("toxic_removed").alias("toxic_lost"),
        F.sum(removed).over(every).alias("shapley"),
    )
