"""From raw documents to packed training sequences: five stages, each over all that the last one kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandsift.llm.common import cut_lineage, ready
from bandsift.llm.crf import good_documents
from bandsift.llm.lines import without_repeated_lines
from bandsift.llm.nearcopies import one_of_each
from bandsift.llm.packing import packed_documents
from bandsift.llm.queries import SURROGATE_KEY
from bandsift.llm.surrogates import with_surrogates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars again the length of the text."""
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")
    return docs.select(*(n_chars if c == "n_chars" else F.col(c) for c in COLUMNS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the line labels reject go."""
    return good_documents(docs.select(*COLUMNS), ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents hold stay in one of them."""
    ready(spark)
    return _counted(without_repeated_lines(docs.select(*COLUMNS), least_chars=40, least_docs=5))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ready(spark)
    return one_of_each(docs.select(*COLUMNS), words=5, similarity=0.8)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates."""
    ready(spark)
    return _counted(with_surrogates(docs.select(*COLUMNS), SURROGATE_KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and offset each is packed into."""
    ready(spark)
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 0, 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: The line labels and the packing can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again by the next."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
