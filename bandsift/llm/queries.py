"""The numbered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandsift.llm.common import documents, table


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.bpe import round_trip

    docs = table(spark, folder, "documents")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Production reads the secret from where secrets are kept; these tables are invented.
SURROGATE_KEY = "surrogates of invented data"


def op2_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.surrogates import with_surrogates

    docs = documents(table(spark, folder, "documents"))
    return with_surrogates(docs, SURROGATE_KEY, count="n_entities")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.suffix import remove_repeats

    found = remove_repeats(table(spark, folder, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.lines import without_repeated_lines

    docs = documents(table(spark, folder, "documents"))
    kept = without_repeated_lines(docs, least_chars=40, least_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_bit_sliced_topk(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.bitslice import top_inner_products

    return top_inner_products(table(spark, folder, "embeddings"), scale=64.0, every=20, k=20)


def op6_simhash_golay(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.simhash import near_groups

    groups = near_groups(table(spark, folder, "documents"), words=4, reach=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.lattice import scores

    return scores(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), modulus=7, left_out=2)


def op8_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.tokenfile import token_file_digests

    docs = table(spark, folder, "documents")
    return token_file_digests(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 50257)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.packing import packed_documents

    docs = table(spark, folder, "documents")
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 0, 2048)


def op10_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.crf import quality

    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.audit import audit

    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.toxicity import toxicity

    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), modulus=4, left_out=2)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from bandsift.llm.runs import periodic_runs

    found = periodic_runs(table(spark, folder, "documents"), altered=True)
    return found.select(*(c for c in found.columns if c != "collapsed"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_bit_sliced_topk": op5_bit_sliced_topk,
    "op6_simhash_golay": op6_simhash_golay,
    "op7_lattice_scores": op7_lattice_scores,
    "op8_token_ids": op8_token_ids,
    "op9_packing": op9_packing,
    "op10_line_quality": op10_line_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_toxicity": op12_toxicity,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op5_bit_sliced_topk": """
WITH whole AS (
    SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op4_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, k.place, k.line, r.key IS NOT NULL AND k.doc_id < r.stays AS gone
    FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_filter_audit": r"""
WITH docs AS (
    SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), marks AS (
    SELECT CAST(doc_id AS BIGINT) AS doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1
), failing AS (
    SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
           100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
           regexp_matches(text, '[#$%&*|]') AS d,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS e,
           coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
    FROM docs LEFT JOIN marks USING (doc_id)
), counted AS (
    SELECT part, [a, b, c, d, e] AS f,
           count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM failing GROUP BY ALL
), letter AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
    FROM letter p, letter q, letter r, letter s, letter t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), fallen AS (
    SELECT c.*, filter_order, step, filter_order[step] AS own, f[ascii(filter_order[step]) - 64] AS fails,
           len([i FOR i IN [1, 2, 3, 4, 5] IF i < step AND f[ascii(filter_order[i]) - 64]]) > 0 AS gone,
           len([x FOR x IN f IF x]) = 1 AS alone
    FROM counted c, orders, unnest([1, 2, 3, 4, 5]) AS u(step)
), steps AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE gone AND fails), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE fails AND alone), 0) AS unique_fails,
           coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0) AS toxic_lost
    FROM fallen GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM steps
""",
}
