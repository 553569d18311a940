"""The registered queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; the same package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.piece_nbest import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.html_text import html_text

    return html_text(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.line_dedup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.packing import packing

    return packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewatch.llm.token_alignment import token_alignment

    return token_alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewatch.llm.byte_bpe import byte_bpe_digest

    return byte_bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.llm.spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: The others can't be stated as SQL on the given tables: models, dictionaries and searches
#: are fitted or read outside SQL. tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_suffix_dedup": """WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, x[i:i + 99] AS w FROM (SELECT doc_id, x, unnest(range(1, n - 98)) AS i FROM bytes WHERE n >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM late)) GROUP BY doc_id, r),
gone AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM runs UNION ALL SELECT doc_id, max(z) + 1, any_value(n) FROM runs JOIN bytes USING (doc_id) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(hex(x[f:t]), '' ORDER BY f) AS h FROM gaps JOIN bytes USING (doc_id) WHERE t >= f GROUP BY 1)
SELECT bytes.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN n_removed IS NULL THEN x ELSE unhex(coalesce(h, '')) END) AS kept_sha256 FROM bytes LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_jaccard_join": f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
filed AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) - count(*) AS both_sizes, count(*) AS shared FROM filed a JOIN filed b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 75 * both_sizes),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, c AS component_id FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) ON a = sets.doc_id""",
}
