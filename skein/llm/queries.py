"""The queries of this folder, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .byte_bpe import encode_and_decode
from .chat import rotate_perspectives
from .line_dedup import dedup_lines
from .ngram_join import near_duplicates
from .packing import pack_documents
from .quality import judge_repetition
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .url_filters import RULES, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_repetition(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_repetition_rules, op2_token_counts, op3_line_dedup, op4_packing, op5_url_filters, op6_suffix_dedup, op7_perspective_rotation, op8_ngram_jaccard_join, op9_nearest_neighbours, op10_byte_bpe)
}

ORACLE_SQL = {
    "op5_url_filters": """
        WITH parts AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\\n)*$', '') ELSE '' END AS body FROM pages
        ), split AS (
            SELECT page_id, translate(split_part(body, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   CASE WHEN strpos(body, '/') > 0 THEN substr(body, strpos(body, '/')) ELSE '' END AS path FROM parts
        ), rules(r_host, r_path, r_verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), fits AS (
            SELECT page_id, r_host || r_path AS rule, r_verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS i
            FROM split JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
        )
        SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.r_verdict, 'allow') AS verdict
        FROM split s LEFT JOIN fits f ON s.page_id = f.page_id AND f.i = 1
    """,
    "op7_perspective_rotation": """
        WITH said AS (
            SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations
        ), people AS (
            SELECT DISTINCT conv_id, speaker AS participant FROM said WHERE speaker <> 'system'
        ), shown AS (
            SELECT s.*, participant,
                   CASE WHEN speaker = participant THEN '<|im_start|>assistant' || chr(10)
                        WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
                        ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head
            FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
        ), placed AS (
            SELECT *, head || content || '<|im_end|>' || chr(10) AS rendered,
                   row_number() OVER w - 1 AS position,
                   CAST(sum(length(head || content || '<|im_end|>' || chr(10))) OVER w AS BIGINT) AS upto
            FROM shown WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn ASC NULLS LAST, speaker, content ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, participant, position, turn, speaker, rendered, upto - length(rendered) AS start,
               CASE WHEN speaker = participant THEN upto - length(rendered) + length(head) END AS mask_start,
               CASE WHEN speaker = participant THEN upto - 1 END AS mask_end
        FROM placed
    """,
}
