"""The queries opN_<name>: each operator over its whole table with production parameters, and oracles where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bpe import bpe_digests
from lectern.llm.common import table
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.html_extract import extract
from lectern.llm.licenses import license_scan
from lectern.llm.lm_scoring import lm_scores
from lectern.llm.mixing import mix
from lectern.llm.ngram_join import jaccard_components
from lectern.llm.quality import quality
from lectern.llm.secret_scan import scan
from lectern.llm import url_filter


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=5, percent=80)


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_mixing": op7_mixing,
    "op8_secret_scan": op8_secret_scan,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_url_filter": url_filter.op10_url_filter,
}

#: Words as the operators take them: white space is 0x20 and 0x09-0x0D, A-Z are lowered.
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLES = {
    "op10_url_filter": url_filter.ORACLE,
    "op9_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y, c = i.n AND c = j.n AS same FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
        r AS (SELECT doc_id AS x, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.x WHERE r.m < e.y),
        m AS (SELECT x, min(m) AS m FROM r GROUP BY 1),
        k AS (SELECT x, count(*) AS n_links, count(*) FILTER (same) AS n_same FROM e GROUP BY 1)
        SELECT n.doc_id, n.n AS n_shingles, m.m AS component_id, coalesce(n_links, 0) AS n_links, coalesce(n_same, 0) AS n_same FROM n JOIN m ON m.x = n.doc_id LEFT JOIN k ON k.x = n.doc_id
    """,
    "op2_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)
    """,
}
