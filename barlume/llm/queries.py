"""The thin queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.llm import alignment, bpe, chat, collocations, html_extract, jaccard, langid, licenses, mixing, quality, token_files, topk, toxicity
from barlume.llm.common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.to_integers(table(spark, sf_dir, "embeddings"))
    return topk.nra_top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_conversations(rows))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


#: The documents have no paths: each gets one from its doc_id, ten to a directory three levels deep,
#: with a licence file first in each directory of ten, hundred and thousand.
PATHS = """SELECT doc_id, text, concat('d', CAST(floor(doc_id / 1000) AS BIGINT), '/',
  CASE WHEN doc_id % 1000 = 0 THEN 'LICENSE' ELSE concat('d', CAST(floor(doc_id / 100) AS BIGINT), '/',
  CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE concat('d', CAST(floor(doc_id / 10) AS BIGINT), '/',
  CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE concat(CAST(doc_id AS VARCHAR(20)), '.txt') END) END) END) AS path FROM """


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(spark.sql(PATHS + "{docs}", docs=docs))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), Scratch(spark, "tokens")))


TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5"""


CHATS = "SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')"


def queries() -> dict[str, Query]:
    found = (
        op1_topk_search, op2_html_extraction, op3_source_mixing, op4_chat_formatting, op5_language_id, op6_bpe, op7_toxicity, op8_license_scan, op9_ngram_jaccard, op10_quality_rules,
        op11_tokenizer_alignment, op12_phrase_collocations, op13_token_files,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the whole result; the others are tested against brute force in tests/llm."""
    return {
        "op1_topk_search": TOPK_SQL, "op3_source_mixing": mixing.mix_sql(), "op4_chat_formatting": chat.read_back_sql(CHATS), "op8_license_scan": licenses.scan_sql(PATHS + "documents"),
        "op9_ngram_jaccard": jaccard.components_sql(), "op12_phrase_collocations": collocations.collocations_sql(),
    }
