"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.store import Scratch, bound_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The default tokenizer file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.html import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.huffman import read_encoded, write_encoded

    path = f"{Scratch(spark, 'huffman-files').path}/documents"
    write_encoded(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_encoded(spark, path, with_ids=False).drop("ids")


def op4_cosine_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.packing import packed

    return packed(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.pii import detected, span_digests

    return span_digests(detected(_table(spark, sf_dir, "documents")))


def op6_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.mips import top_products

    return top_products(_table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.chat import digests, formatted

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql("select -7L conv_id, cast(pos as bigint) turn, role, '</s>[INST] ok [/INST]' text from (select posexplode(array('user', 'assistant')) as (pos, role))")
    return digests(formatted(turns.unionByName(hard)))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.mixing import mixed

    return mixed(_table(spark, sf_dir, "documents")).drop("row_hash")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.langid import fit_documents, held_out, identified

    docs = _table(spark, sf_dir, "documents")
    predicted = identified(docs.select("doc_id", "text"), fit_documents(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.simhash import linked

    return linked(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_text, op2_huffman_ids, op3_pii, op4_cosine_lsh, op5_packing, op6_inner_products, op7_chat_format, op8_source_mix, op9_language_id, op10_simhash_dedup, pipeline)
    return {f.__name__: f for f in found}


# Rows that share a component of floor(256 * x) products; exact in 64 bits.
_OP6 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
p AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda t: t[1] * t[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 5
"""

# A turn's text and role count two characters for each [, < and \\; its marks are those of the template.
_OP7 = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
m AS (
    SELECT *, role IS NOT DISTINCT FROM lag(role) OVER w AS goes_on,
        length(text) + length(regexp_replace(text, '[^\[<\\]', '', 'g')) AS chars,
        CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 10
            ELSE 19 + length(role) + length(regexp_replace(role, '[^\[<\\]', '', 'g')) END AS marks
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(chars + CASE WHEN goes_on THEN 5 ELSE marks END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_inner_products": _OP6, "op7_chat_format": _OP7}
