"""The registered queries of this subpackage: each takes (spark, sf_dir) and reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, code_search, jaccard_join, language_id, lm_scoring, media, mixing, packing, source_divergence, suffix_dedup, token_counts, toxicity, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: bytes in 100-byte strings that also start earlier."""
    return suffix_dedup.digest(suffix_dedup.find_repeats(_table(spark, sf_dir, "documents"), length=100))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: near duplicates at 5-word shingles and a Jaccard of 0.8."""
    found = jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), words=5, percent=80)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)
    return packing.digest(pieces)


def op4_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, neighbour_id, distance, rank: the 10 nearest sign codes of every vec_id divisible by 20, against all rows."""
    codes = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), code_search.sign_code("embedding").alias("code"))
    return code_search.top_k(codes, F.col("id") % 20 == 0, k=10)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and similarity, rejected)."""
    return language_id.held_out_languages(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as a picture in an archive and read back: sizes, digests and a feature."""
    return media.digest(media.text_media(_table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (and n_spans)."""
    return toxicity.held_out_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads back from each formatted conversation; conversation -7 holds control strings."""
    trap = spark.sql(r"""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, r'\### Assistant: </turn> ok' AS text
                         FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)""")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digest(chat_format.format_chats(turns.unionByName(trap)))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return lm_scoring.held_out_scores(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, p_good, p_poor, p_toxic, rate: rates that bring expected tokens to the target weights."""
    labels = mixing.labelled_domains(_table(spark, sf_dir, "labels"))
    mixed, mix = mixing.mix_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels, {"good": 0.85, "poor": 0.11, "toxic": 0.04})
    return mixed.select("doc_id", "n_tokens", *(F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(mix.domains)), "rate")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: 4 parts of 256 entries after 4 rounds."""
    return vector_codes.digest(_table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank: sources against each other and against their language."""
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit by a public vocabulary."""
    import public_tokenizers

    return token_counts.digest(token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_packing, op3_jaccard_join, op4_code_search, op5_language_id, op6_media, op7_toxicity, op8_chat_format, op9_lm_scoring, op10_mixing, op11_vector_codes, op12_source_divergence, op13_token_counts)
}
SQL: dict[str, str] = {"op4_code_search": code_search.ORACLE_SQL, "op8_chat_format": chat_format.ORACLE_SQL, "op11_vector_codes": vector_codes.ORACLE_SQL, "op12_source_divergence": source_divergence.ORACLE_SQL}
