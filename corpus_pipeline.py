"""A corpus from raw documents to packed windows, in five stages over whole tables.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, written as Parquet and read again as the next one's docs. Stages take
the columns of documents and ignore others. An empty table stays empty. Null and
empty texts and null ids are treated as each operator states; a document of null
or empty text has no language and goes in stage 1.

1. language: documents that language identification rejects go.
2. near_duplicates: of each group of linked documents the one of the smallest
   doc_id stays (a repeated row stays once).
3. repeated_passages: bytes in 100-byte strings that also start earlier go from
   the texts; n_chars follows; a document of which nothing is left goes.
4. mixing: rates bring the expected tokens of poor text down to TARGETS, or leave
   them where the corpus holds less; good text has the rest. A stage can drop
   documents but not repeat them, so a document of rate 1 or more stays, of the
   others the share of their rate, by hash. Good text has rates of 1 and above.
   Toxic text is no domain here: toxic documents read like others but for a few
   words, so every document is a little of it, and bringing it down drops most.
5. packing: token windows of lexical neighbours.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, language_id, mixing, packing, suffix_dedup
from tessera.llm.storage import fresh_path

#: Shares of all tokens that domains may have.
TARGETS = {"poor": 0.035}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(language_id.training_rows(docs))
    return language_id.identify(docs.select(COLUMNS), model).where(~F.col("rejected")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(docs)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(COLUMNS).join(stays, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "text", "lang", "source"]

    def left(found: pa.Table) -> pa.Table:
        whole = pc.equal(pc.list_value_length(found["spans"]), 0)
        stays = pc.or_(whole, pc.greater(pc.binary_length(found["kept"]), 0))
        found, whole = found.filter(stays), whole.filter(stays)
        rows = zip(found["text"], whole.to_pylist(), found["kept"], strict=True)
        texts = [text.as_py() if w else kept.as_py().decode("utf-8", "ignore") for text, w, kept in rows]  # a cut inside a character drops what is left of it
        return found.select(columns).set_column(1, "text", pa.array(texts, pa.string()))

    cut = suffix_dedup.find_repeats(docs.select(COLUMNS), carry=columns[2:], then=(left, docs.select(columns).schema))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def weights(shares: dict[str, float]) -> dict[str, float]:
    """The weights of the domains that a corpus of these shares can reach by dropping documents of those in TARGETS."""
    less = {d: min(TARGETS[d], shares[d]) for d in shares if d in TARGETS}
    return less | {d: s / (sum(shares.values()) - sum(shares[x] for x in less)) * (1 - sum(less.values())) for d, s in shares.items() if d not in less}


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = mixing.labelled_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"), toxic=False)
    mixed, _ = mixing.mix_documents(docs.select(COLUMNS), labels, weights)
    return mixing.keep_by_rate(mixed).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: No SQL form: learned centroids and rates, and token ids. tests/llm compares each stage with a plain version.
ORACLE_SQL = None
