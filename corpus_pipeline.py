"""From raw documents to token ids: language, near-duplicates, benchmark copies, secrets, subword ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and hands what it reads back to the next stage, so a lost executor costs the tasks of one stage. All stages but the
last return the columns of documents, extra columns included; rows with a null or empty text, or one without letters,
are dropped by the first, as they have no language, and so are texts in none of the labelled languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm import bbit_minhash, byte_cnn, piece_codec, seed_align, token_secrets
from prefspark.llm.common import documents, fresh, materialise, tokenizer_path
from prefspark.llm.queries import secret_vocabulary

#: The network's probability of its best language below which a text is not taken for any of them; up to five languages
#: always reach it, so texts in none of them are told by their letter trigrams.
LEAST_SCORE = 0.2


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell; trained on the labelled documents themselves."""
    names = docs.columns
    weights = byte_cnn.fit(docs, F.lit(True))
    told, score, fits = fresh(docs, "told"), fresh(docs, "told_score"), fresh(docs, "told_fits")
    seen = byte_cnn.identify(docs, weights, keep=names, names=(told, score, fits))
    return seen.where((F.col(told) != byte_cnn.UNKNOWN) & (F.col(score) >= LEAST_SCORE) & F.col(fits)).select(*names)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; rows with a null id stay."""
    found = bbit_minhash.find_components(docs, bbit_minhash.Params(shingle=5, percent=80))
    # only ids that go travel; of rows that repeat an id all stay or go
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited or not."""
    return seed_align.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and ``n_chars`` counted anew."""
    masked = token_secrets.redact(docs, *secret_vocabulary())
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def with_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their text, with ``token_ids``, their number, and whether they decode to the text.

    The vocabulary writes a space as a marker, so a text that holds markers of its own decodes to spaces there.
    """
    keep = [c for c in docs.columns if c.lower() not in ("text", "token_ids", "decoded", "n_tokens", "exact")]
    coded = piece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), keep=[*keep, "text"])
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select(*keep, F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", exact.alias("exact"))


STAGES = [
    ("language", with_language),
    ("near_copies", without_near_copies),
    ("benchmarks", without_benchmarks),
    ("secrets", without_secrets),
    ("token_ids", with_token_ids),
]

#: Network, signatures, alignment and subword ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
