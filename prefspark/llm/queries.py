"""One query per operator over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefspark.llm import bbit_minhash, byte_cnn, byte_shards, compression_bands, fourier_quality, hilbert_codes, license_rules, orc_tokens, piece_codec, quotient_phrases, seed_align, token_secrets, weak_toxicity
from prefspark.llm.common import documents, tokenizer_path
from prefspark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a ``(spark, sf_dir) -> DataFrame`` function under its own name."""
    QUERIES[build.__name__] = build
    return build


def secret_vocabulary() -> tuple[str, str]:
    """Ranks file and splitting pattern of the byte-level vocabulary that measures token efficiency."""
    import public_tokenizers

    return tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    return piece_codec.digests(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


@query
def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the compression bands for every document."""
    return compression_bands.measure(documents(spark, sf_dir))


@query
def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; a third of the ids is held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return weak_toxicity.toxicity(documents(spark, sf_dir), labels, byte_cnn.remainder("doc_id", 3) == 1)


@query
def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a network learnt from the rows that are not held out."""
    docs = documents(spark, sf_dir)
    weights = byte_cnn.fit(docs, byte_cnn.remainder("doc_id", 4) != 2)
    marked = docs.withColumn("held_out", byte_cnn.remainder("doc_id", 4) == 2)
    return byte_cnn.identify(marked, weights, keep=["doc_id", "held_out"])


@query
def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return byte_shards.assign_shards(documents(spark, sf_dir), shards=24)


@query
def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences of every document and the licences their order gives."""
    return license_rules.flat(license_rules.scan(documents(spark, sf_dir)))


SQL["op6_license_rules"] = license_rules.scan_sql()


@query
def op7_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents on two-word shingles."""
    return bbit_minhash.find_components(documents(spark, sf_dir), bbit_minhash.Params(shingle=2, percent=80))


@query
def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to ORC files and read back from them."""
    path = scratch_path(spark, "orc-tokens")
    orc_tokens.write_tokens(documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return orc_tokens.checksums(orc_tokens.read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_token_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns and strings that a subword vocabulary compresses badly."""
    return token_secrets.digests(token_secrets.find_secrets(documents(spark, sf_dir), *secret_vocabulary()))


@query
def op10_seed_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, word for word or edited, with the alignment of each."""
    return seed_align.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op11_quotient_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of every language."""
    return quotient_phrases.collocations(documents(spark, sf_dir))


SQL["op11_quotient_phrases"] = quotient_phrases.collocations_sql()


@query
def op12_hilbert_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector by codebooks that are fitted to all of them."""
    return hilbert_codes.coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a fifth of the ids is held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fourier_quality.quality(documents(spark, sf_dir), labels, byte_cnn.remainder("doc_id", 5) == 0)
