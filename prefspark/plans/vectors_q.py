"""Queries over vectors (survey 2.1 cache rows, 2.5 centroids and aggregates, 2.9 PCA)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from prefspark.functions.numeric import half_up as rounded
from prefspark.operators import vectors as V
from prefspark.plans.registry import half_up, query
from prefspark.plans.tables import VIEWS
from prefspark.sources import embedding_cache as EC

DIM = 64


@query("embedding_load_valid", "SELECT vec_id FROM embeddings WHERE label NOT IN (3, 4)")
def embedding_load_valid(t):
    broken = F.when(F.col("label") == 3, F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x)))
    vector = broken.when(F.col("label") == 4, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    return V.valid_vectors(t.embeddings.withColumn("v", vector), "v", dim=DIM).select("vec_id")


class HashEncoder:
    """Stand-in for a user's text encoder: eight components from a digest of the text."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        digests = [hashlib.sha256(text.encode()).digest()[:8] for text in texts]
        return np.array([[byte / 255.0 for byte in digest] for digest in digests])


@query(
    "embedding_cache_fill",
    f"""SELECT doc_id, label_known AS from_cache, {half_up("CAST('0x' || substr(sha256(text), 1, 2) AS INTEGER) / 255e0", 6)} AS c0,
               {half_up("CAST('0x' || substr(sha256(text), 15, 2) AS INTEGER) / 255e0", 6)} AS c7
        FROM (SELECT doc_id, text, text IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS label_known FROM documents)""",
)
def embedding_cache_fill(t):
    docs = t.documents.select("doc_id", "text")
    seen = docs.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("text").distinct()
    digest = F.sha2("text", 256)
    bytes_of = F.array(*[F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / F.lit(255.0) for i in range(8)])
    cache = seen.select(EC.cache_key("stub", F.col("text")).alias("key"), F.lit("stub").alias("model_name"), bytes_of.alias("embedding"))
    filled, _ = EC.fill(docs, "text", cache, "stub", 8, HashEncoder)
    return filled.select(
        "doc_id", "from_cache", rounded(F.element_at("embedding", 1), 6).alias("c0"), rounded(F.element_at("embedding", 8), 6).alias("c7")
    )


@query(
    "cache_validity",
    """SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic = 0 AND lang <> 'es'""",
)
def cache_validity(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return EC.usable_cached(rows, ["quality", "n_chars"], F.col("toxic") == 1, F.col("lang") != "es").select("doc_id")


@query(
    "class_centroid",
    f"""SELECT label, pos, {half_up('avg(x)', 6)} AS mean, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings)
        GROUP BY label, pos""",
)
def class_centroid(t):
    centroids = V.class_centroid(t.embeddings, "label", "embedding")
    flat = centroids.select("label", "n", F.posexplode("centroid").alias("pos", "x"))
    return flat.select("label", F.col("pos").cast("bigint").alias("pos"), rounded("x", 6).alias("mean"), "n")


CENTROID_SQL = """(SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos
    FROM embeddings WHERE label >= 5) GROUP BY pos))"""


@query(
    "centroid_similarity",
    f"""SELECT vec_id, CASE WHEN label = 4 THEN 0.5 ELSE {half_up('(list_cosine_similarity(embedding::DOUBLE[], c) + 1) / 2', 4)} END AS similarity
        FROM embeddings, {CENTROID_SQL}""",
)
def centroid_similarity(t):
    vectors = t.embeddings.withColumn("v", F.when(F.col("label") == 4, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")))
    return V.centroid_similarity(vectors, "v", F.col("label") >= 5).select("vec_id", "similarity")


VIEWS["unit_vectors"] = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"


@query(
    "group_vector_aggregate",
    f"""
    WITH m AS (SELECT label, list(x ORDER BY pos) AS c, max(n) AS n FROM (SELECT label, pos, avg(x) AS x, count(*) AS n FROM
               (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM unit_vectors) GROUP BY label, pos) GROUP BY label),
    p AS (SELECT a.label, max(list_cosine_similarity(a.v, b.v)) AS s FROM unit_vectors a JOIN unit_vectors b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)
    SELECT label, n AS useful_count, {half_up('c[1] / sqrt(list_sum(list_transform(c, lambda x: x * x)))', 6)} AS first_component,
           {half_up('greatest(0, least(1, (s + 1) / 2))', 4)} AS duplicate_score, {half_up('1 - greatest(0, least(1, (s + 1) / 2))', 4)} AS diversity
    FROM m JOIN p USING (label)""",
)
def group_vector_aggregate(t):
    grouped = V.group_vector_aggregate(t.embeddings, "label", "vec_id", "embedding")
    first = rounded(F.element_at("mean_vector", 1), 6).alias("first_component")
    return grouped.select("label", "useful_count", first, "duplicate_score", "diversity")


@query(
    "group_feature_rollup",
    f"""
    WITH g AS (SELECT *, l_returnflag = 'R' AS bad FROM lineitem)
    SELECT l_orderkey, count(*) AS assets, coalesce(max((l_linestatus = 'O')::INTEGER) FILTER (NOT bad), 0) AS any_flag, coalesce(max(l_discount) FILTER (NOT bad), 0.5) AS max_value,
           {half_up('coalesce(avg(l_discount) FILTER (NOT bad), 0.5)', 6)} AS mean_value,
           {half_up('coalesce(sum(l_discount * l_tax) FILTER (NOT bad AND l_tax > 0) / sum(l_tax) FILTER (NOT bad AND l_tax > 0), 0.5)', 6)} AS weighted_value,
           coalesce(arg_max(l_partkey, (l_quantity, l_partkey)) FILTER (NOT bad), -1) AS best_ref, {half_up('count(*) FILTER (bad) / count(*)', 4)} AS failure_ratio,
           count(*) FILTER (NOT bad) = 0 AS all_failed
    FROM g GROUP BY 1""",
)
def group_feature_rollup(t):
    c = F.col
    rolled = V.feature_rollup(
        t.lineitem,
        "l_orderkey",
        failed=c("l_returnflag") == "R",
        flag=c("l_linestatus") == "O",
        value=c("l_discount"),
        weight=c("l_tax"),
        score=c("l_quantity"),
        ref="l_partkey",
    )
    return rolled.withColumn("best_ref", F.coalesce("best_ref", F.lit(-1)))


@query("pca_fit_project")
def pca_fit_project(t):
    """Sixteen components of every vector. Rows only: the signs of components are arbitrary."""
    model = V.fit_pca(t.embeddings, "embedding", 16, DIM)
    projected = V.project_pca(t.embeddings, model, "embedding", 16, DIM)
    return projected.select("vec_id", *[rounded(f"pc_{i + 1:02d}", 6).alias(f"pc_{i + 1:02d}") for i in range(16)])
