"""Queries of joins and set operations (survey 2.4 and 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import hashing as H
from prefspark.functions import vectors as V
from prefspark.functions.numeric import half_up as rounded
from prefspark.functions.text import normalize_key, raw_tokens
from prefspark.functions.urls import stable_key
from prefspark.operators import keys as K
from prefspark.operators import labelled as LB
from prefspark.operators import matching as J
from prefspark.plans.registry import half_up, query
from prefspark.plans.tables import VIEWS

SEP = "chr(31)"
VIEWS["review_keys"] = f"""
    SELECT review_id, created_at, review_status, review_mode, unnest(kinds) AS kind, unnest(vals) AS key FROM (
        SELECT *, ['name_age_text', 'name_age', 'photo_url', 'photo_url_path', 'photo_identity', 'photo_identity', 'photo_identity'] AS kinds,
               [CASE WHEN name <> '' THEN lower(name) || {SEP} || age || {SEP} || sha1(lower(text) || {SEP} || lower(tags)) END,
                CASE WHEN name <> '' THEN lower(name) || {SEP} || age END, nullif(url, ''),
                CASE WHEN url <> '' THEN 'img.example.com' || {SEP} || '/u/' || o_custkey || '/' || age || '.jpg' END,
                CASE WHEN url <> '' THEN 'path:img.example.com/u/' || o_custkey || '/' || age || '.jpg' END,
                CASE WHEN url <> '' THEN 'owner:' || o_custkey END, CASE WHEN url <> '' THEN 'photo:' || o_custkey || '/' || age || '.jpg' END] AS vals
        FROM reviews)"""
VIEWS["live_keys"] = "SELECT * FROM review_keys WHERE key IS NOT NULL"


def keys_of_reviews():
    return K.review_keys(name=F.col("name"), age=F.col("age"), text=F.col("text"), tags=F.col("tags"), url=F.col("url"))


def _dedupe(t, strong):
    flat = K.explode_keys(t.reviews, keys_of_reviews(), "review_id", "review_status", strong_only=strong)
    pending = F.col("review_status") == "pending"
    return K.matching_ids(flat.filter(pending), flat.filter(~pending), "review_id")


MATCH_SQL = """SELECT DISTINCT a.review_id FROM live_keys a JOIN live_keys b ON a.kind = b.kind AND a.key = b.key
    WHERE a.review_status = 'pending' AND b.review_status <> 'pending'"""


@query("multi_key_dedupe_join", MATCH_SQL)
def multi_key_dedupe_join(t):
    return _dedupe(t, strong=False)


@query("strong_key_join", MATCH_SQL + " AND a.kind <> 'name_age'")
def strong_key_join(t):
    return _dedupe(t, strong=True)


VIEWS["text_keys"] = """
    SELECT id, label_text, src_no, n_chars, unnest([source || ' ' || n_chars, sha1(trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')))]) AS key
    FROM profile_rows"""


@query(
    "anti_join_trained",
    """
    WITH k AS (SELECT id, CASE WHEN label_text <> '' THEN 'trained' WHEN src_no >= 15 THEN 'queue' ELSE 'new' END AS part, n_chars, key FROM text_keys),
    s AS (SELECT n.id, min(CASE k2.part WHEN 'queue' THEN 1 ELSE 2 END) AS stage FROM k n JOIN k k2 ON n.key = k2.key AND k2.part <> 'new' WHERE n.part = 'new' GROUP BY n.id)
    SELECT CASE WHEN n_chars < 100 THEN 'filtered' WHEN stage = 1 THEN 'in_queue' WHEN stage = 2 THEN 'trained' ELSE 'new' END AS stage, count(*) AS n
    FROM (SELECT DISTINCT id, n_chars FROM k WHERE part = 'new') LEFT JOIN s USING (id) GROUP BY 1""",
)
def anti_join_trained(t):
    rows = t.profile_rows.withColumn(
        "keys", K.review_keys(name=F.col("source"), age=F.col("n_chars"), content=F.sha1(normalize_key("text")))
    )
    labelled, queued = F.col("label_text") != "", F.col("src_no") >= 15
    flat = K.explode_keys(rows.withColumns({"labelled": labelled, "queued": queued}), F.col("keys"), "id", "labelled", "queued")
    fresh = ~F.col("labelled") & ~F.col("queued")
    candidates = rows.filter(~labelled & ~queued).select("id", "n_chars")
    staged = J.enqueue_stages(
        candidates, "id", F.col("n_chars") < 100, flat.filter(fresh), flat.filter(~F.col("labelled") & F.col("queued")), flat.filter("labelled")
    )
    return staged.groupBy("stage").agg(F.count("*").alias("n"))


@query(
    "asset_lookup_preferring",
    """
    WITH a AS (SELECT o_custkey AS c_custkey, original_label = 'LIKE' AS liked, o_orderpriority = '5-LOW' AS is_alias, epoch_us(created_at) AS mtime, review_id FROM reviews)
    SELECT c.c_custkey, coalesce((SELECT review_id FROM a WHERE a.c_custkey = c.c_custkey
        ORDER BY liked = (c_acctbal > 5000) DESC, is_alias, mtime DESC, review_id LIMIT 1), -1) AS asset FROM customer c""",
)
def asset_lookup_preferring(t):
    assets = t.reviews.select(
        F.col("o_custkey").alias("c_custkey"),
        (F.col("original_label") == "LIKE").alias("liked"),
        (F.col("o_orderpriority") == "5-LOW").alias("alias"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("mtime"),
        F.col("review_id").alias("path"),
    )
    rows = t.customer.select("c_custkey", (F.col("c_acctbal") > 5000).cast("int").alias("label"))
    return J.asset_lookup(rows, assets, ["c_custkey"], "label").select("c_custkey", F.coalesce("asset", F.lit(-1)).alias("asset"))


@query(
    "positional_one_to_one",
    """
    WITH a AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
    b AS (SELECT p_partkey, p_size % 25 AS c_nationkey, row_number() OVER (PARTITION BY p_size % 25 ORDER BY p_partkey) AS n FROM part)
    SELECT c_custkey, coalesce(p_partkey, -1) AS p_partkey FROM a LEFT JOIN b USING (c_nationkey, n)""",
)
def positional_one_to_one(t):
    targets = t.customer.select("c_custkey", "c_nationkey")
    assets = t.part.select("p_partkey", (F.col("p_size") % 25).alias("c_nationkey"))
    paired = J.pair_by_position(targets, assets, ["c_nationkey"], "c_custkey", "p_partkey", 256)
    return paired.select("c_custkey", F.coalesce("p_partkey", F.lit(-1)).alias("p_partkey"))


def _updates(t):
    return t.customer.filter("c_acctbal < 500").select(
        "c_custkey",
        F.lit("BUILDING").alias("signature"),
        F.upper("c_name").alias("c_name"),
        F.when(F.col("c_acctbal") < 250, F.col("c_nationkey")).otherwise(99).alias("c_nationkey"),
        F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise("X").alias("c_mktsegment"),
        F.lit(0.0).alias("c_acctbal"),
    )


REPLACED = "c_acctbal < 500 AND (c_mktsegment = 'BUILDING' OR c_acctbal < 0)"


@query(
    "merge_replace_row",
    f"""SELECT c_custkey, coalesce({REPLACED}, false) AS replaced, CASE WHEN {REPLACED} THEN 0 ELSE c_acctbal END AS c_acctbal,
               CASE WHEN {REPLACED} THEN c_acctbal ELSE -1e6 END AS backup_acctbal, c_acctbal AS restored FROM customer""",
)
def merge_replace_row(t):
    target = t.customer.withColumn("signature", F.col("c_mktsegment"))
    merged = LB.merge_replace(
        target, _updates(t), "c_custkey", "signature", ["c_name", "c_nationkey"], ["c_mktsegment"], ["c_acctbal"]
    )
    restored = F.when(F.col("replaced"), F.col("backup_c_acctbal")).otherwise(F.col("c_acctbal"))
    return merged.select(
        "c_custkey", "replaced", "c_acctbal", F.coalesce("backup_c_acctbal", F.lit(-1e6)).alias("backup_acctbal"), restored.alias("restored")
    )


@query(
    "key_lookup_join",
    f"""SELECT page_id, {half_up('coalesce(embedding[1], 0)', 6)} AS first_component, embedding IS NOT NULL AS found
        FROM pages LEFT JOIN (SELECT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS k, arg_min(embedding, vec_id) AS embedding
             FROM embeddings JOIN pages ON vec_id = page_id * 2 GROUP BY 1) ON k = regexp_extract(url, '://[^/?#]*([^?#]*)', 1)""",
)
def key_lookup_join(t):
    filed = t.embeddings.join(t.pages, F.col("vec_id") == F.col("page_id") * 2).groupBy(stable_key("url").alias("k"))
    cache = filed.agg(F.min_by("embedding", "vec_id").alias("embedding"))
    found = t.pages.select("page_id", stable_key("url").alias("k")).join(cache, "k", "left")
    return found.select(
        "page_id",
        rounded(F.coalesce(F.get("embedding", F.lit(0)), F.lit(0.0)), 6).alias("first_component"),
        F.col("embedding").isNotNull().alias("found"),
    )


@query("ack_removal", "SELECT review_id FROM reviews WHERE review_status = 'pending' AND o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def ack_removal(t):
    confirmed = t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey")).distinct()
    return t.reviews.filter("review_status = 'pending'").join(confirmed, "o_custkey", "left_anti").select("review_id")


@query(
    "active_membership",
    """SELECT review_id, (o_custkey IN (SELECT user_id FROM events)) OR (full_name, age) IN (SELECT c_name, c_nationkey FROM customer WHERE c_acctbal > 9000) AS is_active
       FROM reviews""",
)
def active_membership(t):
    rows = t.reviews.select("review_id", F.col("full_name").alias("name"), "age", F.col("o_custkey").alias("who"))
    probe = K.explode_keys(rows, K.review_keys(name=F.col("name"), age=F.col("age"), item_id=F.col("who")), "review_id")
    ids = t.events.select(F.lit("id").alias("kind"), F.col("user_id").cast("string").alias("key")).distinct()
    rich = t.customer.filter("c_acctbal > 9000")
    named = K.explode_keys(rich, K.review_keys(name=F.col("c_name"), age=F.col("c_nationkey")))
    return J.active_members(rows, "review_id", probe, ids.unionByName(named)).select("review_id", "is_active")


@query(
    "similar_topk_join",
    f"""
    WITH s AS (SELECT label, max(vec_id) AS src FROM embeddings GROUP BY label),
    c AS (SELECT s.src AS source_id, v.vec_id AS candidate_id, (list_cosine_similarity(v.embedding::DOUBLE[], w.embedding::DOUBLE[]) + 1) / 2 AS sim
          FROM embeddings v JOIN s USING (label) JOIN embeddings w ON w.vec_id = s.src WHERE v.vec_id <> s.src)
    SELECT source_id, candidate_id, position, {half_up('sim', 6)} AS similarity FROM
        (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sim DESC, candidate_id) AS position FROM c WHERE sim >= 0.46) WHERE position <= 6""",
)
def similar_topk_join(t):
    vectors = t.embeddings
    sources = vectors.groupBy("label").agg(F.max_by(F.struct("vec_id", "embedding"), "vec_id").alias("s")).select("label", "s.*")
    score = V.blend_similarity(V.cosine01("embedding", "src_embedding"), F.lit(None).cast("double"))
    top = J.similar_topk(sources, vectors, "label", "vec_id", score)
    return top.withColumn("similarity", rounded("similarity", 6))


@query(
    "target_match_score",
    f"""
    WITH tg AS (SELECT DISTINCT 'interest' AS kind, source AS norm FROM items WHERE src_no % 5 = 2 UNION SELECT DISTINCT 'descriptor', 'lang: ' || lang FROM items WHERE lang <> 'en'),
    it AS (SELECT id, 'interest' AS kind, source AS norm FROM items UNION SELECT id, 'interest', lang FROM items UNION SELECT id, 'descriptor', 'lang: ' || lang FROM items),
    h AS (SELECT id, avg(CASE kind WHEN 'interest' THEN 0.86e0 ELSE 0.88e0 END) AS m, count(*) AS n FROM it JOIN tg USING (kind, norm) GROUP BY id)
    SELECT id, n AS hits, {half_up('least(1, m + (n - 1) * 0.035e0)', 6)} AS target_score,
           {half_up('least(1, least(1, m + (n - 1) * 0.035e0) * 0.7e0 + p * (1 - 0.7e0))', 6)} AS final_score
    FROM h JOIN (SELECT id AS lid, p FROM labelled) ON id = lid""",
)
def target_match_score(t):
    targets = (
        t.items.filter("src_no % 5 = 2").select(F.lit("interest").alias("kind"), F.col("source").alias("norm"))
        .unionByName(t.items.filter("lang <> 'en'").select(F.lit("descriptor").alias("kind"), F.concat(F.lit("lang: "), "lang").alias("norm")))
        .distinct()
    )
    entries = F.array(
        F.struct(F.lit("interest").alias("kind"), F.col("source").alias("norm")),
        F.struct(F.lit("interest").alias("kind"), F.col("lang").alias("norm")),
        F.struct(F.lit("descriptor").alias("kind"), F.concat(F.lit("lang: "), F.col("lang")).alias("norm")),
    )
    candidates = t.items.select("id", F.inline(F.array_distinct(entries)))
    scored = J.target_scores(targets, candidates, "id").join(t.labelled.select("id", "p"), "id")
    return scored.select(
        "id",
        "hits",
        rounded("target_score", 6).alias("target_score"),
        rounded(J.blend_target(F.col("target_score"), F.col("p")), 6).alias("final_score"),
    )


@query(
    "content_hash_match",
    """SELECT d.doc_id, f.first_id, f.copies FROM documents d JOIN (SELECT text, min(doc_id) AS first_id, count(*) AS copies FROM documents
       GROUP BY text HAVING count(*) > 1) f USING (text)""",
)
def content_hash_match(t):
    hashed = t.documents.select("doc_id", H.content_hash("text").alias("h"))
    groups = hashed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    return hashed.join(groups, "h").select("doc_id", "first_id", "copies")


@query(
    "backfill_columns",
    """
    WITH m AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS a FROM supplier),
    j AS (SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_size < 10 THEN CASE WHEN k IS NULL THEN 'failed' ELSE 'updated' END ELSE 'skipped' END AS outcome, a
          FROM part LEFT JOIN m ON k = p_partkey)
    SELECT outcome, count(*) AS n, CAST(count(CASE WHEN outcome = 'updated' THEN a ELSE p_retailprice END) AS BIGINT) AS filled FROM j GROUP BY 1""",
)
def backfill_columns(t):
    measured = t.supplier.select(
        F.col("s_suppkey").alias("p_partkey"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("p_retailprice")
    )
    filled = LB.backfill_columns(t.part, measured, "p_partkey", ["p_retailprice"], F.col("p_size") < 10)
    return filled.groupBy("outcome").agg(F.count("*").alias("n"), F.count("p_retailprice").alias("filled"))


@query(
    "union_all",
    """SELECT source_table, count(*) AS n, count(c_acctbal) AS with_customer, count(s_acctbal) AS with_supplier FROM
       (SELECT 'customer' AS source_table, c_acctbal, NULL AS s_acctbal FROM customer UNION ALL SELECT 'supplier', NULL, s_acctbal FROM supplier) GROUP BY 1""",
)
def union_all(t):
    both = t.customer.withColumn("source_table", F.lit("customer")).unionByName(
        t.supplier.withColumn("source_table", F.lit("supplier")), allowMissingColumns=True
    )
    return both.groupBy("source_table").agg(
        F.count("*").alias("n"), F.count("c_acctbal").alias("with_customer"), F.count("s_acctbal").alias("with_supplier")
    )


@query(
    "key_set_intersect",
    """SELECT page_id, list_has_any([x for x in string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') if x <> ''], ['en', 'es']) AS shared FROM pages""",
)
def key_set_intersect(t):
    parts = F.filter(F.split(stable_key("url"), "/"), lambda x: x != "")
    return t.pages.select("page_id", F.arrays_overlap(parts, F.array(F.lit("en"), F.lit("es"))).alias("shared"))


@query(
    "set_difference",
    """SELECT id, md5(array_to_string(list_sort([x for x in list_distinct(raw) if not list_contains(['the', 'and', 'und', 'der'], x)]), ' ')) AS kept FROM tokens""",
)
def set_difference(t):
    drop = F.array(*[F.lit(w) for w in ("the", "and", "und", "der")])
    kept = F.array_except(raw_tokens("text"), drop)
    return t.documents.select(F.col("doc_id").alias("id"), F.md5(F.array_join(F.array_sort(kept), " ")).alias("kept"))


@query(
    "ordered_distinct",
    """SELECT id, md5(array_to_string(list_transform(list_sort(list_distinct(list_transform(raw, lambda x:
              [lpad(list_position(raw, x)::VARCHAR, 9, '0'), x]))), lambda y: y[2]), ' ')) AS firsts FROM tokens""",
)
def ordered_distinct(t):
    return t.documents.select(
        F.col("doc_id").alias("id"), F.md5(F.array_join(F.array_distinct(raw_tokens("text")), " ")).alias("firsts")
    )
