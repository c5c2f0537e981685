"""Queries of the scalar functions (survey 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import attrs as A
from prefspark.functions import hashing as H
from prefspark.functions import numeric as N
from prefspark.functions import text as T
from prefspark.functions import urls as U
from prefspark.functions import vectors as V
from prefspark.operators import features as X
from prefspark.plans.registry import half_up, query
from prefspark.plans.tables import VIEWS

NKEY = r"trim(regexp_replace(strip_accents(lower({0})), '\s+', ' ', 'g'))"
STOPS_EN = T.STOPWORDS["en"]
SQL_STOPS = "[" + ", ".join(f"'{w}'" for w in sorted(STOPS_EN)) + "]"
WORDS_EN = ("the", "and", "und", "enlich", "of the", "der die", "est la", "that")
VIEWS["tokens"] = f"""
    SELECT id, lang, label_text, raw,
           list_concat([x for x in raw if not list_contains({SQL_STOPS}, x)],
                       list_transform(range(1, len(raw)), lambda i: raw[i] || ' ' || raw[i + 1])) AS toks
    FROM (SELECT doc_id AS id, lang, source AS label_text,
                 regexp_extract_all({NKEY.format('text')}, '[a-z]{{3,}}') AS raw FROM documents)"""


@query("text_normalize", f"SELECT doc_id AS id, md5({NKEY.format('text')}) AS normalized FROM documents")
def text_normalize(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.md5(T.normalize_key("text")).alias("normalized"))


@query(
    "deep_normalize",
    r"""
    WITH plain AS (SELECT doc_id AS id, translate(strip_accents(lower(text)), '0134558@$!+q', 'oieassbasitk') AS s FROM documents),
    joined AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(s, '([a-z])[._-]([a-z])', '\1\2', 'g'),
                          '([a-z])[._-]([a-z])', '\1\2', 'g'), '([a-z])[._-]([a-z])', '\1\2', 'g') AS s FROM plain),
    chars AS (SELECT id, string_split(s, '') AS c FROM joined)
    SELECT id, md5(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i:
        NOT (c[i] <> chr(10) AND i > 1 AND c[i] = c[i - 1]
             AND ((i > 2 AND c[i - 2] = c[i]) OR (i < len(c) AND c[i + 1] = c[i])))), lambda i: c[i]), '')) AS normalized
    FROM chars""".replace("'0134558@$!+q', 'oieassbasitk'", "'01345@$!+8q', 'oieasasitbk'"),
)
def deep_normalize(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.md5(T.deep_normalize("text")).alias("normalized"))


def _kw_sql(words, text):
    parts = []
    for w in words:
        if " " in w:
            parts.append(f"CAST(contains({text}, '{w}') AS BIGINT)")
        else:
            parts.append(rf"CAST(regexp_matches({text}, '(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)') AS BIGINT)")
    return " + ".join(parts)


@query(
    "keyword_count",
    f"SELECT doc_id AS id, {_kw_sql([w for w in WORDS_EN if w != 'that'], 'strip_accents(lower(text))')} AS hits FROM documents",
)
def keyword_count(t):
    hits = T.keyword_count("text", WORDS_EN, ignored=["Thát"]).cast("bigint")
    return t.documents.select(F.col("doc_id").alias("id"), hits.alias("hits"))


@query(
    "tokenize_ngrams",
    "SELECT id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, '|')) AS digest FROM tokens",
)
def tokenize_ngrams(t):
    raw = t.documents.select(F.col("doc_id").alias("id"), T.raw_tokens("text").alias("raw"))
    toks = raw.select("id", T.ngrams_of(F.col("raw"), STOPS_EN).alias("toks"))
    return toks.select("id", F.size("toks").cast("bigint").alias("n_tokens"), F.md5(F.array_join("toks", "|")).alias("digest"))


@query(
    "signal_candidate_predicate",
    f"""SELECT id, CAST(len([x for x in toks if contains(x, ' ') and len(x) >= 7 and x <> 'and the'
            and not list_has_any(string_split(x, ' '), {SQL_STOPS})]) AS BIGINT) AS candidates FROM tokens""",
)
def signal_candidate_predicate(t):
    raw = t.documents.select(F.col("doc_id").alias("id"), T.raw_tokens("text").alias("raw"))
    kept = T.candidate_bigrams(F.col("raw"), STOPS_EN, ("and the",))
    return raw.select("id", F.size(kept).cast("bigint").alias("candidates"))


@query(
    "list_parse",
    """
    WITH raw AS (SELECT id, unnest([json_extract_string(nullif(details, ''), '$.selected_domains'),
                                    json_extract_string(nullif(details, ''), '$.secondary_domains')]) AS v FROM feedback)
    SELECT id, array_to_string([trim(x) for x in (CASE WHEN v LIKE '[%' THEN from_json(v, '["VARCHAR"]')
           ELSE string_split(v, ',') END) if trim(x) <> ''], '|') AS parsed FROM raw WHERE v IS NOT NULL""",
)
def list_parse(t):
    keys = F.array(*[F.get_json_object("details", f"$.{k}") for k in ("selected_domains", "secondary_domains")])
    raw = t.feedback.select("id", F.explode(keys).alias("v")).filter(F.col("v").isNotNull())
    return raw.select("id", F.array_join(T.parse_list("v"), "|").alias("parsed"))


VIEWS["attr_text"] = """
    SELECT id, lang, source, size_class,
           CASE lang WHEN 'fr' THEN '{"lang":"fr","source":"' || source || '"}' WHEN 'es' THEN ''
                ELSE 'lang: ' || lang || ' | source:' || source || '|size: ' || size_class || ' : ' || lang END AS raw
    FROM items"""


def attr_text(t):
    return t.items.select(
        "id",
        "lang",
        "source",
        "size_class",
        F.expr("""CASE lang WHEN 'fr' THEN '{"lang":"fr","source":"' || source || '"}' WHEN 'es' THEN ''
                ELSE 'lang: ' || lang || ' | source:' || source || '|size: ' || size_class || ' : ' || lang END""").alias("raw"),
    )


def item_attrs():
    return F.create_map(
        F.lit("Läng"), F.col("lang"), F.lit("Source"), F.col("source"), F.lit("Size"), F.concat(F.col("size_class"), F.lit("  text"))
    )


@query(
    "attr_parse",
    """SELECT id, CASE lang WHEN 'es' THEN 0 WHEN 'fr' THEN 2 ELSE 3 END::BIGINT AS n_keys,
              CASE WHEN lang = 'es' THEN '' ELSE source END AS source_value,
              CASE WHEN lang IN ('fr', 'es') THEN '' ELSE size_class || ' : ' || lang END AS size_value FROM attr_text""",
)
def attr_parse(t):
    parsed = attr_text(t).select("id", A.parse_attrs("raw").alias("m"))
    return parsed.select(
        "id",
        F.size("m").cast("bigint").alias("n_keys"),
        A.attr_value("m", "SOURCE").alias("source_value"),
        A.attr_value("m", "sizé").alias("size_value"),
    )


@query(
    "attr_items",
    "SELECT id, 'lang: ' || lang || '|source: ' || source || '|size: ' || size_class || ' text' AS items_text FROM items",
)
def attr_items(t):
    mapped = t.items.select("id", item_attrs().alias("m"))
    return mapped.select("id", F.array_join(A.attr_items("m"), "|").alias("items_text"))


FLAG_RULES = (
    A.FlagRule("flag_western", ("lang",), ("fr", "es")),
    A.FlagRule("flag_long", ("size",), ("long", "medium"), blocked_by=("medium",)),
    A.FlagRule("flag_source_tens", ("Source",), ("src1",), blocked_by=("src19",)),
)


@query(
    "attr_flags",
    """SELECT id, CAST(lang IN ('fr', 'es') AS INTEGER) AS flag_western, CAST(size_class = 'long' AS INTEGER) AS flag_long,
              CAST(source LIKE 'src1%' AND source NOT IN ('src19', 'src12', 'src1') AS INTEGER) AS flag_source_tens FROM items""",
)
def attr_flags(t):
    mapped = t.items.select("id", item_attrs().alias("m"))
    veto = F.array(F.lit("source: src12"))
    flags = A.attr_flags("m", FLAG_RULES, veto)
    return mapped.select("id", *[c.alias(n) for n, c in flags.items()])


LEXICON = {"the": 0.1, "and": -0.2, "that": 0.5, "und": 0.25, "die": -1.0, "est": 0.75, "con": 1.0, "los": -0.5}


def lexicon_frame(t):
    return t.spark.createDataFrame(list(LEXICON.items()), "word string, polarity double")


VIEWS["lexicon"] = " UNION ALL ".join(f"SELECT '{w}' AS word, {p}::DOUBLE AS polarity" for w, p in LEXICON.items())


@query(
    "lexicon_sentiment",
    f"""SELECT d.doc_id AS id, coalesce(s.sentiment, 0) AS sentiment FROM documents d LEFT JOIN
        (SELECT id, {half_up('avg(polarity)', 6)} AS sentiment FROM (SELECT id, unnest(raw) AS word FROM tokens)
         JOIN lexicon USING (word) GROUP BY id) s ON d.doc_id = s.id""",
)
def lexicon_sentiment(t):
    scored = X.lexicon_sentiment(t.items.select("id", "text"), lexicon_frame(t), "id", "text")
    return scored.select("id", N.half_up("sentiment", 6).alias("sentiment"))


@query(
    "text_basic_features",
    r"""SELECT id, CAST(length(text) AS BIGINT) AS n_length, CAST(CASE WHEN trim(text, E' \t\n\r') = '' THEN 0 ELSE
        len(regexp_split_to_array(trim(text, E' \t\n\r'), '\s+')) END AS BIGINT) AS n_words,
        CAST(length(text) >= 200 AS INTEGER) AS long_enough FROM items""",
)
def text_basic_features(t):
    return t.items.select(
        "id",
        F.length("text").cast("bigint").alias("n_length"),
        T.word_count("text").cast("bigint").alias("n_words"),
        (F.length("text") >= 200).cast("int").alias("long_enough"),
    )



@query(
    "range_features",
    f"""SELECT o_orderkey AS id, coalesce(in_range, 0) AS in_range, CAST(x IS NULL AS INTEGER) AS missing,
               coalesce(over, 0) AS over, coalesce(score, 0.5) AS score, {half_up('abs(coalesce(x, 0) - 20) / 15e0', 6)} AS center_dist
        FROM (SELECT *, {half_up("CASE WHEN x IS NULL THEN NULL WHEN x <= 35 THEN 0 ELSE least(1, (x - 35) / 24.5e0) END", 4)} AS over,
              {half_up("CASE WHEN x IS NULL THEN NULL WHEN x < 5 THEN x / 5e0 WHEN x <= 35 THEN 1 ELSE 1 - least(1, (x - 35) / 24.5e0) END", 4)} AS score
              FROM (SELECT o_orderkey, x, CAST(x >= 5 AND x <= 35 AS INTEGER) AS in_range
              FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 5e3 END AS x FROM orders)))""",
)
def range_features(t):
    x = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / F.lit(5000.0))
    df = t.orders.select(F.col("o_orderkey").alias("id"), x.alias("x"))
    soft = N.soft_range("x", 5, 35)
    center = N.half_up(N.center_distance(F.coalesce(F.col("x"), F.lit(0.0)), 5, 35), 6)
    return df.select("id", *[soft[n].alias(n) for n in ("in_range", "missing", "over", "score")], center.alias("center_dist"))


@query(
    "list_overlap",
    """SELECT id, CAST(lang IN ('en', 'de') AS INTEGER) + CAST(source IN ('src1', 'src7') AS INTEGER)
              + CAST(lang IN ('en', 'de') AS INTEGER) AS overlap FROM items""",
)
def list_overlap(t):
    tags = F.array(F.col("lang"), F.upper("source"), F.col("lang"))
    overlap = X.list_overlap(tags, ["EN", "dé", "fr", "src1", "src7"], vetoed=["FR"])
    return t.items.select("id", overlap.alias("overlap"))


FEATURES = X.FeatureConfig(
    age_range=(500, 4000),
    distance_range=(2, 10),
    positive_keywords=("the", "und"),
    negative_keywords=("that", "est la"),
    preferred_tags=("en", "src1"),
    disliked_names=("SRC3",),
    flag_rules=FLAG_RULES,
    measurements={"brightness": 0.5, "sharpness": 0.5},
)


def item_features(df, keys=("id",), sentiment=None):
    """The wide feature row over documents, as the model queries use it."""
    columns = X.feature_columns(
        FEATURES,
        name=F.col("source"),
        age=F.col("n_chars"),
        distance=F.when(F.col("lang") != "es", F.col("src_no").cast("double")),
        text=F.col("text"),
        tags=F.array("lang", "source"),
        attrs=item_attrs(),
        measurements={"brightness": F.col("n_chars") % 97 / F.lit(97.0)},
        sentiment=sentiment,
        plain_text=F.col("_plain"),
    )
    plain = T.normalize(F.coalesce("text", F.lit("")))
    return X.feature_projection(df.withColumn("_plain", plain), list(keys), columns)


@query(
    "feature_projection",
    f"""
    WITH f AS (SELECT *, CASE WHEN lang <> 'es' THEN src_no::DOUBLE END AS d, strip_accents(lower(text)) AS nt,
                      trim(text, E' \\t\\n\\r') AS tt FROM items)
    SELECT id, CAST(n_chars BETWEEN 500 AND 4000 AS DOUBLE) AS age_in_range,
           {half_up('abs(n_chars - 2250) / 1750e0', 6)} AS age_distance, coalesce(d, 0) AS distance,
           CAST(d IS NULL AS DOUBLE) AS distance_missing, coalesce(CAST(d BETWEEN 2 AND 10 AS DOUBLE), 0) AS distance_in_range,
           coalesce({half_up('CASE WHEN d IS NULL THEN NULL WHEN d <= 10 THEN 0 ELSE least(1, (d - 10) / 7e0) END', 4)}, 0) AS distance_over,
           coalesce({half_up('CASE WHEN d IS NULL THEN NULL WHEN d < 2 THEN d / 2e0 WHEN d <= 10 THEN 1 ELSE 1 - least(1, (d - 10) / 7e0) END', 4)}, 0.5) AS distance_score,
           CAST(length(text) AS DOUBLE) AS text_length,
           CAST(CASE WHEN tt = '' THEN 0 ELSE len(regexp_split_to_array(tt, '\\s+')) END AS DOUBLE) AS text_words,
           CAST(length(text) >= 20 AS DOUBLE) AS text_long_enough,
           CAST({_kw_sql(('the', 'und'), 'nt')} AS DOUBLE) AS positive_keywords,
           CAST({_kw_sql(('that', 'est la'), 'nt')} AS DOUBLE) AS negative_keywords, 0::DOUBLE AS sentiment,
           2::DOUBLE AS tag_count, CAST(lang = 'en' AS DOUBLE) + CAST(source = 'src1' AS DOUBLE) AS tag_overlap,
           CAST(length(source) AS DOUBLE) AS name_length, CAST(source = 'src3' AS DOUBLE) AS name_disliked,
           CAST(lang IN ('fr', 'es') AS DOUBLE) AS flag_western, CAST(size_class = 'long' AS DOUBLE) AS flag_long,
           CAST(source LIKE 'src1%' AND source <> 'src19' AS DOUBLE) AS flag_source_tens,
           {half_up('n_chars % 97 / 97e0', 6)} AS brightness, 0.5::DOUBLE AS sharpness
    FROM f""",
)
def feature_projection(t):
    wide = item_features(t.items)
    return wide.withColumns({c: N.half_up(c, 6) for c in ("age_distance", "brightness")})


@query(
    "url_identity_keys",
    r"""
    WITH u AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT -review_id - 1, url FROM reviews),
    s AS (SELECT id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host,
                 regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM u),
    p AS (SELECT *, [x for x in string_split(path, '/') if x <> ''] AS parts FROM s),
    o AS (SELECT *, CASE WHEN list_position(parts, 'u') > 0 THEN parts[list_position(parts, 'u') + 1] END AS owner,
                 CASE WHEN list_position(parts, 'u') > 0 THEN parts[list_position(parts, 'u') + 2] END AS photo FROM p)
    SELECT id, concat_ws(' ', CASE WHEN path <> '' THEN 'path:' || host || path END, 'owner:' || owner,
                         'photo:' || owner || '/' || photo) AS keys FROM o""",
)
def url_identity_keys(t):
    urls = t.pages.select(F.col("page_id").alias("id"), "url").unionByName(
        t.reviews.select((-F.col("review_id") - 1).alias("id"), "url")
    )
    return urls.select("id", F.array_join(U.url_identity_keys("url"), " ").alias("keys"))


@query(
    "url_stable_key",
    r"""SELECT page_id AS id, path, host LIKE '%.example.com' AND (path = '/en' OR path LIKE '/en/%') AS listed,
               coalesce(parts[1], '') AS action, coalesce(parts[2], '') AS target
        FROM (SELECT *, [x for x in string_split(path, '/') if x <> ''] AS parts FROM
              (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
                      lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages))""",
)
def url_stable_key(t):
    two = U.first_two_segments("url")
    return t.pages.select(
        F.col("page_id").alias("id"),
        U.stable_key("url").alias("path"),
        U.host_matches("url", "example.com", ["/en/"]).alias("listed"),
        two["action"].alias("action"),
        two["target"].alias("target"),
    )


@query(
    "filename_key",
    r"""SELECT review_id, 'customer 0' || substr(full_name, 12, 8) AS short_name, 'customer ' || substr(full_name, 10) AS full_name,
               CAST(age AS INTEGER) AS parsed_age FROM reviews""",
)
def filename_key(t):
    """File names carry the truncated slug; a name is filed in full and truncated."""
    slug = T.filename_slug(F.concat(F.lit("Cústomer  0"), F.substring("full_name", 12, 8), F.lit("!")))
    path = F.concat(F.col("review_id").cast("string"), F.lit("_"), slug, F.lit("_"), F.col("age"), F.lit("_body.jpg"))
    parsed = T.filename_key(path)
    keys = T.name_keys(F.concat(F.lit("Customer_"), F.substring("full_name", 10, 20)))
    return t.reviews.select(
        "review_id",
        parsed["name"].alias("short_name"),
        F.element_at(keys, 1).alias("full_name"),
        parsed["age"].alias("parsed_age"),
    )


@query(
    "row_signature",
    """SELECT c_custkey, sha1(concat_ws(chr(31), 'c_custkey=' || c_custkey, 'c_mktsegment=' || c_mktsegment, 'c_name=' || c_name,
              'c_nationkey=' || coalesce(CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END::VARCHAR, ''))) AS signature FROM customer""",
)
def row_signature(t):
    df = t.customer.withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3)))
    return df.select("c_custkey", H.row_signature(["c_name", "c_custkey", "c_nationkey", "c_mktsegment"]).alias("signature"))


@query(
    "feature_fingerprint",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.05 AND l_tax > 0.05 THEN '' ELSE
        sha1(concat_ws('|', printf('l_quantity=%.4f', l_quantity), printf('l_extendedprice=%.4f', l_extendedprice),
        CASE WHEN l_discount <= 0.05 THEN printf('l_discount=%.4f', l_discount) END,
        CASE WHEN l_tax <= 0.05 THEN printf('l_tax=%.4f', l_tax) END)) END AS fingerprint FROM lineitem""",
)
def feature_fingerprint(t):
    df = t.lineitem.withColumns(
        {c: F.when(F.col(c) <= 0.05, F.col(c)) for c in ("l_discount", "l_tax")}
    )
    mark = H.feature_fingerprint(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], min_parts=3)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", mark.alias("fingerprint"))


@query(
    "batch_digest",
    """SELECT conv_id, count(*) AS members, sha1(concat_ws(':', count(*)::VARCHAR,
              sum(CAST('0x' || substr(d, 1, 15) AS BIGINT))::VARCHAR, sum(CAST('0x' || substr(d, 16, 15) AS BIGINT))::VARCHAR)) AS digest
       FROM (SELECT conv_id, md5(role || '|' || turn || '|' || text) AS d FROM conversations) GROUP BY conv_id""",
)
def batch_digest(t):
    member = F.concat_ws("|", "role", F.col("turn").cast("string"), "text")
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("members"), H.batch_digest(member).alias("digest"))


@query(
    "age_from_birthdate",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2024 - year(o_orderdate)
              - CAST('0229' < strftime(o_orderdate, '%m%d') AS INTEGER) END AS age FROM orders""",
)
def age_from_birthdate(t):
    born = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(
        F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd")
    ).otherwise("not a date")
    return t.orders.select(F.col("o_orderkey").alias("id"), N.age_years(born, F.lit("2024-02-29")).alias("age"))


@query(
    "unit_convert",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {half_up('CASE WHEN l_quantity < 45 THEN l_quantity * 1.609e0 END', 0)} AS km FROM lineitem",
)
def unit_convert(t):
    miles = F.when(F.col("l_quantity") < 45, F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", N.miles_to_km(miles).alias("km"))


@query(
    "tent_score",
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
        {half_up('greatest(0, least(1, 1 - abs(greatest(0, least(1, l_extendedprice / 9e4)) - 0.52e0) / 0.52e0))', 6)} AS score FROM lineitem""",
)
def tent_score(t):
    score = N.half_up(N.tent_score(F.col("l_extendedprice") / F.lit(90000.0)), 6)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"))


@query(
    "weighted_mean",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {half_up('''CASE WHEN l_discount + l_tax > 0
        THEN (l_quantity / 50e0 * l_discount + l_extendedprice / 1e5 * l_tax) / (l_discount + l_tax) ELSE 0.5 END''', 6)} AS mean FROM lineitem""",
)
def weighted_mean(t):
    mean = N.weighted_mean(
        [(F.col("l_quantity") / F.lit(50.0), F.col("l_discount")), (F.col("l_extendedprice") / F.lit(1e5), F.col("l_tax"))]
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", N.half_up(mean, 6).alias("mean"))


@query(
    "composite_scores",
    f"""
    WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 9e4 AS b, l_quantity / 50e0 AS s, l_discount * 10 AS c,
                      l_tax * 10 AS f, l_returnflag = 'A' AS bonus, l_linestatus = 'X' AS failed FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN failed OR least(b, 1) <= 0.055 OR (least(b, 1) <= 0.09 AND c <= 0.12 AND f <= 0.12) THEN 0
           ELSE {half_up('least(1, greatest(0, 1 - abs(least(1, b) - 0.52e0) / 0.52e0) * 0.36e0 + least(1, s) * 0.24e0 + least(1, c) * 0.18e0 + least(1, f) * 0.12e0 + CASE WHEN bonus THEN 0.1e0 ELSE 0 END)', 4)} END AS content_score,
           {half_up('(s * 0.45e0 + b * 0.25e0 + c * 0.2e0 + f * 0.1e0) / (0.45e0 + 0.25e0 + 0.2e0 + 0.1e0)', 6)} AS quality FROM m""",
)
def composite_scores(t):
    m = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_extendedprice") / F.lit(90000.0)).alias("b"),
        (F.col("l_quantity") / F.lit(50.0)).alias("s"),
        (F.col("l_discount") * 10).alias("c"),
        (F.col("l_tax") * 10).alias("f"),
        (F.col("l_returnflag") == "A").alias("bonus"),
        (F.col("l_linestatus") == "X").alias("failed"),
    )
    c = F.col
    return m.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        X.content_score(c("b"), c("s"), c("c"), c("f"), c("bonus"), c("failed")).alias("content_score"),
        N.half_up(X.image_quality(c("s"), c("b"), c("c"), c("f")), 6).alias("quality"),
    )


@query(
    "vector_cosine",
    f"""SELECT vec_id, {half_up('list_cosine_similarity(a, b)', 6)} AS cosine,
               {half_up('(list_cosine_similarity(a, b) + 1) / 2', 6)} AS cosine01
        FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings)""",
)
def vector_cosine(t):
    left, right = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    longer = F.slice("embedding", 33, 32)
    return t.embeddings.select(
        "vec_id",
        N.half_up(V.cosine(left, right), 6).alias("cosine"),
        N.half_up(V.cosine01(left, longer), 6).alias("cosine01"),
    )


@query(
    "vector_from_columns",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(len(v) AS INTEGER) AS n_values, {half_up('list_avg(v)', 6)} AS mean,
               coalesce(CAST(v[1] AS DOUBLE), -1) AS first_value
        FROM (SELECT *, [x for x in [CASE WHEN l_discount > 0.02 THEN l_discount END, l_quantity, CASE WHEN l_tax > 0.02 THEN l_tax END]
                         if x is not null] AS v FROM lineitem)""",
)
def vector_from_columns(t):
    df = t.lineitem.withColumns({c: F.when(F.col(c) > 0.02, F.col(c)) for c in ("l_discount", "l_tax")})
    names = ["l_tax", "l_quantity", "l_discount"]
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.size(V.from_columns(names)).alias("n_values"),
        N.half_up(V.mean_of(names), 6).alias("mean"),
        F.coalesce(F.try_element_at(V.from_columns(names), F.lit(1)), F.lit(-1.0)).alias("first_value"),
    )


SIM_SQL = """
    WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS a1, l_tax * 10 AS b1, l_quantity / 50e0 AS a2,
                      CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice / 9e4 END AS b2 FROM lineitem),
    s AS (SELECT *, CASE WHEN b2 IS NULL THEN 1 - least(1, abs(a1 - b1))
                    ELSE ((1 - least(1, abs(a1 - b1))) * 0.3e0 + (1 - least(1, abs(a2 - b2))) * 0.7e0) / (0.3e0 + 0.7e0) END AS f FROM m)"""


def measurement_pairs(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_discount") * 10).alias("a1"),
        (F.col("l_tax") * 10).alias("b1"),
        (F.col("l_quantity") / F.lit(50.0)).alias("a2"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") / F.lit(90000.0)).alias("b2"),
    )


@query(
    "feature_similarity",
    SIM_SQL
    + f"""SELECT l_orderkey, l_linenumber, l_partkey, {half_up('f', 6)} AS feature_score,
                 {half_up('CASE WHEN b2 IS NULL THEN f ELSE b2 * 0.58e0 + f * 0.42e0 END', 6)} AS blended FROM s""",
)
def feature_similarity(t):
    c = F.col
    score = V.feature_similarity([(c("a1"), c("b1"), 0.3), (c("a2"), c("b2"), 0.7)])
    df = measurement_pairs(t).withColumn("f", score)
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        N.half_up("f", 6).alias("feature_score"),
        N.half_up(V.blend_similarity(c("b2"), c("f")), 6).alias("blended"),
    )


@query(
    "score_labels",
    """SELECT id, CASE WHEN p >= 0.72 THEN 'high' WHEN p >= 0.58 THEN 'good' WHEN p >= 0.43 THEN 'neutral'
              WHEN p >= 0.28 THEN 'low' ELSE 'very low' END AS word FROM labelled""",
)
def score_labels(t):
    return t.labelled.select("id", N.score_label("p").alias("word"))


@query(
    "soft_bucket",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q < 0.35 THEN 0 WHEN x < 0.36 THEN 1 WHEN x < 0.48 THEN 0.5 ELSE 0 END::DOUBLE AS small,
        CASE WHEN q < 0.35 THEN 0 WHEN x < 0.36 THEN 0 WHEN x < 0.48 THEN 0.5 WHEN x < 0.58 THEN 1 WHEN x < 0.66 THEN 0.5 ELSE 0 END::DOUBLE AS medium,
        CASE WHEN q < 0.35 THEN 0 WHEN x < 0.58 THEN 0 WHEN x < 0.66 THEN 0.5 ELSE 1 END::DOUBLE AS large
       FROM (SELECT *, l_extendedprice / 1e5 AS x, l_quantity / 50e0 AS q FROM lineitem)""",
)
def soft_bucket(t):
    small, medium, large = N.soft_bucket(F.col("l_extendedprice") / F.lit(1e5), F.col("l_quantity") / F.lit(50.0))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", small.alias("small"), medium.alias("medium"), large.alias("large")
    )


@query(
    "similarity_notes",
    SIM_SQL
    + """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(concat_ws('; ', CASE WHEN b2 > 0.9 THEN 'close vector' END,
              CASE WHEN abs(a1 - b1) <= 0.25 THEN 'first' END, CASE WHEN abs(a2 - b2) <= 0.15 THEN 'second' END), ''), 'close measurements') AS notes FROM s""",
)
def similarity_notes(t):
    c = F.col
    pairs = [(c("a1"), c("b1"), 0.25, "first"), (c("a2"), c("b2"), 0.15, "second")]
    notes = X.similarity_notes(pairs, F.coalesce(c("b2") > 0.9, F.lit(False)))
    return measurement_pairs(t).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(notes, "; ").alias("notes"))
