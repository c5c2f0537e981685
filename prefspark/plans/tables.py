"""The driver tables, and the generic inputs (items, reviews, feedback, ...) built from them.

Every adapter has two forms that must stay in step: a DataFrame property and a SQL view of the same name
in ``VIEWS``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.session import spread

#: Most labels that are sent to every executor, at some 50 bytes each, so that the texts they belong to need not move.
MOST_LABELS = 2_000_000

VIEWS: dict[str, str] = {
    # items: one row per document
    "items": """
        SELECT doc_id AS id, text, lang, source, n_chars,
               CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END AS size_class,
               CAST(substr(source, 4) AS INTEGER) AS src_no
        FROM documents""",
    # labelled: items that have a human label, with a score in [0, 1]
    "labelled": """
        SELECT i.*, l.quality AS label, l.toxic, least(i.n_chars / 5e3, 1e0) AS p
        FROM items i JOIN labels l ON i.id = l.doc_id""",
    # feedback: labelled items with decisions and the feedback a reviewer attached to them
    "feedback": """
        SELECT f.*, CASE WHEN p >= 0.5e0 THEN 'CURTIR' ELSE 'PASS' END AS model_decision,
               CASE WHEN toxic = 1 AND label = 1 THEN 'Super_Like' WHEN src_no = 13 THEN 'talvez'
                    WHEN label = 1 THEN 'like' ELSE 'passar' END AS final_decision,
               CASE WHEN (p >= 0.5e0) <> (label = 1) THEN '1.0' ELSE '0' END AS manual_corrected,
               CASE src_no % 5 WHEN 0 THEN 'Other' WHEN 1 THEN 'bio' WHEN 2 THEN 'interests'
                    WHEN 3 THEN 'descriptors' ELSE 'photo' END AS feedback_domain,
               CASE lang WHEN 'en' THEN '2' WHEN 'fr' THEN '1.0' WHEN 'de' THEN '3' ELSE '' END AS feedback_intensity,
               CASE src_no % 3 WHEN 0 THEN 'photo_face' WHEN 1 THEN '' ELSE 'contexto' END AS feedback_reason,
               CASE lang
                 WHEN 'en' THEN CASE WHEN size_class = 'long' THEN '' ELSE '{"quick_agree":true}' END
                 WHEN 'fr' THEN '{"selected_domains":["interests"],"selected_interests":["fr","' || source || '"]}'
                 WHEN 'de' THEN '{"secondary_domains":"bio, photo","bio_not_positive":["und die"],"photo_score_adjustment":"'
                                || CASE WHEN label = 1 THEN 'lower' ELSE 'higher' END || '"}'
                 ELSE '{"descriptor_positive_details":["lang: es"],"descriptor_negative_details":["source: ' || source
                      || '","lang: es"],"target_action":"super_like"}' END AS details
        FROM labelled f""",
    # profile_rows: every item as a stored row, label and origin kept as text ('' = missing)
    "profile_rows": """
        SELECT i.*, CASE WHEN l.quality IS NULL THEN '' WHEN l.toxic = 1 THEN l.quality || '.0'
                         ELSE CAST(l.quality AS VARCHAR) END AS label_text,
               CASE WHEN src_no < 15 THEN 'Real' WHEN src_no = 15 THEN '' ELSE 'synthetic' END AS origin
        FROM items i LEFT JOIN labels l ON i.id = l.doc_id""",
    # reviews: a review queue, one row per order
    "reviews": """
        SELECT o_orderkey AS review_id, o_orderdate AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'reviewed' WHEN 'P' THEN 'skipped' ELSE 'pending' END AS review_status,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'history' WHEN '2-HIGH' THEN 'quick_agree_recheck'
                    ELSE 'auto' END AS review_mode,
               CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '' ELSE c_name END AS name, c_name AS full_name,
               c_nationkey AS age, c_mktsegment || ' ' || o_orderpriority AS text, c_mktsegment AS tags,
               CASE o_orderpriority WHEN '5-LOW' THEN '' ELSE 'https://img.example.com/u/' || o_custkey || '/' || c_nationkey
                    || '.jpg?sig=' || o_orderkey END AS url,
               o_custkey AS target_index, c_mktsegment AS target_signature, o_totalprice / 5e5 AS p,
               CASE WHEN o_totalprice / 5e5 >= 0.48e0 THEN 'LIKE' ELSE 'PASS' END AS original_label,
               o_custkey, o_orderpriority
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    # decisions: the event stream, in whole microseconds
    "decisions": """
        SELECT event_id, user_id, epoch_us(ts) AS us, event_type, value,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events""",
    # signal_events: explicit feedback on single tags, text pieces and attributes
    "signal_events": """
        SELECT event_id AS id, ts AS created_at,
               CASE event_type WHEN 'click' THEN 'interest' WHEN 'view' THEN 'bio' WHEN 'purchase' THEN 'Descriptor '
                    WHEN 'signup' THEN 'interest' ELSE 'photo' END AS signal_type,
               CASE event_type WHEN 'click' THEN 'src' || (user_id % 20) WHEN 'view' THEN 'the  Th' WHEN 'purchase'
                    THEN 'source: src' || (user_id % 20) WHEN 'signup' THEN (CASE WHEN value < 5 THEN ' ' ELSE 'FR' END)
                    ELSE 'x' END AS signal_value,
               CASE WHEN value >= 30 THEN 'Positive' WHEN value >= 10 THEN 'neutral' WHEN value >= 1 THEN 'negative'
                    ELSE 'odd' END AS polarity,
               CASE WHEN value >= 100 THEN 'many' ELSE CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) END AS weight
        FROM events""",
}


class Tables:
    """Lazily opened driver tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._read(name)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """Whole texts make for heavy tasks, so a scan with too few of them is spread."""
        return spread(self._read("documents"), "doc_id")

    @cached_property
    def pages(self) -> DataFrame:
        return spread(self._read("pages"), "page_id")

    @cached_property
    def items(self) -> DataFrame:
        size = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "medium").otherwise("long")
        return self.documents.select(
            F.col("doc_id").alias("id"),
            "text",
            "lang",
            "source",
            "n_chars",
            size.alias("size_class"),
            F.substring("source", 4, 10).cast("int").alias("src_no"),
        )

    @cached_property
    def profile_rows(self) -> DataFrame:
        labels = self.labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
        return self.items.join(labels, "id", "left").selectExpr(
            *self.items.columns,
            "CASE WHEN quality IS NULL THEN '' WHEN toxic = 1 THEN quality || '.0' ELSE CAST(quality AS STRING) END AS label_text",
            "CASE WHEN src_no < 15 THEN 'Real' WHEN src_no = 15 THEN '' ELSE 'synthetic' END AS origin",
        )

    @cached_property
    def labelled(self) -> DataFrame:
        return self._labelled(self.labels)

    def _labelled(self, scan: DataFrame) -> DataFrame:
        labels = scan.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "toxic")
        score = F.least(F.col("n_chars").cast("double") / F.lit(5000.0), F.lit(1.0))
        return self.items.join(labels, "id").withColumn("p", score)

    @cached_property
    def feedback(self) -> DataFrame:
        return self._feedback(self.labelled)

    @cached_property
    def feedback_in_place(self) -> DataFrame:
        """``feedback``, but of at most ``MOST_LABELS`` labels, whose texts stay where they are read."""
        few = self.labels.count() <= MOST_LABELS
        return self._feedback(self._labelled(F.broadcast(self.labels) if few else self.labels))

    def _feedback(self, labelled: DataFrame) -> DataFrame:
        return labelled.selectExpr(
            "*",
            "CASE WHEN p >= 0.5D THEN 'CURTIR' ELSE 'PASS' END AS model_decision",
            "CASE WHEN toxic = 1 AND label = 1 THEN 'Super_Like' WHEN src_no = 13 THEN 'talvez' "
            "WHEN label = 1 THEN 'like' ELSE 'passar' END AS final_decision",
            "CASE WHEN (p >= 0.5D) <> (label = 1) THEN '1.0' ELSE '0' END AS manual_corrected",
            "CASE src_no % 5 WHEN 0 THEN 'Other' WHEN 1 THEN 'bio' WHEN 2 THEN 'interests' "
            "WHEN 3 THEN 'descriptors' ELSE 'photo' END AS feedback_domain",
            "CASE lang WHEN 'en' THEN '2' WHEN 'fr' THEN '1.0' WHEN 'de' THEN '3' ELSE '' END AS feedback_intensity",
            "CASE src_no % 3 WHEN 0 THEN 'photo_face' WHEN 1 THEN '' ELSE 'contexto' END AS feedback_reason",
            """CASE lang
                 WHEN 'en' THEN CASE WHEN size_class = 'long' THEN '' ELSE '{"quick_agree":true}' END
                 WHEN 'fr' THEN '{"selected_domains":["interests"],"selected_interests":["fr","' || source || '"]}'
                 WHEN 'de' THEN '{"secondary_domains":"bio, photo","bio_not_positive":["und die"],"photo_score_adjustment":"'
                                || CASE WHEN label = 1 THEN 'lower' ELSE 'higher' END || '"}'
                 ELSE '{"descriptor_positive_details":["lang: es"],"descriptor_negative_details":["source: ' || source
                      || '","lang: es"],"target_action":"super_like"}' END AS details""",
        )

    @cached_property
    def reviews(self) -> DataFrame:
        joined = spread(self.orders, "o_orderkey").join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return joined.selectExpr(
            "o_orderkey AS review_id",
            "o_orderdate AS created_at",
            "CASE o_orderstatus WHEN 'F' THEN 'reviewed' WHEN 'P' THEN 'skipped' ELSE 'pending' END AS review_status",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'history' WHEN '2-HIGH' THEN 'quick_agree_recheck' "
            "ELSE 'auto' END AS review_mode",
            "CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '' ELSE c_name END AS name",
            "c_name AS full_name",
            "c_nationkey AS age",
            "c_mktsegment || ' ' || o_orderpriority AS text",
            "c_mktsegment AS tags",
            "CASE o_orderpriority WHEN '5-LOW' THEN '' ELSE 'https://img.example.com/u/' || o_custkey || '/' || c_nationkey "
            "|| '.jpg?sig=' || o_orderkey END AS url",
            "o_custkey AS target_index",
            "c_mktsegment AS target_signature",
            "o_totalprice / 500000D AS p",
            "CASE WHEN o_totalprice / 500000D >= 0.48D THEN 'LIKE' ELSE 'PASS' END AS original_label",
            "o_custkey",
            "o_orderpriority",
        )

    @cached_property
    def decisions(self) -> DataFrame:
        return spread(self.events, "event_id").select(
            "event_id",
            "user_id",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def signal_events(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id AS id",
            "ts AS created_at",
            "CASE event_type WHEN 'click' THEN 'interest' WHEN 'view' THEN 'bio' WHEN 'purchase' THEN 'Descriptor ' "
            "WHEN 'signup' THEN 'interest' ELSE 'photo' END AS signal_type",
            "CASE event_type WHEN 'click' THEN 'src' || (user_id % 20) WHEN 'view' THEN 'the  Th' WHEN 'purchase' "
            "THEN 'source: src' || (user_id % 20) WHEN 'signup' THEN (CASE WHEN value < 5 THEN ' ' ELSE 'FR' END) "
            "ELSE 'x' END AS signal_value",
            "CASE WHEN value >= 30 THEN 'Positive' WHEN value >= 10 THEN 'neutral' WHEN value >= 1 THEN 'negative' "
            "ELSE 'odd' END AS polarity",
            "CASE WHEN value >= 100 THEN 'many' ELSE CAST(CAST(floor(value) AS INT) AS STRING) END AS weight",
        )
