"""Signals: what tags, text tokens and attributes say about liking, learned from labels and explicit feedback."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions.labels import detail
from prefspark.functions.numeric import half_up
from prefspark.functions.text import BLOCKED_BIGRAMS_PT, STOPWORDS_PT, candidate_pairs, ngrams_of, normalize_key, parse_list, raw_tokens, stopwords_nulled
from prefspark.operators.term_cells import term_cells, term_filter
from prefspark.session import cut_lineage, scratch_path

# fixed values: signal kinds, polarities, the default weight and its limits
KINDS = ("interest", "bio", "descriptor")
POLARITIES = ("positive", "neutral", "negative")
DEFAULT_WEIGHT, MIN_WEIGHT, MAX_WEIGHT = 3, 1, 20
LIKED, DISLIKED, MIN_EVIDENCE, SHOWN = 0.70, 0.30, 2, 5
#: Most terms that are sent to every executor; the others are joined by a shuffle.
HEAD = 100_000
#: Most terms that are looked up where the texts are read: in Arrow a term takes about 25 bytes, in a joined table several times that.
LOOKED_UP = 1_000_000
#: Terms taught more often are not told apart by how often.
OFTEN = 10_000


def laplace_score(likes: Column | str, dislikes: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (likes, dislikes))
    return (a + 1.0) / (a + b + 2.0)


def clean_signals(df: DataFrame) -> DataFrame:
    """Signal records with canonical columns and a ``reason`` that is null for the valid ones."""
    kind, polarity = F.lower(F.trim("signal_type")), F.lower(F.trim("polarity"))
    value = F.trim(F.coalesce("signal_value", F.lit("")))
    weight = F.coalesce(F.nullif(F.col("weight").cast("string").try_cast("int"), F.lit(0)), F.lit(DEFAULT_WEIGHT))
    reason = (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "bad type")
        .when(~F.coalesce(polarity.isin(*POLARITIES), F.lit(False)), "bad polarity")
        .when(value == "", "empty value")
    )
    return df.withColumns(
        {
            "reason": reason,
            "signal_type": kind,
            "polarity": polarity,
            "signal_value": value,
            "signal_norm": normalize_key(value),
            "weight": F.greatest(F.lit(MIN_WEIGHT), F.least(F.lit(MAX_WEIGHT), weight)),
        }
    )


def valid_signals(df: DataFrame) -> DataFrame:
    return clean_signals(df).filter(F.col("reason").isNull() & (F.col("signal_norm") != "")).drop("reason")


def _group(kind: str, norms: Column, likes: Column, dislikes: Column, veto_pos: int = 0, veto_neg: int = 0) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        norms.alias("norms"),
        likes.cast("bigint").alias("likes"),
        dislikes.cast("bigint").alias("dislikes"),
        F.lit(veto_pos).cast("bigint").alias("not_positive"),
        F.lit(veto_neg).cast("bigint").alias("not_negative"),
        F.lit(not (veto_pos or veto_neg)).alias("counted"),
    )


def _distinct_norms(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda x: normalize_key(x)), lambda x: x != ""))


def signal_rows(
    df: DataFrame, *, label: str, domains: str, details: str, text: str, tags: str, items: str, stopwords: Sequence[str] = STOPWORDS_PT
) -> DataFrame:
    """One row per (row, kind, norm) taught: likes / dislikes and vetoes. A row teaches a kind only when its feedback
    names that domain; selected entries replace the full list; positive attributes win over negative ones.
    """
    liked, passed = F.col(label) == 1, F.col(label) != 1
    none = F.array().cast("array<string>")

    def when_domain(name: str, values: Column) -> Column:
        return F.when(F.array_contains(F.col(domains), name), values).otherwise(none)

    staged = df.withColumns(
        {
            "_selected": parse_list(detail(details, "selected_interests")),
            "_bio": F.trim(detail(details, "bio_detail")),
            "_pos": _distinct_norms(parse_list(detail(details, "descriptor_positive_details"))),
            "_neg": _distinct_norms(parse_list(detail(details, "descriptor_negative_details"))),
            "_chosen": _distinct_norms(parse_list(detail(details, "descriptor_detail"))),
        }
    ).withColumn("_raw", raw_tokens(F.when(F.col("_bio") != "", F.col("_bio")).otherwise(F.col(text))))
    interests = when_domain("interests", _distinct_norms(F.when(F.size("_selected") > 0, F.col("_selected")).otherwise(F.col(tags))))
    tokens = when_domain("bio", F.array_distinct(ngrams_of(F.col("_raw"), stopwords)))
    untaught = (F.size("_pos") == 0) & (F.size("_neg") == 0)
    all_items = F.when(F.size("_chosen") > 0, F.col("_chosen")).otherwise(F.array_distinct(F.col(items)))
    plain = F.when(untaught, when_domain("descriptors", all_items)).otherwise(none)
    one, zero = F.lit(1), F.lit(0)
    groups = [
        _group("interest", interests, liked, passed),
        _group("bio", tokens, liked, passed),
        _group("descriptor", F.col("_pos"), one, zero),
        _group("descriptor", F.array_except("_neg", "_pos"), zero, one),
        _group("descriptor", plain, liked, passed),
    ]
    for kind in KINDS:
        for key, pos, neg in ((f"{kind}_not_positive", 1, 0), (f"{kind}_not_negative", 0, 1)):
            vetoed = F.filter(F.transform(parse_list(detail(details, key)), lambda x: normalize_key(x)), lambda x: x != "")
            groups.append(_group(kind, vetoed, zero, zero, pos, neg))
    flat = staged.select(F.inline_outer(F.array(*groups)))
    return flat.select("kind", F.explode("norms").alias("norm"), "likes", "dislikes", "not_positive", "not_negative", "counted")


def feedback_rows(signals: DataFrame) -> DataFrame:
    """Explicit signal feedback in the same shape: weight on one side and vetoes against the other."""
    positive, negative = F.col("polarity") == "positive", F.col("polarity") == "negative"
    return signals.select(
        F.col("signal_type").alias("kind"),
        F.col("signal_norm").alias("norm"),
        F.when(positive, F.col("weight")).otherwise(0).cast("bigint").alias("likes"),
        F.when(negative, F.col("weight")).otherwise(0).cast("bigint").alias("dislikes"),
        (~positive).cast("bigint").alias("not_positive"),
        (~negative).cast("bigint").alias("not_negative"),
        F.lit(True).alias("counted"),
    )


def signal_table(*parts: DataFrame) -> DataFrame:
    """Learned table: one row per (kind, norm), from label rows and any number of feedback rows."""
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("kind", "norm")
        .agg(
            F.sum("likes").alias("likes"),
            F.sum("dislikes").alias("dislikes"),
            F.sum("not_positive").alias("not_positive"),
            F.sum("not_negative").alias("not_negative"),
            F.max("counted").alias("counted"),
        )
    )


def feedback_pivot(signals: DataFrame) -> DataFrame:
    """Counts per (kind, norm) by polarity, with the total."""
    return (
        signals.groupBy(F.col("signal_type").alias("kind"), F.col("signal_norm").alias("norm"))
        .agg(*[F.count_if(F.col("polarity") == p).alias(p) for p in POLARITIES], F.count("*").alias("total"))
    )


def veto_tables(table: DataFrame, min_count: int = 2) -> DataFrame:
    """(veto, norm) of every term neutralized at least ``min_count`` times."""
    pairs = F.array(
        F.struct(F.concat("kind", F.lit("_not_positive")).alias("veto"), F.col("not_positive").alias("n")),
        F.struct(F.concat("kind", F.lit("_not_negative")).alias("veto"), F.col("not_negative").alias("n")),
    )
    return table.select("norm", F.inline(pairs)).filter(F.col("n") >= min_count).select("veto", "norm", "n")


def vetoed_score() -> Column:
    """Laplace score of a table row after its vetoes."""
    score = laplace_score("likes", "dislikes")
    no_pos, no_neg = F.col("not_positive") > 0, F.col("not_negative") > 0
    return (
        F.when(no_pos & no_neg, 0.5)
        .when(no_pos, F.least(score, F.lit(0.55)))
        .when(no_neg, F.greatest(score, F.lit(0.45)))
        .otherwise(score)
    )


def _scored_terms(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The terms that score, with their score and whether they count as a hit: the most taught ones, at most ``most`` and so fit for a
    broadcast, and the rest (None if there is none). Written once, as learning them reads all taught texts."""
    spark, total = table.sparkSession, F.col("likes") + F.col("dislikes")
    score, enough = vetoed_score(), total >= MIN_EVIDENCE
    path = scratch_path(spark, "terms")
    table.filter("counted").select(
        "kind",
        "norm",
        F.least(total, F.lit(OFTEN)).cast("int").alias("taught"),
        score.alias("score"),
        (enough & (F.col("not_positive") == 0) & (score >= LIKED)).alias("liked"),
        (enough & (F.col("not_negative") == 0) & (score <= DISLIKED)).alias("disliked"),
    ).write.parquet(path)
    terms = spark.read.schema("kind string, norm string, taught int, score double, liked boolean, disliked boolean").parquet(path)
    sizes = {r.taught: r.n for r in terms.groupBy("taught").agg(F.count("*").alias("n")).collect()}
    least, room = max(sizes, default=0) + 1, most
    for taught in sorted(sizes, reverse=True):
        room -= sizes[taught]
        if room < 0:
            break
        least = taught
    head = terms.filter(F.col("taught") >= least).drop("taught")
    return head, terms.filter(F.col("taught") < least).drop("taught") if room < 0 else None


def _known_items(items: DataFrame, table: DataFrame) -> DataFrame:
    """Items found in the learned table, with their score and whether they count as a hit.

    Most items are among the few most taught terms. Those are scored where the texts are read; only what is left is shuffled to the
    rest of the table, once, whose partitions are hashed, as that saves sorting the (far more) items.
    """
    common, rare = _known_parts(items, table)
    return common if rare is None else common.unionByName(rare)


def _known_parts(items: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``_known_items`` by the most taught terms, and by the others."""
    head, tail = _scored_terms(table, HEAD)
    common = items.join(F.broadcast(head), ["kind", "norm"])
    if tail is None:
        return common, None
    left = items.join(F.broadcast(head.select("kind", "norm")), ["kind", "norm"], "left_anti")
    # kind and norm travel as one text, as a second one would cost most of a row's bytes
    term = F.concat(F.substring("kind", 1, 1), "norm").alias("_term")
    rest = left.select(*[c for c in items.columns if c not in ("kind", "norm")], term)
    rare = rest.join(tail.select(term, "score", "liked", "disliked").hint("shuffle_hash"), "_term")
    kind = F
    for name in KINDS:
        kind = kind.when(F.col("_term").startswith(name[0]), name)
    return common, rare.withColumns({"kind": kind.otherwise(None), "norm": F.expr("substring(_term, 2)")}).select(*common.columns)


def _token_scores(known: DataFrame, key: str) -> DataFrame:
    return known.groupBy(key, "kind").agg(
        half_up(F.avg("score"), 4).alias("score"),
        F.count_if("liked").alias("positive_hits"),
        F.count_if("disliked").alias("negative_hits"),
    )


def token_score_join(items: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Score the items (key, kind, pos, norm) of each row against the table: mean score, hits, first five signals.

    Repeats count. Unknown items drop out in the join. Of the common terms, what is no hit is summed to one cell per row and kind before
    it is shuffled; the lists that are gathered are the hits inside one row's own text.
    """
    common, rare = _known_parts(items, table)
    hit = F.col("liked") | F.col("disliked")
    place = [key, "kind", F.when(hit, F.col("pos")).alias("pos"), F.when(hit, F.col("norm")).alias("norm"), "liked", "disliked"]
    cells = common.groupBy(*place).agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    if rare is not None:
        cells = cells.unionByName(rare.select(*place, F.col("score").alias("total"), F.lit(1).cast("bigint").alias("n")))
    # dealt as plain rows: buffers of lists, which hold a hit or none each, would be larger
    cells = cells.repartition(key, "kind")

    def shown(flag: str) -> Column:
        uses = F.sort_array(F.collect_list(F.when(F.col(flag), F.struct("pos", "norm"))))
        return F.array_join(F.transform(F.slice(uses, 1, SHOWN), lambda u: u["norm"]), ",")

    return cells.groupBy(key, "kind").agg(
        half_up(F.sum("total") / F.sum("n"), 4).alias("score"),
        F.coalesce(F.sum(F.when(F.col("liked"), F.col("n"))), F.lit(0)).alias("positive_hits"),
        F.coalesce(F.sum(F.when(F.col("disliked"), F.col("n"))), F.lit(0)).alias("negative_hits"),
        shown("liked").alias("positive_signals"),
        shown("disliked").alias("negative_signals"),
    )


def text_token_scores(df: DataFrame, table: DataFrame, key: str, text: str, tags: str, items: str, stopwords: Sequence[str] = STOPWORDS_PT) -> DataFrame:
    """``token_score_join`` of ``item_signals``, with each text read once and its terms looked up as whole lists.

    What the most taught terms give is told in a few cells per row and kind. Of the others only those that the table may know are
    shuffled to it, the cells beside them, and what is found there comes back to its row as numbers; the term comes along only
    where it can be among the first hits.
    """
    side = F.when(F.col("liked"), 1).when(F.col("disliked"), -1).otherwise(0).alias("side")
    head, tail = _scored_terms(table, LOOKED_UP)
    lists = item_lists(df, key, text, tags, items, stopwords).withColumnRenamed(key, "_key")
    found = term_cells(lists, "_key", KINDS, head.select("kind", "norm", "score", side), None if tail is None else term_filter(tail, "norm"), SHOWN)
    cell = F.struct("kind", "own", "shown")
    if tail is None:
        met = found.select("_key", F.lit(0).alias("code"), F.lit(0.0).alias("score"), cell.alias("cell"))
    else:
        met = _met_terms(found, cell, tail.select("kind", "norm", "score", side))

    # most rows are single terms of no further use, a code of kind and side and a score
    number, single = F.shiftright("code", 2), F.pmod("code", F.lit(4)) - 1

    def summed(field: str, one: Column) -> Column:
        return F.sum(F.coalesce(f"cell.own.{field}", one)).alias(field)

    # dealt as plain rows and summed twice, as a list is gathered by sorting: so only over the few rows that the first sum leaves
    kind = F.coalesce("cell.kind", F.element_at(F.array(*map(F.lit, KINDS)), F.nullif(number, F.lit(0))))
    few = met.repartition("_key").groupBy("_key", kind.alias("kind"), F.col("cell.shown").alias("shown")).agg(
        summed("total", F.col("score")),
        summed("n", F.lit(1)),
        summed("positive", (single == 1).cast("bigint")),
        summed("negative", (single == -1).cast("bigint")),
        F.count("*").cast("int").alias("times"),
    )
    told = F.when(F.col("shown").isNotNull(), F.flatten(F.array_repeat("shown", F.col("times"))))

    def first_hits(side: int) -> Column:
        uses = F.sort_array(F.filter(F.flatten(F.collect_list(told)), lambda u: u["side"] == side))
        return F.array_join(F.transform(F.slice(uses, 1, SHOWN), lambda u: u["norm"]), ",")

    return few.groupBy(F.col("_key").alias(key), "kind").agg(
        half_up(F.sum("total") / F.sum("n"), 4).alias("score"),
        F.sum("positive").alias("positive_hits"),
        F.sum("negative").alias("negative_hits"),
        first_hits(1).alias("positive_signals"),
        first_hits(-1).alias("negative_signals"),
    )


def _met_terms(found: DataFrame, cell: Column, tail: DataFrame) -> DataFrame:
    """(_key, code, score, cell) of the cells of ``term_cells`` and of its other terms that ``tail`` has. The narrower both shuffles'
    rows are, the better: kind and norm travel as one text, and what is found as a number, 4 x the place of its kind + side + 1."""
    term, own = F.concat(F.substring("kind", 1, 1), "norm"), F.col("own").isNotNull()
    # no kind begins with "="; cells, which meet no term, are spread by their row
    sent = found.select(
        "_key", F.when(own, F.concat_ws("", F.lit("="), "kind", "_key")).otherwise(term).alias("_term"), "pos", F.when(own, cell).alias("cell")
    )
    joined = sent.join(tail.select(term.alias("_term"), "score", "side").hint("shuffle_hash"), "_term", "left")
    met = joined.filter(F.col("cell").isNotNull() | F.col("score").isNotNull())
    number = F.position(F.substring("_term", 1, 1), F.lit("".join(k[0] for k in KINDS)))
    one = F.struct(
        F.col("score").alias("total"),
        F.lit(1).cast("bigint").alias("n"),
        (F.col("side") == 1).cast("bigint").alias("positive"),
        (F.col("side") == -1).cast("bigint").alias("negative"),
    )
    hit = F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), F.nullif(number, F.lit(0))).alias("kind"),
        one.alias("own"),
        F.array(F.struct("side", "pos", F.expr("substring(_term, 2)").alias("norm"))).alias("shown"),
    )
    met = met.withColumn("cell", F.coalesce("cell", F.when((F.col("side") != 0) & F.col("pos").isNotNull(), hit)))
    plain = F.col("cell").isNull()
    return met.select("_key", F.when(plain, number * 4 + F.col("side") + 1).alias("code"), F.when(plain, F.col("score")).alias("score"), "cell")


def item_lists(df: DataFrame, key: str, text: str, tags: str, items: str, stopwords: Sequence[str]) -> DataFrame:
    """(key, interest, bio, descriptor): a list per kind of everything that can be scored in a row; repeats are kept."""
    norms = F.filter(F.transform(F.col(tags), lambda x: normalize_key(x)), lambda x: x != "")
    raw = df.select(key, norms.alias(KINDS[0]), F.col(items).alias(KINDS[2]), raw_tokens(text).alias("_raw"))
    return raw.select(key, KINDS[0], ngrams_of(F.col("_raw"), stopwords).alias(KINDS[1]), KINDS[2])


def item_signals(df: DataFrame, key: str, text: str, tags: str, items: str, stopwords: Sequence[str] = STOPWORDS_PT) -> DataFrame:
    """(key, kind, pos, norm) of everything that can be scored in a row; repeats are kept."""
    norms = F.filter(F.transform(F.col(tags), lambda x: normalize_key(x)), lambda x: x != "")
    raw = df.select(key, norms.alias("_tags"), F.col(items).alias("_items"), raw_tokens(text).alias("_raw"))
    flat = raw.select(
        key,
        F.size("_tags").alias("_first"),
        F.size("_items").alias("_last"),
        F.concat("_tags", "_items", ngrams_of(F.col("_raw"), stopwords)).alias("_all"),
    )
    # the outer form keeps the optimizer from adding a size(...) > 0 filter, which would tokenize every text twice
    placed = flat.select(key, "_first", "_last", F.posexplode_outer("_all").alias("pos", "norm")).filter(F.col("norm").isNotNull())
    kind = F.when(F.col("pos") < F.col("_first"), KINDS[0]).when(F.col("pos") < F.col("_first") + F.col("_last"), KINDS[2]).otherwise(KINDS[1])
    return placed.select(key, kind.alias("kind"), "pos", "norm")


def profile_text_score(df: DataFrame, table: DataFrame, key: str, text: str, tags: str, items: str, stopwords: Sequence[str] = STOPWORDS_PT) -> DataFrame:
    """Per row the three signal scores and their blend; attributes count only when they say something."""
    scored = _token_scores(_known_items(item_signals(df, key, text, tags, items, stopwords), table), key)
    wide = scored.groupBy(key).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in KINDS],
        F.sum("positive_hits").alias("positive_hits"),
        F.sum("negative_hits").alias("negative_hits"),
    )
    filled = df.select(key).join(wide, key, "left").fillna(0.5, [*KINDS]).fillna(0, ["positive_hits", "negative_hits"])
    with_attrs = F.col("interest") * 0.45 + F.col("bio") * 0.35 + F.col("descriptor") * 0.20
    without = F.col("interest") * 0.55 + F.col("bio") * 0.45
    blended = half_up(F.when(F.col("descriptor") != 0.5, with_attrs).otherwise(without), 4)
    return filled.withColumn("text_preference_score", blended)


def signal_occurrences(df: DataFrame, key: str, label: str, text: str, tags: str, displays: str, stopwords: Sequence[str], blocked: Sequence[str] = BLOCKED_BIGRAMS_PT) -> DataFrame:
    """(key, label, kind, display, norm): every tag, candidate bigram (once per row) and attribute of the rows."""
    raw = df.select(key, label, tags, displays, raw_tokens(text).alias("_raw"))
    raw = raw.withColumn("_raw", stopwords_nulled(F.col("_raw"), stopwords))
    bigrams = F.array_distinct(candidate_pairs(F.col("_raw"), blocked))
    groups = [
        F.struct(F.lit(kind).alias("kind"), values.alias("displays"))
        for kind, values in (("interest", F.col(tags)), ("bio", bigrams), ("descriptor", F.col(displays)))
    ]
    # the outer form: see item_signals
    grouped = raw.select(key, label, F.inline_outer(F.array(*groups)))
    flat = grouped.select(key, label, "kind", F.explode("displays").alias("display"))
    # bigrams are normalized already; normalizing them again would be most of the work
    norm = F.when(F.col("kind") == "bio", F.col("display")).otherwise(normalize_key("display"))
    return flat.withColumns({"display": F.trim("display"), "norm": norm}).filter(F.col("norm") != "")


def signal_candidates(
    occurrences: DataFrame, feedback: DataFrame, key: str, label: str, limit: int = 60, min_occurrences: int = 3, max_explicit: int = 2, examples: int = 3
) -> DataFrame:
    """Frequent signals still short of explicit feedback, most useful first, with a few example rows.

    All signals are only counted, which hashes; how one is displayed is looked up for the ``limit`` chosen ones, as an aggregate that
    keeps a text per signal would sort every occurrence.
    """
    counted = occurrences.groupBy("kind", "norm").agg(
        F.count("*").alias("occurrences"),
        F.count_if(F.col(label) == 1).alias("likes"),
        F.count_if(F.col(label) != 1).alias("dislikes"),
    )
    frequent = counted.filter(F.col("occurrences") >= min_occurrences)
    known = feedback_pivot(feedback).select("kind", "norm", F.col("total").alias("explicit"))
    joined = frequent.join(known, ["kind", "norm"], "left").withColumn("explicit", F.coalesce("explicit", F.lit(0)))
    score = laplace_score("likes", "dislikes")
    ranked = joined.filter(F.col("explicit") <= max_explicit).withColumns(
        {
            "learned_score": half_up(score, 4),
            "priority": half_up(F.col("occurrences") / (1 + F.col("explicit")) * (1.0 + F.abs(score - 0.5)), 4),
        }
    )
    # the report is `limit` rows long, so it is small by construction; it is read twice, and counting again would read all texts again
    best = cut_lineage(ranked.orderBy("explicit", F.desc("priority"), F.desc("occurrences"), "kind", "norm").limit(limit))
    found = occurrences.select(key, "kind", "display", "norm").join(F.broadcast(best.select("kind", "norm")), ["kind", "norm"])
    order = Window.partitionBy("kind", "norm").orderBy(key, "display")
    shown = found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= examples)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", key))), lambda e: e[key].cast("string")), ",")
    looked_up = shown.groupBy("kind", "norm").agg(F.min_by("display", "rn").alias("display"), text.alias("examples"))
    return best.join(looked_up, ["kind", "norm"])


def summary_topn(table: DataFrame, top: int = 8) -> DataFrame:
    """Per kind the most liked and most disliked signals with enough evidence."""
    score, total = laplace_score("likes", "dislikes"), F.col("likes") + F.col("dislikes")
    known = table.withColumns({"score": score, "total": total}).filter(F.col("counted") & (total >= MIN_EVIDENCE))
    sided = known.withColumn("side", F.when(F.col("score") >= LIKED, "liked").when(F.col("score") <= DISLIKED, "disliked"))
    sign = F.when(F.col("side") == "liked", 1).otherwise(-1)
    order = Window.partitionBy("kind", "side").orderBy(F.desc(F.col("score") * sign), F.desc(F.col("total") * sign), "norm")
    ranked = sided.filter(F.col("side").isNotNull()).withColumn("position", F.row_number().over(order))
    return ranked.filter(F.col("position") <= top).select("kind", "side", "position", "norm", half_up("score", 4).alias("score"), "total")
