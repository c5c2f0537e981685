"""Plans and results whose work must grow with the input and no faster."""

import random

from pyspark.sql import functions as F

from prefspark.functions import text as T
from prefspark.operators import signals as G
from prefspark.operators import term_cells as C
from prefspark.plans import load_all


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_of_text(spark):
    rows = [(i, i % 2, "green apples taste great", ["Tea " if i == 1 else "tea"], ["Size: Big"]) for i in range(1, 6)]
    return spark.createDataFrame(rows, "id long, label int, text string, tags array<string>, displays array<string>")


def test_signal_candidates_counts_without_texts_and_reads_them_twice_at_most(spark):
    occurrences = G.signal_occurrences(rows_of_text(spark), "id", "label", "text", "tags", "displays", ("the",), ())
    feedback = spark.createDataFrame([], "signal_type string, signal_value string, polarity string, weight string")
    found = G.signal_candidates(occurrences, G.valid_signals(feedback), "id", "label")
    assert plan_of(found).count("regexp_extract_all(") == 1  # only the lookup of the chosen ones is left to run
    shown = {(r.kind, r.norm): (r.display, r.occurrences, r.likes, r.examples) for r in found.collect()}
    assert shown[("interest", "tea")] == ("Tea", 5, 3, "1,2,3") and shown[("descriptor", "size: big")] == ("Size: Big", 5, 3, "1,2,3")
    assert shown[("bio", "green apples")] == ("green apples", 5, 3, "1,2,3") and len(shown) == 5


def test_ascii_texts_pass_the_accent_table_by(spark):
    texts = ["", " ", "\n a  b\t", "Zürich CAFÉ", "the Kelvin K", None, "été thé", "plain words"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    table = F.translate(F.lower("s"), *T.fold_table())
    same = df.select("s", (T.normalize("s").eqNullSafe(table)).alias("n"), (T.fold("s").eqNullSafe(F.translate("s", *T.fold_table()))).alias("f"))
    assert all(r.n and r.f for r in same.collect()) and "octet_length" in plan_of(same)
    trimmed = F.regexp_replace("s", r"^\s+|\s+$", "")
    before = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
    assert all(r.x for r in df.select(T.word_count("s").eqNullSafe(before).alias("x")).collect())
    tokens = F.regexp_extract_all(T.normalize_key("s"), F.lit("[a-z]{3,}"), F.lit(0))
    assert all(r.x for r in df.select(T.raw_tokens("s").eqNullSafe(tokens).alias("x")).collect())


def test_cleanup_keeps_numbers_not_structs_and_the_lowest_id_of_a_tie(spark):
    from prefspark.operators import review_queue as Q

    rows = [(1, 5, "pending"), (2, 5, "pending"), (3, 4, "pending")]
    df = spark.createDataFrame(rows, "review_id long, s long, review_status string").selectExpr(
        "review_id", "timestamp_seconds(s) AS created_at", "review_status", "'auto' AS review_mode"
    )
    keys = F.array(F.struct(F.lit("k").alias("kind"), F.lit("x").alias("key")))
    lost = Q.duplicate_pending(df, "review_id", keys)
    assert "SortAggregate" not in lost._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.review_id for r in lost.collect()) == [2, 3]


def test_rare_terms_are_scored_like_common_ones(spark, monkeypatch):
    table = spark.createDataFrame(
        [("bio", "a", 50, 0, 0, 0, True), ("bio", "b", 3, 0, 0, 0, True), ("interest", "a", 0, 3, 0, 0, True)],
        "kind string, norm string, likes long, dislikes long, not_positive long, not_negative long, counted boolean",
    )
    items = spark.createDataFrame([(1, "bio", p, n) for p, n in enumerate("baxb")] + [(1, "interest", 0, "a")], "id long, kind string, pos int, norm string")
    assert G.HEAD >= 3
    whole = {tuple(r) for r in G.token_score_join(items, table, "id").collect()}
    monkeypatch.setattr(G, "HEAD", 1)
    split = G.token_score_join(items, table, "id")
    assert {tuple(r) for r in split.collect()} == whole and len(whole) == 2
    assert "LeftAnti" in plan_of(split)


def test_heads_fit_side_by_side_on_matrices_of_few_tasks(spark):
    from prefspark.operators import heads as M

    assert M.matrix_tasks(spark, 10) == spark.sparkContext.defaultParallelism and M.matrix_tasks(spark, 50 * M.TASK_ROWS) == 50
    df = spark.createDataFrame([(float(i), int(i > 9)) for i in range(20)], "f double, y int").repartition(40)
    one, two = M.fit_heads(spark, [(df, ["f"], "y", None), (df.filter("f > 2"), ["f"], "y", None)])
    for model in (one, two):
        scores = [r.s for r in M.score(model, df.withColumn("id", F.col("f")), ["f"], "s").orderBy("id").collect()]
        assert scores == sorted(scores) and scores[0] < 0.5 < scores[-1]


def scored_texts(spark, rows: int = 60):
    """Texts of few words, of which a table knows some well, some little and some not at all."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(30)]
    texts = [(i, " ".join(rng.choices(words, k=rng.choice((0, 1, 4, 40)))) or None, [rng.choice(words)] * (i % 3), [None, rng.choice(words)]) for i in range(rows)]
    df = spark.createDataFrame(texts, "id long, text string, tags array<string>, displays array<string>")
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    known = [("bio", n) for n in [*words[:20], *pairs]] + [(k, n) for k in ("interest", "descriptor") for n in words[5:15]]
    table = [(k, n, *rng.choice([(40, 1), (1, 40), (3, 0), (0, 3), (1, 0), (20, 20)]), int(rng.random() < 0.1), int(rng.random() < 0.1), rng.random() < 0.9) for k, n in known]
    return df, spark.createDataFrame(table, "kind string, norm string, likes long, dislikes long, not_positive long, not_negative long, counted boolean")


def test_token_scores_read_texts_once_and_equal_the_join_of_their_items(spark, monkeypatch):
    df, table = scored_texts(spark)
    args = ("id", "text", "tags", "displays", ("the",))
    want = {tuple(r) for r in G.token_score_join(G.item_signals(df, *args), table, "id").collect()}
    assert len({r[1] for r in want}) == 3 and max(r[5].count(",") for r in want) == 4
    for most in (G.LOOKED_UP, 12, 0):
        monkeypatch.setattr(G, "LOOKED_UP", most)
        scored = G.text_token_scores(df, table, *args)
        assert {tuple(r) for r in scored.collect()} == want
        assert plan_of(scored).count("regexp_extract_all(") == 1


def test_hits_of_equal_rows_are_told_for_each(spark, monkeypatch):
    rows = [(1, "tea cup", ["x"], ["y"])] * 3
    df = spark.createDataFrame(rows, "id long, text string, tags array<string>, displays array<string>")
    table = spark.createDataFrame(
        [("bio", n, 5, 0, 0, 0, True) for n in ("tea", "cup")], "kind string, norm string, likes long, dislikes long, not_positive long, not_negative long, counted boolean"
    )
    for most in (G.LOOKED_UP, 0):
        monkeypatch.setattr(G, "LOOKED_UP", most)
        (row,) = G.text_token_scores(df, table, "id", "text", "tags", "displays", ()).collect()
        assert (row.positive_hits, row.positive_signals) == (6, "tea,tea,tea,cup,cup")


def test_query_of_token_scores_reads_texts_once(spark, monkeypatch):
    monkeypatch.setattr(G, "LOOKED_UP", 1000)
    assert plan_of(load_all()["token_score_join"](spark, "/root/testdata/sf0.001")).count("regexp_extract_all(") == 1


def test_texts_stay_where_they_are_while_labels_are_few(spark, monkeypatch):
    from prefspark.plans import signals_q, tables

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "strategy=broadcast" in plan_of(signals_q.label_rows(tables.Tables(spark, "/root/testdata/sf0.001")))
        monkeypatch.setattr(tables, "MOST_LABELS", 10)
        assert "strategy=broadcast" not in plan_of(signals_q.label_rows(tables.Tables(spark, "/root/testdata/sf0.001")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_only_rare_known_terms_leave_their_text_and_late_ones_without_place(spark):
    lists = spark.createDataFrame([(1, ["rare", "none", "good", "good", "rare", "bad"], [])], "id long, bio array<string>, interest array<string>")
    head = spark.createDataFrame([("bio", "good", 0.9, 1), ("bio", "bad", 0.1, -1)], "kind string, norm string, score double, side int")
    known = C.term_filter(spark.createDataFrame([("rare",)], "norm string"), "norm")
    cells = C.term_cells(lists, "id", ("bio", "interest"), head, known, 1).collect()
    assert sorted((r.norm, r.pos) for r in cells if r.norm) == [("rare", 0), ("rare", 4)]
    told = [(round(r.own.total, 6), *r.own[1:], [tuple(u) for u in r.shown]) for r in cells if r.own]
    assert told == [(1.9, 3, 2, 1, [(1, 2, "good"), (-1, 5, "bad")])]
    full = spark.createDataFrame([(1, ["good", "bad", "rare"])], "id long, bio array<string>")
    assert [(r.norm, r.pos) for r in C.term_cells(full, "id", ("bio",), head, known, 1).collect() if r.norm] == [("rare", None)]
