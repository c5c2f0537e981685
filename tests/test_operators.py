"""Operators against brute force on small, deliberately skewed fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from prefspark.operators import bucketed as B
from prefspark.operators import event_rules as E
from prefspark.operators import heads as M
from prefspark.operators import keys as K
from prefspark.operators import matching as J
from prefspark.operators import metrics as ME
from prefspark.operators import review_queue as Q
from prefspark.operators import scoring as S
from prefspark.operators import signals as G
from prefspark.operators import vectors as V


@pytest.fixture(scope="module")
def events(spark):
    """One key holds two thirds of the rows, and times repeat."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", rng.randrange(0, 4000), rng.choice("ABC"), rng.random()) for i in range(900)]
    return spark.createDataFrame(rows, "id long, key string, ts long, who string, value double").cache()


def pairs(df, column):
    return {r.id: r[column] for r in df.select("id", column).collect()}


@pytest.mark.parametrize("width", [50, 700, 10_000])
def test_ordered_scan_equals_plain_windows(events, width):
    w = Window.partitionBy("key").orderBy("ts", "id")
    marked = F.when(F.col("value") > 0.7, F.col("value"))
    plain = events.select(
        "id",
        F.lag("ts").over(w).alias("prev"),
        F.last(marked, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last"),
        F.last(marked, True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.sum(F.lit(2)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        F.row_number().over(w).alias("n"),
    )
    scanned = B.ordered_scan(
        events, ["key"], "ts", "id", width, previous={"prev": F.col("ts")}, last={"last": marked}, last_before={"before": marked}, running_sum={"total": F.lit(2)}, row_number="n"
    )
    for column in ("prev", "last", "before", "total", "n"):
        assert pairs(scanned, column) == pairs(plain, column)


def test_rolling_range_equals_plain_window(events):
    w = Window.partitionBy("key").orderBy("ts").rangeBetween(-90, 0)
    rolled = B.rolling_range(events, ["key"], "ts", 90, {"n": lambda x: F.count("*").over(x)}, width=120)
    assert pairs(rolled, "n") == pairs(events.withColumn("n", F.count("*").over(w)), "n")


@pytest.mark.parametrize("n, share", [(1, 0.8), (2, 0.5), (101, 0.8), (500, 0.33)])
def test_order_cut(spark, n, share):
    values = sorted(random.Random(n).sample(range(10**9), n))
    df = spark.createDataFrame([(v,) for v in values], "id long")
    split = B.chronological_split(df, "id", share)
    assert split.filter("NOT is_holdout").count() == int(share * n)
    top = split.filter("is_holdout").agg(F.min("id")).first()[0]
    assert top == values[int(share * n)]


def greedy(times, gap):
    out, last = [], None
    for t in times:
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


@pytest.fixture
def many_runs(spark):
    """Small tables stay in several partitions, so that rules are handed on from run to run."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("gap", [1, 7, 40, 300, 10_000])
def test_cooldown_equals_greedy_walk(events, gap, many_runs):
    got = E.cooldown(events, ["key"], "ts", "id", gap).collect()
    rows = sorted(events.collect(), key=lambda r: (r.ts, r.id))
    for key in {r.key for r in rows}:
        assert sorted(r.ts for r in got if r.key == key) == greedy([r.ts for r in rows if r.key == key], gap)


@pytest.mark.parametrize("window, threshold, quiet", [(30, 3, 50), (100, 9, 1), (4000, 200, 300), (5, 1, 20)])
def test_alerts_equal_a_walk(events, window, threshold, quiet, many_runs):
    got = E.threshold_alerts(events, ["key"], "ts", "id", window, threshold, quiet).collect()
    rows = sorted(events.collect(), key=lambda r: (r.ts, r.id))
    for key in {r.key for r in rows}:
        times = [r.ts for r in rows if r.key == key]
        loud = [t for t in times if sum(t - window <= x <= t for x in times) >= threshold]
        assert sorted(r.ts for r in got if r.key == key) == greedy(loud, quiet)


def test_runs_share_a_hot_key_and_burst(spark, many_runs):
    """Nine tenths of the rows belong to one key and one day: no run holds twice the mean."""
    burst = spark.range(40_000).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id") % 7)).otherwise("hot").alias("key"), (F.col("id") * 97 % 86_400).alias("ts"))
    sizes = [r["count"] for r in E.in_runs(burst, ["key"], "ts", "id").groupBy("_run").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 2 * sum(sizes) / len(sizes)
    times = [r.ts for r in burst.filter("key = 'hot'").orderBy("ts", "id").collect()]
    got = E.cooldown(burst, ["key"], "ts", "id", 500).filter("key = 'hot'")
    assert sorted(r.ts for r in got.collect()) == greedy(times, 500)


@pytest.mark.parametrize("hold", [3, 25, 5000])
def test_flipflop_equals_sequential_walk(events, hold, many_runs):
    named = events.withColumn("name", F.lit("n"))
    got = pairs(E.flipflop(named, ["key"], "ts", "id", "who", "name", hold), "ignored")
    want = {}
    for key in {r.key for r in events.collect()}:
        state = E.BLANK
        for r in sorted((r for r in events.collect() if r.key == key), key=lambda r: (r.ts, r.id)):
            want[r.id], state = E.flipflop_step(state, r.ts, r.who, "n", hold)
    assert got == want and any(want.values())


def test_duplicate_refreshes_the_clock(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 50), (3, "a", 100), (4, "a", 200)], "id long, key string, ts long")
    assert pairs(E.dedupe_ttl(df, ["key"], "ts", "id", 60), "is_duplicate") == {1: False, 2: True, 3: True, 4: False}


def test_any_key_match_is_not_transitive(spark):
    df = spark.createDataFrame(
        [(1, "pending", "2024-01-01", "Ana", 20, ""), (2, "pending", "2024-01-02", "Ana", 20, "http://h/u/o/1"), (3, "pending", "2024-01-03", "", 20, "http://h/u/o/1")],
        "review_id long, review_status string, created_at string, name string, age int, url string",
    ).withColumn("review_mode", F.lit("auto"))
    keys = K.review_keys(name=F.col("name"), age=F.col("age"), url=F.col("url"))
    assert {r.review_id for r in Q.duplicate_pending(df, "review_id", keys).collect()} == {1, 2}


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([(i, "pending", f"2024-01-{i + 1:02d}", f"n{i % 3}", 20) for i in range(9)], "review_id long, review_status string, created_at string, name string, age int")
    df = df.withColumn("review_mode", F.lit("auto"))
    keys = K.review_keys(name=F.col("name"), age=F.col("age"))
    losers = Q.duplicate_pending(df, "review_id", keys)
    kept = df.join(losers.select("review_id"), "review_id", "left_anti")
    assert losers.count() == 6
    assert Q.duplicate_pending(kept, "review_id", keys).count() == 0


def test_text_key_covers_the_whole_text(spark):
    long = "x" * 200
    df = spark.createDataFrame([(1, long + "a"), (2, long + "b")], "id long, text string")
    full = K.review_keys(name=F.lit("n"), age=F.lit(1), text=F.col("text"))
    cut = K.review_keys(name=F.lit("n"), age=F.lit(1), text=F.col("text"), text_cut=120)

    def distinct(keys):
        return K.explode_keys(df, keys, "id").filter("kind = 'name_age_text'").select("key").distinct().count()

    assert (distinct(full), distinct(cut)) == (2, 1)


def test_active_set_empty_means_everything_active(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, key string")
    probe = rows.select("id", F.lit("id").alias("kind"), "key")
    nobody = probe.filter("false").select("kind", "key")
    assert {r.is_active for r in J.active_members(rows, "id", probe, nobody).collect()} == {True}
    some = probe.filter("id = 1").select("kind", "key")
    assert pairs(J.active_members(rows, "id", probe, some), "is_active") == {1: True, 2: False}


@pytest.mark.parametrize("block", [3, 50])
def test_max_pair_cosine_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, "hot" if i % 4 else f"g{i % 3}", rng.normal(size=16).tolist()) for i in range(60)] + [(99, "single", [1.0] * 16), (100, "twin", [1.0] * 16), (101, "twin", [2.0] * 16)]
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>")
    got = {r.grp: r.max_cosine for r in V.max_pair_cosine(df, "grp", "id", "v", block).collect()}
    for name in ("hot", "g0", "g1", "g2", "twin"):
        m = np.array([v for _, g, v in rows if g == name])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        product = m @ m.T
        np.fill_diagonal(product, -2)
        assert got[name] == pytest.approx(product.max(), abs=1e-9)
    assert "single" not in got


def test_threshold_fallback_below_thirty_rows(spark):
    df = spark.createDataFrame([(i % 2, 0.4 + i / 40) for i in range(8)], "y int, p double")
    row = ME.threshold_sweep(df, "y", "p").first()
    assert (row.like_threshold, row.threshold_source) == (0.48, "fallback_insufficient_data")


def test_threshold_prefers_recall_above_the_floor(spark):
    rows = [(1, 0.47)] * 20 + [(1, 0.9)] * 20 + [(0, 0.1)] * 20 + [(0, 0.46)] * 5
    df = spark.createDataFrame(rows, "y int, p double")
    row = ME.threshold_sweep(df, "y", "p").first()
    assert row.threshold_source == "optimized_precision_floor"
    assert (row.tp, row.fp, row.fn) == (40, 0, 0) and row.like_threshold == 0.47


def test_bins_and_ranges_add_up(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randrange(2), rng.choice([0.0, 0.3, 0.4, 0.6, 1.0, rng.random()])) for _ in range(200)], "y int, p double")
    assert ME.calibration_bins(df, "y", "p").agg(F.sum("n")).first()[0] == 200
    assert ME.range_metrics(df, "y", "p", 0.48).agg(F.sum("n")).first()[0] == 200


def test_neutral_signal_scores_one_half(spark):
    signals = spark.createDataFrame([("interest", "Tea", "neutral", "5")], "signal_type string, signal_value string, polarity string, weight string")
    table = G.signal_table(G.feedback_rows(G.valid_signals(signals)))
    items = spark.createDataFrame([(1, "interest", 0, "tea")], "id long, kind string, pos int, norm string")
    row = G.token_score_join(items, table, "id").first()
    assert (row.score, row.positive_hits, row.negative_hits) == (0.5, 0, 0)


def test_repeated_items_count_and_show_in_order(spark):
    table = spark.createDataFrame([("bio", "a", 5, 0, 0, 0, True), ("bio", "b", 9, 0, 0, 0, True)], "kind string, norm string, likes long, dislikes long, not_positive long, not_negative long, counted boolean")
    items = spark.createDataFrame([(1, "bio", p, n) for p, n in enumerate("bab" + "a" * 6)], "id long, kind string, pos int, norm string")
    row = G.token_score_join(items, table, "id").first()
    assert row.positive_hits == 9 and row.positive_signals == "b,a,b,a,a"


def test_folds_are_balanced_and_deterministic(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(210)], "id long, y int")
    first = M.stratified_folds(df, "id", "y").select("id", "y", "fold")
    sizes = [r.n for r in first.groupBy("y", "fold").agg(F.count("*").alias("n")).filter("y = 1").collect()]
    assert sizes == [6] * 5
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in M.stratified_folds(df, "id", "y").select("id", "y", "fold").collect()}


def test_single_class_is_refused(spark):
    df = spark.createDataFrame([(1.0, 1)] * 5, "f double, y int")
    with pytest.raises(ValueError):
        M.fit_head(df, ["f"], "y")


def test_small_data_gets_a_logistic_head(spark):
    df = spark.createDataFrame([(float(i), int(i > 9)) for i in range(20)], "f double, y int")
    model = M.fit_head(df, ["f"], "y")
    scores = [r.s for r in M.score(model, df.withColumn("id", F.col("f")), ["f"], "s").orderBy("id").collect()]
    assert scores == sorted(scores) and scores[0] < 0.5 < scores[-1]


def test_cap_keeps_the_side(spark):
    df = spark.createDataFrame([(p / 50,) for p in range(51)], "p double")
    rows = df.select("p", *[c.alias(n) for n, c in S.probability_safety(F.col("p"), F.lit(0.78)).items()]).collect()
    assert all((r.p >= 0.5) == (r.probability >= 0.5) for r in rows)
    assert max(r.probability for r in rows) == 0.78 and min(r.probability for r in rows) == 0.22


def test_review_state_folds_the_action_log(spark):
    log = [
        (1, 1, "apply", "LIKE"), (1, 2, "apply", "PASS"),
        (2, 1, "apply", "LIKE"), (2, 2, "undo", ""),
        (3, 1, "apply", "LIKE"), (3, 2, "undo", ""), (3, 3, "apply", "PASS"),
        (4, 1, "skip", ""), (5, 1, "apply", "LIKE"),
    ]
    actions = spark.createDataFrame(log, "review long, seq long, action string, decision string")
    trained = spark.createDataFrame([(5,)], "review long")
    got = {r.review: (r.review_status, r.decision) for r in Q.review_state(actions, "review", "seq", trained).collect()}
    assert got == {1: ("reviewed", "LIKE"), 2: ("pending", ""), 3: ("reviewed", "PASS"), 4: ("skipped", ""), 5: ("skipped", "")}


def test_sort_modes_put_available_assets_first(spark):
    df = spark.createDataFrame([(1, True, 0.9, "2024-01-01"), (2, False, 0.5, "2024-01-05"), (3, True, 0.5, "2024-01-02")], "id long, asset_available boolean, p double, created_at string").withColumn("review_priority", F.col("p"))
    order = {m: [r.id for r in Q.sort_reviews(df, m, "id").collect()] for m in ("priority", "uncertain", "recent")}
    assert order == {"priority": [1, 3, 2], "uncertain": [3, 1, 2], "recent": [3, 1, 2]}
