"""Tables with a pointer, caches, queues and streams: what they keep over runs, restarts and replays."""

import random

import pytest
from pyspark.sql import functions as F

from prefspark.operators import bucketed as B
from prefspark.operators import review_queue as Q
from prefspark.sources import feature_cache, records, versioned
from prefspark.streaming import jobs, rules, runner


def test_versions_count_once_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    one = spark.createDataFrame([(1,)], "x int")
    assert versioned.current(spark, path) is None and versioned.read(spark, path, one.schema).count() == 0
    assert versioned.write(one, path, 3)
    one.union(one).write.parquet(versioned.folder(path, 4))  # written but never committed
    assert versioned.current(spark, path) == 3 and versioned.read(spark, path, one.schema).count() == 1
    assert not versioned.write(one.union(one).union(one), path, 3) and versioned.read(spark, path, one.schema).count() == 1
    versioned.write(one.union(one), path, 4)
    assert versioned.read(spark, path, one.schema).count() == 2 and versioned.read(spark, path, one.schema, newest=False).count() == 3
    versioned.drop_before(spark, path, 4)
    assert versioned.versions(spark, path) == [4]


def test_cuts_of_repeated_values(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(-5, 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v long")
    values = sorted(v for _, v in rows)
    assert [B.kth_value(df, "v", k) for k in (1, 50, 123, 200, 999)] == [values[k - 1] for k in (1, 50, 123, 200, 200)]
    for k in (0, 1, 77, 200, 300):
        got = {r.id for r in B.smallest(df, "v", "id", k).collect()}
        assert got == {i for _, i in sorted((v, i) for i, v in rows)[:k]}


def test_feature_cache_computes_what_is_new(spark, tmp_path):
    asked = []

    def compute(rows):
        return rows.select("content_hash", F.array(F.length("text").cast("double"), F.col("n").cast("double")).alias("features"))

    def run(rows, most=50_000):
        df = spark.createDataFrame(rows, "id long, text string, n int")
        found, stats = feature_cache.cached_features(df, ["text", "n"], compute, f"{tmp_path}/cache", most)
        asked.append(stats["computed"])
        assert {r.id: r.features for r in found.collect()} == {i: [None if t is None else float(len(t)), None if n is None else float(n)] for i, t, n in rows}
        return stats

    rows = [(i, f"t{i % 7}", i % 3) for i in range(21)] + [(50, None, None), (51, "", None), (52, None, None)]
    run(rows)
    run(rows)
    run([(1, "changed", 1), *rows[2:]])
    assert asked == [23, 0, 1]
    # the limit pushes out what was used longest ago
    assert run([(1, "a", 1), (2, "b", 1)], most=4)["kept"] == 4
    assert run([(1, "a", 1), (2, "b", 1)], most=4)["computed"] == 0 and run(rows, most=4)["computed"] >= 21


def sequential_admission(incoming, recent, queued, cap):
    """Rows one after another, as (order, key, other key)."""
    seen, waiting, out = set(queued), len(queued), {}
    for order, key, also in sorted(incoming):
        if key in recent and key is not None or also in recent and also is not None:
            out[order] = "recent"
        elif key is not None and key in seen:
            out[order] = "duplicate"
        else:
            seen.add(key)
            waiting += 1
            out[order] = "added" if cap <= 0 or waiting <= cap else "dropped"
    return out


@pytest.mark.parametrize("cap", [0, 3, 12, 1000])
def test_admission_equals_one_after_another(spark, cap):
    rng = random.Random(cap)
    items = [(i, rng.choice(["", "7", "8", None, " 9 "]), rng.choice(["", None, "aa"]), rng.choice(["Ana", "ÂNA ", "", None, "Bo"]), rng.choice([0, 20, 21])) for i in range(80)]
    schema = "order long, item string, hash string, name string, age int"
    df = spark.createDataFrame(items, schema)
    df = df.withColumn("key", Q.queue_key(*(F.col(c) for c in ("item", "hash", "name", "age")))).withColumn("also", Q.name_age_key(F.col("name"), F.col("age")))
    keys = {r.order: (r.key, r.also) for r in df.collect()}
    plain = {i: (f"id:{item.strip()}" if (item or "").strip() else f"hash:{h}" if h else None) for i, item, h, _, _ in items}
    names = {i: f"name:{ {'Ana': 'ana', 'ÂNA ': 'ana', 'Bo': 'bo'}[n]}:{age}" if n and age else None for i, _, _, n, age in items}
    assert keys == {i: (plain[i] or names[i], names[i]) for i in plain}
    recent = spark.createDataFrame([("id:8", 100), ("name:bo:20", 90), ("id:7", 10)], "key string, at long")
    queued = spark.createDataFrame([("name:ana:21",), ("id:x",), (None,)], "key string")
    got = {r.order: r.outcome for r in Q.admit(df, "order", "key", "also", recent, F.lit(50), queued, cap).collect()}
    # a queued row without a key takes a place too
    want = sequential_admission([(i, *keys[i]) for i in keys], {"id:8", "name:bo:20"}, {"name:ana:21", "id:x", "keyless"}, cap)
    assert got == want
    stay = Q.make_room(df, "order", cap)
    assert {r.order for r in stay.collect()} == set(sorted(keys)[-cap:] if cap else keys)


def test_new_lines_are_read_once(spark, tmp_path):
    logs, state, schema = tmp_path / "logs", str(tmp_path / "state"), "a int"
    logs.mkdir()
    (logs / "x.jsonl").write_text('{"a":1}\n\n{"a":\n[1]\n"s"\n{"a":2}\n')
    read = lambda: sorted((r.line_no, r.a) for r in records.read_new_lines(spark, str(logs), state, schema).collect())
    assert read() == [(1, 1), (6, 2)] and read() == []
    with (logs / "x.jsonl").open("a") as f:
        f.write('  {"a":3,"b":[1]} \nnull\n')
    (logs / "y.jsonl").write_text('{"a":9}\n')
    assert read() == [(1, 9), (7, 3)]
    faults = {(r.file.rsplit("/", 1)[1], r.line_no): r.fault for r in records.rejected_lines(spark, state).collect()}
    assert faults == {("x.jsonl", 2): "blank", ("x.jsonl", 3): "broken", ("x.jsonl", 4): "not an object", ("x.jsonl", 5): "not an object", ("x.jsonl", 8): "not an object"}


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = records.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(lines) == 5000 and all(int(r.value.split()[1]) == r.line_no for r in lines)


def test_a_row_is_enqueued_once_also_when_a_batch_is_replayed(spark, tmp_path):
    schema = "id long, h string, p double"
    score = lambda rows: rows.select("id", "h", F.lit(0.5).alias("p"))
    batch = lambda *rows: spark.createDataFrame(rows, "id long, h string")
    queue = str(tmp_path / "queue")
    put = lambda n, *rows: jobs.enqueue(batch(*rows), queue, n, "h", "id", score, schema)
    put(0, (1, "a"), (2, "a"), (3, "b"), (4, None))
    put(1, (5, "b"), (6, "c"))
    put(1, (5, "b"), (6, "c"))  # replayed after its commit
    (batch((9, "z")).write.parquet(versioned.folder(queue, 2)))  # a try that failed before its commit
    put(2, (7, "c"), (8, "d"))
    assert sorted((r.id, r.h) for r in versioned.read(spark, queue, schema, newest=False).collect()) == [(1, "a"), (3, "b"), (6, "c"), (8, "d")]


def test_a_failed_fit_leaves_the_model_in_use(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    labels = spark.createDataFrame([(1.0, 1)], "x double, label int")
    fit = lambda df: Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol=f"v{df.count()}")]).fit(df)

    def broken(df):
        raise ValueError("one class")

    models = str(tmp_path / "models")
    assert jobs.current_model(spark, models) is None
    assert not jobs.retrain(labels, models, 0, broken) and jobs.current_model(spark, models) is None
    assert jobs.retrain(labels, models, 1, fit) and not jobs.retrain(labels, models, 2, broken)
    assert versioned.current(spark, models) == 1 and jobs.current_model(spark, models).stages[0].getOutputCol() == "v1"
    assert jobs.retrain(labels.union(labels), models, 3, fit) and jobs.current_model(spark, models).stages[0].getOutputCol() == "v2"


def timed(spark, rows):
    return spark.createDataFrame([(i, k, t * 1_000_000) for i, k, t in rows], "id long, key string, us long").withColumn("at", F.timestamp_micros("us"))


def test_rows_wait_for_the_watermark_and_too_late_ones_are_left_out(spark, tmp_path):
    """Rows come in any order within the delay; state goes on after a restart; what is later than the delay is dropped."""
    parts = [[(1, "a", 1000), (2, "a", 1030), (3, "b", 1010)], [(4, "a", 1015), (5, "b", 1200)], [(6, "a", 1100), (7, "a", 1230)], [(8, None, 9000)]]
    rule = lambda folder: rules.stream_dedupe_ttl(
        runner.file_stream(spark, folder, timed(spark, parts[0]).schema), ["key"], "us", "id", 20_000_000, event_time="at", delay="60 seconds"
    )
    out = runner.drain_parts(rule, [timed(spark, p) for p in parts], str(tmp_path / "s"))
    got = {r.id: r.is_duplicate for r in out.filter("key IS NOT NULL").collect()}
    # 4 came late, between 1 and 2; 6 is behind the watermark of 1140
    assert got == {1: False, 4: True, 2: True, 3: False, 5: False, 7: False}


def test_sessions_are_told_open_and_closed(spark, tmp_path):
    rows = [[(1, "a", 1000), (2, "a", 1050), (3, "b", 1010)], [(4, "a", 1030), (5, "a", 1400)], [(6, "b", 1420), (7, "a", 1390)]]
    flags = {"final": F.lit("LIKE"), "super": F.lit(False), "model": F.lit("PASS"), "prompted": F.lit(True), "value": F.col("id").cast("double")}
    frames = [timed(spark, r).withColumns(flags) for r in rows]
    rule = lambda folder: rules.stream_session_stats(runner.file_stream(spark, folder, frames[0].schema), "key", "us", "at", 100_000_000, "40 seconds", "value")
    log = runner.drain_parts(rule, frames, str(tmp_path / "s"))
    got = {(r.key, r.first // 1_000_000, r.last // 1_000_000): (r.total, r.closed, r.like_score) for r in rules.sessions_of(log, "key").collect()}
    assert got == {("a", 1000, 1050): (3, True, 2.3333), ("a", 1390, 1400): (2, False, 6.0), ("b", 1010, 1010): (1, True, 3.0), ("b", 1420, 1420): (1, False, 6.0)}


def test_keys_share_calls_and_large_ids_survive(spark, tmp_path):
    """A processor is called per group of keys, however many keys there are; ids beyond 2^53 stand beside missing ones."""
    big = 1 << 60
    rows = [(big + i, f"k{i % 700}", 1000 + i // 700) for i in range(2100)]
    frame = timed(spark, rows)
    groups = rules.grouped(frame, ["key"], ["us", "id"]).select(rules.GROUP).distinct().count()
    assert groups <= rules.GROUPS < 700
    rule = lambda folder: rules.stream_dedupe_ttl(
        runner.file_stream(spark, folder, frame.schema), ["key"], "us", "id", 20_000_000, event_time="at", delay="60 seconds"
    )
    out = runner.drain_parts(rule, [frame, timed(spark, [(None, f"k{i}", 9000) for i in range(700)])], str(tmp_path / "s"))
    got = {r.id: r.is_duplicate for r in out.filter("id IS NOT NULL").collect()}
    assert got == {i: i - big >= 700 for i, _, _ in rows}


def test_rows_of_one_instant_count_for_each_other():
    """As in a range window: six rows at one instant alert, all of them are told, and an earlier alert's state goes on."""
    alert = rules.ThresholdAlert("us", "id", 100, 6, 1000)
    alert.keys, alert.columns = {"rule": "string"}, {"us": "bigint", "id": "bigint"}
    out, state = alert.walk([("r", 50, 1), *[("r", 60, i) for i in range(2, 8)], ("r", 70, 9)], None)
    assert out == [("r", 60, i) for i in range(2, 8)] and state == ([60] * 5 + [70], 60)
    assert alert.walk([("r", 1060, i) for i in range(10, 16)], state)[0] == [("r", 1060, i) for i in range(10, 16)]
