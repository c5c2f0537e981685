"""Operators that compare rows: shards, near-duplicates, benchmark copies, and the pipeline, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prefspark.llm import bbit_minhash, byte_shards, queries, seed_align
from prefspark.llm.components import connected_components
from tests.llm.helpers import ODD, components, edited, folder, prose, shingles, table


def test_op5_shards(spark, tmp_path):
    rng = random.Random(4)
    texts = [*ODD, *[prose(i, rng.randint(1, 60)) for i in range(500)], *["copy " * 20] * 300]
    got = queries.op5_byte_shards(spark, folder(table(spark, texts), tmp_path / "t")).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    target, largest = sum(sizes.values()) / 24, max(r.size for r in got)
    assert all(abs(sizes[k] - target) <= largest + 0.02 * target for k in range(24) if largest < target or sizes[k])


def test_small_groups_stay_whole_across_partitions():
    class Row(tuple):
        part, rows, bytes, first_group, last_group, first_bytes, last_bytes = (property(lambda s, i=i: s[i]) for i in range(7))

    totals = [Row((0, 2, 20, "a", "b", 10, 10)), Row((1, 1, 10, "b", "b", 10, 10)), Row((2, 2, 20, "b", "c", 10, 10))]
    at, total = byte_shards.offsets(totals)
    assert total == 50 and at == {0: (0, 0, 20), 1: (20, 10, 10), 2: (30, 20, 0)}
    ten = lambda n: np.full(n, 10, np.int64)
    cuts = [
        byte_shards.cut(ten(2), np.array([0, 1]), at[0], total, 2, 2.0),
        byte_shards.cut(ten(1), np.array([0]), at[1], total, 2, 2.0),
        byte_shards.cut(ten(2), np.array([0, 1]), at[2], total, 2, 2.0),
    ]
    assert len({cuts[0][1], cuts[1][0], cuts[2][0]}) == 1
    assert byte_shards.cut(ten(1), np.array([0]), at[1], total, 50, 0.01)[0] == 25  # too large a group: by its rows


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1_000 + i, 1_001 + i) for i in range(40)]
    links += [(2_000, 2_000 + i) for i in range(1, 60)] + [(5, 5), (None, 7), links[0]]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def family(base: int, n: int, rate: float) -> list[str]:
    """Edited copies of one text, many of them near the threshold to each other."""
    return [edited(prose(base, 120), base * 100 + k, rate) for k in range(n)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, tmp_path, size):
    texts = [*ODD, *[prose(i, 150) for i in range(10)], prose(0, 150), prose(0, 150).upper()]
    texts += family(50, 25, 0.03) + family(51, 25, 0.08) + family(52, 10, 0.01) + ["one two", "one two three", ""]
    docs = table(spark, texts)
    # a small block makes families meet in several pairs of blocks
    got = {r.doc_id: r for r in bbit_minhash.find_components(docs, bbit_minhash.Params(shingle=size, block=500)).collect()}
    sets = {i: shingles(t, size) for i, t in enumerate(texts)}
    want = components(sets)
    assert len(got) == len(texts) and len(set(want.values())) < len(texts)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i), i


def test_op7_ids_that_repeat_or_are_null(spark, tmp_path):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "x y z w"), (9, "x y z w"), (8, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    got = sorted(map(tuple, queries.op7_bbit_minhash(spark, folder(docs, tmp_path / "t")).collect()), key=str)
    assert got == sorted([(7, 3, 7, True), (7, 3, 7, True), (9, 3, 7, False), (8, 3, 7, False), (None, 3, None, True)], key=str)
    assert queries.op7_bbit_minhash(spark, folder(docs.limit(0), tmp_path / "e")).count() == 0


def test_short_texts_with_one_word_more_are_linked(spark):
    texts = [f"a{k} b{k} c{k} d{k} e{k}" for k in range(2_000)]
    docs = table(spark, texts + [f"{x} f" for x in texts], extra=False)
    assert docs.count() == 4_000
    got = {r.doc_id: r.component_id for r in bbit_minhash.find_components(docs).collect()}
    assert [i for i in range(4_000) if got[i] != i % 2_000] == []


def test_blocks_link_short_sets():
    signer, rng = bbit_minhash.Signer(bbit_minhash.Params()), np.random.default_rng(4)
    lost = 0
    for _ in range(2_000):
        x = np.sort(rng.integers(0, 1 << 63, 5).astype(np.uint64) * np.uint64(2))
        lost += bbit_minhash._links([(0, 0, 0, x[:4]), (1, 1, 0, x)], True, signer).num_rows != 1
    assert lost == 0


def test_estimate_is_near_the_similarity():
    signer = bbit_minhash.Signer(bbit_minhash.Params())
    rng = np.random.default_rng(1)
    for shared in (0, 300, 800, 1_000):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) for n in (shared, 1_000 - shared, 1_000 - shared))
        s, t = (signer.packed(signer.minima(np.concatenate([both, x]))).view(np.uint64) for x in (a, b))
        unequal = int(np.bitwise_count((s[:4] ^ t[:4]) | (s[4:] ^ t[4:])).sum())
        assert abs((1 - unequal / 252 - 0.25) / 0.75 - shared / (2_000 - shared)) < 0.14


def words(text: str) -> list[str]:
    return [x for x in (re.sub(r"[\W_]+", "", w.lower()) for w in (text or "").split()) if x]


def best_alignment(item: list[str], text: list[str]) -> int:
    """Smith-Waterman over the whole text, cell by cell: match 2, mismatch and gap -1."""
    last, best = [0] * (len(text) + 1), 0
    for a in item:
        row = [0]
        for j, b in enumerate(text, 1):
            row.append(max(0, last[j - 1] + (2 if a == b else -1), last[j] - 1, row[j - 1] - 1))
        last, best = row, max(best, *row)
    return best


@pytest.fixture(scope="module")
def leaks(spark, tmp_path_factory):
    rng = random.Random(6)
    items = [(k, prose(900 + k, 40)) for k in range(12)] + [(100, None), (101, ""), (102, "two words"), (103, prose(903, 40))]
    texts = [*ODD]
    for k, item in items[:12]:
        for rate in (0.0, 0.1, 0.2):
            host = prose(k, 200).split(" ")
            at = rng.randrange(len(host))
            texts.append(" ".join(host[:at] + edited(item, k, rate).split(" ") + host[at:]))
        texts.append(prose(300 + k, 200))
    texts += [f"{prose(1, 50)} {items[0][1].upper()}! {prose(2, 50)}"] * 40
    docs = table(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return folder(docs, tmp_path_factory.mktemp("leaks") / "t", benchmark=benchmark), texts, items


def test_op10_equals_full_alignment(spark, leaks):
    sf_dir, texts, items = leaks
    got = {(r.doc_id, r.item_id): r.score for r in queries.op10_seed_align(spark, sf_dir).collect()}
    want = {}
    for i, text in enumerate(texts):
        for k, item in items:
            own = words(item)
            if len(own) >= 3:
                share = best_alignment(own, words(text)) / (2 * len(own))
                if share >= 0.4:
                    want[i, k] = share
            elif own and any(words(text)[j : j + len(own)] == own for j in range(len(words(text)))):
                want[i, k] = 1.0
    assert len(want) > 60 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_of_a_benchmark_find_the_same(spark, leaks):
    sf_dir, _, _ = leaks
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = {(r.doc_id, r.item_id) for r in seed_align.contaminated(docs, benchmark).collect()}
    parts = {(r.doc_id, r.item_id) for r in seed_align.contaminated(docs, benchmark, seed_align.Params(block_bytes=1_500)).collect()}
    assert parts == whole
    assert seed_align.contaminated(docs, benchmark.limit(0)).count() == 0
    assert seed_align.contaminated(docs.limit(0), benchmark).count() == 0


def test_pipeline_equals_its_steps(spark, leaks, tmp_path):
    sf_dir, texts, items = leaks
    secret = prose(77, 80) + " token = " + "0123456789abcdef" * 3
    more = [prose(80, 120), prose(80, 120) + " end", secret, "12 34"]
    docs = table(spark, [*texts, *more])
    here = folder(docs, tmp_path / "t", benchmark=spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    all_texts, kept = [*texts, *more], {}
    for i, t in enumerate(all_texts):
        if any(c.isalpha() for c in t or ""):
            kept[i] = t
    group = components({i: shingles(t, 5) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if group[i] == i}
    kept = {i: t for i, t in kept.items() if not any(len(words(x)) >= 3 and best_alignment(words(x), words(t)) >= 0.8 * len(words(x)) for _, x in items)}
    masked = {i: t.replace("token = " + "0123456789abcdef" * 3, "[SECRET]") for i, t in kept.items()}

    from prefspark.llm.common import tokenizer_path
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, here).collect()}
    assert sorted(got) == sorted(masked)
    assert len(texts) + 2 in got and len(texts) + 1 not in got
    for i, t in masked.items():
        assert list(got[i].token_ids) == plain.encode(t) and got[i].n_chars == len(t), repr(t)[:60]


def test_stages_keep_columns_and_stand_empty_tables(spark, leaks):
    sf_dir, _, _ = leaks
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        if name != "token_ids":
            assert out.columns == docs.columns


def plain_alignment(item, passage, p):
    """The best local alignment by the whole table, and a walk back through it."""
    score = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            both = score[i - 1, j - 1] + (p.match if item[i - 1] == passage[j - 1] else p.mismatch)
            score[i, j] = max(0, both, score[i - 1, j] + p.gap, score[i, j - 1] + p.gap)
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    best, last, agree = int(score[i, j]), int(j) - 1, 0
    while score[i, j] > 0:
        same = item[i - 1] == passage[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (p.match if same else p.mismatch):
            agree, i, j = agree + bool(same), i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + p.gap:
            i -= 1
        else:
            j -= 1
    return best, agree, int(j), last


def test_alignment_in_two_rows_equals_the_whole_table():
    rng = np.random.default_rng(8)
    p = seed_align.Params()
    for _ in range(300):
        item, passage = (rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert seed_align.align(item, passage, p)[0] == plain_alignment(item, passage, p)[0]
        got, want = seed_align.align(item, passage, p), plain_alignment(item, passage, p)
        assert got == want


def test_op10_finds_short_and_very_long_items_and_rows_without_id(spark):
    long = prose(1, 3000)
    texts = ["before Zyx after", "nothing here", "a qua, qui b", "a qui qua b", prose(2, 50) + " " + long + " " + prose(3, 50), None, ""]
    docs = table(spark, texts)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id"))).withColumn("kept0", F.lit("x")).withColumn("hits", F.lit("x"))
    items = spark.createDataFrame([(1, "zyx"), (2, "Qua qui!"), (3, long), (4, None), (5, "..."), (6, "absent")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in seed_align.contaminated(docs, items).collect()}
    assert got == {(0, 1, 1.0, 1, 1), (2, 2, 1.0, 1, 2), (None, 3, 1.0, 50, 3049)}
    left = seed_align.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 5, 6]


def test_components_of_large_ids(spark):
    """Ids may be hashes: neither their sums nor their order overflow."""
    big = 1 << 62
    links = [(big, big + 1), (big + 1, big + 2), (-big, -big - 5), (-big - 5, 7), (big + 9, big + 9), (None, 3), (4, None)]
    found = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b")
    assert {tuple(r) for r in found.collect()} == {(big, big), (big + 1, big), (big + 2, big), (-big, -big - 5), (-big - 5, -big - 5), (7, -big - 5)}
    texts = [prose(1, 80), prose(1, 80), prose(2, 80), prose(3, 80) + " one", prose(3, 80) + " two"]
    docs = table(spark, texts, extra=False).withColumn("doc_id", F.lit(big) + F.col("doc_id"))
    got = {r.doc_id - big: r.component_id - big for r in bbit_minhash.find_components(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
