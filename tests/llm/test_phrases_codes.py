"""Collocations against counting, vector codes against plain rounds, quality scores on held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.llm import fourier_quality, hilbert_codes, queries, quotient_phrases
from prefspark.llm.common import utf8
from tests.llm.helpers import ODD, folder, prose, table


def plain_collocations(rows, p: quotient_phrases.Params) -> set[tuple]:
    """(lang, text) rows to the result, by counting."""
    counts, n = {}, Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, p.longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        found = {}
        for phrase, a in f.items():
            if len(phrase) > 1 and a >= p.least:
                cuts = [(10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                found[phrase] = (score, a, f[phrase[:k]], f[phrase[k:]])
        inside = Counter()
        for phrase, (_, a, *_) in found.items():
            for k in range(2, len(phrase)):
                for i in range(len(phrase) - k + 1):
                    inside[phrase[i : i + k]] = max(inside[phrase[i : i + k]], a)
        kept = [(-s, -a, " ".join(x).encode(), " ".join(x), a, l, r, s) for x, (s, a, l, r) in found.items() if 100 * inside[x] < p.inside * a]
        out |= {(lang, i + 1, x[3], *x[4:7], n[lang], x[7]) for i, x in enumerate(sorted(kept)[: p.top])}
    return out


@pytest.mark.parametrize("params", [quotient_phrases.Params(), quotient_phrases.Params(longest=4, least=3, top=15, held=500, per_block=200)])
def test_op11_equals_counting(spark, params):
    rng = random.Random(5)
    texts = [prose(i % 3, 400, words=9) for i in range(12)] + [*ODD, "Aa bB, aa\tbb. AA bb" * 30, "x y\x0bx y", "Ñ ñ Ñ ñ " * 8, ("p q r " * 2000)]
    langs = [rng.choice(["en", "fr", None]) for _ in texts]
    docs = table(spark, texts, langs).withColumn("w1", F.lit("x")).withColumn("f", F.lit("x"))
    got = {tuple(r) for r in quotient_phrases.collocations(docs, params).collect()}
    want = plain_collocations(zip(langs, texts), params)
    assert got == want and len(want) > 20


def test_op11_of_nothing(spark):
    empty = table(spark, [None, "", "one two"], ["en", None, "fr"])
    assert quotient_phrases.collocations(empty).count() == 0
    assert quotient_phrases.collocations(empty.limit(0)).count() == 0


def test_filters_lose_nothing():
    rng = np.random.default_rng(3)
    for size, bits, block_bits in ((2, 20, 5), (3, 41, 5), (4, 63, 7)):
        mix = quotient_phrases.Mix(size, bits)
        ids = [rng.integers(0, 1 << bits, 3000).astype(np.uint64) for _ in range(size)]
        assert all((a == b).all() for a, b in zip(mix.back(mix.forward(ids)), ids))
        counts = rng.integers(1, 600, 3000)
        counts[:3] = [254, 255, 1 << 40]
        lanes = mix.forward(ids)
        want = Counter(dict(zip(zip(*[x.tolist() for x in ids]), counts.tolist())))
        order = quotient_phrases.in_order(lanes)
        one = quotient_phrases.QuotientFilters(mix, block_bits, [lane[order] for lane in lanes], counts[order])
        blocks, columns = one.to_arrow()
        assert blocks.tolist() == sorted(set((lanes[0] >> np.uint64(bits - block_bits)).tolist()))
        half = len(blocks) // 2
        again = [quotient_phrases.QuotientFilters.from_arrow(mix, block_bits, blocks[k], [c.slice(k.start, k.stop - k.start) for c in columns])
                 for k in (slice(0, half), slice(half, len(blocks)))]
        merged = quotient_phrases.QuotientFilters.merged([*again, one])
        keys, n = merged.items()
        assert dict(zip(zip(*[k.tolist() for k in keys]), (n // 2).tolist())) == want
        first = tuple(int(x[0]) for x in ids)
        assert merged.count(first) == 2 * want[first] and merged.count((*first[:-1], first[-1] ^ 1)) == 0


def test_ids_of_words_differ_and_agree_with_the_column(spark):
    words = ["a", "ab", "ñandú", "日本", "x" * 5000]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for ids in (quotient_phrases.distinct_ids(frame), quotient_phrases.Ids(40, "7:")):
        got = {r.word: r.id for r in frame.select("word", ids.column(F.col("word")).alias("id")).collect()}
        assert [got[w] for w in words] == ids.of(words).tolist() and len(set(got.values())) == len(words)


# --- vector codes


def plain_codes(rows, p: hilbert_codes.Params):
    """(id, vector, label) rows to {id: code, error, label_error} and the listing of the codebooks."""
    kept = [(i, [int(np.floor(4096 * np.float64(x))) for x in v], g) for i, v, g in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in kept])
    width = x.shape[1] // p.parts
    parts = [x[:, k * width : (k + 1) * width] for k in range(p.parts)]
    books = [part[: p.entries].copy() for part in parts]
    assign = lambda part, book: ((part[:, None] - book[None]) ** 2).sum(axis=2)
    for _ in range(p.rounds):
        for part, book in zip(parts, books):
            at = assign(part, book).argmin(axis=1)
            for e in range(len(book)):
                if (at == e).any():
                    book[e] = part[at == e].sum(axis=0) // (at == e).sum()
    d = [assign(part, book) for part, book in zip(parts, books)]
    error = sum(one.min(axis=1) for one in d)
    total = Counter()
    for (_, _, g), e in zip(kept, error):
        total[g] += int(e)
    out = [(r[0], "".join(f"{one[i].argmin():02x}" for one in d), int(error[i]), total[r[2]]) for i, r in enumerate(kept)]
    return out, ",".join(str(v) for book in books for v in book.ravel())


@pytest.mark.parametrize("n,width", [(600, 16), (9, 8)])
def test_op12_equals_plain_rounds(spark, tmp_path, n, width):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(7, width))
    rows = [(i, (centres[i % 7] + rng.normal(scale=0.1, size=width)).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in range(0, 3 * n, 3)]
    rows += [(1, None, 1), (4, [None] * width, 1), (7, [float("nan")] * width, 0), (10, [float("inf")] * width, 0), (13, [], 1)]
    rows += [(3, rows[5][1], 0), (3, rows[5][1], 0), (None, rows[2][1], None), *[(10_000 + i, rows[1][1], 1) for i in range(n // 2)]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit("x")).withColumn("code", F.lit("x"))
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_hilbert_codes(spark, str(tmp_path)).collect()
    want, listing = plain_codes(rows, hilbert_codes.Params())
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r)[:4] for r in got], key=order) == sorted(want, key=order)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(listing.encode()).hexdigest()}


def test_op12_of_nothing_and_of_lengths_that_do_not_fit(spark, tmp_path):
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert hilbert_codes.coded(none).count() == 0 and hilbert_codes.coded(none.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 9, 1)], none.schema)
    with pytest.raises(ValueError):
        hilbert_codes.coded(odd)
    mixed = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1), (3, [0.5] * 8, None)], none.schema)
    coded, books = hilbert_codes.compress(mixed)
    assert {r.vec_id: r.error for r in coded.collect()} == {1: 0, 3: 0}
    codes = {r.vec_id: r.code for r in coded.collect()}
    assert hilbert_codes.decode(codes[3], books).tolist() == [0.5] * 8


def test_hilbert_places_are_a_walk():
    for d, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        points = np.array(np.meshgrid(*[np.arange(side)] * d)).reshape(d, -1).T
        place = hilbert_codes.hilbert(points, bits)
        assert sorted(place.tolist()) == list(range(side**d))
        walk = points[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(1)
    for _ in range(200):
        v = rng.integers(-50, 50, (20, 3)) // rng.integers(1, 20)
        entries = rng.integers(-50, 50, (8, 3)) // rng.integers(1, 10)
        may = hilbert_codes.shortlist(v.min(axis=0)[None], v.max(axis=0)[None], entries)[0]
        at, distance = hilbert_codes.nearest(v, entries, np.flatnonzero(may))
        d = ((v[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


# --- quality


def bad(text: str, kind: int) -> str:
    return [text.upper(), " ".join(w + "###" for w in text.split()), "same words " * 60][kind % 3]


def test_op13_tells_held_out_quality(spark, tmp_path):
    texts = [prose(i, 60 + i % 90) if i % 3 else bad(prose(i, 60), i // 3) for i in range(700)] + [*ODD, "x " * 60_000]
    docs = table(spark, texts)
    docs = docs.union(docs.where("doc_id < 20"))
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0), 0) for i in range(700)] + [(5, None, 1), (6, 1, 0), (6, 0, 0), (None, 1, 1), (8, 7, 0)], "doc_id long, quality int, toxic int"
    )
    got = queries.op13_fourier_quality(spark, folder(docs, tmp_path / "a", labels=labels)).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(len(texts)), *range(20)])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r.predicted == int(r.doc_id % 3 > 0) for r in got if r.held_out and r.doc_id < 700]
    assert len(held) > 100 and sum(held) >= 0.97 * len(held)
    assert len({r.score for r in got if not (texts[r.doc_id] or "")}) == 1


def test_op13_without_labels_rows_or_with_one_class(spark, tmp_path):
    docs = table(spark, ["some text", None, "other text"])
    schema = "doc_id long, quality int, toxic int"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(i, 1, 0) for i in range(3)], schema)
    assert {r.score for r in queries.op13_fourier_quality(spark, folder(docs, tmp_path / "a", labels=none)).collect()} == {0.5}
    assert {round(r.score, 6) for r in queries.op13_fourier_quality(spark, folder(docs, tmp_path / "b", labels=one)).collect()} == {1.0}
    assert queries.op13_fourier_quality(spark, folder(docs.limit(0), tmp_path / "c", labels=one)).count() == 0


def test_statistics_of_a_text():
    x = fourier_quality.statistics(utf8(__import__("pyarrow").array(["Ab cd\nAb cd!! 12 ##", None, "é"])), fourier_quality.classes())
    one = dict(zip(fourier_quality.STATISTICS, x[0]))
    assert one["log_words"] == pytest.approx(np.log(7)) and one["distinct_words"] == pytest.approx(5 / 6) and one["upper"] == pytest.approx(2 / 8)
    assert one["wordless"] == pytest.approx(2 / 6) and one["symbols"] == pytest.approx(2 / 19) and one["log_lines"] == pytest.approx(np.log(3))
    assert not x[1].any() and x[2][fourier_quality.STATISTICS.index("above_ascii")] == 1


def test_pooling_is_the_best_rising_fit():
    rng = np.random.default_rng(2)
    good, count = rng.integers(0, 5, 12), np.full(12, 5)
    places, values = fourier_quality.pooled(np.arange(12.0), good, count)
    fit = np.interp(np.arange(12.0), places, values)
    assert (np.diff(values) >= 0).all()
    # the min-max formula of isotonic regression
    mean = lambda a, b: Fraction(int(good[a : b + 1].sum()), int(count[a : b + 1].sum()))
    want = [float(max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1))) for i in range(12)]
    assert fit == pytest.approx(want)


def test_normal_equations_equal_a_single_pass(spark):
    rng = np.random.default_rng(4)
    d = len(fourier_quality.STATISTICS)
    x, y, fold = rng.normal(size=(200, d)).astype(np.float32), rng.integers(0, 2, 200), rng.integers(0, 4, 200)
    rows = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold)], "stats array<float>, label int, fold int").repartition(5)
    features = fourier_quality.Features(np.zeros(d), np.ones(d), fourier_quality.Params(features=16))
    products, targets = fourier_quality.normal_equations(rows, features, 4)
    z = features.of(x.astype(float))
    for f in range(4):
        assert products[f] == pytest.approx(z[fold == f].T @ z[fold == f]) and targets[f] == pytest.approx(z[fold == f].T @ y[fold == f])
