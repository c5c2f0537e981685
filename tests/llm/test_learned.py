"""Learned operators on held-out rows, and the parts of their models against definitions."""

import random
import string
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.llm import byte_cnn, queries, weak_toxicity
from tests.llm.helpers import ODD, folder, table

SYLLABLES = {"xx": ["ba", "ko", "lun", "ta", "wa"], "yy": ["ëri", "ção", "ñe", "lhu", "zi"], "zz": ["schr", "ung", "ver", "ich", "pf"]}


def sentence(lang: str, rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark, tmp_path_factory):
    rng = random.Random(3)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(400)]
    texts = [sentence(g, rng, rng.randint(3, 120)) for g in langs]
    texts += [*ODD, texts[0], texts[0]]
    langs += [None] * (len(ODD) + 1) + [langs[0]]
    return folder(table(spark, texts, langs), tmp_path_factory.mktemp("langs") / "t"), texts, langs


def test_op4_tells_held_out_languages(spark, languages):
    sf_dir, texts, langs = languages
    got = queries.op4_byte_cnn(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 60 and sum(held) >= 0.95 * len(held)
    for r in got:
        if not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in SYLLABLES
    same = {(r.lang_pred, r.score) for r in got if texts[r.doc_id] == texts[0]}
    assert len(same) == 1


def test_op4_without_labels_or_rows(spark, tmp_path):
    docs = table(spark, ["some text", None], [None, None])
    assert {r.lang_pred for r in queries.op4_byte_cnn(spark, folder(docs, tmp_path / "a")).collect()} == {"und"}
    assert queries.op4_byte_cnn(spark, folder(docs.limit(0), tmp_path / "b")).count() == 0


def test_op4_samples_distinct_texts_of_every_language(spark, monkeypatch):
    """Few texts with many copies: each language is learnt, and copies bring nothing to the driver."""
    rng = random.Random(21)
    texts = [(g, sentence(g, rng, 60)) for g in SYLLABLES for _ in range(6)]
    docs = table(spark, [x for _, x in texts], [g for g, _ in texts]).select("lang", "text").crossJoin(spark.range(200)).drop("id")
    seen = []
    monkeypatch.setattr(byte_cnn, "train", lambda pieces, labels, classes, net: seen.append((pieces, classes)) or byte_cnn.Weights(net, classes))
    sizes = []
    plain = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: sizes.append(len(out := plain(self))) or out)
    for per_class in (3, 6, 20):
        byte_cnn.fit(docs, F.lit(True), byte_cnn.Net(per_class=per_class))
    assert [classes for _, classes in seen] == [sorted(SYLLABLES)] * 3
    assert max(sizes) <= len(texts) * byte_cnn.Net().crops


def test_language_stage_drops_unlearnt_languages_and_gibberish(spark):
    rng = random.Random(31)
    learnt = [(g, sentence(g, rng, rng.randint(3, 120))) for g in ("xx", "yy") for _ in range(150)]
    clean = [(None, sentence(g, rng, 40)) for g in ("xx", "yy") for _ in range(20)]
    other = [(None, sentence("zz", rng, 40)) for _ in range(20)] + [(None, "Это русский текст, которого сеть не знает.")]
    gibberish = [(None, "".join(rng.choices(string.ascii_letters + "   ", k=200))) for _ in range(20)]
    rows = learnt + clean + other + gibberish
    docs = table(spark, [x for _, x in rows], [g for g, _ in rows])
    kept = corpus_pipeline.with_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(learnt) + len(clean)))


def test_windows_cover_every_byte_once():
    net = byte_cnn.Net(window=16, widths=(2, 3))
    one = byte_cnn.Classifier(byte_cnn.Weights(net, ["a"]))
    for n in (1, 2, 13, 14, 15, 16, 17, 28, 30, 31, 100):
        data = bytes(range(1, n + 1))
        windows, sizes = one.windows(data)
        assert sizes.sum() == n and (sizes > 0).all()
        starts = [int(w[0]) for w in windows]
        assert starts == [1 + 14 * k for k in range(len(starts))]
        seen = {int(x) for w in windows for x in w if x != byte_cnn.PAD}
        assert seen == set(data)


def test_pooling_equals_plain_convolution():
    net = byte_cnn.Net(window=12, widths=(2, 3), filters=2, embedding=3)
    w = byte_cnn.train([b"abcabcabcabc", b"xyzxyzxyzxyz"], np.array([0, 1]), ["a", "b"], byte_cnn.Net(window=12, widths=(2, 3), filters=2, embedding=3, steps=5))
    data = np.array([[97, 98, 99, 100, 97, 98, 99, 100, 97, 98, 99, 100]])
    top, _ = byte_cnn.pooled(w.p, byte_cnn.patches(w.p, data, 3))
    plain = []
    for f in range(4):
        kernel = w.p["filters"][:, f].reshape(net.embedding, 3)
        plain.append(max(sum(float(w.p["bytes"][data[0, i + k]] @ kernel[:, k]) for k in range(3)) for i in range(10)) + float(w.p["bias"][f]))
    assert np.allclose(top[0], plain, atol=1e-5)
    assert not w.p["filters"].reshape(3, 3, 4)[:, 2, :2].any()  # width two has no third byte


def test_op3_scores_held_out_rows(spark, tmp_path):
    rng = random.Random(9)
    bad = ["idiot", "scum", "grobnak", "grobnel", "grobnus", "grobnor", "grobnit"]
    texts, toxic = [], []
    for _ in range(600):
        words = sentence("xx", rng, rng.randint(20, 80)).split()
        toxic.append(int(rng.random() < 0.25))
        if toxic[-1]:
            for _ in range(rng.randint(2, 4)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
    texts += ODD
    labels = [(i, 0, t) for i, t in enumerate(toxic)] + [(3, 0, toxic[3]), (5_000, 1, 1), (len(toxic), 1, None), (None, 1, 1)]
    sf_dir = folder(table(spark, texts), tmp_path / "t", labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = queries.op3_weak_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id < len(toxic)]
    hits = sum(p and t for p, t in held)
    assert hits >= 0.9 * sum(t for _, t in held) and hits >= 0.9 * sum(p for p, _ in held)
    assert not any(r.predicted for r in got if r.doc_id >= len(toxic))


def test_op3_without_labels_or_rows(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, ["some text", None])
    assert [r.score for r in queries.op3_weak_toxicity(spark, folder(docs, tmp_path / "a", labels=none)).collect()] == [0.0, 0.0]
    assert queries.op3_weak_toxicity(spark, folder(docs.limit(0), tmp_path / "b", labels=none)).count() == 0


def test_label_model_finds_accuracies_and_a_copied_voter():
    rng = np.random.default_rng(2)
    y = rng.random(40_000) < 0.2
    rates = np.array([[0.05, 0.1, 0.02], [0.8, 0.6, 0.7]])
    votes = (rng.random((len(y), 3)) < rates[y.astype(int)]).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # the fourth says what the first says
    combos, at = np.unique(votes, axis=0, return_inverse=True)
    labelled = np.zeros((len(combos), 2))
    np.add.at(labelled, (at[:4_000], y[:4_000].astype(int)), 1)
    counts = np.bincount(at[4_000:], minlength=len(combos)).astype(float)
    model = weak_toxicity.fit_label_model(combos, counts, labelled, 100)
    assert abs(model.prior - 0.2) < 0.04 and np.abs(model.rate[:, :3] - rates).max() < 0.1
    assert model.correlation[0, 3] > 0.8 and model.weight[0] < 0.65 < model.weight[1]


def test_linear_fit_separates():
    rows = [([0], [1.0], 1.0, 1.0), ([1], [1.0], 0.0, 1.0), ([], [], 0.0, 5.0)] * 10
    w = weak_toxicity.fit_linear(rows, 2, 1e-3)
    assert w[0] + w[2] > 1 and w[1] + w[2] < -1 and w[2] < -1


def test_remainder_is_the_crc_of_the_id_as_text(spark):
    got = spark.range(50).select("id", byte_cnn.remainder("id", 4).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 4 for r in got)
    assert spark.sql("SELECT CAST(NULL AS LONG) AS id").select(byte_cnn.remainder("id", 4).alias("m")).first().m == 0
