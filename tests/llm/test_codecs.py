"""Subword ids against the libraries themselves, in memory and through ORC files."""

import hashlib
import zlib

import numpy as np
import pytest

from prefspark.llm import orc_tokens, piece_codec, queries
from prefspark.llm.common import tokenizer_path
from tests.llm.helpers import ODD, folder, prose, table

TEXTS = [*ODD, *[prose(i, 40) for i in range(20)], prose(3, 40), "\n".join(prose(i, 400) for i in range(5))]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    return folder(table(spark, TEXTS), tmp_path_factory.mktemp("codecs") / "t")


def test_op1_equals_the_library(spark, sf_dir):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.op1_piece_codec(spark, sf_dir).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = plain.encode(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), digest), repr(text)[:60]
        assert got[i].decoded_sha256 == hashlib.sha256(plain.decode(ids).encode()).hexdigest()


def test_stored_ids_decode_to_what_the_encoder_saw(spark, sf_dir):
    path = tokenizer_path("piece_bpe_32k.model")
    coded = piece_codec.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    again = {r.doc_id: r.decoded for r in piece_codec.decode_ids(coded.drop("decoded"), path).collect()}
    assert again == {r.doc_id: r.decoded for r in coded.collect()}


def test_pieces_that_cross_markers_are_refused():
    piece_codec.check_markers(["▁", "▁▁", "▁the", "ing"])
    with pytest.raises(ValueError):
        piece_codec.check_markers(["▁", "of▁the"])
    with pytest.raises(ValueError):
        piece_codec.check_markers(["▁the"])


def test_a_full_table_starts_anew_without_changing_ids():
    from pathlib import Path

    import pyarrow as pa

    texts = pa.array([prose(i, 60) for i in range(6)], pa.large_string())
    model = Path(tokenizer_path("piece_bpe_32k.model")).read_bytes()
    whole, small = piece_codec.PieceTable(model), piece_codec.PieceTable(model)
    small.words.most = 100
    for k in range(len(texts)):
        assert whole.encode(texts.slice(k, 1)) == small.encode(texts.slice(k, 1))


def test_op8_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = queries.op8_orc_tokens(spark, sf_dir).orderBy("doc_id").collect()
    start = 0
    for row, text in zip(got, TEXTS, strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc), repr(text)[:60]
        start += len(ids)


def test_lookup_and_repeated_or_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a"), (2, "c"), (2, "b")], "doc_id long, text string")
    path = f"{tmp_path}/orc"
    orc_tokens.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), files=3)
    rows = orc_tokens.read_tokens(spark, path).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.start) for r in rows) == [(False, 0, 0), (True, 1, 2), (True, 2, 4), (True, 2, 6), (True, 2, 8)]
    assert orc_tokens.lookup(spark, path, [1]).count() == 1


def test_empty_tables(spark, tmp_path):
    empty = folder(table(spark, ["x"]).limit(0), tmp_path / "t")
    assert queries.op1_piece_codec(spark, empty).count() == 0
    assert queries.op8_orc_tokens(spark, empty).count() == 0


def test_op8_table_equals_the_library_on_every_letter_and_odd_text():
    """Every kind of character before every sign, and random mixtures of what normalizers change."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from prefspark.llm.common import model_bytes, utf8

    path = tokenizer_path("word_bpe_49k.json")
    plain, table_ = Tokenizer.from_file(path), orc_tokens.WordTable(model_bytes(path))
    rng = random.Random(1)
    codes = [c for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0)]
    texts = ["".join(f"a{chr(c)}{s} {chr(c)}{s}b{chr(c)} " for s in ".,!?;:*$%&#|") for c in codes]
    odd = [chr(c) for c in range(0x20, 0x250)] + ["İ", "ı", "ſ", "́", "̇", "Σ", "日", "🎉", "<|endoftext|>", "<|", "'s", " ", "\xa0", "\n", "ﬁ", "क़"] * 8
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(10_000)] + ["word " * 400_000 + "x" * 300_000]
    for i in range(0, len(texts), 500):
        ids, sizes = table_.encode(utf8(pa.array(texts[i : i + 500])), 1)
        want = [e.ids + [1] for e in plain.encode_batch(texts[i : i + 500], add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_files_are_in_the_order_of_their_numbers(spark, tmp_path, monkeypatch):
    """From 100,000 files on, names no longer sort like numbers."""
    import os

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "doc_id long, text string")
    path = f"{tmp_path}/orc"
    orc_tokens.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), files=3)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    for number, name in zip((99_999, 100_000, 100_001), files, strict=True):
        os.rename(f"{path}/{name}", f"{path}/part-{number}-{name[11:]}")
    for crc in [f for f in os.listdir(path) if f.endswith(".crc")]:
        os.remove(f"{path}/{crc}")
    starts = {r.file: (r.start, r.first_id) for r in orc_tokens._manifest(spark, path).collect()}
    assert [starts[f] for f in sorted(starts, key=lambda f: int(f.split("-")[1]))] == sorted(starts.values())


def test_a_worker_gives_back_the_memory_of_each_slice(spark):
    """Workers are used again by later stages, so what a slice took must not stay with them."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from prefspark.llm.common import map_texts

    def make():
        real, calls = pa.default_memory_pool(), []

        class Counting:
            def __getattr__(self, name):
                return getattr(real, name)

            def release_unused(self):
                calls.append(1)
                real.release_unused()

        pa.default_memory_pool = Counting
        return lambda texts: [pa.array([len(calls)] * len(texts), pa.int64())]

    docs = spark.range(0, 3, 1, 1).select("id", F.expr("repeat('x', 3000000)").alias("text"))
    rows = map_texts(docs, "text", ["id"], [T.StructField("calls", T.LongType())], make).collect()
    assert sorted(r.calls for r in rows) == [0, 1, 2]
