"""Operators that look at one text at a time, against plain forms."""

import hashlib
import random
import re
import string
from collections import Counter

import pytest

from prefspark.llm import compression_bands, license_rules, queries, token_secrets
from tests.llm.helpers import ODD, WORD, folder, prose, table
from tests.oracle import connect

HEX40 = "0123456789abcdef" * 2 + "01234567"
RANDOM = "".join(random.Random(5).choices(string.ascii_letters + string.digits, k=44))
TEXTS = [
    *ODD,
    *[prose(i, 400) for i in range(6)],
    " ".join(["same words again"] * 400),
    "".join(random.Random(1).choices(string.ascii_letters + string.digits + "   ", k=4_000)),
    "line one\nline one\n \n \nline two\nline one",
    f'é password: "hunter22" token={HEX40} AKIA{"A1" * 9} PASSWORD=abc secret = short',
    f"a digest {HEX40} and 550e8400-e29b-41d4-a716-446655440000 and {RANDOM} end",
    "Released under the MIT License.\nx. Licensed under\nthe Apache License, Version 2.0. Licensed under CC BY-NC 4.0.",
    "See the License for the specific language governing permissions and limitations under the License.",
]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    return folder(table(spark, TEXTS), tmp_path_factory.mktemp("rows") / "t")


def test_op2_base_counts(spark, sf_dir):
    for r in queries.op2_compression_bands(spark, sf_dir).collect():
        text = TEXTS[r.doc_id] or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        want = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(text)[:60]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_bands_keep_prose_and_reject_the_ends(spark, sf_dir):
    kept = {TEXTS[r.doc_id]: r.kept for r in queries.op2_compression_bands(spark, sf_dir).collect()}
    assert all(kept[prose(i, 400)] for i in range(6))
    strict = compression_bands.Bands(min_words=0, most_repeated=1.0)
    docs = table(spark, [" ".join(["same words again"] * 400), prose(1, 400), RANDOM * 1, prose(2, 300) + " " + "zz " * 3_000])
    assert [r.kept for r in compression_bands.measure(docs, strict).orderBy("doc_id").collect()] == [False, True, True, False]


def test_every_chunk_is_measured(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    good = prose(1, 4_000, 1_000)
    strict = compression_bands.Bands(min_words=0, most_repeated=1.0)
    docs = table(spark, [good[:8_000], good[:4_000] + noise(4_000), good[:4_000] + ("again the same phrase " * 200)[:4_000], good[:8_192] + noise(4_095)])
    rows = compression_bands.measure(docs, strict).orderBy("doc_id").collect()
    assert [r.kept for r in rows[:3]] == [True, False, False]
    assert [r.bad_chunks for r in rows] == [0.0, 0.5, 0.5, 1 / 3]


def test_many_distinct_words_are_numbered_in_two_steps():
    import numpy as np

    words = np.array([3 << 21, 1, 2, 9, 3 << 21, 1, 2, 5])
    assert compression_bands.repeated_words(words) == 6


def test_op9_base_spans(spark, sf_dir):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r.doc_id: r for r in queries.op9_token_secrets(spark, sf_dir).collect()}
    for i, text in enumerate(TEXTS):
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{token_secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        n = Counter(k for _, k, _ in spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (n[0], n[1], n[2])
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_random_strings_are_found_and_digests_left(spark, sf_dir):
    row = next(r for r in queries.op9_token_secrets(spark, sf_dir).collect() if RANDOM in (TEXTS[r.doc_id] or "") and "digest" in TEXTS[r.doc_id])
    start = TEXTS[row.doc_id].index(RANDOM)
    assert f"random:{start}:{start + len(RANDOM)}" in row.spans.split(",") and row.spans.count("random") == 1
    assert "random" not in "".join(r.spans for r in queries.op9_token_secrets(spark, sf_dir).collect() if 18 <= r.doc_id < 24)


def test_secrets_behind_readable_parts_are_found_and_masked(spark):
    rng = random.Random(8)
    around = [("client_credentials_for_production_server=", ""), ("production_database_connection_string=", ""),
              ("webhook/production/customer/", "/notifications/incoming")]
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"]
    cases = [(a, "x" + "".join(rng.choices(s, k=n - 2)) + "9", b) for a, b in around for s in alphabets for n in (24, 32, 40) for _ in range(8)]
    clean = ["client_credentials_for_production_server2=customer_database_connection/notifications", "webhook/production/customer/550e8400-e29b-41d4-a716-446655440000/notifications",
             f"webhook/production/customer/{HEX40.upper()}/notifications/incoming", "reports/2024-01-15/production/customer/webhook"]
    docs = table(spark, [f"see {a}{x}{b} now" for a, x, b in cases] + [f"see {c} now" for c in clean])
    out = [r.text for r in token_secrets.redact(docs, *queries.secret_vocabulary()).orderBy("doc_id").collect()]
    assert out[len(cases) :] == [f"see {c} now" for c in clean]
    for (a, x, b), text in zip(cases, out, strict=False):
        assert "[SECRET]" in text and not any(x[i : i + 6] in text for i in range(len(x) - 5)), (a, x, b, text)


def test_secrets_that_touch_a_base_span_are_found_and_masked(spark):
    rng = random.Random(12)
    key = lambda n: "x" + "".join(rng.choices(string.ascii_letters + string.digits, k=n - 2)) + "9"
    digits = HEX40[:24]
    cases = [("AKIA" + "A1" * 8 + "/", key(40), "") for _ in range(8)] + [("", key(40), "/AKIA" + "A1" * 8) for _ in range(8)]
    cases += [("", key(10) + "Z" + digits + "Z" + key(10), "") for _ in range(8)] + [("", key(30), "=" + HEX40) for _ in range(8)]
    kept = [f"0x{HEX40}", f"release/{HEX40}/production/customer"]
    docs = table(spark, [f"see {a}{x}{b} now" for a, x, b in cases] + [f"see {k} now" for k in kept])
    out = [r.text for r in token_secrets.redact(docs, *queries.secret_vocabulary()).orderBy("doc_id").collect()]
    assert out[len(cases) :] == [f"see {k.replace(HEX40, '[SECRET]')} now" for k in kept]
    for (a, x, b), text in zip(cases, out, strict=False):
        assert not any(x[i : i + 6] in text for i in range(len(x) - 5)), (a, x, b, text)


def test_redaction_masks_overlaps_once_and_keeps_the_rest(spark):
    docs = table(spark, [f"x token={HEX40} y", None, "plain"])
    out = token_secrets.redact(docs, *queries.secret_vocabulary())
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["x [SECRET] y", None, "plain"]


def test_op6_equals_sql_and_finds_wrapped_lines(spark, sf_dir):
    got = sorted(map(tuple, queries.op6_license_rules(spark, sf_dir).collect()))
    duck = connect_folder(sf_dir)
    assert got == sorted(duck.sql(queries.SQL["op6_license_rules"]).fetchall())
    assert got[len(TEXTS) - 2][3] == "Apache-2.0,CC-BY-NC-4.0,MIT" and got[len(TEXTS) - 1][3] == ""


def test_rules_need_their_order(spark):
    s = license_rules.SENTENCES
    right = ". ".join([s["mit-grant"], s["mit-notice"], s["mit-warranty"]])
    wrong = ". ".join([s["mit-notice"], s["mit-grant"], s["mit-warranty"]])
    found = license_rules.scan(table(spark, [right, wrong, "Noise. " + right]))
    assert [list(r.licences) for r in found.orderBy("doc_id").collect()] == [["MIT"], [], ["MIT"]]


def connect_folder(sf_dir):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet/*.parquet'")
    return duck


def test_op6_equals_sql_on_the_given_table(spark):
    import os

    here = "/root/testdata/sf0.001"
    if not os.path.isdir(here):
        pytest.skip("no test tables")
    got = sorted(map(tuple, queries.op6_license_rules(spark, here).collect()))
    assert got == sorted(connect(here).sql(queries.SQL["op6_license_rules"]).fetchall())


def test_empty_tables(spark, tmp_path):
    empty = folder(table(spark, ["x"]).limit(0), tmp_path / "t")
    for name in ("op2_compression_bands", "op6_license_rules", "op9_token_secrets"):
        assert queries.QUERIES[name](spark, empty).count() == 0


def test_op9_time_grows_with_the_text():
    """A run of a megabyte, of readable parts with random ones between, in seconds; each random part is found."""
    import random
    import time
    from pathlib import Path

    vocabulary, pattern = queries.secret_vocabulary()
    scanner = token_secrets.Scanner(Path(vocabulary).read_bytes(), pattern, token_secrets.Efficiency())
    rng = random.Random(4)
    words = ["production", "server", "client", "webhook", "database", "customer"]
    secrets = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(200)]
    text = "/".join("/".join(rng.choice(words) for _ in range(600)) + "/" + s for s in secrets)
    start = time.time()
    spans = scanner.spans(text, (True,) * 4)
    assert len(text) > 900_000 and time.time() - start < 20
    found = [text[a:b] for a, kind, b in spans if kind == 3]
    assert sum(any(s in f for f in found) for s in secrets) >= 190
