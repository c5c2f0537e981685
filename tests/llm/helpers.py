"""Small tables with the cases every operator must stand, and plain reference forms."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, white space, markers, long words, other scripts, control characters.
ODD = [None, "", " ", "  \n\t ", "a", "a  b", "▁x ▁", " lead", "trail ", "x" * 30_000, "日本 語🎉 é", "a b\x0bc", "<s> <|endoftext|> y",
       "one two", "ONE two", "!!! ...", "́a b", "it's I'M"]


def prose(seed: int, n: int, words: int = 300) -> str:
    """Invented text; the same seed gives the same text."""
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "lun", "mes", "ta", "vor", "pil", "sen", "da"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def table(spark: SparkSession, texts: list, langs: list | None = None, extra: bool = True) -> DataFrame:
    """Documents with these texts; ``extra`` adds columns named like outputs and internals of the operators."""
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, g, "s", None if t is None else len(t)) for i, (t, g) in enumerate(zip(texts, langs, strict=True))]
    docs = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("score", "hits", "token_ids", "kept", "t", "node", "masked", "n_tokens", "spans", "lang_pred"):
            docs = docs.selectExpr("*", f"'x' AS {name}")
    return docs


def folder(docs: DataFrame, path, **others: DataFrame) -> str:
    """A data folder with this documents table."""
    docs.write.parquet(f"{path}/documents.parquet")
    for name, frame in others.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def edited(text: str, seed: int, rate: float) -> str:
    """A copy with some words replaced."""
    rng = random.Random(seed)
    return " ".join(w if rng.random() >= rate else f"new{rng.randrange(10_000)}" for w in text.split(" "))


def components(sets: dict[int, frozenset], percent: int = 80) -> dict[int, int]:
    """Smallest id that can be reached from each id over links of similar sets, by comparing all."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def shingles(text: str | None, size: int) -> frozenset:
    """Distinct word shingles, A-Z lowered."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
