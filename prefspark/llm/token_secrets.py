"""Secret scan: fixed patterns, and random strings found by how badly a subword vocabulary compresses them.

A vocabulary learnt on text spends one token on several characters of anything readable, but one on one or two
characters of a random string. Runs of key characters with few characters per token are reported as ``random``, unless
they are known digests (hexadecimal of a usual digest length), UUIDs, dates, numbers, or lie in a span already found (what
a run holds beside such spans is judged). A
run that reads well as a whole is searched for stretches that do not, so readable neighbours cannot hide a secret.

Base kinds, leftmost and non-overlapping per kind; matches that are too short are dropped: ``assign`` (a key name, a
sign and a value), ``access`` (cloud access key ids), ``hex`` (long hexadecimal runs). Spans count code points, the end
is exclusive.

Defined results: null counts as empty and has no spans; every input row gives one output row; texts of any length are
scanned whole; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import fresh, map_texts, model_bytes

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Digests (of the lengths filled in), UUIDs and dates that stand between other parts of a run.
SHAPES = r"(?<![A-Za-z0-9])(?:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|(?:%s)|[0-9]{4}-[0-9][0-9]-[0-9][0-9](?:[t_-][0-9_-]*z?)?)(?![A-Za-z0-9])"
PARTS = re.compile(r"[A-Za-z0-9]+")
#: So many letters and digits right beside a base span belong to the same string; fewer are a mark like 0x.
GLUED = 4
#: What a text must hold to be worth each of the patterns above, in the syntax of the vectorised matcher.
HINTS = (r"(?i)passw|secret|token|api_?key", r"AKIA", r"[0-9a-f]{24}", r"[0-9]|[a-z][A-Z]")
SPAN = T.StructType(
    [T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]
)
SPANS = T.StructField("spans", T.ArrayType(SPAN, False), False)


@dataclass(frozen=True)
class Efficiency:
    """Runs of at least ``min_chars`` key characters with at most ``most_chars_per_token`` are random strings."""

    min_chars: int = 20
    most_chars_per_token: float = 1.9
    digest_lengths: tuple[int, ...] = (32, 40, 48, 56, 64, 96, 128)


class Scanner:
    """Finds the spans of texts; one per task."""

    def __init__(self, ranks: bytes, pattern: str, rule: Efficiency):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.tokens = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.sizes = {i: len(t) for t, i in table.items()}
        self.rule = rule
        self.run = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % rule.min_chars)
        self.shapes = re.compile(SHAPES % "|".join(f"[0-9a-f]{{{n}}}" for n in rule.digest_lengths), re.I)

    def is_random(self, s: str) -> bool:
        """Whether a run of key characters reads like a random string."""
        core = s.strip("-_=/+")
        if len(core) < self.rule.min_chars or not re.search("[A-Za-z]", core):
            return False
        if not re.search("[0-9]", core) and not re.search("[a-z][A-Z]", core):
            return False  # plain words, however long
        if len(core) in self.rule.digest_lengths and re.fullmatch("[0-9a-f]+|[0-9A-F]+", core):
            return False
        if re.fullmatch("(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", core):
            return False
        if re.fullmatch(r"\d{4}-\d\d-\d\d[Tt_-].*", core):
            return False
        return len(core) <= self.rule.most_chars_per_token * len(self.tokens(core))

    def gain(self, s: str) -> float:
        """How far the tokens of a run outnumber those of a readable one."""
        return self.rule.most_chars_per_token * len(self.tokens(s)) - len(s)

    def stretches(self, s: str) -> list[tuple[int, int]]:
        """The random stretches of a run that is not random as a whole: token by token the best ones, widened to whole
        parts between signs, and by neighbouring parts that are as badly compressed."""
        # disjoint stretches, each with the totals before and behind it (Ruzzo and Tompa); done: none can grow any more
        done, best, least = [], [], 0.0
        at, place = 0.0, 0
        for token in self.tokens(s):
            size = self.sizes[token]
            before, at = at, at + self.rule.most_chars_per_token - size
            if at > before:
                one, link = (before, at, place, place + size), len(best) - 1
                if before <= least:
                    done.extend(b for b, _ in best)
                    best, least, link = [], before, -1
                # the nearest stretch that began lower; each keeps a link to its own, so the search skips what lies between
                while best:
                    k = link
                    while k >= 0 and best[k][0][0] >= one[0]:
                        k = best[k][1]
                    link = k
                    if k < 0 or best[k][0][1] >= one[1]:
                        break
                    one, link = (best[k][0][0], one[1], best[k][0][2], one[3]), best[k][1]
                    del best[k:]
                best.append((one, link))
            place += size
        best = [b for b, _ in best]
        parts = [m.span() for m in PARTS.finditer(s)]
        starts, ends = [a for a, _ in parts], [b for _, b in parts]
        near: dict[int, bool] = {}  # each part is measured once, each range of parts judged once
        judged: dict[tuple[int, int], bool] = {}

        def joins(k: int) -> bool:
            if k not in near:
                a, b = parts[k]
                near[k] = b - a <= 3 or self.gain(s[a:b]) + 1 >= 0
            return near[k]

        def random(i: int, j: int) -> bool:
            if (i, j) not in judged:
                judged[i, j] = self.is_random(s[starts[i] : ends[j]])
            return judged[i, j]

        out, taken = [], 0
        for _, _, start, end in done + best:
            # parts that overlap the stretch and begin behind what is taken
            first = max(bisect_right(ends, start), bisect_left(starts, taken))
            last = bisect_left(starts, end) - 1
            if first > last:
                continue
            low, high = first, last
            while low and starts[low - 1] >= taken and joins(low - 1):
                low -= 1
            while high + 1 < len(parts) and joins(high + 1):
                high += 1
            hit = next((pair for pair in ((low, high), (first, high), (low, last), (first, last)) if random(*pair)), None)
            if hit is None and self.is_random(s[start:end]):  # glued to a word without a sign
                hit = first, last
            if hit:
                taken = ends[hit[1]]
                out.append((starts[hit[0]], taken))
        return out

    def pieces(self, s: str) -> list[tuple[int, int]]:
        """The random stretches of a run: all of it, or those between digests, UUIDs, dates and readable parts."""
        if self.is_random(s):
            return [(0, len(s))]
        out, start = [], 0
        for a, b in [*(m.span() for m in self.shapes.finditer(s)), (len(s), len(s))]:
            if a - start >= self.rule.min_chars:
                out += [(start + i, start + j) for i, j in self.stretches(s[start:a])]
            start = b
        return out

    def beside(self, s: str, over: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """The random stretches of a run beside the base spans (rank of the kind, start, end) in it. A key id or
        hexadecimal span with ``GLUED`` or more letters and digits right before or behind it is part of a longer string,
        which is judged with it; all other spans are taken out of the run."""
        out, start = [], 0
        for kind, a, b in [*over, (0, len(s), len(s))]:
            if KINDS[kind] != "assign" and any(len(x) == GLUED and x.isalnum() for x in (s[max(start, a - GLUED) : a], s[b : b + GLUED])):
                continue
            if a - start >= self.rule.min_chars:
                out += [(start + i, start + j) for i, j in self.pieces(s[start:a])]
            start = max(start, b)
        return out

    def spans(self, text: str, hints: tuple[bool, bool, bool, bool]) -> list[tuple[int, int, int]]:
        """(start, rank of the kind, end), in order."""
        found = []
        if hints[0]:
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if hints[1]:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        if hints[2]:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        if hints[3]:
            taken, at, open_ = sorted(found), 0, []  # open_: base spans that start before the run's end and end behind its start
            for m in self.run.finditer(text):
                while at < len(taken) and taken[at][0] < m.end():
                    open_.append(taken[at])
                    at += 1
                open_ = [x for x in open_ if x[2] > m.start()]
                over = [(k, max(a - m.start(), 0), min(b, m.end()) - m.start()) for a, k, b in open_]
                found += [(m.start() + a, 3, m.start() + b) for a, b in self.beside(m[0], over)]
        return sorted(found)

    def scan(self, texts: pa.Array) -> list[pa.Array]:
        """The column of spans of these texts."""
        hints = [pc.match_substring_regex(texts, h).to_numpy(zero_copy_only=False) for h in HINTS]
        sizes, flat = np.zeros(len(texts), np.int64), []
        for i in np.flatnonzero(np.logical_or.reduce(hints)).tolist():
            one = self.spans(texts[i].as_py(), tuple(bool(h[i]) for h in hints))
            sizes[i] = len(one)
            flat += one
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        values = pa.StructArray.from_arrays(
            [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int32()), pa.array([e for _, _, e in flat], pa.int32())],
            fields=[pa.field("kind", pa.string(), False), pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)],
        )
        return [pa.ListArray.from_arrays(offsets, values)]


def find_secrets(
    docs: DataFrame, vocabulary_path: str, pattern: str, rule: Efficiency = Efficiency(), text: str = "text", keep: list[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns and ``spans``, sorted by start, then by kind in the order of ``KINDS``."""
    ranks = docs.sparkSession.sparkContext.broadcast(model_bytes(vocabulary_path))
    return map_texts(docs, text, list(keep), [SPANS], lambda: Scanner(ranks.value, pattern, rule).scan)


def redact(docs: DataFrame, vocabulary_path: str, pattern: str, rule: Efficiency = Efficiency(), text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) of ``text`` replaced by ``mask``; null stays null."""
    ranks = docs.sparkSession.sparkContext.broadcast(model_bytes(vocabulary_path))

    def make():
        scanner = Scanner(ranks.value, pattern, rule)

        def run(texts: pa.Array) -> list[pa.Array]:
            spans = scanner.scan(texts)[0]
            sizes = pc.list_value_length(spans).to_numpy(zero_copy_only=False)
            if not sizes.any():
                return [texts.cast(pa.string())]
            out = texts.to_pylist()
            for i in np.flatnonzero(sizes).tolist():
                parts, at = [], 0
                for s in spans[i].as_py():
                    if s["start"] >= at:
                        parts += [out[i][at : s["start"]], mask]
                    at = max(at, s["end"])
                out[i] = "".join([*parts, out[i][at:]])
            return [pa.array(out, pa.string())]

        return run

    name = fresh(docs, "masked")
    changed = map_texts(docs, text, docs.columns, [T.StructField(name, T.StringType())], make)
    return changed.withColumn(text, F.when(F.col(text).isNotNull(), F.col(name))).select(*docs.columns)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of spans of each base kind, the digest of base spans, and all spans as text."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
