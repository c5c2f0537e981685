"""Near-duplicate documents by b-bit MinHash.

Every text becomes a set of hashed word shingles. Of ``Params.hashes`` minima only the low two bits are kept, packed into
eight 64-bit words; bands of whole minima give candidate buckets. The similarity of a candidate pair is estimated by bit
counts of the packed words, corrected for the quarter of unequal minima whose bits agree by chance, and pairs that may
reach the threshold are confirmed on the full sets. The bits are taken behind a mix of the whole minimum, as the low bits of a
multiplied hash depend on its low bits only; pairs with a set below ``SMALL`` shingles are confirmed without estimate.

1. Equal sets are one node (smallest document id); copies never meet as pairs.
2. In each bucket every node is paired with the bucket's smallest node: one row per member, not one per pair. Estimated,
   confirmed, joined to components.
3. A bucket whose nodes are then in several components may hide links between the others. Such buckets are gathered to
   families, cut into blocks of bounded size, and every pair of blocks compares its nodes of different components, by bits
   first and on full sets where these allow it. Only links leave a task. The work of this step grows with the square of
   a family of texts that are similar but not linked; its rows do not.
4. Components of all links.

Texts travel only for nodes that share a bucket with another node. With 42 bands of 6 a pair at the threshold of 0.8 is
missed with a chance of 3 in a million; the estimate loses 6 in a million more where no set is small.

Defined results: null texts and texts without words have an empty set and link with nothing; a text with fewer words than a
shingle is one shingle; every input row gives one output row; rows with one document id are one document (each keeps its
own set size); a null id is never linked and has a null component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import map_texts, materialise, roll, slices, split_words
from prefspark.llm.components import connected_components

#: Sets below this many shingles are not estimated: the exact check is as cheap there.
SMALL = 64
WORDS = 8  # 64-bit words of a packed signature: four for the lowest bits, four for the next


@dataclass(frozen=True)
class Params:
    """``percent``: links need 100 * shared >= percent * union. ``slack``: how far below the threshold an estimate may
    lie (over four standard errors). ``block``: shingles in one block of a family, which bounds a task's memory."""

    shingle: int = 2
    percent: int = 80
    bands: int = 42
    rows: int = 6
    slack: float = 0.14
    block: int = 1 << 20
    seed: int = 11

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; A-Z count as a-z, other letters as they are."""
    import xxhash

    words, counts = split_words(pc.ascii_lower(texts))
    coded = words.cast(pa.large_binary()).dictionary_encode()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    flat = hashed[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.uint64)
    rolled = roll(flat, size)
    out, end = [], 0
    for n in counts.tolist():
        start, end = end, end + n
        if n >= size:
            out.append(np.unique(rolled[start : end - size + 1]))
        else:
            out.append(roll(flat[start:end], n) if n else np.empty(0, np.uint64))
    return out


class Signer:
    """Minima, packed signature and band keys of a set."""

    def __init__(self, params: Params):
        rng = np.random.default_rng(params.seed)
        self.p = params
        self.by = rng.integers(0, 1 << 31, params.hashes).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, params.hashes, dtype=np.uint64).astype(np.uint32)
        self.band = rng.integers(0, 1 << 63, params.bands).astype(np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.p.hashes, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 512):
            least = np.minimum(least, (x[i : i + 512, None] * self.by + self.plus).min(axis=0))
        return least

    def packed(self, minima: np.ndarray) -> np.ndarray:
        planes = np.zeros((2, 256), np.uint8)
        mixed = (minima ^ minima >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        mixed = (mixed ^ mixed >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        mixed ^= mixed >> np.uint32(16)
        planes[0, : len(minima)] = mixed & np.uint32(1)
        planes[1, : len(minima)] = mixed >> np.uint32(1) & np.uint32(1)
        return np.packbits(planes, axis=1).reshape(-1).view(np.int64)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        h = self.band.copy()
        for column in minima.reshape(self.p.bands, self.p.rows).T:
            h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        return h.view(np.int64)


def features(docs: DataFrame, params: Params, key: str, text: str) -> DataFrame:
    """node, n_shingles, the set's digest (d1, d2), packed signature and band keys of every row."""
    fields = [
        T.StructField("n_shingles", T.LongType(), False),
        T.StructField("d1", T.LongType(), False),
        T.StructField("d2", T.LongType(), False),
        T.StructField("signature", T.ArrayType(T.LongType(), False), False),
        T.StructField("band_keys", T.ArrayType(T.LongType(), False), False),
    ]

    def make():
        import xxhash

        signer = Signer(params)

        def run(texts: pa.Array) -> list[pa.Array]:
            sets = shingle_sets(texts, params.shingle)
            digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            minima = [signer.minima(s) for s in sets]
            many = lambda rows: pa.array([r if len(s) else [] for r, s in zip(rows, sets, strict=True)], pa.list_(pa.int64()))
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digest[:, 0]),
                pa.array(digest[:, 1]),
                many([signer.packed(m) for m in minima]),
                many([signer.keys(m) for m in minima]),
            ]

        return run

    return map_texts(docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")), "text", ["node"], fields, make)


def estimate(a: Column, b: Column, params: Params) -> Column:
    """Similarity of two packed signatures: the share of equal bit pairs, less what agrees by chance."""
    half = WORDS // 2
    unequal = sum((F.bit_count(a[i].bitwiseXOR(b[i]).bitwiseOR(a[i + half].bitwiseXOR(b[i + half]))) for i in range(half)), F.lit(0))
    return (F.lit(1.0) - unequal / F.lit(float(params.hashes)) - F.lit(0.25)) / F.lit(0.75)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on two full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def find_components(docs: DataFrame, params: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id and kept for every row of ``docs``."""
    rows = materialise(features(docs, params, key, text), "minhash-rows")
    full = rows.where("n_shingles > 0 and node is not null")
    copies = materialise(full.groupBy("d1", "d2").agg(F.min("node").alias("rep")), "minhash-copies")
    nodes = full.join(copies, (full.node == copies.rep) & (full.d1 == copies.d1) & (full.d2 == copies.d2), "left_semi")
    banded = nodes.select("node", F.explode("band_keys").alias("band_key"))
    buckets = banded.groupBy("band_key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1")
    shared = materialise(banded.join(buckets, "band_key"), "minhash-buckets")

    signatures = full.select("node", "signature", "n_shingles")
    pairs = shared.where("node <> hub").select("hub", "node").distinct()
    pairs = (
        pairs.join(signatures.select("node", F.col("signature").alias("s"), F.col("n_shingles").alias("m")), "node")
        .join(signatures.select(F.col("node").alias("hub"), F.col("signature").alias("t"), F.col("n_shingles").alias("n")), "hub")
        .where(100 * F.least("m", "n") >= params.percent * F.greatest("m", "n"))
        .where((F.least("m", "n") < SMALL) | (estimate(F.col("s"), F.col("t"), params) >= params.percent / 100 - params.slack))
        .select("hub", "node")
        .distinct()
    )
    met = shared.select("node").distinct()
    texts = materialise(
        docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("t")).join(met, "node", "left_semi"), "minhash-texts"
    )
    first = materialise(_confirm_stars(pairs, texts, params), "minhash-links")
    # rows that share an id but not a set are one document
    same = full.join(copies, ["d1", "d2"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    groups = connected_components(first, "a", "b")
    rest = materialise(_confirm_families(shared, groups, texts, rows, params), "minhash-rest")
    every = first.union(rest).union(same)
    parts = connected_components(every, "a", "b")
    return (
        rows.select("node", "n_shingles").join(parts, "node", "left")
        .select(
            F.col("node").alias(key),
            "n_shingles",
            F.coalesce("component", "node").alias("component_id"),
            F.coalesce(F.col("component") == F.col("node"), F.lit(True)).alias("kept"),
        )
    )


def _confirm_stars(pairs: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """Links (a, b) among (hub, node) pairs; a hub's pairs are dealt out in parts, each with a copy of the hub's text."""
    pairs = materialise(pairs, "minhash-pairs")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / 256).alias("parts"))
    dealt = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node")
    members = dealt.union(dealt.select("hub", "part", F.col("hub").alias("node")).distinct())
    rows = members.join(texts, "node").select("hub", "part", "node", (F.col("node") == F.col("hub")).alias("is_hub"), "t")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "hub", "part").sortWithinPartitions("hub", "part", F.desc("is_hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stars = None, []
        for batch in batches:
            for part, texts in slices(batch, "t"):
                a, b = [], []
                hubs, parts, nodes, flags = (part.column(c).to_pylist() for c in ("hub", "part", "node", "is_hub"))
                for hub, one, node, is_hub, own in zip(hubs, parts, nodes, flags, shingle_sets(texts, params.shingle), strict=True):
                    if at != (hub, one):
                        at, stars = (hub, one), []
                    if is_hub:
                        stars.append(own)
                    elif any(linked(s, own, params.percent) for s in stars):
                        a.append(hub)
                        b.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _confirm_families(shared: DataFrame, groups: DataFrame, texts: DataFrame, rows: DataFrame, params: Params) -> DataFrame:
    """Links (a, b) between different components of ``groups`` within the buckets that still hold several."""
    open_rows = (
        shared.where("members > 2").select("band_key", "node", "hub").join(groups, "node", "left")
        .select("band_key", "node", "hub", F.coalesce("component", "node").alias("component"))
    )
    open_rows = materialise(open_rows, "minhash-open")
    mixed = open_rows.groupBy("band_key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_rows = open_rows.join(mixed, "band_key", "left_semi")
    families = connected_components(open_rows, "node", "hub").select("node", F.col("component").alias("family"))
    sizes = rows.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    placed = materialise(
        open_rows.select("node", "component").distinct().join(families, "node").join(sizes, "node"), "minhash-families"
    )
    blocks = placed.groupBy("family").agg(F.ceil(F.sum("n_shingles") / params.block).cast("int").alias("blocks"))
    dealt = placed.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component"
    )
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.join(texts, "node").repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, at, held = Signer(params), None, []
        for batch in batches:
            for part, texts in slices(batch, "t"):
                families, i, j, block, nodes, component = (part.column(c).to_pylist() for c in ("family", "i", "j", "block", "node", "component"))
                sets = shingle_sets(texts, params.shingle)
                for k, here in enumerate(zip(families, i, j, strict=True)):
                    if at is not None and here != at:
                        yield _links(held, at[1] == at[2], signer)
                        held = []
                    at = here
                    held.append((nodes[k], component[k], block[k], sets[k]))
        if held:
            yield _links(held, at[1] == at[2], signer)

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _links(held: list[tuple[int, int, int, np.ndarray]], one_block: bool, signer: Signer) -> pa.RecordBatch:
    """Links between different components of the rows of two blocks (or of one)."""
    p = signer.p
    held = sorted(held, key=lambda r: r[0])
    nodes, blocks = np.array([r[0] for r in held]), np.array([r[2] for r in held])
    component = np.unique([r[1] for r in held], return_inverse=True)[1]
    sets = [r[3] for r in held]
    lengths = np.array([len(s) for s in sets])
    signs = np.array([signer.packed(signer.minima(s)) for s in sets]).view(np.uint64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    stops = np.cumsum(lengths)
    marked = np.zeros(len(names), bool)
    least = (p.percent / 100 - p.slack) * 0.75 + 0.25
    a, b = [], []
    for i in range(len(held) - 1):
        later = slice(i + 1, len(held))
        unequal = np.bitwise_count((signs[i, :4] ^ signs[later, :4]) | (signs[i, 4:] ^ signs[later, 4:])).sum(axis=1)
        may = (1 - unequal / p.hashes >= least) | (np.minimum(lengths[later], lengths[i]) < SMALL)
        may &= (component[later] != component[i]) & (100 * np.minimum(lengths[later], lengths[i]) >= p.percent * np.maximum(lengths[later], lengths[i]))
        if not one_block:
            may &= blocks[later] != blocks[i]
        close = np.flatnonzero(may) + i + 1
        if not len(close):
            continue
        own = flat[stops[i] - lengths[i] : stops[i]]
        marked[own] = True
        for j in close.tolist():
            if component[i] == component[j]:
                continue
            shared = int(marked[flat[stops[j] - lengths[j] : stops[j]]].sum())
            if 100 * shared >= p.percent * (lengths[i] + lengths[j] - shared):
                a.append(nodes[i])
                b.append(nodes[j])
                component[component == component[j]] = component[i]
        marked[own] = False
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
