"""Near duplicates by min-max hashing: each permutation gives its least and its greatest value.

96 permutations give 192 signature values, cut into bands whose length follows from the similarity: 32 bands of six at 0.85, 38 of five at
0.80. A pair at the similarity shares no band with a probability of 3e-7. Texts with equal shingle sets are one class; only class
representatives are linked:

1. Rounds: every band bucket names leaders, a representative is checked against the most alike of the leaders of other components, and the
   confirmed links are merged. This takes a bounded number of checks per representative, whatever the size of its bucket.
2. The rest, whole: in buckets that still hold several components, every member outside the bucket's largest component is checked
   against all members of other components, so no candidate link between components is left out.

Links are confirmed on the full sets of words themselves. One bit per signature value (192 bits) drops candidates that are too far off: at
0.85, 14 bits are expected to differ (deviation 3.7); pairs beyond a limit that a pair at the similarity passes with a probability below 1e-9
are not checked. The last step compares a longer signature too, within the join, so that pairs well below the similarity are not even listed
(1e-7 for a pair at the similarity). ``limits`` derives all three from the similarity.
"""

from __future__ import annotations

import math
import re
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from hopledger.llm.common import LOWER_ASCII, WORD, kept, map_slices, texts_of
from hopledger.llm.components import components

SHINGLE = 5
PERMUTATIONS = 96
ROUNDS, TRIES = 2, 2
# The finer sketch of the last step: two bits of 1024 values, compared in the join. At 0.85, 115 values are expected to differ (deviation 10).
FINE_PERMUTATIONS = 512
# Probabilities that a pair at the similarity shares no band, has too many differing bits, has too many differing cells.
BAND_LOSS, FAR_LOSS, FINE_LOSS = 3e-7, 1e-9, 1e-7
_WORDS = re.compile(WORD)
_SEED = np.random.default_rng(20)
_A = _SEED.integers(1, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _SEED.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
_FINE_A = _SEED.integers(1, 1 << 31, FINE_PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1)
_FINE_B = _SEED.integers(0, 1 << 32, FINE_PERMUTATIONS, np.uint32)
_BAND = _SEED.integers(1, 1 << 62, (1, 6), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _SEED.integers(1, 1 << 62, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.concatenate([_BAND, _SEED.integers(1, 1 << 62, (1, 2 * PERMUTATIONS - 6), np.uint64) * np.uint64(2) + np.uint64(1)], axis=1)


def _limit(n: int, p: float, loss: float) -> int:
    """Least number that ``n`` values, each differing with probability ``p``, exceed with a probability of at most ``loss``."""
    tail = 0.0
    for k in range(n, 0, -1):
        if 0 < p < 1:
            tail += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
        if tail > loss:
            return k
    return 0


@cache
def limits(percent: int) -> tuple[int, int, int]:
    """(values of a band, bits that may differ, cells of the finer sketch that may differ) for a similarity."""
    alike, values = percent / 100, 2 * PERMUTATIONS
    rows = next((r for r in range(values, 1, -1) if (1 - alike**r) ** (values // r) <= BAND_LOSS), 1)
    return rows, _limit(values, (1 - alike) / 2, FAR_LOSS), _limit(2 * FINE_PERMUTATIONS, 0.75 * (1 - alike), FINE_LOSS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.translate(LOWER_ASCII))


class WordHashes(dict):
    """word -> 64-bit hash, each computed once; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxh3_64_intdigest(word)
        return value


def shingle_hashes(words: list[str], known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    runs = len(words) - size + 1
    total = np.full(runs, size, np.uint64)
    for k in range(size):
        total = _mixed(total * _PLACE[k] + hashes[k:k + runs])
    return np.unique(total)


def signature(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """Least and greatest value under each permutation: two numbers of 32 bits for each."""
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(a.size, 0xFFFFFFFF, np.uint32), np.zeros(a.size, np.uint32)
    step = 50_000 // a.size
    for at in range(0, small.size, step):
        values = small[at:at + step] * a[:, None] + b[:, None]
        values ^= values >> np.uint32(15)
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands_of(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values; a band mixes least and greatest values."""
    bands = values.size // rows
    by_band = values[:rows * bands].reshape(rows, bands).T.astype(np.uint64)
    keys = _mixed((by_band * _BAND[:, :rows]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def bits_of(values: np.ndarray) -> np.ndarray:
    """One bit of each value after mixing, packed into longs."""
    bit = (_mixed(values.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bit).view(np.int64)


def signatures(docs: DataFrame, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, bits) per row; ``set_key`` is equal for equal shingle sets, null for empty ones."""
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, b0 long, b1 long, b2 long"

    def make():
        known = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, keys, bands, bits = [], [], [], []
            if len(known) > 200_000:
                known.clear()
            for text in texts_of(batch):
                shingles = shingle_hashes(words_of(text), known)
                sizes.append(shingles.size)
                if shingles.size:
                    values = signature(shingles)
                    keys.append(xxh3_128_digest(shingles.tobytes()))
                    bands.append(bands_of(values, rows))
                    bits.append(bits_of(values))
                else:
                    keys.append(None)
                    bands.append(None)
                    bits.append(np.zeros(3, np.int64))
            three = np.array(bits).T
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                 *(pa.array(b, pa.int64()) for b in three)],
                ["doc_id", "n_shingles", "set_key", "bands", "b0", "b1", "b2"],
            )

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), "text", schema, make)


def _differing(left: str, right: str):
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{left}{k}").bitwiseXOR(F.col(f"{right}{k}"))) for k in range(3)))


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = 85) -> DataFrame:
    """Pairs (a, b) whose full shingle sets meet the similarity: 100 * intersection >= percent * union."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    left, right = texts.toDF("a", "text"), texts.toDF("b", "other")

    def make():
        def sets(texts: list[str]) -> list[set]:
            return [{tuple(w[k:k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if (w := words_of(t)) else set() for t in texts]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for one, two in zip(sets(texts_of(batch)), sets(texts_of(batch, "other")), strict=True):
                both = len(one & two)
                keep.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return work

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text", "other")
    return map_slices(joined, "text", "a long, b long", make)


def _round(members: DataFrame, bits: DataFrame, label: DataFrame, number: int, far_limit: int) -> DataFrame:
    """Candidate pairs: each representative with the most alike leaders of its buckets' other components."""
    named = members.join(label, "id").select("key", "id", "component")
    order = F.xxhash64("key", F.lit(number), "component")
    inner = F.struct(order, F.xxhash64("key", "id"), "id", "component")
    leaders = named.groupBy("key").agg(F.min(inner).alias("first"), F.max(inner).alias("last"))
    leader = F.when(F.col("first.component") != F.col("component"), F.col("first.id")).when(
        F.col("last.component") != F.col("component"), F.col("last.id")
    )
    pairs = named.join(leaders, "key").select("id", leader.alias("leader")).filter("leader IS NOT NULL").distinct()
    mine = bits.toDF("id", "b0", "b1", "b2")
    theirs = bits.toDF("leader", "t0", "t1", "t2")
    far = pairs.join(mine, "id").join(theirs, "leader").withColumn("far", _differing("b", "t")).filter(F.col("far") <= far_limit)
    part = F.pmod(F.xxhash64("leader", F.lit(number)), F.lit(TRIES))
    best = far.groupBy("id", part.alias("part")).agg(F.min(F.struct("far", "leader")).alias("best"))
    return best.select(F.least("id", "best.leader").alias("a"), F.greatest("id", "best.leader").alias("b")).distinct()


def fine_sketches(texts: DataFrame) -> DataFrame:
    """(id, fine): two bits of each value of a longer signature, as longs."""

    def make():
        known = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(known) > 200_000:
                known.clear()
            out = []
            for text in texts_of(batch):
                values = _mixed(signature(shingle_hashes(words_of(text), known), _FINE_A, _FINE_B).astype(np.uint64))
                two = np.stack([values & np.uint64(1), values >> np.uint64(1) & np.uint64(1)], axis=1).astype(np.uint8)
                out.append(np.packbits(two.ravel()).view(np.int64))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["id", "fine"])

        return work

    return map_slices(texts.select("doc_id", "text"), "text", "id long, fine array<long>", make)


def _fine_differing(left: str, right: str):
    """Number of two-bit cells that differ."""
    even = F.lit(0x5555555555555555)
    cell = lambda x, y: x.bitwiseXOR(y)
    count = lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(even))
    return F.aggregate(F.zip_with(left, right, cell), F.lit(0), lambda total, x: total + count(x))


def _rest(
    members: DataFrame, bits: DataFrame, bands: DataFrame, label: DataFrame, texts: DataFrame, far_limit: int, fine_limit: int,
) -> DataFrame:
    """All candidate pairs between components that share a bucket and are not far apart by the finer sketch.

    A pair that shares several buckets is listed in the first of them only.
    """
    named = members.join(label, "id").select("key", "band", "id", "component")
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "component")).alias("main")).filter("kinds > 1")
    named = kept(named.join(mixed.select("key", F.col("main.component").alias("main")), "key").join(
        bits.toDF("id", "b0", "b1", "b2"), "id"))
    fine = kept(fine_sketches(texts.join(named.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")))
    named = named.join(fine, "id").join(bands, "id")
    minor = named.filter("component <> main").select(
        "key", F.col("id").alias("other"), F.col("component").alias("kind"), F.col("fine").alias("fine_"), F.col("bands").alias("bands_"),
        *(F.col(f"b{k}").alias(f"t{k}") for k in range(3)))
    near = (F.col("component") != F.col("kind")) & (_differing("b", "t") <= far_limit) & (
        _fine_differing("fine", "fine_") <= fine_limit)
    first = F.array_position(F.zip_with("bands", "bands_", lambda x, y: x == y), True) == F.col("band") + 1
    # A pair of two minor members would come twice; the larger id leads then.
    once = (F.col("component") == F.col("main")) | (F.col("id") < F.col("other"))
    return named.join(minor.withColumnRenamed("key", "bucket"), (F.col("key") == F.col("bucket")) & near & once & first).select(
        F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Shingles are five words of the text with A-Z lowered; a shorter text is one shingle, a text without words has none, is linked
    with nothing and is its own component. ``component_id`` is the smallest doc_id that can be reached over links. A doc_id that comes
    with several texts gets the smallest of their components; a row without doc_id is linked with nothing, has a null component and is kept. Extra columns do not matter; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, far_limit, fine_limit = limits(percent)
    signed = kept(signatures(docs, rows))
    sets = signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    class_of = kept(sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands", "b0", "b1", "b2")).alias("r")).select("set_key", "r.*"))
    bits = class_of.select("doc_id", "b0", "b1", "b2").distinct()

    keys = class_of.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = kept(keys.join(shared, "key"))
    label = kept(members.select("id").distinct().withColumn("component", F.col("id")))
    texts = kept(docs.join(label.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"))
    for number in range(ROUNDS):
        links = kept(confirmed(kept(_round(members, bits, label, number, far_limit)), texts, percent))
        label = _merged(label, links)
    bands = class_of.select(F.col("doc_id").alias("id"), "bands")
    links = kept(confirmed(kept(_rest(members, bits, bands, label, texts, far_limit, fine_limit)), texts, percent))
    label = _merged(label, links)

    copies = sets.select(F.col("doc_id").alias("id"), "set_key").join(class_of.select("set_key", F.col("doc_id").alias("rep")), "set_key")
    found = copies.select("id", "rep").join(label.toDF("rep", "component"), "rep", "left").select(
        "id", F.coalesce("component", "rep").alias("component"))
    many = found.groupBy("id").agg(F.min("component").alias("component_id"))
    return signed.select("doc_id", "n_shingles").join(many, signed.doc_id == many.id, "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links."""
    by_component = links.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").select(
        F.col("ca").alias("a"), F.col("cb").alias("b"))
    moved = components(by_component).toDF("component", "target")
    return kept(label.join(moved, "component", "left").select("id", F.coalesce("target", "component").alias("component")))
