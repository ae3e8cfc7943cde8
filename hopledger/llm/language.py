"""Language identification in two steps: the family first, then one-versus-one linear machines inside it.

A text is the relative counts of its letter n-grams (one to three characters, words set apart by one space) hashed to ``DIMENSIONS``
slots. Every family has one machine against the rest; every pair of languages of a family has one machine of its own, and votes decide.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopledger.llm.common import held_out, map_slices, texts_of

DIMENSIONS = 4096
# Rows of the sample that the machines are fitted on: at most this many in all, shared equally by the languages.
SAMPLE_ROWS = 3000
# A text takes 8 bytes a slot while its n-grams are counted.
TEXTS_AT_ONCE = 256
UNDETERMINED = "und"
# Branches of common language codes; any other code is a family by itself.
FAMILIES = {
    "germanic": "en de nl da sv no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "indic": "hi ur bn pa mr gu ne si",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz ky tk",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letters(texts: list[str]) -> np.ndarray:
    return np.array([any(map(str.isalpha, t)) for t in texts], bool)


def features(texts: list[str]) -> np.ndarray:
    """A row per text: square roots of the relative n-gram counts, of length 1 (zero without letters)."""
    flat = np.frombuffer(("\n".join(texts) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    letter = _letters()[flat]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the one blank after a word
    first = np.cumsum(lengths) - lengths
    keep[first] = letter[first]
    codes, owner = np.where(letter, flat, np.uint32(32))[keep].astype(np.uint64), owner[keep]
    out = np.zeros(len(texts) * DIMENSIONS)
    grams = np.zeros(codes.size, np.uint64)
    for n in (1, 2, 3):
        size = codes.size - n + 1
        if size <= 0:
            break
        grams = grams[:size] * np.uint64(0x10001) + codes[n - 1:] + np.uint64(n << 40)
        slot = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
        same = owner[:size] == owner[n - 1:]
        out += np.bincount((owner[:size] * DIMENSIONS + slot)[same], minlength=out.size)
    out = np.sqrt(out.reshape(len(texts), DIMENSIONS))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def machine(blocks: list[np.ndarray], sign: np.ndarray, steps: int = 120, loss: float = 30.0) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine: squared hinge, balanced classes, accelerated gradient.

    ``blocks`` are views of the rows to fit on, one below the other; they are not copied.
    """
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    ends = np.cumsum([len(x) for x in blocks])
    spans = list(zip((ends - [len(x) for x in blocks]).tolist(), ends.tolist(), strict=True))
    w = before = np.zeros(blocks[0].shape[1] + 1, np.float32)
    rate = 1.0 / (1.0 + 4.0 * loss)
    for k in range(steps):
        at = w + np.float32(k / (k + 3.0)) * (w - before)
        margin = np.concatenate([x @ at[:-1] for x in blocks]) + at[-1]
        pull = share * np.maximum(0.0, 1.0 - sign * margin).astype(np.float32) * sign
        slope = np.append(sum(x.T @ pull[a:b] for x, (a, b) in zip(blocks, spans, strict=True)), pull.sum())
        before, w = w, (at - rate * (at - 2.0 * loss * slope)).astype(np.float32)
    return w


@dataclass
class Languages:
    """Fitted machines; ``families`` lists the languages of each family."""

    families: list[tuple[str, list[str]]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, langs: list[str]) -> Languages:
        """Rows of ``x`` must be in the order of their language."""
        groups: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            groups.setdefault(_FAMILY_OF.get(lang, lang), []).append(lang)
        rows = {lang: slice(bisect_left(langs, lang), bisect_right(langs, lang)) for lang in set(langs)}
        of = np.array([_FAMILY_OF.get(lang, lang) for lang in langs])
        sign = lambda mask: np.where(mask, 1.0, -1.0).astype(np.float32)
        rest = [machine([x], sign(of == f)) for f in groups] if len(groups) > 1 else [np.zeros(x.shape[1] + 1, np.float32)] * len(groups)
        pairs = {}
        for members in groups.values():
            for a, b in combinations(members, 2):
                first, second = x[rows[a]], x[rows[b]]
                pairs[a, b] = machine([first, second], sign(np.arange(len(first) + len(second)) < len(first)))
        return Languages(list(groups.items()), np.array(rest), pairs)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and a confidence of 0 to 1 per text."""
        if not self.families or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        x = features(texts)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = x @ self.family_weights.T
        family = margins.argmax(axis=1)
        sure = 1 / (1 + np.exp(-3.0 * margins.max(axis=1).astype(float))) if len(self.families) > 1 else np.ones(len(x))
        found = np.empty(len(x), object)
        for k, (_, members) in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if not rows.size:
                continue
            votes, close = np.zeros((rows.size, len(members))), np.zeros((rows.size, len(members)))
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                margin = x[rows] @ self.pair_weights[a, b]
                votes[:, i] += margin >= 0
                votes[:, j] += margin < 0
                close[:, i] += np.tanh(margin)
                close[:, j] -= np.tanh(margin)
            best = (votes + close / (2 * len(members))).argmax(axis=1)
            found[rows] = np.array(members, object)[best]
            if len(members) > 1:
                sure[rows] *= 1 / (1 + np.exp(-3.0 * close[np.arange(rows.size), best] / (len(members) - 1)))
        letters = has_letters(texts)
        return [f if ok else UNDETERMINED for f, ok in zip(found, letters, strict=True)], np.where(letters, sure, 0.0)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Languages:
    """Machines fitted on a sample of (text, lang), both not null: at most ``sample_rows`` distinct texts, chosen by the text's hash."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows).collect()
    if not counts:
        return Languages([], np.empty((0, 0)), {})
    each = max(1, sample_rows // len(counts))
    share = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1.0, 4.0 * each / r["count"]))))
    drawn = (
        known.withColumn("h", F.xxhash64("text"))
        .filter(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
        .groupBy("lang", "h").agg(F.min("text").alias("text"))
    )
    order = W.partitionBy("lang").orderBy("h")
    chosen = drawn.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            rows = has_letters(texts)
            langs = batch.column("lang").filter(pa.array(rows))
            texts = [t for t, ok in zip(texts, rows.tolist(), strict=True) if ok]
            counts, slots, values = [0], [np.empty(0, int)], [np.empty(0, np.float32)]
            for k in range(0, len(texts), TEXTS_AT_ONCE):
                part = features(texts[k:k + TEXTS_AT_ONCE])
                row, slot = np.nonzero(part)
                counts += np.bincount(row, minlength=len(part)).tolist()
                slots.append(slot)
                values.append(part[row, slot])
            offsets = pa.array(np.cumsum(counts), pa.int32())
            return pa.RecordBatch.from_arrays([
                langs, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(slots), pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))], ["lang", "slots", "values"])

        return work

    # Only slots in use are sent to the driver, and one matrix is filled from them.
    found = map_slices(chosen.select("lang", "text"), "text", "lang string, slots array<int>, values array<float>", make).toArrow()
    if not found.num_rows:
        return Languages([], np.empty((0, 0)), {})
    rows = [(lang, slots.values.to_numpy(), values.values.to_numpy()) for batch in found.to_batches() for lang, slots, values in zip(
        batch.column("lang").to_pylist(), batch.column("slots"), batch.column("values"), strict=True)]
    rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    x, langs = np.zeros((len(rows), DIMENSIONS), np.float32), [r[0] for r in rows]
    for k, (_, slots, values) in enumerate(rows):
        x[k, slots] = values
    del found, rows, slots, values
    pa.default_memory_pool().release_unused()
    return Languages.fit(x, langs)


def identify(docs: DataFrame, languages: Languages, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred and score, a row per row of ``docs``.

    Null texts and texts without a letter get ``und`` and score 0, as does every text if nothing was learned. Only the text counts;
    extra columns do not matter.
    """
    source = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", lang_pred string, score double"
    shipped = source.sparkSession.sparkContext.broadcast(languages)  # at most a few weights a pair of languages

    def make():
        model = shipped.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            langs, scores = [], []
            for k in range(0, len(texts), TEXTS_AT_ONCE):
                found, sure = model.predict(texts[k:k + TEXTS_AT_ONCE])
                langs += found
                scores.append(sure)
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())],
                [*keep, "lang_pred", "score"])

        return work

    return map_slices(source, "text", schema, make)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): machines learned without the fold in which crc32 of the id mod 4 is 2."""
    docs = docs.select("doc_id", "text", "lang")
    languages = fit(docs.filter(~held_out(F.col("doc_id"), 4, 2)))
    found = identify(docs, languages)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
