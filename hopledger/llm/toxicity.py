"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words (runs of letters) are tagged toxic or not. A chain is a run of up to ``CHAIN`` words of one document. Word potentials are sums of
weights of the word and of its beginnings; one two-by-two table holds the transitions. Labels exist for documents only, so word labels for
fitting are derived first: words and beginnings that occur in toxic documents and not in clean ones, taken greedily by the number of toxic
documents that nothing else explains yet. Forward-backward marginals give the toxic words with their offsets, and the
largest and the summed marginal give the score of the document through a logistic function fitted on the same sample.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from hopledger.llm.common import held_out, map_slices, texts_of

CHAIN = 128
SLOTS = 1 << 18
BEGINNINGS = (4, 5, 6, 7)
# Rows of the labelled sample that the field is fitted on, at most and for each label.
SAMPLE_ROWS = {1: 2000, 0: 3000}
WORD = re.compile(r"[^\W\d_]+")
KNOWN_WORDS = 400_000


def word_features(word: str) -> list[str]:
    """The word itself (=) and its beginnings (^)."""
    return ["=" + word] + ["^" + word[:n] for n in BEGINNINGS if len(word) > n]


def slots_of(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % SLOTS for f in word_features(word)]


def marginal_odds(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Odds of the toxic tag at each place of chains with potentials ``e`` (chains x places, log) and transitions ``t``.

    Two tags leave one ratio per direction: forward and backward run over the places for all chains at once.
    """
    w = np.exp(np.clip(e, -40, 40))
    t = np.exp(t)
    ahead, back = np.empty_like(w), np.ones_like(w)
    ahead[:, 0] = w[:, 0]
    for k in range(1, w.shape[1]):
        a = ahead[:, k - 1]
        ahead[:, k] = np.minimum(w[:, k] * (t[0, 1] + a * t[1, 1]) / (t[0, 0] + a * t[1, 0]), 1e30)
    for k in range(w.shape[1] - 2, -1, -1):
        b = w[:, k + 1] * back[:, k + 1]
        back[:, k] = (t[1, 0] + t[1, 1] * b) / (t[0, 0] + t[0, 1] * b)
    return ahead * back


def pair_marginals(e: np.ndarray, t: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Expected number of each tag pair over all places (2 x 2)."""
    w, tt = np.exp(np.clip(e, -40, 40)), np.exp(t)
    p = odds / (1 + odds)
    # P(next toxic | this tag) from the backward ratios: back = odds / ahead.
    ahead = np.empty_like(w)
    ahead[:, 0] = w[:, 0]
    for k in range(1, w.shape[1]):
        a = ahead[:, k - 1]
        ahead[:, k] = np.minimum(w[:, k] * (tt[0, 1] + a * tt[1, 1]) / (tt[0, 0] + a * tt[1, 0]), 1e30)
    b = (odds / ahead * w)[:, 1:]
    up0, up1 = tt[0, 1] * b / (tt[0, 0] + tt[0, 1] * b), tt[1, 1] * b / (tt[1, 0] + tt[1, 1] * b)
    here = p[:, :-1]
    return np.array([[((1 - here) * (1 - up0)).sum(), ((1 - here) * up0).sum()], [(here * (1 - up1)).sum(), (here * up1).sum()]])


def toxic_features(
    toxic: list[np.ndarray], clean: list[np.ndarray], name: Callable[[int], str], size: int, support: int = 4,
) -> set[int]:
    """Features (numbers below ``size``, each once a document) that explain toxic documents greedily.

    No clean document in a hundred holds them, and chance would not give them. Among features of equal reach the longer wins, and a word
    before a beginning.
    """
    count_of = lambda docs: np.bincount(np.concatenate(docs), minlength=size) if docs else np.zeros(size, int)
    count, known = count_of(toxic), count_of(clean)
    base = max(1e-3, min(0.9, len(toxic) / max(1, len(toxic) + len(clean))))
    needed = max(support, int(np.ceil(np.log(max(2, (count > 0).sum())) / -np.log(base))))
    able = (count >= needed) & (known <= 0.01 * count)
    left = [f[able[f]] for f in toxic]
    chosen: dict[int, str] = {}
    while True:
        reach = count_of(left)
        top = int(reach.max(initial=0))
        if top < needed:
            return set(chosen)
        # Everything of half the reach at once; a feature within another of the same reach adds nothing and stays out.
        names = {int(f): name(int(f)) for f in np.flatnonzero(2 * reach >= top)}
        for f, text in sorted(names.items(), key=lambda x: (-reach[x[0]], x[1][0] == "^", -len(x[1]), x[1])):
            inside = any(g[0] == "^" and text[1:].startswith(g[1:]) for g in chosen.values())
            shorter = text[0] == "^" and any(
                g[1:].startswith(text[1:]) and 10 * reach[f] < 11 * reach[k] for k, g in chosen.items())
            if not inside and not shorter:
                chosen[f] = text
        gone = np.zeros(size, bool)
        gone[list(chosen)] = True
        left = [f for f in left if not gone[f].any()]


@dataclass
class ToxicField:
    """Fitted weights; ``score`` holds the logistic coefficients of the document score."""

    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    score: np.ndarray
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def potential(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            value = self.known[word] = self.bias + float(self.weights[slots_of(word)].sum())
        return value

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginal of the toxic tag for each word of each text."""
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        potential = self.potential
        e = np.fromiter((potential(w) for words in texts for w in words), float)
        p = in_chains(e, [len(w) for w in texts], self.transitions)
        return np.split(p, np.cumsum([len(w) for w in texts])[:-1])

    def document(self, p: np.ndarray) -> float:
        x = summary(p) @ self.score
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def summary(p: np.ndarray) -> np.ndarray:
    """What a document's score depends on: its surest word and the number of words that are likely toxic."""
    if not p.size:
        return np.array([1.0, -6.0, 0.0])
    most = float(np.clip(p.max(), 1e-6, 1 - 1e-6))
    return np.array([1.0, np.clip(np.log(most / (1 - most)), -6, 6), np.log1p(p[p >= 0.2].sum())])


def chain_index(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(chains x CHAIN) places into the words of all texts, and which of them are real."""
    starts = np.cumsum([0, *lengths])
    begin = np.concatenate([np.arange(a, b, CHAIN) for a, b in zip(starts, starts[1:], strict=False)] or [np.empty(0, int)]).astype(int)
    end = np.concatenate([np.minimum(np.arange(a, b, CHAIN) + CHAIN, b) for a, b in zip(starts, starts[1:], strict=False)] or [np.empty(0, int)])
    width = int((end - begin).max(initial=0))
    at = begin[:, None] + np.arange(width)
    return at, at < end[:, None]


def in_chains(e: np.ndarray, lengths: list[int], transitions: np.ndarray) -> np.ndarray:
    """Marginals per word; padded places follow the last word of a chain and are given a neutral tail."""
    if not e.size:
        return e
    at, real = chain_index(lengths)
    padded = np.where(real, e[np.minimum(at, e.size - 1)], -40.0)  # a tag that is surely not toxic closes each chain
    odds = marginal_odds(padded, transitions)
    out = np.empty(e.size)
    out[at[real]] = (odds / (1 + odds))[real]
    return out


def fit_field(texts: list[str], toxic: list[int], steps: int = 80, rate: float = 0.15, decay: float = 1e-4) -> ToxicField:
    """A field fitted on labelled texts (a bounded sample); without both labels everything scores as clean."""
    plain = ToxicField(np.zeros(SLOTS, np.float32), -12.0, np.zeros((2, 2)), np.array([-4.0, 0.5, 0.0]))
    label = np.array(toxic, int)
    if not (label == 1).any() or not (label == 0).any():
        return plain
    # Words as numbers: the sample's words are kept once each.
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(t.lower())], np.int32) for t in texts]
    words = list(vocabulary)
    if not words:
        return plain
    kinds = 1 + len(BEGINNINGS)
    hashes = np.empty((len(words), kinds), np.uint64)
    for k, w in enumerate(words):
        found = [xxh3_64_intdigest(f) for f in word_features(w)]
        hashes[k] = found + found[:1] * (kinds - len(found))
    _, first, index = np.unique(hashes.ravel(), return_index=True, return_inverse=True)
    index = index.reshape(hashes.shape).astype(np.int32)
    del hashes
    name = lambda f: word_features(words[first[f] // kinds])[first[f] % kinds]
    sets = [np.unique(index[np.unique(d)]) for d in docs]
    marks = toxic_features([s for s, y in zip(sets, label, strict=True) if y], [s for s, y in zip(sets, label, strict=True) if not y], name, first.size)
    del sets
    if not marks:
        return plain
    marked = np.zeros(first.size, bool)
    marked[list(marks)] = True
    hit = marked[index].any(axis=1)
    stems = {name(f)[1:5] for f in marks}
    stem = np.array([w[:4] in stems for w in words])
    # Chains with a toxic word, chains with a word that begins like one, and as many of the rest, evenly spread.
    chains = [(d[k:k + CHAIN], y) for d, y in zip(docs, label.tolist(), strict=True) for k in range(0, len(d), CHAIN)]
    hard = [c for c in chains if stem[c[0]].any() or c[1] and hit[c[0]].any()]
    rest = [c for c in chains if not c[1] or not hit[c[0]].any()]
    chosen = hard + rest[:: max(1, len(rest) // max(1000, min(6000, 2 * len(hard))))]
    used_words, ids = np.unique(np.concatenate([c for c, _ in chosen]), return_inverse=True)
    y = np.concatenate([hit[c] & bool(t) for c, t in chosen]).astype(float)
    each = [slots_of(words[w]) for w in used_words]
    slot = np.array([s for ss in each for s in ss])
    owner = np.repeat(np.arange(len(each)), [len(ss) for ss in each])
    lengths = [len(c) for c, _ in chosen]
    at, real = chain_index(lengths)
    follow = real[:, 1:] & real[:, :-1]
    tags = np.where(real, y[np.minimum(at, y.size - 1)], 0).astype(int)
    seen = np.array([[(follow & (tags[:, :-1] == i) & (tags[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    used, back = np.unique(slot, return_inverse=True)
    w, bias, trans = np.zeros(used.size), -3.0, np.zeros((2, 2))
    moment, spread = np.zeros(used.size + 5), np.zeros(used.size + 5)
    total = max(1.0, y.sum())
    for step in range(1, steps + 1):
        e = np.bincount(owner, w[back], len(each))[ids] + bias
        padded = np.where(real, e[np.minimum(at, e.size - 1)], -40.0)
        odds = marginal_odds(padded, trans)
        p = np.empty(e.size)
        p[at[real]] = (odds / (1 + odds))[real]
        short = y - p
        by_word = np.bincount(ids, short, len(each))
        grad_w = np.bincount(back, by_word[owner], used.size) - decay * total * w
        grad_t = (seen - pair_marginals(padded, trans, odds)) - decay * total * trans
        grad_t[0, 0] = 0.0  # one pair is the reference
        if not real.all():
            grad_t *= follow.mean()
        grad = np.concatenate([grad_w, [short.sum()], np.clip(grad_t, -total, total).ravel()]) / total
        moment, spread = 0.9 * moment + 0.1 * grad, 0.99 * spread + 0.01 * grad * grad
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-5)
        w, bias, trans = w + move[:used.size], bias + move[used.size], np.clip(trans + move[used.size + 1:].reshape(2, 2), -3, 3)
    weights = np.zeros(SLOTS, np.float32)
    weights[used] = w
    model = ToxicField(weights, float(bias), trans, np.zeros(3))
    potential = np.array([model.bias + float(weights[slots_of(w)].sum()) for w in words])
    lengths = [len(d) for d in docs]
    p = in_chains(potential[np.concatenate(docs)], lengths, trans)
    x = np.array([summary(part) for part in np.split(p, np.cumsum(lengths)[:-1])])
    model.score = logistic(x, label)
    return model


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Coefficients of a logistic function by Newton steps."""
    c = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        slope = x.T @ (y - p) / len(y) - penalty * c
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(len(c))
        c = c + np.linalg.solve(bend, slope)
    return c


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: dict[int, int]) -> tuple[list[str], list[int]]:
    """Distinct (text, toxic) of labelled documents, for each label at most about ``rows`` of them, drawn by a hash of the id."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect() if r.toxic in rows}
    share = F.lit(-1.0)
    for toxic, count in n.items():
        share = F.when(F.col("toxic") == toxic, min(1.0, rows[toxic] / count)).otherwise(share)
    ids = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    drawn = docs.join(F.broadcast(ids), "doc_id").select("text", "toxic")  # at most about sum(rows) ids
    found = drawn.filter("text IS NOT NULL").toArrow()
    pairs = sorted(set(zip(found.column("text").to_pylist(), found.column("toxic").to_pylist(), strict=True)))
    return [t for t, _ in pairs], [y for _, y in pairs]


def score_texts(docs: DataFrame, model: ToxicField) -> DataFrame:
    """(doc_id, score, predicted, n_toxic_words, spans) per row; spans are [start, end) offsets of toxic words in code points.

    A word is toxic where its marginal is at least one half. Texts that are null, empty or without letters are scored as texts
    without a toxic word. Extra columns do not matter.
    """
    schema = "doc_id long, score double, predicted int, n_toxic_words long, spans array<struct<start:int,end:int>>"
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def make():
        field_ = shipped.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            scores, spans = [], []
            lowered = [t.lower() for t in texts]
            for text, low, p in zip(texts, lowered, field_.marginals([WORD.findall(t) for t in lowered]), strict=True):
                scores.append(field_.document(p))
                toxic = set(np.flatnonzero(p >= 0.5).tolist())
                places: list[dict[str, int]] = []
                if toxic:
                    where = WORD.finditer(low if len(low) == len(text) else text)
                    places = [{"start": m.start(), "end": m.end()} for k, m in enumerate(where) if k in toxic]
                spans.append(places)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                 pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, span)],
                ["doc_id", "score", "predicted", "n_toxic_words", "spans"])

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), "text", schema, make)


def score_held_out(docs: DataFrame, labels: DataFrame, sample_rows: dict[int, int] = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, ...): the field is learned without the fold in which crc32 of the id mod 5 is 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts, toxic = labelled_sample(docs, labels.filter(~held_out(F.col("doc_id"), 5, 0)), sample_rows)
    found = score_texts(docs, fit_field(texts, toxic))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "n_toxic_words", "spans")
