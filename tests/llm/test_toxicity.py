import itertools
import random

import numpy as np

from hopledger.llm.toxicity import (
    WORD, fit_field, in_chains, marginal_odds, pair_marginals, score_held_out, score_texts, toxic_features,
)
from tests.llm.conftest import ODD_ROWS


def posts(seed, n):
    draw = random.Random(seed)
    for k in range(n):
        words = ["".join(draw.choices("abdegilmnorstu", k=draw.randrange(2, 7))) for _ in range(draw.randrange(5, 120))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                bad = draw.choice(["idiot", "SCUM###", "vequ" + draw.choice("aeiou") + draw.choice(["r", "nt", "sse"])])
                words.insert(draw.randrange(len(words)), bad)
        yield " ".join(words), int(toxic)


def test_marginals_match_enumeration():
    draw = np.random.default_rng(1)
    e, t = draw.normal(size=(3, 6)), draw.normal(size=(2, 2))
    odds = marginal_odds(e, t)
    pairs = np.zeros((2, 2))
    for row in range(3):
        weight = {}
        for tags in itertools.product((0, 1), repeat=6):
            weight[tags] = np.exp(sum(e[row, k] for k in range(6) if tags[k]) + sum(t[a, b] for a, b in itertools.pairwise(tags)))
        total = sum(weight.values())
        for k in range(6):
            assert np.isclose(odds[row, k] / (1 + odds[row, k]), sum(w for y, w in weight.items() if y[k]) / total)
        for i, j in itertools.product((0, 1), repeat=2):
            pairs[i, j] += sum(w * sum(p == (i, j) for p in itertools.pairwise(y)) for y, w in weight.items()) / total
    assert np.allclose(pair_marginals(e, t, odds), pairs)


def test_chains_do_not_touch_other_documents():
    draw = np.random.default_rng(2)
    e, t = draw.normal(size=700), np.array([[0, -0.5], [-0.3, 1.0]])
    whole = in_chains(e, [300, 0, 400], t)
    assert np.allclose(whole[:300], in_chains(e[:300], [300], t)) and np.allclose(whole[300:], in_chains(e[300:], [400], t))


def test_features_prefer_what_explains_most():
    toxic = [{"=bad", f"=rare{k}"} for k in range(30)] + [{"^vequ", "^vequa", f"=x{k}"} for k in range(20)]
    clean = [{"=good", f"=y{k}"} for k in range(300)]
    names = sorted(set().union(*toxic, *clean))
    numbered = lambda docs: [np.array([names.index(f) for f in d]) for d in docs]
    found = toxic_features(numbered(toxic), numbered(clean), names.__getitem__, len(names))
    assert {names[f] for f in found} == {"=bad", "^vequa"}


def test_held_out_documents(spark, documents):
    made = list(posts(5, 900))
    docs = documents([(k, text) for k, (text, _) in enumerate(made)])
    labels = spark.createDataFrame([(k, 1, y) for k, (_, y) in enumerate(made)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in score_held_out(docs, labels).collect()}
    held = [k for k in found if found[k].held_out]
    assert len(held) > 100
    assert np.mean([found[k].predicted == made[k][1] for k in held]) >= 0.97
    for k in held:
        words = {made[k][0][s.start:s.end] for s in found[k].spans}
        if made[k][1] and found[k].predicted:
            assert any(w in ("idiot", "SCUM") or w.startswith("vequ") for w in words)


def test_odd_rows(spark, odd, empty):
    texts, labels = zip(*posts(6, 400), strict=True)
    model = fit_field(list(texts), list(labels))
    found = score_texts(odd, model).collect()
    assert len(found) == len(ODD_ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert {r.predicted for r in found if r.doc_id in (1, 2, 3, 7)} == {0}
    assert score_texts(empty, model).count() == 0
    assert {r.predicted for r in score_texts(odd, fit_field([], [])).collect()} == {0}
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in score_held_out(odd, no_labels).collect()} == {0}


def test_offsets_are_code_points(spark, documents):
    texts, labels = zip(*posts(6, 400), strict=True)
    model = fit_field(list(texts), list(labels))
    text = "\U0001f600 İ ok idiot fine"
    row = score_texts(documents([(1, text)]), model).first()
    assert [text[s.start:s.end] for s in row.spans] == ["idiot"]
    assert WORD.findall("a1b_c") == ["a", "b", "c"]
