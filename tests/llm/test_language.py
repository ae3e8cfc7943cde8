import random

import numpy as np

from hopledger.llm.language import UNDETERMINED, Languages, features, fit, identify, identify_held_out
from tests.llm.conftest import ODD_ROWS

SYLLABLES = {
    "en": "the ing tion er and wh sh ou", "de": "der ung sch ein ch keit pf ü", "fr": "eau oi é è ou ai tion ç",
    "es": "ción ñ os que ar í ado ll", "xx": "zza qui kko uu yy",
}


def corpus(seed, n=60):
    draw = random.Random(seed)
    for lang, parts in SYLLABLES.items():
        for _ in range(n):
            words = ["".join(draw.choices(parts.split(), k=draw.randrange(1, 4))) for _ in range(draw.randrange(3, 60))]
            yield lang, " ".join(words).capitalize() + "."


def test_held_out_accuracy(documents):
    rows = [(k, text, lang if k % 10 else None) for k, (lang, text) in enumerate(corpus(1))]
    truth = {k: lang for k, (lang, _) in enumerate(corpus(1))}
    found = identify_held_out(documents(rows)).collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 40
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_prediction_does_not_depend_on_the_batch():
    langs, texts = zip(*corpus(2, 30), strict=True)
    model = Languages.fit(features(list(texts)), list(langs))
    assert dict(model.families)["romance"] == ["es", "fr"] and dict(model.families)["xx"] == ["xx"]
    whole, sure = model.predict(list(texts))
    alone = [model.predict([t]) for t in texts[::17]]
    assert [a[0][0] for a in alone] == whole[::17]
    assert np.allclose([a[1][0] for a in alone], sure[::17])


def test_odd_rows(documents, odd, empty):
    model = fit(documents([(k, text, lang) for k, (lang, text) in enumerate(corpus(3, 20))]))
    found = identify(odd, model).collect()
    assert len(found) == len(ODD_ROWS)
    by_id = {r.doc_id: r for r in found}
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1, 2, 3, 7)] == [(UNDETERMINED, 0.0)] * 4
    assert by_id[4].lang_pred in SYLLABLES and by_id[8].lang_pred in SYLLABLES
    assert identify(empty, model).count() == 0
    assert {r.lang_pred for r in identify(odd, fit(empty)).collect()} == {UNDETERMINED}
