import random
import re

import numpy as np

from hopledger.llm import disclosure
from hopledger.llm.disclosure import base_spans, cleaned, disclosing_terms, find, luhn, neighbours, sanitise
from tests.llm.conftest import ODD_ROWS

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), list(PATTERNS).index(kind), m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    draw = random.Random(8)
    parts = ["a.b@c.de", "@", "x@y", "a@b..c", "q@w.e.r@t.y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "007.1.2.0255", "4111 1111 1111 1111",
             "4111-1111-1111-1111", "4111111111111112", "+1 (523) 555-1055", "+12", "++49 30 1234567", "é", " ", "\n", "-", ".", "12", "word", "%", "_"]
    for _ in range(4000):
        text = "".join(draw.choices(parts, k=draw.randrange(1, 9)))
        assert base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    assert base_spans("x" * 400_000 + "@") == [] and base_spans("1" * 300_000) == [] and base_spans("+" * 200_000) == []


def test_neighbours_look_to_both_sides():
    text = "one two three four five a@b.cd six seven eight nine ten"
    assert {t for _, t in neighbours(text, base_spans(text))} == {"two", "three", "four", "five", "six", "seven", "eight", "nine"}
    far = "word " + " " * 5000 + "a@b.cd"
    assert neighbours(far, base_spans(far)) == {("email:a@b.cd", "word")}


def rows():
    draw = random.Random(2)
    word = lambda: "w" + "".join(draw.choices("abcdefgh", k=3))
    made = [(k, " ".join(word() for _ in range(60))) for k in range(300)]
    for k in range(8):
        a, b = word(), word()
        made.append((400 + k, f"{word()} {a} codename Bluebird {b} writes from agent@secret.org to {word()} {word()}"))
    made += [(500 + k, f"the Bluebird {word()} alone") for k in range(2)]
    return made


def test_terms_match_brute_force(documents):
    made = rows()
    near, whole, alone = {}, {}, {}
    for _, text in made:
        spans = base_spans(text)
        for e in {disclosure.entity(text, *s) for s in spans}:
            alone[e] = alone.get(e, 0) + 1
        for pair in neighbours(text, spans):
            near.setdefault(pair, []).append(text)
        for t in set(disclosure.TERM.findall(text.lower())):
            whole[t] = whole.get(t, 0) + 1
    share = {}
    for (e, t), texts in near.items():
        if len(set(texts)) >= disclosure.SUPPORT:
            s = 1 + np.log(len(texts) / whole[t]) / -np.log(alone[e] / len(made))
            share[t] = max(s, share.get(t, -9))
    expected = {t: round(s, 9) for t, s in share.items() if s >= disclosure.GENERALISE}
    assert {r.term: round(r.share, 9) for r in disclosing_terms(documents(made)).collect()} == expected
    assert "bluebird" in expected and "codename" not in expected


def test_spans_and_sanitised_text(documents):
    found = {r.doc_id: r for r in find(documents(rows())).collect()}
    text = dict(rows())
    assert len(found) == len(text)
    got = [s.split(":") for s in found[400].spans.split(",")]
    assert {k for k, _, _ in got} == {"email", "term"} and [int(a) for _, a, _ in got] == sorted(int(a) for _, a, _ in got)
    assert {text[400][int(a):int(b)].lower() for k, a, b in got if k == "term"} >= {"bluebird"}
    assert found[500].spans.startswith("term:4:12") and found[500].n_email == 0
    clean = {r.doc_id: r.text for r in sanitise(documents(rows())).collect()}
    assert "Bluebird" not in clean[400] and "<EMAIL>" in clean[400] and "Bluebird" not in clean[500]
    untouched = [k for k in range(300) if not found[k].spans]
    assert untouched and all(clean[k] == text[k] for k in untouched)
    assert cleaned("call +1 (523) 555-1055 now", {}) == "call <PHONE> now"


def test_filter_misses_no_member(spark, documents):
    terms = spark.createDataFrame([(f"term{k}",) for k in range(200)], "term string")
    for size in (64, 1 << 16):
        filter_ = disclosure.TermFilter.of(terms, size)
        assert len(filter_.passed({f"term{k}" for k in range(200)})) == 200
    assert len(filter_.passed({f"other{k}" for k in range(200)})) < 20


def test_odd_rows(odd, empty):
    found = find(odd).collect()
    assert len(found) == len(ODD_ROWS) and {r.spans for r in found} == {""}
    assert find(empty).count() == 0 and sanitise(empty).count() == 0
    assert sanitise(odd).columns == odd.columns and sanitise(odd).count() == len(ODD_ROWS)
