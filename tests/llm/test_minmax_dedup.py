import random

import pytest

from hopledger.llm import minmax_dedup
from hopledger.llm.components import components
from hopledger.llm.minmax_dedup import near_duplicates, shingle_hashes, signature, words_of, WordHashes
from tests.llm.conftest import ODD_ROWS


def brute(rows):
    sets = {}
    for i, text in rows:
        w = words_of(text or "")
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def drifting(draw, start, steps, first_id):
    """Copies of copies: neighbours are alike, distant ones are not."""
    words, out = list(start), []
    for k in range(steps):
        words = list(words)
        for _ in range(draw.choice((1, 1, 2, 5))):
            words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        out.append((first_id + k, " ".join(words)))
        if draw.random() < 0.3:
            words = draw.choice(out)[1].split(" ")
    return out


def test_groups_match_brute_force(spark, documents):
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(4000)}"
    rows = [(1000 + k, " ".join(word() for _ in range(draw.randrange(1, 90)))) for k in range(120)]
    rows += drifting(draw, [word() for _ in range(150)], 160, 2000)
    rows += [(3000 + k, rows[draw.randrange(len(rows))][1].upper()) for k in range(60)]
    draw.shuffle(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows)).collect()}
    assert found == brute(rows)


def test_links_that_rounds_miss_are_found_by_the_rest(documents, monkeypatch):
    draw = random.Random(3)
    rows = drifting(draw, [f"w{k}" for k in range(120)], 80, 1)
    monkeypatch.setattr(minmax_dedup, "ROUNDS", 0)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows)).collect()}
    assert found == brute(rows)


def jaccard(a, b):
    a, b = ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (words_of(a), words_of(b)))
    return len(a & b) / len(a | b)


def chain(draw, steps, first_id):
    """Texts of which only neighbours are alike, with similarities from 0.80 to 0.85."""
    words, out = [f"c{first_id}x{k}" for k in range(105)], []
    for step in range(steps):
        out.append((first_id + step, " ".join(words)))
        words = list(words)
        for at in (10 + 6 * step % 40, 60 + 6 * step % 40):
            words[at] = f"new{first_id}x{step}x{at}"
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("rounds", [0, 2])
def test_chains_between_80_and_85_percent(documents, monkeypatch, rounds):
    draw = random.Random(8)
    rows = [row for k in range(40) for row in chain(draw, 6, 1000 * k)]
    text = dict(rows)
    near = [jaccard(text[i], text[i + 1]) for i in text if i + 1 in text]
    assert 0.8 <= min(near) and max(near) < 0.85 and len(near) == 200
    monkeypatch.setattr(minmax_dedup, "ROUNDS", rounds)
    found = {r.doc_id: r.component_id for r in near_duplicates(documents(rows), 80).collect()}
    assert found == {i: i // 1000 * 1000 for i in text}
    assert all(r.kept for r in near_duplicates(documents(rows)).collect())


def test_limits_follow_the_similarity():
    for percent in (50, 70, 80, 85, 90, 95):
        rows, far, fine = minmax_dedup.limits(percent)
        assert rows == 1 or (1 - (percent / 100) ** rows) ** (192 // rows) <= 3e-7
        assert 192 * (1 - percent / 100) / 2 < far < 96 and 1024 * 0.75 * (1 - percent / 100) < fine < 768
    assert minmax_dedup.limits(85)[0] == 6 and abs(minmax_dedup.limits(80)[2] - 215) <= 3


def test_odd_rows(odd, empty):
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].n_shingles, by_id[1].component_id, by_id[1].kept) == (0, 1, True)
    assert by_id[2].component_id == 2 and by_id[3].component_id == 3
    assert (by_id[5].component_id, by_id[5].kept) == (4, False)
    assert by_id[None].kept and by_id[None].component_id is None
    assert by_id[8].n_shingles == len({tuple(words_of("many words again and again " * 4)[k:k + 5]) for k in range(5)})
    assert near_duplicates(empty).count() == 0


def test_signature_estimates_similarity():
    a = [f"a{k}" for k in range(2000)]
    b = a[:1700] + [f"b{k}" for k in range(300)]
    x, y = (shingle_hashes(w, WordHashes()) for w in (a, b))
    true = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
    assert abs((signature(x) == signature(y)).mean() - true) < 0.12


@pytest.mark.parametrize("edges", [[], [(5, 5)], [(k, k + 1) for k in range(1, 40)], [(1, k) for k in range(2, 60)] + [(90, 80), (80, 70)]])
def test_components(spark, edges):
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    least = {}
    for _ in range(len(real) + 1):
        for a, b in real:
            m = min(least.get(a, a), least.get(b, b))
            least[a] = least[b] = m
    assert found == least
